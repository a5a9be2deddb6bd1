"""Jobs of many tasks fill the driver: it holds each task's counts until its garbage is collected."""

import uuid

import numpy as np
import pytest

from straitline.llm import components as steps
from straitline.llm import mixing
from straitline.llm.components import components, contracted


def least_reached(edges):
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


@pytest.fixture
def counted(spark):
    """The result of a call, and the tasks that its jobs ran, with 32 partitions in each shuffle."""
    held = {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in held}

    def run(f):
        sc, group = spark.sparkContext, uuid.uuid4().hex
        sc.setJobGroup(group, "counted")
        try:
            out = f()
        finally:
            sc.setLocalProperty("spark.jobGroup.id", None)
        tracker = sc.statusTracker()
        stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
        return out, sum(i.numCompletedTasks for i in map(tracker.getStageInfo, stages) if i)

    for k, v in held.items():
        spark.conf.set(k, v)
    yield run
    for k, v in before.items():
        spark.conf.set(k, v)


def test_contracted_edges_reach_the_same():
    rng = np.random.default_rng(5)
    for n in (1, 3, 40, 400):
        a, b = rng.integers(-n, n, n), rng.integers(-n, n, n)
        want = least_reached(list(zip(a.tolist(), b.tolist())))
        got = dict(zip(*(x.tolist() for x in contracted(a, b))))
        assert got == {x: r for x, r in want.items() if x != r}
    assert [len(x) for x in contracted(np.empty(0, np.int64), np.empty(0, np.int64))] == [0, 0]


def test_components_run_few_tasks(spark, counted):
    rng = np.random.default_rng(3)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(int(x), int(y)) for x, y in rng.integers(5000, 5400, (250, 2))] + [(9000 - 2 * i, 9000 - 2 * i - 2) for i in range(50)] + [(7, 7), (3, 4), (4, 3)]
    edges = [edges[i] for i in rng.permutation(len(edges))]
    rows = spark.createDataFrame(edges, "a long, b long").repartition(6)
    got, tasks = counted(lambda: components(rows))
    want = least_reached([e for e in edges if e[0] != e[1]])
    assert sorted(map(tuple, got.collect())) == sorted(want.items())
    assert tasks <= 1700  # 1347; 2172 with distinct rows after the large star, a union in the small one and uncontracted edges


def test_heap_is_collected_between_rounds(spark, monkeypatch):
    """The driver's heap is collected after each round of components and of the mix's dual, not only at their end."""
    done = []
    for module in (steps, mixing):
        write, free = module.materialize, module.release
        monkeypatch.setattr(module, "materialize", lambda df, name, *a, f=write: done.append(name) or f(df, name, *a))
        monkeypatch.setattr(module, "release", lambda s, f=free: done.append("release") or f(s))
    rows = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long").repartition(4)
    steps.components(rows)
    rounds = done.count("edges") - 1
    assert rounds > 1 and done.count("release") == rounds
    done.clear()
    docs = spark.createDataFrame([(i, "word " * (i % 9 + 1), f"s{i % 3}") for i in range(60)], "doc_id long, text string, source string")
    assert mixing.mix(docs).count() == 60
    assert done.count("release") >= done.count("mix-dual") > 1
