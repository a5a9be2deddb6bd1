import random

import numpy as np
import pytest

from straitline.llm import jaccard as J


def shingles(t):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(texts):
    sets = [(i, shingles(t)) for i, t in texts]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: (len(s), find(i)) for i, s in sets}


def corpus(seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    passage = [r.choice(vocab) for _ in range(30)]
    texts, base = [], []
    for g in range(12):
        base.append([r.choice(vocab) for _ in range(r.choice((3, 8, 40, 120)))] + (passage if g % 3 == 0 else []))
    for i in range(150):
        w = list(r.choice(base))
        for _ in range(r.choice((0, 0, 1, 2, 4))):
            w[r.randrange(len(w))] = r.choice(vocab)
        texts.append((i + 1, " ".join(w)))
    return [*texts, (500, None), (501, ""), (502, "A b C"), (503, "a B c")]


@pytest.mark.parametrize("limits", [(4096, 2048), (8, 6)])
def test_classes_against_brute_force(make, monkeypatch, limits):
    monkeypatch.setattr(J, "BLOCK_LIMIT", limits[0])
    monkeypatch.setattr(J, "CLUSTER_LIMIT", limits[1])
    texts = corpus(limits[0])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.near_classes(make(texts)).collect()}
    assert got == brute(texts)


def test_tree_loses_no_pair():
    r = np.random.default_rng(0)
    base = r.poisson(4, (40, J.DIMS))
    vecs = np.maximum(np.repeat(base, 20, axis=0) + r.integers(-1, 2, (800, J.DIMS)) * (r.random((800, J.DIMS)) < 0.1), 0)
    sizes = vecs.sum(1)
    tree = J.RTree(vecs, sizes)
    for x in range(0, 800, 7):
        overlap = np.minimum(vecs, vecs[x]).sum(1)
        want = np.flatnonzero((overlap >= J.need(sizes, int(sizes[x]))) & (100 * np.minimum(sizes, sizes[x]) >= 80 * np.maximum(sizes, sizes[x])))
        assert sorted(tree.search(x).tolist()) == want.tolist()


def test_edges(docs, no_docs):
    rows = J.near_classes(docs).collect()
    assert len(rows) == docs.count()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in rows}
    assert got[1] == (0, 1) and got[2] == (0, 2) and got[4][1] == got[5][1] == got[6][1] == 4 and got[9] == (1, 9)
    assert J.near_classes(no_docs).collect() == []
    kept = J.deduplicate(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 2, 3, 4, 7, 8, 9, 10]


def test_blocks_of_the_same_classes_are_searched_once(spark):
    members = {1: [10, 11], 2: [10, 11], 3: [10, 11, 12], 4: [10, 12], 5: [13], -7: [11, 10]}
    keys = spark.createDataFrame([(c, k << 24) for k, cs in members.items() for c in cs] + [(14, (9 << 24) + 1), (15, (9 << 24) + 2)], "class long, key long")
    found = {}
    for r in J.blocks_of(keys).collect():
        found.setdefault((r.key, r._met), set()).add(r["class"])
    assert sorted(map(sorted, found.values())) == [[10, 11], [10, 11, 12], [10, 12]]
    assert all(met == len(cs) for (_, met), cs in found.items())


def test_texts_of_kept_documents_stay_where_they_are(spark, make, tmp_path):
    """Bytes that the last step shuffles: texts of a few documents only, not of all."""
    r = random.Random(3)
    texts = [(i, " ".join(f"{r.getrandbits(60):x}" for _ in range(300))) for i in range(400)]
    texts += [(1000 + i, texts[i][1]) for i in range(5)]
    make(texts).repartition(4).write.parquet(f"{tmp_path}/in")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        kept = J.deduplicate(spark.read.parquet(f"{tmp_path}/in"))
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        before = shuffled(spark)
        assert sorted(x.doc_id for x in kept.collect()) == list(range(400))
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        assert shuffled(spark) - before < 0.1 * sum(len(t) for _, t in texts)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def shuffled(spark):
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))
