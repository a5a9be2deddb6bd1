import random
from collections import defaultdict

import pytest

from straitline.llm.mixing import mix


def targets(sizes, cycle=(1.0, 2.0, 3.0), cap=3.0):
    """Shares by weight; what is above a cap is shared again until none is."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: cycle[i % 3] for i, s in enumerate(order)}
    t, open_, left = {}, set(order), float(sum(sizes.values()))
    while open_:
        total = sum(w[s] for s in open_)
        share = {s: left * w[s] / total for s in open_}
        over = {s for s in open_ if share[s] >= cap * sizes[s]}
        if not over:
            return t | share
        for s in over:
            t[s] = cap * sizes[s]
            left -= t[s]
        open_ -= over
    return t


@pytest.mark.parametrize("measure", ["words", "documents"])
def test_targets_and_taken(make, measure):
    r = random.Random(1)
    texts = [(i, " ".join("w" for _ in range(r.randrange(0, 60)))) for i in range(600)]
    sources = {i: r.choice(["a", "a", "a", "a", "b", "c", "Z", None]) for i in range(600)}
    rows = mix(make(texts, sources=sources), measure=measure).collect()
    size = defaultdict(int)
    for i, t in texts:
        size[sources[i]] += len(t.split())
    want, taken = targets(size), defaultdict(int)
    for x in rows:
        s = sources[x.doc_id]
        assert x.size == len(dict(texts)[x.doc_id].split()) and x.source_size == size[s]
        assert abs(x.target - want[s]) < 1e-6 * max(1, want[s])
        assert x.taken == x.size * x.copies <= 3 * x.size
        taken[s] += x.taken
    for s in size:
        assert abs(taken[s] - want[s]) <= 30, (s, taken[s], want[s])
    if measure == "documents":  # the tilt grows with the length
        rates = sorted((x.size, x.rate) for x in rows if sources[x.doc_id] == "a" and x.size)
        assert len({round(r, 9) for _, r in rates}) > 10 and [r for _, r in rates] in (sorted(r for _, r in rates), sorted((r for _, r in rates), reverse=True))
    again = {(x.doc_id, x.taken) for x in mix(make(texts, sources=sources), measure=measure).collect()}
    assert again == {(x.doc_id, x.taken) for x in rows}


def test_edges(docs, no_docs):
    rows = mix(docs).collect()
    assert len(rows) == docs.count() and all(0 <= r.taken <= 3 * r.size for r in rows)
    assert [r.size for r in rows if r.doc_id == 1] == [0] and [r.size for r in rows if r.doc_id == 3] == [0]
    assert mix(no_docs).collect() == []


def test_no_words(make):
    assert [r.taken for r in mix(make([(1, ""), (2, None)])).collect()] == [0, 0]


def test_a_long_document_at_the_boundary_leaves_room_for_others(make):
    """A source of one long and many short documents, and one of long ones alone: the residual is filled with what fits."""
    texts = [(0, "w " * 5000), *[(i, "w " * (20 + i % 7)) for i in range(1, 120)], *[(i, "w " * (100 + 37 * (i % 9))) for i in range(200, 212)], *[(i, "w " * 50) for i in range(300, 400)]]
    sources = {i: "a" if i < 200 else "b" if i < 300 else "c" for i, _ in texts}
    rows = mix(make(texts, sources=sources)).collect()
    assert rows[0].__fields__[:5] == ["doc_id", "size", "source_size", "target", "taken"]
    taken, target = defaultdict(int), {}
    for r in rows:
        taken[sources[r.doc_id]] += r.taken
        target[sources[r.doc_id]] = r.target
    assert abs(taken["a"] - target["a"]) <= 30 and abs(taken["c"] - target["c"]) <= 50
    assert abs(taken["b"] - target["b"]) <= 60


def test_no_python_on_the_main_path(make):
    plan = mix(make([(1, "a b c"), (2, "d")]))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
