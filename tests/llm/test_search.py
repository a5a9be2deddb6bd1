import math
import random

import numpy as np
import pytest

from straitline.llm import decontaminate as D
from straitline.llm import topk as T


def test_top_k_against_brute_force(spark):
    r = random.Random(5)
    rows = [(i, [r.gauss(0, 0.3) for _ in range(12)]) for i in range(400)] + [(400, None), (401, [0.1, None]), (402, [float("nan")]), (403, [float("inf"), 0.0]), (404, []), (405, [1.0]), (7, [0.5] * 12), (406, [0.25] * 12), (407, [0.25] * 12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("vec_id", "embedding")
    q = df.select("vec_id", T.quantise(df["embedding"]).alias("v")).where("v is not null")
    got = {(x.query_id, x["rank"]): (x.vec_id, x.score) for x in T.top_k(q.where("vec_id % 20 = 0"), q, 20).collect()}
    f32 = lambda v: float(np.float32(v))
    ints = [(i, [math.floor(64 * f32(x)) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = {}
    for i, v in ints:
        if i % 20 == 0:
            s = sorted(((-sum(a * b for a, b in zip(v, w)), j) for j, w in ints if j != i))[:20]
            want |= {(i, k + 1): (j, -x) for k, (x, j) in enumerate(s)}
    assert got == want


def test_stops_on_proof_only():
    r = np.random.default_rng(1)
    x = r.integers(-60, 60, (3000, 16))
    x[100:140] = x[5]  # ties
    q = x[:20]
    qi, ci, s = T.search_block(np.arange(20), q, T.Block.load(T.Block(np.arange(3000), x).dump()), 10)
    for i in range(20):
        full = sorted((-int(v), j) for j, v in enumerate(q[i] @ x.T) if j != i)[:10]
        assert [(-int(a), int(b)) for a, b in zip(s[qi == i], ci[qi == i])] == full


def test_wide_vectors():
    r = np.random.default_rng(2)
    x = r.integers(-60, 60, (90, 40_000))
    q = x[:5]
    qi, ci, s = T.search_block(np.arange(5), q, T.Block.load(T.Block(np.arange(90), x).dump()), 10)
    for i in range(5):
        full = sorted((-int(v), j) for j, v in enumerate(q[i] @ x.T) if j != i)[:10]
        assert [(-int(a), int(b)) for a, b in zip(s[qi == i], ci[qi == i])] == full


def test_segments_hold_every_entry_once_by_impact():
    r = np.random.default_rng(4)
    x = r.integers(-70, 70, (200, 9))
    b = T.Block.load(T.Block(np.arange(200), x).dump())
    parts = b.matrices(9, np.float64)
    assert (sum(m for m, _ in parts) == x).all()
    tops = [int(np.abs(m).max()).bit_length() for m, _ in parts]
    assert tops == sorted(tops, reverse=True) and not parts[-1][1].any()


def test_blocks_and_shelves_of_any_size_agree(spark, monkeypatch):
    r = np.random.default_rng(6)
    rows = [(i, [int(v) for v in r.integers(-64, 64, 8)]) for i in range(700)] + [(0, [1] * 8)] * 3
    df = spark.createDataFrame(rows, "vec_id long, v array<bigint>").repartition(5)
    q = df.where("vec_id % 20 = 0")
    want = {tuple(x) for x in T.top_k(q, df, 7).collect()}
    monkeypatch.setattr(T, "BLOCK", 50)
    monkeypatch.setattr(T, "SHELF", 100)
    monkeypatch.setattr(T, "STRIP", 9)
    monkeypatch.setattr(T, "QUERY_BLOCK", 4)
    monkeypatch.setattr(T, "RESCORE", 1)
    assert {tuple(x) for x in T.top_k(q, df, 7).collect()} == want


def test_large_components_stay_exact():
    x = np.array([[2**30, 1], [2**30, 2], [2**30, 0]])
    _, ci, s = T.search_block(np.array([9]), np.array([[2**30, 1]]), T.Block(np.arange(3), x), 3)
    assert ci.tolist() == [1, 0, 2] and s.tolist() == [2**60 + 2, 2**60 + 1, 2**60]


def test_empty_index(spark):
    df = spark.createDataFrame([], "vec_id long, v array<bigint>")
    assert T.top_k(df, df).collect() == []


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_banded_distance_is_exact():
    r = np.random.default_rng(2)
    a = r.integers(0, 3, (300, 10))
    b = np.where(r.random((300, 10)) < 0.7, a, r.integers(0, 3, (300, 10)))
    b = np.concatenate([b, r.integers(0, 3, (300, 3))], axis=1)
    got = D.edit_distances(a, b, 3)
    assert got.tolist() == [min(4, *(edit(x, y[:j]) for j in range(14))) for x, y in zip(a.tolist(), b.tolist())]


def test_recall_on_edited_passages():
    r = random.Random(3)
    vocab = [f"w{i}" for i in range(2000)]
    items = [(i, [r.choice(vocab) for _ in range(r.randrange(15, 60))]) for i in range(60)]
    built, total, found = D.Items(items), 0, 0
    docs, want = [], []
    for i, w in items * 4:
        e, x = D.allowed(len(w)), list(w)
        for _ in range(r.randrange(0, e + 1)):
            p = r.randrange(len(x))
            r.choice([lambda: x.__setitem__(p, r.choice(vocab)), lambda: x.insert(p, r.choice(vocab)), lambda: x.pop(p)])()
        docs.append([r.choice(vocab) for _ in range(15)] + x + [r.choice(vocab) for _ in range(15)])
        want.append(i)
    doc, item, m, start, dist = D.match(built, docs)
    got = {(a, b) for a, b in zip(doc.tolist(), item.tolist())}
    words = dict(items)
    for k, i in enumerate(want):
        n = len(words[i])
        if any(edit(words[i], docs[k][s : s + n]) <= D.allowed(n) for s in range(len(docs[k]) - n + 1)):
            total, found = total + 1, found + ((k, i) in got)
    assert found >= D.RECALL * total
    for a, i, n, s, d in zip(doc.tolist(), item.tolist(), m.tolist(), start.tolist(), dist.tolist()):
        assert min(edit(words[i], docs[a][s : s + j]) for j in range(n - d, n + d + 1)) == d <= D.allowed(n)


def test_decontaminate_edges(spark, docs, no_docs, monkeypatch):
    bench = spark.createDataFrame([(1, "The CAT sat -- on the mat, and looked at the moon!"), (2, None), (3, "too short"), (4, "nothing like this item is in any of these texts at all today")], "item_id long, text string")
    bench = bench.where("item_id <> 3")
    out = D.decontaminate(docs, bench)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect() if r.doc_id is not None) == [1, 2, 3, 7, 8, 9, 10]
    monkeypatch.setattr(D, "ITEM_GROUP", 5)  # a pass an item
    found = {(r.doc_id, m.item_id, m.distance) for r in D.find_matches(docs, bench).collect() for m in r.matches}
    assert found == {(4, 1, 0), (5, 1, 0), (6, 1, 0)}
    assert D.decontaminate(no_docs, bench).collect() == []
    assert D.decontaminate(docs, bench.limit(0)).count() == docs.count()


def without_block(x, kind, e, rng):
    """``x`` without e words in a row: the first, the last, or some between."""
    at = {"lost head": 0, "lost tail": len(x) - e}.get(kind, int(rng.integers(0, len(x) - e + 1)))
    return x[:at] + x[at + e :]


def recall_at_the_limit(m, kind, items=20, copies=6, before=9):
    """Share found of passages of m words after exactly the allowed number of edits of a kind."""
    r, rng = random.Random(m), np.random.default_rng(m)
    vocab = [f"w{i}" for i in range(5000)]
    rows = [(i, [r.choice(vocab) for _ in range(m)]) for i in range(items)]
    docs = []
    for _, w in rows * copies:
        x = without_block(w, kind, D.allowed(m), rng) if kind.startswith("lost") else D.edited(w, kind, D.allowed(m), rng, lambda: f"new{r.randrange(5000)}")
        docs.append([r.choice(vocab) for _ in range(before)] + x + [r.choice(vocab) for _ in range(9)])
    doc, item, *_, dist = D.match(D.Items(rows), docs)
    assert (dist <= D.allowed(m)).all()
    return len({(d, i) for d, i in zip(doc.tolist(), item.tolist()) if d % items == i}) / len(docs)


@pytest.mark.parametrize("m", [8, 10, 15, 25, 40, 60, 100, 200])
def test_recall_holds_at_exactly_the_allowed_edits_wherever_they_lie(m):
    found = {kind: recall_at_the_limit(m, kind) for kind in D.KINDS}
    assert min(found.values()) >= D.RECALL, found


@pytest.mark.parametrize("before", [0, 9, 250])
@pytest.mark.parametrize("m", [8, 10, 25, 60, 200])
def test_recall_of_passages_that_lost_a_block_wherever_they_stand(m, before):
    found = {kind: recall_at_the_limit(m, kind, before=before) for kind in ("lost head", "lost tail", "lost block")}
    assert min(found.values()) >= D.RECALL, found


def test_a_lost_beginning_is_reported_at_the_start_of_the_text():
    item = [f"w{i}" for i in range(100)]
    doc, _, m, start, dist = D.match(D.Items([(7, item)]), [item[20:], ["x", "y", *item[18:]], item[21:]])
    best = {}
    for k, s, d in zip(doc.tolist(), start.tolist(), dist.tolist()):
        best[k] = min(best.get(k, (d, s)), (d, s))
    assert best == {0: (20, 0), 1: (18, 0)}
    assert (start >= 0).all() and m.tolist() == [100] * len(m)


def test_short_items_match_exactly():
    items = [(m, [f"a{m}_{i}" for i in range(m)]) for m in range(1, 8)]
    docs = [["x", *w, "y"] for _, w in items] + [w for _, w in items] + [[*w[:-1], "other"] for _, w in items]
    doc, item, _, start, dist = D.match(D.Items(items), docs)
    assert sorted(zip(doc.tolist(), item.tolist(), start.tolist())) == sorted([(k, k + 1, 1) for k in range(7)] + [(k + 7, k + 1, 0) for k in range(7)])
    assert not dist.any()


def test_passes_hold_one_broadcast_at_a_time(spark, docs, monkeypatch):
    live, most, real = set(), [0], type(spark.sparkContext).broadcast

    def broadcast(sc, value):
        b = real(sc, value)
        if isinstance(value, D.Items):
            live.add(id(b))
            most[0] = max(most[0], len(live))
            free = b.destroy
            b.destroy = lambda *a: (live.discard(id(b)), free(*a))
        return b

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", broadcast)
    monkeypatch.setattr(D, "ITEM_GROUP", 4)
    bench = spark.createDataFrame([(i, f"item{i} cat sat on the mat") for i in range(6)] + [(9, "the cat sat")], "item_id long, text string")
    found = {(r.doc_id, m.item_id) for r in D.find_matches(docs, bench).collect() for m in r.matches}
    assert found == {(4, 9), (5, 9), (6, 9)} and most[0] == 1


def test_sizes_of_plans():
    assert [D.size_class(m) for m in (8, 31, 33, 100, 200, 401)] == [(8, 8), (31, 31), (32, 33), (100, 103), (200, 207), (400, 415)]
