import math
import tracemalloc
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from straitline.llm import suffix_tree as P
from straitline.llm.common import crc_mod


def test_hash_agrees_with_the_engine(spark):
    ws = [b"", b"a", b"abcd", "héllo wörld, twelve".encode(), b"x" * 100]
    got = [r.h for r in spark.createDataFrame([(bytearray(w),) for w in ws], "w binary").select(F.xxhash64("w").alias("h")).collect()]
    assert got == [int(np.uint64(xxhash.xxh64_intdigest(w, 42)).view(np.int64)) for w in ws]


def brute_base(texts, train):
    c = Counter()
    for t in train:
        c.update((t or "").encode().lower().split() + [b""])
    n, v = sum(c.values()), len(c)
    score = lambda ws: sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)
    return {t: (len(ws), sum(c[w] > 0 for w in ws), n, score(ws)) for t in texts for ws in [(t or "").encode().lower().split() + [b""]]}


def test_counts_base_and_distributions(make):
    texts = [(i, " ".join(["the quick brown fox", "jumps over", "the lazy dog", f"rare{i}"][j % 4] for j in range(i % 9))) for i in range(300)]
    docs = make(texts)
    rows = P.score_texts(docs, train_when=crc_mod(docs["doc_id"], 7) != 2).collect()
    held = {r.doc_id for r in docs.where(crc_mod(docs["doc_id"], 7) == 2).collect()}
    want = brute_base([t for _, t in texts], [t for i, t in texts if i not in held])
    by = dict(texts)
    for r in rows:
        n, known, total, base = want[by[r.doc_id]]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, known, total, r.doc_id in held)
        assert abs(r.base_score - base) < 1e-9
    unseen = [r for r in rows if r.held_out]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen) + 10
    model = P.learn(docs.select(F.col("text").cast("binary").alias("text")))[0]
    assert model.order > 1
    code = lambda w: xxhash.xxh64_intdigest(w.encode(), 42)
    for ctx in ("", "the", "quick brown", "jumps over the", "over the lazy"):
        ctx = [P.END_HASH, *map(code, ctx.split())]
        own = sum(10 ** model.score(np.array([*ctx, w], dtype=np.uint64))[-1] for w in model.hashes)
        rest = 10 ** model.score(np.array([*ctx, 1], dtype=np.uint64))[-1] * (1 - (10.0**model.root).sum())
        assert abs(own + rest - 1) < 1e-9


def test_edges(docs, no_docs):
    rows = P.score_texts(docs).collect()
    assert len(rows) == docs.count() and all(r.score <= 0 for r in rows)
    assert [r.n_tokens for r in rows if r.doc_id in (1, 2, 3)] == [1, 1, 1]
    assert P.score_texts(no_docs).collect() == []
    nothing = P.score_texts(docs, train_when=F.lit(False)).collect()
    assert {(r.base_score, r.score, r.n_known, r.train_tokens) for r in nothing} == {(0.0, 0.0, 0, 0)}


def brute_score(text, train):
    """The tree by plain recursion over counted runs of words."""
    c = Counter()
    for t in train:
        x = [b"", *t.encode().split(), b""]
        c.update(tuple(x[i : i + k]) for k in range(1, P.MAX_ORDER + 2) for i in range(len(x) - k + 1) if k > 1 or i)
    total, kinds = sum(n for g, n in c.items() if len(g) == 1), sum(len(g) == 1 for g in c)
    nodes, after = {()}, {}

    def prob(ctx, w):
        if not ctx:
            return (c[(w,)] + 1) / (total + kinds + 1)
        if ctx not in nodes:
            return prob(ctx[1:], w)
        rest = c[ctx] - sum(after[ctx].values())
        return (after[ctx].get(w, 0) + (P.ALPHA + rest) * prob(ctx[1:], w)) / (c[ctx] + P.ALPHA)

    counted = {g for g, n in c.items() if len(g) == 1 and n >= P.MIN_COUNT}
    for order in range(1, P.MAX_ORDER + 1):
        tried = {g for g, n in c.items() if len(g) == order + 1 and n >= P.MIN_COUNT and g[:-1] in counted and g[1:] in counted and (order == 1 or g[1:-1] in nodes)}
        for g in tried:
            after.setdefault(g[:-1], {})[g[-1]] = c[g]
        for ctx in {g[:-1] for g in tried}:
            nodes.add(ctx)
            rest = c[ctx] - sum(after[ctx].values())
            gain = sum(n * math.log(prob(ctx, w) / prob(ctx[1:], w)) for w, n in after[ctx].items()) + rest * math.log((P.ALPHA + rest) / (c[ctx] + P.ALPHA))
            if gain < P.DIVERGENCE * c[ctx] or gain < 0.5 * len(after[ctx]) * math.log(c[ctx]):
                nodes.remove(ctx)
        counted = tried
    x = [b"", *text.encode().split(), b""]
    depth = max(map(len, nodes))
    return sum(math.log10(prob(tuple(x[max(0, i - P.MAX_ORDER) : i]), x[i])) for i in range(1, len(x))), depth


def test_rare_contexts_and_next_words_keep_their_mass(make, monkeypatch):
    """Words, contexts and transitions below every share of the tokens count as the frequent ones do."""
    r = np.random.default_rng(8)
    texts = [(i, " ".join(f"w{x}" for x in r.zipf(1.4, 12) if x < 90)) for i in range(150)] + [(i, "one rare run of words that comes again") for i in range(150, 170)]
    docs = make(texts)
    train = [t for _, t in texts]
    monkeypatch.setattr(P, "MIN_COUNT", 2)
    assert brute_score("w1", train)[1] > 1
    for share in (P.P_TABLE, 0.02, 1.0):  # all broadcast, some, none
        monkeypatch.setattr(P, "P_TABLE", share)
        got = {x.doc_id: x.score for x in P.score_texts(docs).collect()}
        assert max(abs(got[i] - brute_score(t, train)[0]) for i, t in texts[::10] + texts[-1:]) < 1e-9, share


def test_shipped_setting_against_brute_force(make, monkeypatch):
    """Greatest order and least count as they are shipped; nothing broadcast and all broadcast."""
    r = np.random.default_rng(4)
    texts = [(i, " ".join(f"w{x}" for x in r.zipf(1.3, 14) if x < 40)) for i in range(250)] + [(i, ["p a b c y", "q a b c z", "e b c w", "f c v"][i % 4]) for i in range(250, 410)]
    docs = make(texts)
    train = [t for _, t in texts]
    assert brute_score("w1", train)[1] == P.MAX_ORDER
    for share in (P.P_TABLE, 1.0):
        monkeypatch.setattr(P, "P_TABLE", share)
        got = {x.doc_id: x.score for x in P.score_texts(docs).collect()}
        assert len(got) == len(texts) and max(abs(got[i] - brute_score(t, train)[0]) for i, t in texts[::25] + texts[-4:]) < 1e-9, share


def test_a_bit_set_comes_in_one_job(spark):
    """Jobs don't grow with the number of partitions; before, each partition was a job of its own."""
    keys = np.unique(np.random.default_rng(1).integers(-(1 << 63), 1 << 63, 5000))
    table = spark.createDataFrame([(int(k),) for k in keys], "key long").repartition(2)
    sc = spark.sparkContext
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    spark.conf.set("spark.sql.shuffle.partitions", 40)
    try:
        sc.setJobGroup("screen", "")
        screen = P.Screen(table)
        assert len(sc.statusTracker().getJobIdsForGroup("screen")) < 10
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert screen.has(keys.view(np.uint64)).all()


def test_word_codes_give_the_counts_in_any_number_of_buckets(make, spark):
    """The same counts in sixteen times the buckets, without contexts and suffixes in the shuffle, which were there before."""
    r = np.random.default_rng(5)
    docs = make([(i, " ".join(f"w{x}" for x in r.zipf(1.2, 600) if x < 5000)) for i in range(60)])
    chunks = P.written(docs.select(F.lit(0).alias("id"), F.lit(False).alias("held_out"), F.col("text").cast("binary").alias("text")))
    vocab = P.materialize(P.count(chunks, 0, 8), "t")
    frequent = P.Frequent(vocab)
    sc, sizes, rows = spark.sparkContext, [], []
    screens, often = sc.broadcast((P.Screen(vocab), P.Screen(vocab))), sc.broadcast((frequent.hashes, frequent.index))
    for buckets in (8, 128):
        found = P.count(chunks, 1, buckets, screens, often)
        rows.append({tuple(x) for x in found.collect()})
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "ctx" not in plan.split("Exchange")[-1]  # no hashes of contexts or suffixes are dealt
        sizes.append(len(rows[-1]))
    assert rows[0] == rows[1] and sizes[0] > 100
    c = Counter(g for d in docs.collect() for x in [["", *d.text.split(), ""]] for g in zip(x, x[1:]))
    assert sorted(n for *_, n in rows[0]) == sorted(n for n in c.values() if n >= P.MIN_COUNT)


def test_codes_and_counts_return():
    for top in (1, P.MORE, P.RARE + 1):
        codes = np.random.default_rng(top).integers(0, top, (3, 500)).astype(np.uint32)
        codes[0, 0] = top - 1
        for n in (np.ones(500, np.int64), np.arange(500) << 30):
            got = P.expand(P.squeeze(codes, n), 3)
            assert (got[0] == codes).all() and (got[1] == n).all()
    one, frequent = 2000, 4.2  # bytes a bigram of frequent words, in small messages; 17 before
    codes = np.sort(np.random.default_rng(1).integers(0, 60_000, (2, one)).astype(np.uint32))
    assert len(P.squeeze(codes, np.ones(one, np.int64))) < frequent * one


def test_index_finds_as_a_search_does():
    r = np.random.default_rng(2)
    for size in (0, 1, 2, 1000):
        keys = np.unique(r.integers(0, 1 << 63, size).astype(np.uint64) * np.uint64(2))
        r.shuffle(keys)
        wanted = np.concatenate([keys, r.integers(0, 1 << 63, 500).astype(np.uint64), np.array([0, 2**64 - 1], np.uint64)])
        at = {int(k): i for i, k in enumerate(keys)}
        assert P.Index(keys).find(wanted).tolist() == [at.get(int(w), -1) for w in wanted]


def test_words_that_are_asked_for(make, monkeypatch):
    """Few words and grams broadcast, so most counts, codes and values go by hash."""
    r = np.random.default_rng(6)
    texts = [(i, " ".join(f"w{x}" for x in r.zipf(1.4, 12) if x < 90)) for i in range(200)]
    docs, train = make(texts), [t for _, t in texts]
    monkeypatch.setattr(P, "P_TABLE", 1.0)
    want = brute_base(train, train)
    for often in (0, 12):
        monkeypatch.setattr(P, "OFTEN", often)
        for x in P.score_texts(docs).where("doc_id % 10 = 0").collect():
            t = texts[x.doc_id][1]
            assert (x.n_tokens, x.n_known) == want[t][:2] and abs(x.base_score - want[t][3]) < 1e-9
            assert abs(x.score - brute_score(t, train)[0]) < 1e-9, often


class Tasks:
    """Stands for a table of chunks and keeps the functions that tasks run on it."""

    def __init__(self):
        self.run = []

    def mapInArrow(self, run, schema):
        self.run.append(run)
        return self

    def __getattr__(self, name):
        return lambda *a: self


class All:
    def has(self, keys):
        return np.ones(len(keys), bool)


def tasks_of_count(order, buckets, frequent):
    tasks, value = Tasks(), lambda v: SimpleNamespace(value=v)
    P.count(tasks, order, buckets, value((All(), All())), value((frequent, P.Index(frequent))))
    return tasks.run


def chunk_of(words):
    words = np.concatenate([words, [P.END_HASH]])
    lists = [pa.array([v]) for v in ([len(words)], [False])]
    return pa.RecordBatch.from_arrays([pa.array([P.pack(words)], pa.binary()), *lists], names=["tokens", "length", "held_out"])


def test_memory_of_a_counting_task():
    """Bytes a token that a task holds beside its input; before, its counts and tokens were copied whole (100, 25 now)."""
    r = np.random.default_rng(7)
    words = np.unique(r.integers(1, 1 << 63, 30_000).astype(np.uint64))
    chunks, tokens = [chunk_of(r.choice(words, 60_000)) for _ in range(20)], 20 * 60_001
    count = tasks_of_count(1, 44, words)[0]
    tracemalloc.start()
    try:
        rows = sum(batch.num_rows for batch in count(iter(chunks)))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows == 64 and peak < 45 * tokens


@pytest.mark.parametrize("order", [0, 1, 3])
@pytest.mark.parametrize("buckets", [2, 8, 100])
def test_counts_of_a_task_that_merges_and_sends_often(monkeypatch, order, buckets):
    """Small limits, so counts are merged by range and sent again and again; a third of the words has no code."""
    r = np.random.default_rng(order)
    words = np.unique(r.integers(1, 1 << 63, 90).astype(np.uint64))
    parts = [words[np.minimum(r.zipf(1.5, 400), len(words)) - 1] for _ in range(30)]
    monkeypatch.setattr(P, "FLUSH", 700)
    count, summed = tasks_of_count(order, buckets, words[::3])
    sent = pa.Table.from_batches([b for b in count(iter(chunk_of(x) for x in parts)) if b.num_rows]).sort_by("bucket").combine_chunks()
    if order:  # else there are no more than 90 entries
        assert sent.num_rows > len(set(sent.column("bucket").to_pylist()))
    got = Counter()
    for batch in summed(iter(sent.to_batches())):
        got.update(dict(zip(batch.column("key").to_pylist(), batch.column("n").to_pylist())))
    want = Counter()
    for x in parts:
        x = np.concatenate([[P.END_HASH], x, [P.END_HASH]])
        key = x[1:] if not order else [(ok, key) for ok, key, _, _ in P.grams(x, order)][-1]
        want.update((key if not order else key[1][key[0]]).view(np.int64).tolist())
    assert got == {k: n for k, n in want.items() if n >= (P.MIN_COUNT if order else 1)}


def test_a_batch_of_messages_is_small(make, spark, monkeypatch):
    """As many messages as the engine puts in one batch; before, they reached its limit of 64 MB."""
    monkeypatch.setattr(P, "OFTEN", 0)
    docs = make([(0, " ".join(f"w{i}" for i in range(20_000)))])
    chunks = P.written(docs.select(F.lit(0).alias("id"), F.lit(False).alias("held_out"), F.col("text").cast("binary").alias("text")))
    model, *_, buckets = P.fit(chunks)
    asked = P.asked(chunks, spark.sparkContext.broadcast(model), buckets).where(F.col("kind") == P.ASK_WORDS)
    size = asked.select(F.max(F.length("keys") + F.length("at"))).first()[0]
    assert 10_000 * size < 1 << 25
