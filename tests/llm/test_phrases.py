"""Phrase collocations against a direct reading of the contract; the perfect hash and the exact cuts by themselves."""

import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from straitline.llm import phrases as P
from straitline.llm.perfect_hash import PerfectHash, mix


def brute(rows, least, longest=5, top=2000, factor=1000, ratio=100):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            f.update((lang, *ws[i : i + k]) for k in range(1, longest + 1) for i in range(len(ws) - k + 1))
    found = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    covered = set()
    for p, above in found.items():
        ws = p[1:]
        for size in range(2, len(ws)):
            covered |= {(p[0], *ws[i : i + size]) for i in range(len(ws) - size + 1) if 100 * above >= ratio * f[(p[0], *ws[i : i + size])]}
    best = {}
    for p, a in found.items():
        lang, ws = p[0], p[1:]
        cuts = [(factor * a * n[lang] // (f[(lang, *ws[:k])] * f[(lang, *ws[k:])]), k) for k in range(1, len(ws))]
        score, k = min(cuts)
        if p not in covered:
            best.setdefault(lang, []).append((" ".join(ws), a, f[(lang, *ws[:k])], f[(lang, *ws[k:])], n[lang], score))
    out = []
    for lang, items in best.items():
        items.sort(key=lambda x: (-x[5], -x[1], x[0].encode()))
        out += [(lang, i + 1, *x) for i, x in enumerate(items[:top])]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def corpus(n, seed=1):
    rng = random.Random(seed)
    fixed = ["the Strait of Hormuz", "crude oil tanker", "at anchor off the port", "über Nacht", "東京 港", "a a a a a a", "of the Strait of Hormuz traffic"]
    words = ["the", "of", "oil", "ship", "port", "Zone", "z\x1cz", "ÀB", "é", "x-y"]
    out = []
    for i in range(n):
        parts = [rng.choice(fixed) if rng.random() < 0.4 else rng.choice(words) for _ in range(rng.randint(0, 30))]
        glue = ["", ".", ", ", "\n", " ", "\t", "  ", "\x0b", "\x0c", "; "]
        out.append((rng.choice(["en", "de", None, "und"]), "".join(p + rng.choice([" "] * 12 + glue) for p in parts)))
    return [*out, ("en", None), ("en", ""), (None, " \t "), ("fr", "seul")]


@pytest.fixture
def frame(spark):
    return lambda rows: spark.createDataFrame([(i, t, x, 1, 2, 3) for i, (x, t) in enumerate(rows)], "doc_id long, text string, lang string, slot int, a int, n int").repartition(3)


@pytest.mark.parametrize(("least", "part", "ratio", "longest"), [(12, 1 << 20, 100, 5), (10, 60, 60, 3)])
def test_equals_brute_force(spark, frame, monkeypatch, least, part, ratio, longest):
    monkeypatch.setattr(P, "BLOCK", 4)
    rows = corpus(400)
    got = rows_of(P.collocations(frame(rows), least=least, part=part, ratio=ratio, longest=longest))
    assert got == brute(rows, least, longest=longest, ratio=ratio) and len(got) > 10


def test_first_of_each_language_and_ties(spark, frame):
    rows = [("en", f"w{i} v{i}. ") for i in range(30) for _ in range(6)] + [(None, "b c"), ("und", "b c")] * 5
    got = rows_of(P.collocations(frame(rows), least=6, top=7))
    assert got == brute(rows, 6, top=7) and len(got) == 8


def test_empty_and_awkward_tables(spark, frame, docs, no_docs):
    columns = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    for df in (P.collocations(no_docs, least=1), P.collocations(docs, least=10**6), P.collocations(frame([("en", "one")]), least=1)):
        assert df.columns == columns and df.count() == 0
    few = [(r["lang"], r["text"]) for r in docs.where("doc_id <> 7 or doc_id is null").collect()]
    assert rows_of(P.collocations(docs.where("doc_id <> 7 or doc_id is null"), least=2)) == brute(few, 2)
    assert P.collocations(docs, least=2).where("phrase like 'word%runs%'").count() > 0


def test_contract_columns_and_reruns(spark, tmp_path, frame):
    rows = [("en", "tanker at anchor. " * 60), ("en", "oil tanker at sea, " * 55)] * 2
    frame(rows).write.parquet(f"{tmp_path}/documents.parquet")
    one, two = (P.op12(spark, str(tmp_path)) for _ in range(2))
    assert one.dtypes == [("lang", "string"), ("rank", "bigint"), ("phrase", "string"), ("a", "bigint"), ("l", "bigint"), ("r", "bigint"), ("n", "bigint"), ("score", "bigint")]
    assert rows_of(one) == rows_of(two) == brute(rows, 100)


def test_cuts_are_exact_past_64_bits(spark):
    big = [(10**11 + 7, 10**13 + 1, 3 * 10**11 + 1, 2 * 10**11 + 3), (10**12 - 1, 10**14 - 1, 10**12 + 1, 10**12 + 5), (2, 10**6, 2, 2)]
    for a, n, l, r in big:
        level = spark.createDataFrame([(0, a, "en", "x y", [l], [r])], "slot long, a long, lang string, phrase string, ls array<long>, rs array<long>")
        got = P.cut_scores(level, spark.createDataFrame([("en", n)], "lang string, n long"), 2).first()
        assert got["score"] == 1000 * a * n // (l * r)


def test_ties_of_cuts_go_to_the_shortest_first_part(spark):
    level = spark.createDataFrame([(0, 5, "en", "x y z", [10, 20], [20, 10])], "slot long, a long, lang string, phrase string, ls array<long>, rs array<long>")
    got = P.cut_scores(level, spark.createDataFrame([("en", 100)], "lang string, n long"), 3).first()
    assert (got["l"], got["r"], got["score"]) == (20, 20, 1250)
    level = spark.createDataFrame([(0, 5, "en", "x y z", [10, 25], [8, 20])], "slot long, a long, lang string, phrase string, ls array<long>, rs array<long>")
    got = P.cut_scores(level, spark.createDataFrame([("en", 100)], "lang string, n long"), 3).first()  # 5*100*1000/200 twice
    assert (got["l"], got["r"]) == (10, 20)


@settings(max_examples=40, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=300), st.lists(st.integers(0, 2**64 - 1), max_size=50))
def test_perfect_hash_is_minimal_and_verified(keys, others):
    table = PerfectHash(np.array(sorted(keys), np.uint64))
    slots = table.slots(np.array(sorted(keys), np.uint64))
    assert sorted(slots.tolist()) == list(range(len(keys)))
    got = table.slots(np.array(others, np.uint64)) if others else np.empty(0)
    assert all((s >= 0) == (o in keys) for s, o in zip(got, others))


def test_perfect_hash_of_many_keys():
    keys = mix(np.arange(300_000, dtype=np.uint64), 5)
    table = PerfectHash(keys)
    assert np.array_equal(np.sort(table.slots(keys)), np.arange(len(keys))) and (table.slots(mix(np.arange(300_000, 600_000, dtype=np.uint64), 5)) < 0).all()
    assert np.array_equal(table.keys[table.slots(keys)], keys) and len(table.bits) * 64 < 5 * len(keys)
    with pytest.raises(ValueError, match="distinct"):
        PerfectHash(np.array([1, 2, 2], np.uint64))


def test_screen_stops_counting_at_least(spark):
    slots = np.array([1, 2] * 5000 + [-1] + [3, 4, -1] * 9 + [5, 6, -1] * 10, np.int32)
    df = spark.createDataFrame([(slots.tobytes(),), (slots[:3].tobytes(),)], "slots binary")
    packed = P.candidates(df, 10).collect()
    keys = {(int(k) >> 32, int(k) & 0xFFFFFFFF) for r in packed for k in np.frombuffer(r["keys"], np.uint64)}
    assert keys == {(1, 2), (2, 1), (5, 6)} and sum(r["m"] for r in packed) == 3


def test_sums_of_a_segment_hold_few_times_its_keys():
    """Peak of a merge of sorted runs, against a dictionary's sums; the merge before this one took 8.1 times the keys' bytes here."""
    r = np.random.default_rng(5)
    runs = [np.unique(r.integers(0, 1 << 40, 1 << 17).astype(np.uint64)) for _ in range(8)]
    runs += [runs[0][::3], runs[0][::5]]
    counts = [r.integers(1, 101, len(k)).astype(np.uint16) for k in runs]
    want = Counter()
    for k, c in zip(runs, counts):
        for x, n in zip(k.tolist(), c.tolist()):
            want[x] += n
    size = sum(k.nbytes for k in runs)
    tracemalloc.start()
    keys, sums = P.added(runs, counts, 100)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert dict(zip(keys.tolist(), sums.tolist())) == {k: min(n, 100) for k, n in want.items()} and (np.diff(keys) > 0).all()
    assert peak < 6 * size
    held = [keys, keys[::2], keys[::4]]
    keys, n = P.distinct(held, 2, np.uint16)
    assert held == [] and Counter(n.tolist()) == Counter({1: len(keys) // 2, 2: -(-len(keys) // 2)}) and n.dtype == np.uint16
