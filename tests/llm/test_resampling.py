"""Importance resampling against a direct reading of its contract in plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from straitline.llm import resampling as R

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, grams=1):
    ws = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return ws, [" ".join(ws[i : i + g]) for g in range(1, grams + 1) for i in range(len(ws) - g + 1)]


def brute(docs, target, grams=1, buckets=10_000, percent=10, least=20):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in docs for f in features(t, grams)[1])
    q = Counter(bucket(f) for t in target for f in features(t, grams)[1])
    s_all, q_all = sum(s.values()), sum(q.values())
    gain = lambda b: math.floor(1000 * math.log((q[b] + 1.0) * (s_all + buckets) / ((s[b] + 1.0) * (q_all + buckets))))
    out = []
    for key, text in docs:
        ws, fs = features(text, grams)
        weight = sum(gain(bucket(f)) for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"2024:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append((key, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(ws)))
    fit = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    rank = {id(r): i + 1 for i, r in enumerate(fit[: percent * len(fit) // 100])}
    return [(*r[:4], rank.get(id(r))) for r in out]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


VOCABULARY = ["oil", "Tanker", "x9", "Straße", "東京", "berth", "naïve", "zone", "it's", "a.b"]


def corpus(n):
    return [(i, " ".join(VOCABULARY[(i * 7 + j * j * (1 + i % 5)) % len(VOCABULARY)] + ("" if j % 3 else f"{(i + j) % 40}") for j in range(i % 60))) for i in range(n)]


@pytest.mark.parametrize(("grams", "buckets", "percent"), [(1, 10_000, 10), (1, 7, 50), (3, 101, 100)])
def test_equals_brute_force(spark, make, grams, buckets, percent):
    docs, target = corpus(300), ["oil tanker berth", "Zone zone ZONE oil", None, ""]
    got = R.resample(make(docs), make(list(enumerate(target))), grams=grams, buckets=buckets, percent=percent)
    assert rows(got) == sorted(brute(docs, target, grams, buckets, percent), key=str)


def test_ties_go_to_the_smaller_key_and_ranks_have_no_gaps(spark, make):
    docs = [(i, "same words " * 15) for i in range(400)]
    got = R.resample(make(docs), make([(0, "other")]), percent=37)
    drawn = sorted((r for r in got.collect() if r["rank"]), key=lambda r: r["rank"])
    assert [r["rank"] for r in drawn] == list(range(1, 149))
    assert [(r["score"], r["doc_id"]) for r in drawn] == sorted(((r["score"], r["doc_id"]) for r in drawn), key=lambda x: (-x[0], x[1]))
    assert rows(got) == sorted(brute(docs, ["other"], percent=37), key=str)


def test_cutoff_inside_a_score():
    assert R.rank_offsets([(5, 2), (9, 1), (7, 4), (1, 3)], 3) == [(9, 0), (7, 1)]
    assert R.rank_offsets([(5, 2)], 0) == [] and R.rank_offsets([], 4) == []


def test_awkward_and_empty_tables(spark, docs, no_docs):
    got = R.resample(docs, docs)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and got.count() == docs.count()
    by_id = {r["doc_id"]: r for r in got.collect()}
    assert by_id[1]["n_features"] == by_id[2]["n_features"] == by_id[1]["weight"] == 0 and by_id[7]["n_features"] == 40_000
    assert R.resample(no_docs, docs).count() == 0
    assert R.resample(docs, no_docs).count() == docs.count()


def test_contract_columns_and_reruns(spark, tmp_path, make):
    make(corpus(250)).write.parquet(f"{tmp_path}/documents.parquet")
    make([(0, "oil berth zone")]).write.parquet(f"{tmp_path}/benchmark.parquet")
    one, two = (R.op13(spark, str(tmp_path)) for _ in range(2))
    assert one.dtypes == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
    assert rows(one) == rows(two) == sorted(brute(corpus(250), ["oil berth zone"]), key=str)
