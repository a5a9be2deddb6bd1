"""Importance resampling towards a target: array-scored weights, an exact histogram of integer scores, ranks from offsets.

A feature is a run of words; its bucket is the crc32 of its bytes. Two passes read the texts. The first counts buckets in an
array a task (sums are ``buckets`` numbers, whatever the corpus). The second looks each feature's gain up in one array and
takes the floored mean. Scores are integers, so their histogram is exact and has at most ``score_span`` rows: its suffix
sums are the rank offsets, the cutoff is where they reach the draw, and only documents at or above it are sorted, each
score by itself. Nothing is sorted globally and no document reaches the driver.

Defined results: null and empty texts have no features and weight 0; a null key counts as the empty text in the draw's hash
and sorts first among equal scores; repeated rows are documents of their own; an empty corpus gives an empty table, an
empty target an array of gains for T = 0; columns of the input other than key and text aren't read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Remembered, bounded, broadcasting, materialize, slices, to_batch

BUCKETS, GRAMS, SEED, PERCENT, LEAST_WORDS = 10_000, 1, 2024, 10, 20

#: A-Z become a-z, other bytes that are no word bytes become spaces.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def tokens(raw: bytes) -> list[bytes]:
    """Runs of ASCII letters and digits and of non-ASCII characters, ASCII letters in lower case."""
    return raw.translate(_FOLD).split()


def feature_buckets(ws: list[bytes], memory: Remembered, grams: int, buckets: int) -> np.ndarray:
    """The bucket of each run of 1 to ``grams`` words; ``memory`` maps a word to its crc32."""
    one = np.fromiter(map(memory.__getitem__, ws), np.int64, len(ws))
    runs = [one % buckets]
    crcs = one.tolist() if grams > 1 else []
    for g in range(1, grams):  # a run's crc continues the crc of the run without its last word
        crcs = [zlib.crc32(w, zlib.crc32(b" ", c)) for c, w in zip(crcs, ws[g:])]
        runs.append(np.array(crcs, np.int64) % buckets)
    return np.concatenate(runs)


def _arrays(batch: pa.RecordBatch, memory: Remembered, grams: int, buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, words a text, features a text, buckets of all features in order) for stretches of a batch."""
    texts = batch.column("text").cast(pa.binary()).to_pylist()
    for a, b in slices(texts):
        found = [tokens(t) if t else [] for t in texts[a:b]]
        n = np.array([len(w) for w in found], np.int64)
        if grams == 1:
            flat = [w for ws in found for w in ws]
            yield a, n, n, feature_buckets(flat, memory, 1, buckets)
        else:
            parts = [feature_buckets(ws, memory, grams, buckets) for ws in found]
            yield a, n, np.array([len(p) for p in parts], np.int64), np.concatenate(parts) if parts else np.empty(0, np.int64)


def bucket_counts(texts: DataFrame, grams: int = GRAMS, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket: an array a task, summed by Spark."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, n = Remembered(zlib.crc32), np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, _, found in _arrays(batch, memory, grams, buckets):
                n += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["bucket", "n"])

    rows = texts.select("text").mapInArrow(bounded(count), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # at most ``buckets`` rows
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the add-one ratio of target to source share), a bucket."""
    b, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + b) / ((s + 1.0) * (t_all + b)))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, key: str = "doc_id", grams: int = GRAMS) -> DataFrame:
    """key, n_words, n_features, weight of each document: the floored mean gain of its features."""
    kind, spark = docs.schema[key].dataType.simpleString(), docs.sparkSession
    shared = spark.sparkContext.broadcast(gain)  # ``buckets`` numbers
    schema = pa.schema([("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, by_bucket = Remembered(zlib.crc32), shared.value
        for batch in batches:
            for a, n, f, found in _arrays(batch, memory, grams, len(by_bucket)):
                ends = np.cumsum(f)
                summed = np.concatenate([[0], np.cumsum(by_bucket[found])])
                total = summed[ends] - summed[ends - f]
                out = to_batch(schema, n_words=n, n_features=f, weight=np.where(f > 0, total // np.maximum(f, 1), 0))
                yield pa.RecordBatch.from_arrays([batch.column(key).slice(a, len(n)), *out.columns], names=[key, *schema.names])

    return docs.select(key, "text").mapInArrow(bounded(weigh), f"`{key}` {kind}, n_words long, n_features long, weight long")


def draw_score(key: str, seed: int = SEED):
    """weight plus the floored Gumbel draw of the key: 32 bits of its hash as a number between 0 and 1."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return (F.col("weight") + F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0))))).cast("long")


def rank_offsets(counts: list[tuple[int, int]], take: int) -> list[tuple[int, int]]:
    """(score, documents above it) of each score that can hold a drawn document, from (score, documents) of all scores."""
    out, above = [], 0
    for score, n in sorted(counts, reverse=True):
        if above >= take:
            break
        out.append((score, above))
        above += n
    return out


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", grams: int = GRAMS, buckets: int = BUCKETS, seed: int = SEED, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """key, n_features, weight, score, rank of every document; ``rank`` counts the drawn ones from 1 and is null elsewhere."""
    gain = gains(bucket_counts(docs, grams, buckets), bucket_counts(target, grams, buckets))
    scored = materialize(weights(docs, gain, key, grams).withColumn("score", draw_score(key, seed)), "resample-scores")
    fit = F.col("n_words") >= least_words
    counts = [(r["score"], r["count"]) for r in scored.where(fit).groupBy("score").count().collect()]  # one row an integer score
    take = percent * sum(n for _, n in counts) // 100
    offsets = rank_offsets(counts, take)
    columns = [key, "n_features", "weight", "score"]
    if not offsets:
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    table = F.broadcast(docs.sparkSession.createDataFrame(offsets, "score long, _above long"))
    drawn = fit & (F.col("score") >= offsets[-1][0])
    rank = F.row_number().over(Window.partitionBy("score").orderBy(F.col(key), F.col("n_features"), F.col("weight"))) + F.col("_above")
    kept = scored.where(drawn).join(table, "score").select(*columns, rank.cast("long").alias("rank"))
    kept = kept.withColumn("rank", F.when(F.col("rank") <= take, F.col("rank")))
    return kept.unionByName(scored.where(~drawn).select(*columns, F.lit(None).cast("long").alias("rank")))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return resample(docs, target)


#: crc32 is spelled out: a table of its 256 steps, folded over the bytes of each distinct word.
ORACLE = r"""
WITH steps AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS r(i))),
words AS (
  SELECT 'd' AS side, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents
  UNION ALL
  SELECT 't', 0, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark),
bytes AS (SELECT w, [4294967295::BIGINT] || list_transform(range(1, octet_length(encode(w)) + 1), lambda i: ('0x' || hex(encode(w))[2 * i - 1 : 2 * i])::BIGINT) AS b FROM (SELECT DISTINCT w FROM words)),
crcs AS (SELECT w, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c & 255, x) + 1)::INT])), 4294967295) % 10000 AS bucket FROM bytes, steps),
counts AS (SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 't') AS t FROM words JOIN crcs USING (w) GROUP BY bucket),
sums AS (SELECT coalesce(sum(s), 0)::DOUBLE AS s_all, coalesce(sum(t), 0)::DOUBLE AS t_all FROM counts),
gain AS (SELECT bucket, floor(1000 * ln((t + 1.0::DOUBLE) * (s_all + 10000) / ((s + 1.0::DOUBLE) * (t_all + 10000))))::BIGINT AS g FROM counts, sums),
per_doc AS (SELECT doc_id, count(*) AS n, floor(sum(g)::DOUBLE / count(*))::BIGINT AS weight FROM words JOIN crcs USING (w) JOIN gain USING (bucket) WHERE side = 'd' GROUP BY doc_id),
scored AS (
  SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296))))::BIGINT AS score
  FROM documents d LEFT JOIN per_doc p ON d.doc_id = p.doc_id),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT s.doc_id, n_features, weight, score, CASE WHEN r <= 10 * n // 100 THEN r END::BIGINT AS rank FROM scored s LEFT JOIN ranked r ON s.doc_id = r.doc_id
"""
