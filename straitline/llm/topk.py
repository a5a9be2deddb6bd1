"""Exact top-k inner products by an impact-ordered, score-at-a-time index.

Vectors are integers. The index deals them into blocks, where they lie; within a block the entries (dimension, vector,
value) are grouped once by quantised impact, ``bit_length(|value|)``, into posting segments in descending order, and with
each segment stands what the later ones can still add to a vector: the norm of its unseen part. A query reads segment by
segment; the products of the segment's entries are added to the accumulators of the vectors that may still be members.
After each segment the unseen entries of a vector change its score by at most ``||q|| * ||unseen part||`` (Cauchy-Schwarz),
so the k-th best lower bound so far is a proof: vectors whose upper bound is below it are out and read no later segment. A
query stops by itself when few enough possible members remain, and these are rescored exactly.

Blocks of the index lie on shelves and queries in strips, both of a bounded size; a task has one shelf and one strip, and
carries each query's k-th best score from block to block. A vector is sent once a strip, a query once a shelf. The winners
of a query are merged by a window of at most k rows a shelf.

Cases: vectors that are null or hold null or non-finite components take no part, neither as queries nor as candidates; a
shorter vector counts as padded with zeros; ties go to the smaller id; rows that repeat an id are candidates each, but
not for a query of that id; fewer than k candidates are all returned; an empty table gives an empty result. Vectors
whose products could leave 53 bits are scored as 64-bit integers, without bounds.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize

BLOCK, QUERY_BLOCK = 8192, 1024
#: Vectors of a shelf and queries of a strip; queries that are scored at once.
SHELF, STRIP, CHUNK = 16 * BLOCK, 16 * QUERY_BLOCK, 256
#: Possible members of a query at which rescoring beats another segment, per k.
RESCORE = 8


def quantise(vector: Column, scale: float = 64.0) -> Column:
    """floor(scale * component) of every component as longs; null unless all are finite."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(doubles, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.when(~bad, F.transform(doubles, lambda x: F.floor(x * F.lit(scale))))


def _dump(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _matrix(values: list) -> np.ndarray:
    width = max(map(len, values), default=0)
    if all(len(v) == width for v in values):
        return np.array(values, dtype=np.int64).reshape(len(values), width)
    return np.array([list(v) + [0] * (width - len(v)) for v in values], dtype=np.int64).reshape(len(values), width)


class Block:
    """Vectors of a block: ids, values, and the posting segments in descending order of impact."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x, self.segments = ids, x, []
        size = np.abs(x)
        level = np.zeros(x.shape, np.int8)
        while size.any():
            level += size > 0
            size >>= 1
        for b in range(int(level.max(initial=0)), 0, -1):
            vec, dim = np.nonzero(level == b)
            if len(vec):
                rest = np.sqrt((np.where(level < b, x, 0).astype(np.float64) ** 2).sum(1)) * (1 + 1e-12)
                self.segments.append((vec.astype(np.int32), dim.astype(np.int16 if x.shape[1] <= 1 << 15 else np.int32), rest))

    def dump(self) -> bytes:
        top = int(np.abs(self.x).max(initial=0))
        kind = next(t for t in (np.int8, np.int16, np.int32, np.int64) if top <= np.iinfo(t).max)
        arrays = {f"{name}{i}": v for i, s in enumerate(self.segments) for name, v in zip(("vec", "dim", "rest"), (s[0], s[1], s[2].astype(np.float32) * np.float32(1 + 1e-6)))}
        out = io.BytesIO()
        np.savez(out, ids=self.ids, x=self.x.astype(kind), **arrays)
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> Block:
        z, out = np.load(io.BytesIO(raw)), cls.__new__(cls)
        out.ids, out.x = z["ids"], z["x"].astype(np.int64)
        out.segments = [(z[f"vec{i}"], z[f"dim{i}"], z[f"rest{i}"]) for i in range((len(z.files) - 2) // 3)]
        return out

    def matrices(self, width: int, kind: type) -> list[tuple[np.ndarray, np.ndarray]]:
        """Each segment's entries as rows of the block, and the rest behind it."""
        out = []
        for vec, dim, rest in self.segments:
            m = np.zeros((len(self.ids), width), kind)
            m[vec, dim] = self.x[vec, dim]
            out.append((m, rest))
        return out


def _packed(size: int, dump):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, values = [], []

        def pack() -> pa.RecordBatch:
            n = min(size, len(ids))
            raw = dump(np.array(ids[:n], dtype=np.int64), _matrix(values[:n]))
            return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([raw], pa.binary())], names=["n", "block"])

        for batch in batches:
            ids += batch.column(0).to_pylist()
            values += batch.column(1).to_pylist()
            while len(ids) >= size:
                yield pack()
                del ids[:size], values[:size]
        if ids:
            yield pack()

    return run


def best_of(qi: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of each query's k best, ties to the smaller id."""
    order = np.lexsort((ids, -score, qi))
    own = qi[order]
    first = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1]) if len(own) else np.empty(0, np.int64)
    rank = np.arange(len(own)) - np.repeat(first, np.diff(np.append(first, len(own)))) if len(own) else own
    return order[rank < k]


def search_block(qids: np.ndarray, q: np.ndarray, block: Block, k: int, kth: np.ndarray | None = None, parts: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate row, score) of the block's members of each query's k best, by exact integer scores.

    ``kth`` has each query's k-th best score of the blocks before, and is raised; ``parts`` may give the block's matrices.
    """
    width = max(q.shape[1], block.x.shape[1])
    q, x = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (q, block.x))
    kth = np.full(len(q), -np.inf) if kth is None else kth
    possible = qids[:, None] != block.ids[None, :]
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(width, 1)
    members: list[tuple[np.ndarray, np.ndarray]] = []
    live, cols = np.arange(len(q)), np.arange(len(x))
    if most < 2.0**53:
        kind = np.float32 if most < 2.0**22 else np.float64
        qf, norm = q.astype(kind), np.sqrt((q.astype(np.float64) ** 2).sum(1)) * (1 + 1e-6)
        acc = np.zeros(possible.shape, kind)
        for m, rest in block.matrices(width, kind) if parts is None else parts:
            acc += qf[live] @ m[cols].T
            slack = (norm[live, None] * rest[None, cols]).astype(kind)
            if len(cols) >= k:
                low = np.where(possible, acc - slack, -np.inf)
                kth[live] = np.maximum(kth[live], np.partition(low, len(cols) - k, axis=1)[:, len(cols) - k])
            possible &= acc + slack >= kth[live, None] - 1  # sums are exact; one is more than what rounding takes off a bound
            done = possible.sum(1) <= RESCORE * k
            qi, ci = np.nonzero(possible[done])
            members.append((live[done][qi], cols[ci]))
            stay = possible[~done].any(0)
            live, cols, acc, possible = live[~done], cols[stay], acc[~done][:, stay], possible[~done][:, stay]
            if not len(live):
                break
    qi, ci = np.nonzero(possible)
    members.append((live[qi], cols[ci]))
    qi, ci = (np.concatenate(m) for m in zip(*members))
    exact = np.concatenate([(q[qi[i : i + 100_000]] * x[ci[i : i + 100_000]]).sum(1) for i in range(0, len(qi), 100_000)]) if len(qi) else np.empty(0, np.int64)
    keep = best_of(qi, block.ids[ci], exact, k)
    qi, ci, exact = qi[keep], ci[keep], exact[keep]
    n = np.bincount(qi, minlength=len(q))
    last = np.cumsum(n)[n >= k] - 1  # the k-th of each query that has k here
    kth[n >= k] = np.maximum(kth[n >= k], exact[last])
    return qi, ci, exact


def top_k(queries: DataFrame, index: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score) for tables (vec_id, v): each query against every vector but those of its own id."""
    spark = index.sparkSession
    number = lambda c: F.shiftright(c, 33) + c.bitwiseAND(F.lit((1 << 33) - 1))  # noqa: E731  of a block, from partition and place

    def blocks(rows: DataFrame, size: int, dump, name: str) -> tuple[DataFrame, int, int]:
        packed = materialize(rows.mapInArrow(_packed(size, dump), "n long, block binary").withColumn("b", number(F.monotonically_increasing_id())), name)
        count, total = packed.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        return packed, count, total

    packed, count, total = blocks(index, BLOCK, lambda ids, x: Block(ids, x).dump(), "impact-index")
    packed_q, _, total_q = blocks(queries, QUERY_BLOCK, lambda ids, x: _dump(ids=ids, x=x), "impact-queries")
    strips = max(1, -(-total_q // STRIP))
    shelves = max(1, -(-total // SHELF), min(count, -(-spark.sparkContext.defaultParallelism // strips)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = packed.select("block", F.pmod("b", F.lit(shelves)).cast("int").alias("shelf"), every(strips).alias("strip"))
    right = packed_q.select("block", F.pmod("b", F.lit(strips)).cast("int").alias("strip"), every(shelves).alias("shelf"))

    def run(shelf: pa.Table, strip: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        found: list[list[np.ndarray]] = [[np.empty(0, np.int64)] * 3]
        qs = [np.load(io.BytesIO(raw)) for raw in strip.column("block").to_pylist()]
        qids = np.concatenate([z["ids"] for z in qs]) if qs else np.empty(0, np.int64)
        width = max((z["x"].shape[1] for z in qs), default=0)
        q = np.concatenate([np.pad(z["x"], ((0, 0), (0, width - z["x"].shape[1]))) for z in qs]) if qs else np.zeros((0, 0), np.int64)
        kth = np.full(len(q), -np.inf)
        for raw in shelf.column("block").to_pylist() if len(q) else ():
            block = Block.load(raw)
            wide = max(width, block.x.shape[1])
            most = float(np.abs(q).max(initial=0)) * float(np.abs(block.x).max(initial=0)) * max(wide, 1)
            parts = block.matrices(wide, np.float32) if most < 2.0**22 else None
            for i in range(0, len(q), CHUNK):
                qi, ci, score = search_block(qids[i : i + CHUNK], q[i : i + CHUNK], block, k, kth[i : i + CHUNK], parts)
                found.append([qi + i, block.ids[ci], score])
        qi, ids, score = (np.concatenate(f) for f in zip(*found))
        keep = best_of(qi, ids, score, k)
        return pa.table([pa.array(qids[qi[keep]]), pa.array(ids[keep]), pa.array(score[keep].astype(np.int64))], names=names)

    by = ["shelf", "strip"]
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(run, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", quantise(F.col("embedding")).alias("v")).where("v is not null and vec_id is not null")
    return top_k(rows.where("vec_id % 20 = 0"), rows)


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
             CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
