"""Connected components by alternating large-star and small-star steps on an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, discard, materialize, release

MAX_ROUNDS = 60
#: Edges that a task contracts at a time.
CONTRACT = 500_000


def contracted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node that it reaches by these edges) of each node that is not that least one."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v, root = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        hi, lo = np.maximum(root[u], root[v]), np.minimum(root[u], root[v])
        if np.array_equal(hi, lo):
            break
        np.minimum.at(root, hi, lo)
        while not np.array_equal(root, up := root[root]):
            root = up
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def flush() -> pa.RecordBatch:
        a, b = (np.concatenate([x.column(i).to_numpy(zero_copy_only=False) for x in held]) for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in contracted(a, b)], names=["a", "b"])

    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= CONTRACT:
            yield flush()
            held, size = [], 0
    if size:
        yield flush()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link the neighbours of each node (the larger ones, or the smaller ones and itself) to its least neighbour.

    The large star makes at most a row an edge, so only the small one, which follows, drops repeated rows.
    """
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    linked = both.join(least, "a")
    if large:
        return linked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    ends = F.explode(F.array("a", "b")).alias("a")
    return linked.select(ends, F.col("m").alias("b")).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b: longs): the least node that it reaches.

    Each task first replaces its edges by links to the least nodes that they reach, without a shuffle. A round then moves each
    edge towards the least node of its component; rounds needed grow with the logarithm of the number of nodes. Each round is
    written to the shared folder, so its lineage is one read, and what the driver holds of it is collected. Loops and repeated
    edges are ignored.
    """
    spark = edges.sparkSession
    now = materialize(edges.select("a", "b").where("a <> b").mapInArrow(bounded(_contract), "a long, b long"), "edges")
    before = None
    for _ in range(MAX_ROUNDS):
        nxt = materialize(_star(_star(now, True), False), "edges")
        mark = nxt.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b") % F.lit(1 << 40)), F.lit(0))).first()
        discard(now)
        release(spark)
        now, done = nxt, tuple(mark) == before
        before = tuple(mark)
        if done:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
    raise RuntimeError("components did not settle")
