"""N-gram Jaccard join by count-vector R-trees: classes of documents whose shingle sets are near.

Points. A document's set of distinct five-word shingles is hashed into groups, more for larger sets; the counts of the
groups are its point. Two sets share at most ``sum(min(a_g, b_g))`` shingles, and a node of an R-tree whose upper corner bounds its
points shares at most ``sum(min(a_g, hi_g))`` with any: no pair below it can reach the threshold if that is too little.

Plan. (1) Documents with equal sets are one class from the start. (2) Two classes can only be similar if they share one of
the least frequent ``n - ceil(0.8 n) + 1`` shingles of either, under one global order; the order ranks shingles by a
count sketch, so passages that many documents share come last. Classes meet in blocks by those shingles. Shingles of one class
only are told by a count and dropped by a bit set before the rest travels, and of blocks with the same classes one is searched.
(3) In each block an R-tree over the points finds a spanning forest of the pairs that its bound can't exclude. (4) The connected parts of all forests are clusters: a
superset of the wanted classes. Each cluster's sets are fetched once, an R-tree over its points prunes again, and
survivors are verified on the exact sets. A search from each member compares it with all members not yet reached, so no
link between two classes is left out although pairs within a class are not enumerated.

A block or cluster of more than its limit is split into tiles by hash, and every pair of tiles is a task of its own; the
forests of the tasks join in the final components. No group is collected whole, and nothing that grows is broadcast.

Cases: null or empty text has no set and is linked with nothing; fewer words than five make one shingle; repeated rows
keep their number; the smallest id of a class names it, a null id counts as none; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, column, discard, materialize, release
from .components import components
from .shingles import SIZE, shingle_sets, word_hashes
from .suffix_tree import Screen

SHINGLE_WORDS = SIZE
DIMS, PER_GROUP = 64, 12
SKETCH_BITS = 16
LEAF, FAN = 16, 16
#: Classes of a block and of a cluster that one task handles; beyond, tiles.
BLOCK_LIMIT, CLUSTER_LIMIT = 4096, 2048
MEAN_SHINGLES = 1000  # shingles of a cluster count as a member at least each, which bounds the memory of a task
#: Bits of the filter that spares unneeded texts, for each class that needs one and at most; when it is full, more travel.
BLOOM_PER_CLASS, BLOOM_BITS = 16, 1 << 28
SHORT = 24  # bits of a shingle that its first count leaves out: fewer bytes travel, and what meets by chance is told apart afterwards
SALTS = 16  # shares of a class that a third of all rows may carry


def need(n: np.ndarray, m: int) -> np.ndarray:
    """Least overlap of sets of n and m members with 100 * overlap >= 80 * union: overlap >= 80 (n + m) / 180."""
    return (80 * (n + m) + 179) // 180


def points(sets: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.bincount((u & np.uint64(DIMS - 1)).astype(np.int64), minlength=DIMS) for u in sets]) if sets else np.zeros((0, DIMS), np.int64)


class RTree:
    """R-tree over count vectors, bulk-loaded by sorting on size and then on the coordinates' order; nodes keep upper
    corners, the range of sizes, and how many of their members are left."""

    def __init__(self, vecs: np.ndarray, sizes: np.ndarray):
        order = np.lexsort((vecs[:, 1], vecs[:, 0], sizes // np.maximum(1, sizes // 8), np.log2(np.maximum(sizes, 1)).astype(int)))
        self.order, self.vecs, self.sizes = order, vecs, sizes
        self.leaves = [order[i : i + LEAF] for i in range(0, len(order), LEAF)]
        hi = np.stack([vecs[x].max(0) for x in self.leaves])
        lo_n, hi_n = (np.array([f(sizes[x]) for x in self.leaves]) for f in (np.min, np.max))
        self.levels = [(hi, lo_n, hi_n)]
        while len(hi) > FAN:
            cut = np.arange(0, len(hi), FAN)
            hi, lo_n, hi_n = np.maximum.reduceat(hi, cut), np.minimum.reduceat(lo_n, cut), np.maximum.reduceat(hi_n, cut)
            self.levels.append((hi, lo_n, hi_n))
        self.left = np.ones(len(sizes), bool)

    def take(self, members: np.ndarray) -> None:
        self.left[members] = False

    def search(self, x: int) -> np.ndarray:
        """Members still left whose bound with ``x`` allows similarity."""
        v, n = self.vecs[x], int(self.sizes[x])
        at = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            hi, lo_n, hi_n = self.levels[depth]
            ok = (100 * np.minimum(hi_n[at], n) >= 80 * n) & (100 * n >= 80 * lo_n[at])
            at = at[ok]
            at = at[np.minimum(hi[at], v).sum(1) >= need(np.maximum(lo_n[at], (80 * n + 99) // 100), n)]
            if depth:
                below = len(self.levels[depth - 1][0])
                at = (at[:, None] * FAN + np.arange(FAN)).ravel()
                at = at[at < below]
        m = np.concatenate([self.leaves[i] for i in at]) if len(at) else np.empty(0, np.int64)
        m = m[self.left[m]]
        m = m[(100 * np.minimum(self.sizes[m], n) >= 80 * np.maximum(self.sizes[m], n))]
        return m[np.minimum(self.vecs[m], v).sum(1) >= need(self.sizes[m], n)]


def forest(vecs: np.ndarray, sizes: np.ndarray, verify=None) -> list[tuple[int, int]]:
    """Edges of a spanning forest over the pairs that pass the bound, and ``verify(x, candidates)`` if given."""
    count, edges = len(sizes), []
    if count < 2:
        return edges
    if count == 2:
        ok = 100 * min(sizes) >= 80 * max(sizes) and np.minimum(vecs[0], vecs[1]).sum() >= need(sizes[:1], int(sizes[1]))[0]
        return [(0, 1)] if ok and (verify is None or len(verify(0, np.array([1])))) else edges
    tree = RTree(vecs, sizes)
    for root in range(count):
        if not tree.left[root]:
            continue
        stack = [root]
        tree.take(np.array([root]))
        while stack:
            x = stack.pop()
            found = tree.search(x)
            if verify is not None and len(found):
                found = verify(x, found)
            tree.take(found)
            edges += [(x, int(y)) for y in found]
            stack += found.tolist()
    return edges


def overlap_verifier(sets: list[np.ndarray]):
    """Exact test of one member against candidates: overlaps counted on the members' shingles in one flat array."""
    codes, flat = np.unique(np.concatenate(sets), return_inverse=True) if sets else (np.empty(0), np.empty(0, int))
    ends = np.cumsum([len(s) for s in sets])
    starts = ends - np.array([len(s) for s in sets])
    mark = np.zeros(len(codes), bool)

    def verify(x: int, cand: np.ndarray) -> np.ndarray:
        own = flat[starts[x] : ends[x]]
        mark[own] = True
        inter = np.array([np.count_nonzero(mark[flat[starts[y] : ends[y]]]) for y in cand])
        mark[own] = False
        union = len(own) + (ends[cand] - starts[cand]) - inter
        return cand[100 * inter >= 80 * union]

    return verify


# ---- passes over the texts ----


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, hashes = np.zeros(1 << SKETCH_BITS, np.int64), word_hashes()
    for batch in batches:
        for u in shingle_sets(column(batch, "text"), hashes):
            total += np.bincount((u >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(total))
    slots = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(total[slots])], names=["slot", "n"])


def _describe(sketch):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, hashes = sketch.value, word_hashes()
        for batch in batches:
            ns, classes, rare, vecs = [], [], [], []
            for u in shingle_sets(column(batch, "text"), hashes):
                n = len(u)
                ns.append(n)
                classes.append(np.int64(np.uint64(xxhash.xxh3_64_intdigest(u.tobytes()))) if n else None)
                order = np.argsort(rank[(u >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], kind="stable")[: n - (4 * n + 4) // 5 + 1]
                rare.append(u[order].view(np.int64) if n else np.empty(0, np.int64))
                vecs.append(pack(u))
            offsets = np.concatenate([[0], np.cumsum([len(r) for r in rare])]).astype(np.int32)
            keys = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rare) if rare else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ns, pa.int64()), pa.array(classes, pa.int64()), keys, pa.array(vecs, pa.binary())], names=["id", "n", "class", "rare", "vec"])

    return run


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Runs of equal ``group`` of a sorted stream: (group, record batch of its rows); a run may span batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        g = np.asarray(batch.column(0).to_numpy(zero_copy_only=False))
        cuts = np.flatnonzero(g[1:] != g[:-1]) + 1
        bounds = [0, *cuts.tolist(), len(g)]
        for a, b in zip(bounds[:-1], bounds[1:]):
            part = batch.slice(a, b - a)
            if held and held[0].column(0)[0].as_py() != part.column(0)[0].as_py():
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def dims(n: int) -> int:
    """Groups of a set of n: the power of two that leaves 6 to 12 members a group, so that chance overlap stays below the
    bound at any size; DIMS at least."""
    return max(DIMS, 1 << max(0, -(-n // PER_GROUP) - 1).bit_length())


def pack(u: np.ndarray) -> bytes:
    """A set's point in the narrowest type that holds it, behind a byte that tells its width."""
    g = dims(len(u))
    counts = np.bincount((u & np.uint64(g - 1)).astype(np.int64), minlength=g)
    top = counts.max(initial=0)
    kind = np.uint8 if top < 256 else np.uint16 if top < 65536 else np.uint32
    return bytes([np.dtype(kind).itemsize]) + counts.astype(kind).tobytes()


def unpack(v: bytes) -> np.ndarray:
    return np.frombuffer(v, {1: np.uint8, 2: np.uint16, 4: np.uint32}[v[0]], offset=1).astype(np.int64)


def levelled_forest(vecs: list[np.ndarray], sizes: np.ndarray) -> list[tuple[int, int]]:
    """Forest over points of different numbers of groups. Sizes of a similar pair differ by a quarter, so their numbers of
    groups are equal or one doubling apart: a tree for each number, with the doubled ones folded to it."""
    wide, edges = np.array([len(v) for v in vecs]), []
    for g in np.unique(wide).tolist():
        sel = np.flatnonzero((wide == g) | (wide == 2 * g))
        if len(sel) < 2:
            continue
        own = wide[sel] == g
        folded = np.stack([vecs[i] if len(vecs[i]) == g else vecs[i].reshape(2, g).sum(0) for i in sel])
        mine = forest(folded, sizes[sel], lambda x, cand, own=own: cand if own[x] else cand[own[cand]])
        edges += [(int(sel[x]), int(sel[y])) for x, y in mine]
    return edges


def _block_forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b = [], []
    for run in _unpack(batches):
        if run.num_rows > 1:
            ids = run.column("class").to_numpy()
            for x, y in levelled_forest([unpack(v) for v in run.column("vec").to_pylist()], run.column("n").to_numpy()):
                a.append(int(ids[x]))
                b.append(int(ids[y]))
        if len(a) > 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
            a, b = [], []
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _cluster_forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for run in _unpack(batches):
        ids = run.column("class").to_numpy()
        sets = [np.asarray(s.values.to_numpy(), dtype=np.int64).view(np.uint64) for s in chain.from_iterable(c for c in run.column("set").chunks)]
        edges = forest(points(sets), np.array([len(s) for s in sets]), overlap_verifier(sets)) if len(sets) > 1 else []
        yield pa.RecordBatch.from_arrays([pa.array([int(ids[x]) for x, _ in edges], pa.int64()), pa.array([int(ids[y]) for _, y in edges], pa.int64())], names=["a", "b"])


def tiled(rows: DataFrame, group: str, limit: int) -> DataFrame:
    """``rows`` (class, group, _met: size of the group) with ``_task``: the group, or for a group beyond ``limit`` each pair
    of its tiles that holds the row. Only keys are in these rows; what they stand for is joined afterwards."""
    tiles = F.ceil(F.col("_met") * 2 / F.lit(limit)).cast("int")
    large = F.col("_met") > limit
    rows = rows.withColumn("_own", F.when(large, F.pmod(F.xxhash64("class", F.lit("tile")), tiles.cast("long")).cast("int")).otherwise(0))
    rows = rows.withColumn("_other", F.explode(F.when(large, F.sequence(F.lit(0), tiles - 1)).otherwise(F.array(F.lit(0)))))
    pair = F.xxhash64(group, F.least("_own", "_other"), F.greatest("_own", "_other"))
    return rows.withColumn("_task", F.when(large, pair).otherwise(F.col(group))).select("class", "_task")


def _bloom(rows: DataFrame, col: str, bits: int) -> np.ndarray:
    """A filter of ``bits`` bits over the values of ``col``: each task sends the bytes it sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            h = np.asarray(batch.column(0).to_numpy(zero_copy_only=False)).astype(np.int64).view(np.uint64) % np.uint64(bits)
            np.bitwise_or.at(own, (h >> np.uint64(3)).astype(np.int64), (1 << (h & np.uint64(7)).astype(np.uint8)).astype(np.uint8))
        at = np.flatnonzero(own)
        for i in range(0, len(at), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[i : i + 100_000]), pa.array(own[at[i : i + 100_000]].astype(np.int64))], names=["at", "bits"])

    got = rows.select(F.col(col).cast("long")).mapInArrow(bounded(run), "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(bits // 8, np.uint8)
    out[got.column("at").to_numpy()] = got.column("bits").to_numpy()
    return out


def _fetch(bloom):
    """Sets of the documents whose key may be needed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, hashes = bloom.value, word_hashes()
        for batch in batches:
            h = np.asarray(batch.column(0).to_numpy(zero_copy_only=False)).astype(np.int64).view(np.uint64) % np.uint64(8 * len(bits))
            may = np.flatnonzero((bits[(h >> np.uint64(3)).astype(np.int64)] >> (h & np.uint64(7)).astype(np.uint8)) & 1)
            sets = [u for u in shingle_sets(batch.column(1).take(pa.array(may)).to_pylist(), hashes) if len(u)]
            offsets = np.concatenate([[0], np.cumsum([len(u) for u in sets])]).astype(np.int32)
            values = np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64)
            classes = pa.array([np.int64(np.uint64(xxhash.xxh3_64_intdigest(u.tobytes()))) for u in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([classes, pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=["class", "set"])

    return run


def _may(shared: Broadcast, key: Column) -> Column:
    """Whether the broadcast ``Screen`` may hold the key, a 64-bit hash."""

    def may(h: pd.Series) -> pd.Series:
        return pd.Series(shared.value.has(h.to_numpy().astype(np.int64).view(np.uint64)))

    return F.pandas_udf(may, "boolean")(key)


def blocks_of(keys: DataFrame) -> DataFrame:
    """(class, key, _met) of ``keys`` (class, key, each pair once): the keys that several classes have, ``_met`` of them, and
    of keys with the same classes one.

    Most keys have one class. They are counted by an aggregation and dropped where they are, and only the others are joined,
    so no task holds all classes of a common key.
    """
    short = F.shiftrightunsigned("key", SHORT)
    counted = keys.groupBy(short.alias("_short")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    several = materialize(counted.select(F.xxhash64("_short").alias("key")), "several")
    shared = keys.sparkSession.sparkContext.broadcast(Screen(several))
    some = materialize(keys.where(_may(shared, F.xxhash64(short))), "blocks")
    shared.unpersist()
    discard(several)
    met = some.groupBy("key").agg(F.count(F.lit(1)).alias("_met"), F.bit_xor(F.xxhash64("class")).alias("_who")).where("_met > 1")
    once = met.groupBy("_met", "_who").agg(F.min("key").alias("key"))
    out = materialize(some.join(once.select("key", "_met"), "key").select("class", "key", "_met"), "blocks")
    discard(some)
    return out


def near_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id), one row per row of ``docs``."""
    spark, sc = docs.sparkSession, docs.sparkSession.sparkContext
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("binary").alias("text"))
    ranks = np.zeros(1 << SKETCH_BITS, np.int64)
    for r in rows.select("text").mapInArrow(bounded(_sketch), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():  # one number a slot
        ranks[r.slot] = r.n
    sketch = sc.broadcast(ranks)
    described = materialize(rows.mapInArrow(bounded(_describe(sketch)), f"id {kind}, n long, class long, rare array<long>, vec binary"), "sets")
    sketch.unpersist()
    release(spark)

    some = described.where("class is not null")
    keys = materialize(some.groupBy("class").agg(F.first("rare").alias("rare")).select("class", F.explode("rare").alias("key")), "keys")
    blocks = blocks_of(keys)
    discard(keys)
    release(spark)
    vectors = some.groupBy("class").agg(F.first("n").alias("n"), F.first("vec").alias("vec"))
    tasks = tiled(blocks, "key", BLOCK_LIMIT).join(vectors, "class").select("_task", "class", "n", "vec")
    pairs = materialize(tasks.repartition("_task").sortWithinPartitions("_task").mapInArrow(_block_forests, "a long, b long").distinct(), "pairs")
    discard(blocks)
    release(spark)
    clusters = materialize(components(pairs), "clusters")

    reps = some.groupBy("class").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    wanted = materialize(reps.join(clusters.select(F.col("node").alias("class")), "class", "left_semi"), "reps")
    release(spark)
    bits = 1 << 16
    while bits < min(BLOOM_PER_CLASS * wanted.count(), BLOOM_BITS):
        bits *= 2
    bloom = sc.broadcast(_bloom(wanted.select(F.xxhash64("rep").alias("h")), "h", bits))
    release(spark)
    fetched = rows.select(F.xxhash64("id").alias("h"), "text").mapInArrow(bounded(_fetch(bloom)), "class long, set array<long>").groupBy("class").agg(F.first("set").alias("set"))
    named = clusters.withColumnRenamed("node", "class").join(vectors.select("class", "n"), "class")
    weight = F.greatest(F.count(F.lit(1)), F.ceil(F.sum("n") / F.lit(MEAN_SHINGLES)))  # long texts count as several
    tasks = tiled(named.join(named.groupBy("component").agg(weight.alias("_met")), "component"), "component", CLUSTER_LIMIT)
    tasks = tasks.join(fetched, "class").select("_task", "class", "set")
    links = materialize(tasks.repartition("_task").sortWithinPartitions("_task").mapInArrow(_cluster_forests, "a long, b long"), "links")
    bloom.unpersist()
    release(spark)

    # the least id of a component goes to its linked classes, then to the rows of classes that are linked or have copies;
    # both joins deal a hot key over SALTS shares
    parts = components(links).withColumnRenamed("node", "class").join(wanted, "class")
    least = parts.groupBy("component").agg(F.min("rep").alias("component_id"))
    shares = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
    salt = lambda c: F.pmod(F.xxhash64(c, F.lit("salt")), F.lit(SALTS)).cast("int").alias("_salt")
    linked = parts.select("class", "component", salt("class")).join(least.select("*", shares), ["component", "_salt"]).select("class", "component_id")
    copied = reps.where("copies > 1").select("class", F.col("rep").alias("component_id"))
    ids = linked.unionByName(copied).groupBy("class").agg(F.min("component_id").alias("component_id"))
    out = described.select("id", "n", "class", salt("id")).join(ids.select("*", shares), ["class", "_salt"], "left")
    result = materialize(out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id")), "near")
    discard(described, pairs, clusters, wanted, links)
    release(spark)
    return result


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class: that of its smallest id. Rows without shingles, linked with nothing, all stay.

    An id that several rows carry is rare; only of those rows the texts are compared, and equal rows count once. Rows whose id
    is kept and is theirs alone, which are most, stay where they are; only those that a bit set of the other ids may hold are
    joined. Columns may have any names.
    """
    near = near_classes(docs, id_col=id_col, text_col=text_col)
    alone = (F.count(F.lit(1)) == 1) & F.bool_and(F.col(id_col).eqNullSafe(F.col("component_id")))
    others = near.groupBy(F.col(id_col).alias("_id")).agg(alone.alias("_alone")).where("NOT _alone")
    others = materialize(others.select(F.xxhash64("_id").alias("key")), "others")
    shared = docs.sparkSession.sparkContext.broadcast(Screen(others))
    discard(others)
    release(docs.sparkSession)
    keep = near.where(F.col(id_col).eqNullSafe(F.col("component_id"))).groupBy(F.col(id_col).alias("_keep")).agg(F.count(F.lit(1)).alias("_rows"))
    alias = {c: f"_doc_{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*[docs[c].alias(a) for c, a in alias.items()])
    other = _may(shared, F.xxhash64(alias[id_col]))
    kept = rows.where(other).join(keep, F.col(alias[id_col]).eqNullSafe(F.col("_keep")))
    several = kept.where("_rows > 1").withColumn("_text", F.xxhash64(alias[text_col])).dropDuplicates(["_keep", "_text"]).drop("_text")
    return rows.where(~other).unionByName(kept.where("_rows = 1").unionByName(several).drop("_keep", "_rows")).select(*[F.col(a).alias(c) for c, a in alias.items()])


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) END AS sh FROM w),
e AS (SELECT doc_id, unnest(sh) AS g FROM s),
n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n FROM s),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 80 * (p.n + q.n - k)),
r AS (SELECT doc_id, doc_id AS c FROM n UNION SELECT r.doc_id, l.y FROM r JOIN l ON l.x = r.c)
SELECT n.doc_id, n.n AS n_shingles, min(r.c) AS component_id FROM n JOIN r ON r.doc_id = n.doc_id GROUP BY 1, 2
"""
