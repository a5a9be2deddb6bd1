"""Mixing sources to target weights by entropy balancing, in DataFrame functions only.

For every source s the mix must hold ``T_s`` words. Among all document rates ``w_i`` in [0, cap] that meet this, entropy
balancing takes those nearest to the rate 1 in relative entropy, ``sum b_i (w_i log w_i - w_i + 1)``. Its dual is convex in
one multiplier per source, and the optimum is an exponential tilt ``w_i = min(cap, exp(lambda_s * t_i / b_i))`` with
``t_i`` the words of the document. ``measure="documents"``, the default, weighs documents alike (``b_i`` is the mean length
of the source): a source that must shrink loses long documents first, one that must grow repeats them first, so that as
few documents as possible change. ``measure="words"`` weighs the entropy by words (``b_i = t_i``): every document of a
source has one rate, which is plain proportional scaling.

Newton iterations run over the histogram of (source, size): a rate depends on nothing else, so its sums equal those over
the documents. A step sums the histogram by source, with map-side combine, and joins a row a source back. One that leaves
the bracket of the root becomes a bisection, which makes convergence certain.

Rates become copies by taking ``floor(w)`` copies of all and one more of some documents, in the order of a hash less the
fraction, up to the residual of the source. First the documents of over a hundredth of their source, fewer than a hundred
each: one is taken if it fits, or if the small ones can make up for it. Then the small ones fill the rest; their running
sums are taken in hash buckets of a source, so that a hot source is dealt over many tasks. What remains is at most half a
small document, or, in a source without small ones, what no document left fits better.

Cases: null or empty text has size 0, target share 0 and takes 0 words; a null source is a source of its own, ordered
last; repeated rows are documents of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, release

TOKEN = r"[^\x20\x09-\x0D]+"
ROUNDS, STEPS = 60, 2  # at most 120 Newton steps, tested for convergence after each round
SMALL = 0.01  # share of its source up to which a document is small
SALTS, BUCKETS = 16, 1024


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, cycle: tuple[float, ...] = (1.0, 2.0, 3.0), cap: float = 3.0) -> DataFrame:
    """(_src, source_size, target): weights repeat over the sources in order; no target above ``cap`` sizes.

    The water level of the re-shared excess has a closed form: in order of ``cap * size / weight`` a source is full
    when even the level at which all before it are full would lift it over its cap. One row per source is sorted here.
    """
    src = sizes.groupBy("_src").agg(F.sum("size").alias("source_size"))
    k = F.row_number().over(Window.orderBy("_src")) - 1
    src = src.withColumn("_w", F.element_at(F.array(*[F.lit(float(c)) for c in cycle]), (F.pmod(k, F.lit(len(cycle))) + 1).cast("int")))
    order = Window.orderBy("_ratio", "_src")
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    src = src.withColumn("_cap", F.col("source_size") * F.lit(cap)).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    src = src.withColumns({"_full": F.coalesce(F.sum("_cap").over(before), F.lit(0.0)), "_used": F.coalesce(F.sum("_w").over(before), F.lit(0.0)), "_all": F.sum("source_size").over(whole), "_weights": F.sum("_w").over(whole)})
    src = src.withColumn("_level", (F.col("_all") - F.col("_full")) / (F.col("_weights") - F.col("_used")))
    src = src.withColumn("_sat", F.col("_ratio") <= F.col("_level"))
    level = F.min(F.when(~F.col("_sat"), F.struct("_ratio", "_src", "_level"))).over(whole)["_level"]
    return src.select("_src", "source_size", F.when(F.col("_sat"), F.col("_cap")).otherwise(F.col("_w") * level).alias("target"))


def solve_dual(cells: DataFrame, targets: DataFrame, cap: float, tol: float) -> DataFrame:
    """(_src, _lambda) from cells (_src, _words, _x): Newton steps on the dual, kept in a bracket of the root."""
    now = materialize(targets.select("_src", "target", F.lit(0.0).alias("_lambda"), F.lit(-1e6).alias("_lo"), F.lit(1e6).alias("_hi"), F.lit(None).cast("double").alias("_left")), "mix-dual")
    rate = F.least(F.lit(cap), F.exp(F.col("_lambda") * F.col("_x")))
    for _ in range(ROUNDS):
        step = now
        for _ in range(STEPS):
            sums = cells.join(step.select("_src", "_lambda"), "_src").groupBy("_src").agg(F.sum(F.col("_words") * rate).alias("_got"), F.sum(F.when(rate < F.lit(cap), F.col("_words") * rate * F.col("_x")).otherwise(0.0)).alias("_curve"))
            step = step.join(sums, "_src").withColumn("_gap", F.col("_got") - F.col("target"))
            step = step.withColumns({"_hi": F.when(F.col("_gap") > 0, F.col("_lambda")).otherwise(F.col("_hi")), "_lo": F.when(F.col("_gap") < 0, F.col("_lambda")).otherwise(F.col("_lo"))})
            newton = F.col("_lambda") - F.try_divide(F.col("_gap"), F.nullif(F.col("_curve"), F.lit(0.0)))
            inside = (newton > F.col("_lo")) & (newton < F.col("_hi"))
            left = F.abs("_gap") / F.greatest("target", F.lit(1e-9))
            step = step.withColumn("_left", left).withColumn("_lambda", F.when(F.col("_left") <= F.lit(tol), F.col("_lambda")).when(inside, newton).otherwise((F.col("_lo") + F.col("_hi")) / 2))
            step = step.select(*now.columns)
        last, now = now, materialize(step, "mix-dual")
        discard(last)
        release(cells.sparkSession)
        # a source whose every rate is at the cap can't be met better
        left = now.agg(F.max(F.when(F.col("_hi") - F.col("_lo") > 1e-12, F.col("_left")))).first()[0]
        if left is None or left <= tol:
            break
    return now


def large_extras(large: DataFrame) -> DataFrame:
    """Rows (_src, ..., _extra) of the large documents, from rows with ``_goal``, the words that they should add, and
    ``_slack``, what the small ones of the source can take back. Fewer than 1 / SMALL a source are in its array."""
    fields = ["_s", "_h", "size", "_t", "doc_id", "rate", "_whole"]
    sources = large.groupBy("_src").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("docs"), *[F.first(c).alias(c) for c in ("_goal", "_slack", "source_size", "target")])
    start = F.struct(F.col("_goal").alias("left"), F.array().cast("array<boolean>").alias("takes"))

    def take(acc, doc):
        fits = doc["size"] <= acc["left"] + F.col("_slack")
        return F.struct((acc["left"] - F.when(fits, doc["size"]).otherwise(F.lit(0))).alias("left"), F.concat(acc["takes"], F.array(fits)).alias("takes"))

    sources = sources.withColumn("done", F.aggregate("docs", start, take))
    sources = sources.select("*", F.explode(F.arrays_zip("docs", F.col("done.takes").alias("take"))).alias("r")).drop("docs")
    # without small documents, one more document may come nearer than none
    miss = F.abs(F.col("done.left") - F.col("r.docs.size"))
    nearer = ~F.col("r.take") & (F.col("_slack") <= 0) & (miss < F.abs("done.left"))
    best = F.row_number().over(Window.partitionBy("_src").orderBy(F.when(nearer, 0).otherwise(1), miss, F.col("r.docs._h"), F.col("r.docs._t"))) == 1
    return sources.select("_src", "source_size", "target", *[F.col(f"r.docs.{f}").alias(f) for f in fields], (F.col("r.take") | (nearer & best)).alias("_extra"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cycle: tuple[float, ...] = (1.0, 2.0, 3.0), cap: float = 3.0, measure: str = "documents", tol: float = 1e-9) -> DataFrame:
    """One row per document: id, size, source_size, target, taken, rate, copies. See the module's docstring."""
    source = docs[source_col].cast("string")
    sizes = docs.select(docs[id_col].alias("doc_id"), F.coalesce(F.concat(F.lit("a"), source), F.lit("z")).alias("_src"), word_count(docs[text_col]).alias("size"), F.xxhash64(docs[id_col], F.lit("mix")).alias("_h"), F.xxhash64(docs[text_col]).alias("_t"))
    sizes = materialize(sizes, "mix-sizes")
    means = sizes.groupBy("_src").agg(F.avg(F.when(F.col("size") > 0, F.col("size"))).alias("_mean"))
    targets = materialize(source_targets(sizes, cycle, cap).join(means, "_src"), "mix-targets")
    x = F.lit(1.0) if measure == "words" else F.col("size") / F.col("_mean")
    cells = sizes.where("size > 0").groupBy("_src", "size").agg(F.count(F.lit(1)).alias("docs")).join(targets, "_src")
    cells = materialize(cells.select("_src", (F.col("size").cast("double") * F.col("docs")).alias("_words"), x.alias("_x")), "mix-cells")
    duals = solve_dual(cells, targets, cap, tol)

    salted = targets.join(duals.select("_src", "_lambda"), "_src", "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rated = sizes.withColumn("_salt", F.pmod(F.col("_h"), F.lit(SALTS)).cast("int")).join(salted, ["_src", "_salt"])
    rated = rated.withColumn("rate", F.when(F.col("size") > 0, F.coalesce(F.least(F.lit(cap), F.exp(F.col("_lambda") * x)), F.lit(0.0))).otherwise(0.0))
    whole = F.floor(F.col("rate") + F.lit(1e-9))
    rated = rated.withColumns({"_whole": whole, "_part": F.greatest(F.col("rate") - whole, F.lit(0.0)), "_u": F.pmod(F.shiftrightunsigned("_h", 11), F.lit(1 << 53)) / F.lit(float(1 << 53))})
    rated = rated.withColumn("_s", F.col("_u") - F.col("_part")).withColumn("_b", F.floor((F.col("_s") + 1) * F.lit(BUCKETS / 2)).cast("int"))
    rated = rated.withColumns({"_room": (F.col("_whole") + 1 <= F.lit(cap)) & (F.col("size") > 0), "_large": F.col("size") > F.col("source_size") * F.lit(SMALL)})
    columns = ["_src", "_s", "_b", "_h", "_t", "doc_id", "size", "source_size", "target", "rate", "_whole", "_part", "_room", "_large"]
    rated = materialize(rated.select(*columns), "mix-rated")
    release(docs.sparkSession)

    part = F.col("_part") * F.col("size")
    sums = rated.groupBy("_src").agg(F.sum(F.col("_whole") * F.col("size")).alias("_given"), F.sum(F.when(~F.col("_large"), part).otherwise(0.0)).alias("_slack"))
    large = rated.where("_large AND _room").join(sums, "_src").withColumn("_goal", F.col("target") - F.col("_given") - F.col("_slack"))
    large = materialize(large_extras(large), "mix-large")
    used = large.groupBy("_src").agg(F.sum(F.when(F.col("_extra"), F.col("size")).otherwise(F.lit(0))).alias("_used"))
    goals = sums.join(used, "_src", "left").select("_src", (F.col("_given") + F.coalesce("_used", F.lit(0))).alias("_given"))

    small = rated.where("NOT _large AND _room")
    buckets = small.groupBy("_src", "_b").agg(F.sum("size").alias("_bucket")).join(goals, "_src")
    before = Window.partitionBy("_src").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # at most BUCKETS rows a source
    buckets = buckets.select("_src", "_b", "_given", F.coalesce(F.sum("_bucket").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_src", "_b").orderBy("_s", "_h", "size", "_t").rowsBetween(Window.unboundedPreceding, -1)
    middle = F.col("_before") + F.coalesce(F.sum("size").over(within), F.lit(0)) + F.col("size") / 2
    small = small.join(buckets, ["_src", "_b"]).withColumn("_extra", middle <= F.col("target") - F.col("_given"))

    rest = rated.where("NOT _room").withColumn("_extra", F.lit(False))
    names = ["doc_id", "size", "source_size", "target", "rate", "_whole", "_extra"]
    out = large.select(*names).unionByName(small.select(*names)).unionByName(rest.select(*names))
    out = out.withColumn("copies", (F.col("_whole") + F.when(F.col("_extra"), 1).otherwise(0)).cast("int"))
    discard(sizes, targets, cells, duals)
    release(docs.sparkSession)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "rate", "copies")


def op2(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
