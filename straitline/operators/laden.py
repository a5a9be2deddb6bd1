"""Laden state of vessels from static reports, and its daily share by zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from straitline.config import Zone
from straitline.functions import geo

from .asof import asof_backward

THRESHOLD, STALE_DAYS = 0.75, 30
#: Typical full draught (m) of a length below the bound (m); longer vessels 24.5.
BANDS = ((120.0, 7.0), (180.0, 12.2), (250.0, 17.0), (330.0, 22.0))
LONGEST = 24.5


def class_draught(length: Column) -> Column:
    out = F.when(length.isNull() | F.isnan(length) | (length <= 0) | (length == float("inf")), F.lit(None).cast("double"))
    for bound, draught in BANDS:
        out = out.when(length < bound, F.lit(draught))
    return out.otherwise(F.lit(LONGEST))


def classify(static: DataFrame, threshold: float = THRESHOLD, reference: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """+ draught (0 as null), full_draught, draught_source, draught_ratio, is_laden (null if unknown), draught_age_hours.

    A vessel's own largest draught is its full one; a vessel of ``reference`` (mmsi, max_draught) takes that, and others
    fall back on their class. ``strict`` looks at reports so far only.
    """
    ship = Window.partitionBy("mmsi")
    own = ship.orderBy("ts").rangeBetween(Window.unboundedPreceding, 0) if strict else ship
    s = static.withColumn("draught", F.when((F.col("draught") > 0) & ~F.isnan("draught"), F.col("draught")))
    if reference is None:
        s = s.withColumn("_own", F.max("draught").over(own))
    else:
        s = s.join(reference.select("mmsi", F.col("max_draught").alias("_own")), "mmsi", "left")
    typical = class_draught(F.col("length_m"))
    s = s.withColumns({"full_draught": F.coalesce("_own", typical), "draught_source": F.when(F.col("_own").isNotNull(), "observed").when(typical.isNotNull(), "class").otherwise("unknown")})
    s = s.withColumn("draught_ratio", F.col("draught") / F.nullif("full_draught", F.lit(0.0)))
    last = s.agg(F.max("ts").alias("_last"))  # one row
    return s.crossJoin(F.broadcast(last)).withColumns({"is_laden": F.col("draught_ratio") >= threshold, "draught_age_hours": F.timestamp_diff("MICROSECOND", F.col("ts"), F.col("_last")) / 3.6e9}).drop("_own", "_last")


def laden_daily(pos: DataFrame, static: DataFrame, zones: dict[str, Zone], threshold: float = THRESHOLD, stale_days: int = STALE_DAYS) -> DataFrame:
    """Per day and zone: vessels present, of known state, laden, their share of the known, median age of the report used."""
    keys = F.array_compact(F.array(*[F.when(geo.inside(z, F.col("lon"), F.col("lat")), F.lit(k)) for k, z in zones.items()]))
    day = F.date_trunc("day", F.col("ts")).cast("timestamp_ntz")
    present = pos.select("mmsi", day.alias("ts"), F.explode(keys).alias("zone_key")).distinct()
    known = classify(static, threshold).where("is_laden is not null")
    known = known.groupBy("mmsi", "ts").agg(F.max_by("is_laden", "event_id" if "event_id" in known.columns else "draught").alias("is_laden"))
    j = asof_backward(present, known, ["mmsi"], "ts", ["is_laden"], 24.0 * stale_days)
    age = F.timestamp_diff("MICROSECOND", F.col("matched_at"), F.col("ts")) / F.lit(8.64e10)
    out = j.withColumn("_age", age).groupBy(F.to_date("ts").alias("date"), "zone_key").agg(F.count(F.lit(1)).alias("n_present"), F.count("is_laden").alias("n_laden_known"), F.count_if("is_laden").alias("n_laden"), F.median("_age").alias("median_draught_age_days"))
    return out.withColumn("laden_share", F.col("n_laden") / F.nullif("n_laden_known", F.lit(0)))
