"""As-of joins as one sort: both sides united, the last right row carried forward along the key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_backward(left: DataFrame, right: DataFrame, by: list[str], on: str, values: list[str], tolerance_hours: float | None = None) -> DataFrame:
    """``left`` with the columns ``values`` and ``matched_at`` of the last ``right`` row at or before ``left.on``.

    Linear in both sides; a right row at the same time counts, and a match older than the tolerance gives nulls. Values
    and time travel in one struct, so a null value isn't skipped in favour of an older row. Without keys (``by`` empty)
    the order is global: only for dimension-sized tables.
    """
    payload = F.struct(F.col(on).alias("_at"), *values)
    kind = right.select(payload.alias("p")).schema["p"].dataType
    extra = [c for c in left.columns if c not in by and c != on]
    rows = left.select(*by, on, F.struct(*extra).alias("_left") if extra else F.lit(None).alias("_left"), F.lit(1).alias("_o"), F.lit(None).cast(kind).alias("_p"))
    reports = right.select(*by, on, F.lit(None).cast(rows.schema["_left"].dataType).alias("_left"), F.lit(0).alias("_o"), payload.alias("_p"))
    w = Window.partitionBy(*by).orderBy(on, "_o").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.unionByName(reports).withColumn("_m", F.last("_p", ignorenulls=True).over(w)).where("_o = 1")
    if tolerance_hours is not None:
        out = out.withColumn("_m", F.when(F.timestamp_diff("MICROSECOND", F.col("_m._at"), F.col(on)) <= tolerance_hours * 3.6e9, F.col("_m")))
    return out.select(*by, on, *[F.col(f"_left.{c}") for c in extra], *[F.col(f"_m.{v}").alias(v) for v in values], F.col("_m._at").alias("matched_at"))


def first_at_or_after(events: DataFrame, dates: DataFrame, date: Column | str = "date") -> DataFrame:
    """``events`` with ``trading_date``: the first of ``dates`` at or after the event's date; events are a few rows."""
    hit = events.select("event", F.col("date").alias("_d")).join(dates.select(F.col("date").alias("trading_date")), F.col("trading_date") >= F.col("_d"))
    return events.join(hit.groupBy("event").agg(F.min("trading_date").alias("trading_date")), "event", "left")
