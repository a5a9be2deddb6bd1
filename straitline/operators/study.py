"""Event study: mean-adjusted abnormal returns around events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from straitline.functions.dist import t_two_sided

from .asof import first_at_or_after

WINDOW, ESTIMATION, GAP = (-5, 20), 120, 10


def per_event(prices: DataFrame, events: DataFrame, column: str, window: tuple[int, int] = WINDOW, length: int = ESTIMATION, gap: int = GAP) -> DataFrame:
    """event, rel_day, ret, abnormal, car. Events too near either end, or without a usable estimation window, are left out."""
    days = prices.select("date", F.col(column).alias("ret")).withColumn("i", F.row_number().over(Window.orderBy("date")) - 1)
    n = days.agg(F.max("i").alias("_top"))
    at = first_at_or_after(events, prices.select("date")).where("trading_date is not null").join(days.select(F.col("date").alias("trading_date"), F.col("i").alias("p")), "trading_date")
    at = at.crossJoin(F.broadcast(n)).where((F.col("p") + window[0] - gap - length >= 0) & (F.col("p") + window[1] <= F.col("_top")))
    around = days.join(F.broadcast(at.select("event", "p")), F.col("i").between(F.col("p") + window[0] - gap - length, F.col("p") + window[1]))
    by = Window.partitionBy("event")
    base = F.when(F.col("i") < F.col("p") + window[0] - gap, F.col("ret"))
    around = around.withColumns({"_mean": F.avg(base).over(by), "_sd": F.stddev_samp(base).over(by), "_n": F.count(base).over(by)})
    used = around.where((F.col("_n") >= length // 2) & (F.col("_sd") > 0) & (F.col("i") >= F.col("p") + window[0]))
    used = used.withColumns({"rel_day": (F.col("i") - F.col("p")).cast("int"), "abnormal": F.col("ret") - F.col("_mean")})
    run = F.sum("abnormal").over(by.orderBy("rel_day"))
    return used.withColumn("car", F.when(F.col("abnormal").isNotNull(), run)).select("event", "rel_day", "ret", "abnormal", "car")


def average(events: DataFrame) -> DataFrame:
    """mean_car, std_car, n_events, t_stat by relative day."""
    out = events.groupBy("rel_day").agg(F.avg("car").alias("mean_car"), F.stddev_samp("car").alias("std_car"), F.count("car").alias("n_events"))
    return out.withColumn("t_stat", F.col("mean_car") / F.nullif(F.col("std_car") / F.sqrt("n_events"), F.lit(0.0)))


def with_p(averages: DataFrame) -> DataFrame:
    """+ p_value, two-sided Student t with max(n - 1, 1) degrees of freedom."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield p.assign(p_value=[t_two_sided(t, max(n - 1, 1)) if pd.notna(t) else None for t, n in zip(p.t_stat, p.n_events)])

    return averages.mapInPandas(run, averages.schema.simpleString()[7:-1].replace(":", " ", 99) + ", p_value double")


def by_regime(events: DataFrame, start: str = "2026-02-28") -> dict[str, DataFrame]:
    return {"before": events.where(F.col("date") < F.lit(start).cast("date")), "after": events.where(F.col("date") >= F.lit(start).cast("date"))}
