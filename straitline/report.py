"""A Markdown report of small tables; sections fail on their own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from straitline.operators import dynamics, forecast, series, study

#: Fixed values: |z| from which a card is red, and orange.
RED, ORANGE = 2.5, 1.5


def markdown(df: DataFrame, rows: int = 40) -> str:
    """A table of at most ``rows`` rows; one more is read to tell that some are left out."""
    got = df.limit(rows + 1).collect()
    cell = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    lines += ["| " + " | ".join(map(cell, r)) + " |" for r in got[:rows]]
    return "\n".join(lines + (["| … |" + " |" * (len(df.columns) - 1)] if len(got) > rows else []))


def section(title: str, body: Callable[[], str]) -> str:
    try:
        return f"## {title}\n\n{body()}\n"
    except Exception as e:  # noqa: BLE001  one section's failure must not cost the others
        return f"## {title}\n\n_Not available: {e}_\n"


def coverage(table: DataFrame, columns: list[str]) -> DataFrame:
    """column, n, share, first_date, last_date, from one pass."""
    aggs = []
    for c in columns:
        seen = F.when(F.col(c).isNotNull(), F.col("date"))
        aggs.append(F.struct(F.lit(c).alias("column"), F.count(c).alias("n"), (F.count(c) / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("share"), F.min(seen).alias("first_date"), F.max(seen).alias("last_date")))
    return table.agg(F.array(*aggs).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def discover(columns: list[str]) -> dict[str, list[str]]:
    """Targets, price features and flow features by name."""
    targets = [c for c in columns if "_fwd_" in c]
    price = [c for c in columns if c not in targets and c.startswith(("brent", "wti")) and any(k in c for k in ("_ret_", "_rv_", "_chg_"))]
    flow = [c for c in columns if c.endswith(("_z28d", "_z90d", "_yoy_dev"))]
    return {"targets": targets, "price": price, "flow": flow}


def flow_column(table: DataFrame, zone: str = "hormuz", portwatch_id: str = "chokepoint6") -> tuple[str | None, str]:
    """The raw traffic column to draw: by id, by key, else any measure that has data; with a label that says which."""
    raw = [c for c in table.columns if c.endswith(series.MEASURES)]
    if not raw:
        return None, "no flow column"
    counts = table.agg(*[F.count(c).alias(c) for c in raw]).first()
    for owner in (portwatch_id, zone):
        for m in series.MEASURES:
            if f"{owner}_{m}" in raw and counts[f"{owner}_{m}"]:
                return f"{owner}_{m}", f"{zone} {m}"
    rest = [c for c in raw if counts[c]]
    return (rest[0], f"{rest[0]} (not {zone})") if rest else (None, "no data")


def status(z):
    return F.when(z.isNull(), "gray").when(F.abs(z) >= RED, "red").when(F.abs(z) >= ORANGE, "orange").otherwise("green")


def cards(table: DataFrame, zones: list[str], measure: str = "n_transits") -> DataFrame:
    """zone, value, z, status of the latest row."""
    last = table.orderBy(F.col("date").desc()).limit(1)
    row = lambda z: F.struct(F.lit(z).alias("zone"), F.col(f"{z}_{measure}").alias("value"), F.col(f"{z}_{measure}_z28d").alias("z"), status(F.col(f"{z}_{measure}_z28d")).alias("status"))
    return last.select(F.explode(F.array(*map(row, zones))).alias("r")).select("r.*")


def car_band(average: DataFrame) -> DataFrame:
    """Mean path with a band of one standard error."""
    se = F.col("std_car") / F.sqrt("n_events")
    return average.withColumns({"low": F.col("mean_car") - se, "high": F.col("mean_car") + se})


def skill(board: DataFrame, benchmark: str = "price_only") -> DataFrame:
    """RMSE of each model in percent of the benchmark's."""
    base = F.max(F.when(F.col("model") == benchmark, F.col("rmse"))).over(Window.partitionBy())
    return board.withColumn("rmse_vs_benchmark_pct", (F.col("rmse") / base - 1) * 100)


def generate(table: DataFrame, events: DataFrame, horizons: tuple[int, ...] = (1, 5, 20), min_train: int = 500) -> str:
    cols = discover(table.columns)
    first = cols["flow"][0] if cols["flow"] else None

    def forecasts() -> str:
        return "\n\n".join(f"### {h} days\n\n{markdown(skill(forecast.compare(table, f'brent_fwd_ret_{h}d', cols['price'][:3], cols['flow'][:3], h, min_train)))}" for h in horizons)

    return "\n".join(
        [
            "# Flows and prices\n",
            section("Coverage", lambda: markdown(coverage(table, cols["price"] + cols["flow"]))),
            section("Events", lambda: markdown(events.orderBy("date"))),
            section("Stationarity", lambda: markdown(dynamics.stationarity(table, cols["price"][:3] + cols["flow"][:3]))),
            section("Event study", lambda: markdown(study.with_p(study.average(study.per_event(table, events, "brent_ret_1d"))).orderBy("rel_day"))),
            section("Granger", lambda: markdown(dynamics.granger_both(table, "brent_ret_1d", first))),
            section("Local projection", lambda: markdown(dynamics.local_projection(table, "brent_ret_1d", first, 10).orderBy("horizon"))),
            section("Forecasts", forecasts),
            section("Verdicts", lambda: markdown(forecast.verdicts(table, cols["price"][:3], cols["flow"][:3], horizons, min_train))),
            section("Limitations", lambda: "Research output, not advice. Published series are lagged to their release; own counts depend on collection."),
        ]
    )
