"""Daily series: returns and targets, baselines, publication lag, widening, carrying forward, events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from straitline.functions import windows as W

HORIZONS, VOL_WINDOW, TRADING_DAYS = (1, 5, 20), 20, 252
BASELINES = (28, 90)
MEASURES = ("n_transits", "n_tanker", "n_total", "n_cargo")


def pick_column(columns: list[str], candidates: tuple[str, ...], role: str) -> str:
    """The first candidate that is there, or an error that names what is."""
    for c in candidates:
        if c in columns:
            return c
    raise KeyError(f"no column for {role} among {candidates}; there are {columns}")


def returns(prices: DataFrame, price: str, prefix: str, horizons: tuple[int, ...] = HORIZONS, vol_window: int = VOL_WINDOW) -> DataFrame:
    """+ log returns, forward targets, realised and forward volatility. Rows are trading days, in one global order."""
    w = Window.orderBy("date")
    log = F.ln(F.col(price))
    out = prices.withColumn("_r1", log - F.lag(log, 1).over(w))
    year = F.lit(TRADING_DAYS**0.5)
    cols: dict[str, Column] = {}
    for h in horizons:
        cols[f"{prefix}_ret_{h}d"] = log - F.lag(log, h).over(w)
        cols[f"{prefix}_fwd_ret_{h}d"] = F.lead(log, h).over(w) - log
    r = F.col("_r1")
    cols[f"{prefix}_rv_{vol_window}d"] = W.guarded(F.stddev_samp(r), r, w.rowsBetween(-(vol_window - 1), 0), vol_window) * year
    for h in horizons:
        if h >= 2:
            cols[f"{prefix}_fwd_rv_{h}d"] = W.guarded(F.stddev_samp(r), r, w.rowsBetween(1, h), h) * year
    return out.withColumns(cols).drop("_r1")


def price_panel(brent: DataFrame, wti: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """Both prices by date (full outer), their features, and the spread with its changes. Inputs are (date, value)."""
    p = brent.select("date", F.col("value").alias("brent_spot")).join(wti.select("date", F.col("value").alias("wti_spot")), "date", "full_outer")
    p = returns(returns(p, "brent_spot", "brent", horizons), "wti_spot", "wti", horizons)
    w = Window.orderBy("date")
    p = p.withColumn("brent_wti_spread", F.col("brent_spot") - F.col("wti_spot"))
    s = F.col("brent_wti_spread")
    return p.withColumns({"brent_wti_spread_chg_1d": s - F.lag(s).over(w)} | {f"brent_wti_spread_fwd_chg_{h}d": F.lead(s, h).over(w) - s for h in horizons})


def baselines(daily: DataFrame, values: list[str], group: str | None = "zone_key", sizes: tuple[int, ...] = BASELINES, yearly: bool = True) -> DataFrame:
    """+ <value>_z<w>d and <value>_yoy_dev (relative to the mean a year before). All windows share one sort by group."""
    by = [group] if group else []
    w, cols = Window.partitionBy(*by).orderBy("date"), {}
    for v in (c for c in values if c in daily.columns):
        for n in sizes:
            cols[f"{v}_z{n}d"] = W.zscore(F.col(v), w, n)
        if yearly:
            base = W.prior_year(F.col(v), F.col("date"), by)
            cols[f"{v}_yoy_dev"] = (F.col(v) - base) / F.nullif(base, F.lit(0.0))
    return daily.withColumns(cols)


def publication_date(date: Column, weekday: str = "TU", least_days: int = 2) -> Column:
    """The first ``weekday`` at least ``least_days`` after the date."""
    return F.next_day(F.date_add(date, least_days - 1), weekday)


def published(daily: DataFrame) -> DataFrame:
    return daily.withColumn("available_from", publication_date(F.col("date")))


def lag_stats(daily: DataFrame) -> DataFrame:
    """One row: median and largest number of days between a date and its publication."""
    days = F.datediff("available_from", "date")
    return daily.agg(F.median(days).alias("median_lag_days"), F.max(days).alias("max_lag_days"))


def numeric(df: DataFrame, skip: tuple[str, ...]) -> list[str]:
    return [f.name for f in df.schema.fields if f.name not in skip and f.dataType.typeName() in ("double", "float", "long", "integer", "short", "decimal")]


def widen(daily: DataFrame, group: str, groups: list[str], lag: bool = True, prefix: str = "", measures: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """One row a date with <prefix><group>_<measure>; with ``lag``, by publication date, the last non-null value of each."""
    measures = measures or numeric(daily, ("date", group))
    key = publication_date(F.col("date")) if lag else F.col("date")
    last = lambda g, m: F.max_by(F.when((F.col(group) == g) & F.col(m).isNotNull(), F.col(m)), F.when((F.col(group) == g) & F.col(m).isNotNull(), F.col("date")))
    names = {(g, m): f"{prefix}{g}_{m}" for g in groups for m in measures}
    return daily.groupBy(key.alias("date")).agg(*[last(g, m).alias(n) for (g, m), n in names.items()]), list(names.values())


def carry_forward(table: DataFrame, columns: list[str]) -> DataFrame:
    """Each column filled with its last value, + <column>_age_days. One global order: for tables of a row a day."""
    w = Window.orderBy("date")
    return table.withColumns({f"{c}_age_days": W.carried_age(F.col(c), F.col("date"), w) for c in columns} | {c: W.carried(F.col(c), w) for c in columns})


def cross_route(daily: DataFrame, value: str, cape: str = "cape_of_good_hope", suez: str = "suez") -> DataFrame:
    """The Cape's share of Cape and Suez traffic."""
    of = lambda z: F.sum(F.when(F.col("zone_key") == z, F.col(value)))
    both = daily.groupBy("date").agg(of(cape).alias("_c"), of(suez).alias("_s"))
    return both.select("date", (F.col("_c") / F.nullif(F.col("_c") + F.col("_s"), F.lit(0.0))).alias("cape_suez_share"))


def resolve_ports(directory: DataFrame, ports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(port_key, port_group, port_id) of configured ports by id or by name substring, and ports without a match.

    Both sides are dimension tables, a row a port.
    """
    ids = directory.select("port_id", "port_name").distinct()
    override = F.col("p.portwatch_id") if "portwatch_id" in ports.columns else F.lit(None).cast("string")
    name = F.contains(F.lower("d.port_name"), F.lower("p.match_name"))
    hit = ids.alias("d").join(F.broadcast(ports.alias("p")), F.when(override.isNotNull(), F.col("d.port_id") == override).otherwise(name))
    mapping = hit.select("p.port_key", "p.port_group", "d.port_id")
    return mapping, ports.join(mapping.select("port_key").distinct(), "port_key", "left_anti")


def port_groups(daily: DataFrame, ports: DataFrame, value: str) -> DataFrame:
    mapping, _ = resolve_ports(daily, ports)
    return daily.join(F.broadcast(mapping), "port_id").groupBy("date", "port_group").agg(F.coalesce(F.sum(value), F.lit(0.0)).alias(value))


def event_dummies(table: DataFrame, events: DataFrame, categories: list[str]) -> DataFrame:
    """+ event_<category> (0/1) and days_since_event. ``events`` is a small table of dated events."""
    days = events.groupBy("date").agg(*[F.max((F.col("category") == c).cast("int")).alias(f"event_{c}") for c in categories])
    out = table.join(days.withColumn("_event", F.col("date")), "date", "left")
    out = out.withColumns({f"event_{c}": F.coalesce(f"event_{c}", F.lit(0)) for c in categories})
    dates = events.select(F.col("date").alias("_d")).distinct()
    last = table.select("date").distinct().join(F.broadcast(dates), F.col("_d") <= F.col("date"), "left").groupBy("date").agg(F.max("_d").alias("_last"))
    return out.join(last, "date", "left").withColumn("days_since_event", F.datediff("date", "_last")).drop("_event", "_last")


def smooth(value: Column, order, window: int = 7) -> Column:
    return W.guarded(F.avg(value), value, order.rowsBetween(-(window - 1), 0), max(2, window // 2))


def feature_table(prices: DataFrame, chokepoints: DataFrame, *, zones: list[str], values: tuple[str, ...] = ("n_transits",), lag: bool = True, fill: bool = True, port_daily: DataFrame | None = None, ports: DataFrame | None = None, port_value: str = "n_tanker", groups: list[str] | None = None, ais_daily: DataFrame | None = None, ais_values: tuple[str, ...] = ("n_transits", "n_waiting", "laden_share"), waiting: DataFrame | None = None, events: DataFrame | None = None, categories: list[str] | None = None) -> DataFrame:
    """One row a price date. Published series join by publication date and are carried; own measures are neither."""
    parts: list[tuple[DataFrame, list[str]]] = [widen(baselines(chokepoints, list(values)), "zone_key", zones, lag)]
    share = cross_route(chokepoints, values[0]).withColumn("_route", F.lit("cross"))
    parts.append(widen(share, "_route", ["cross"], lag, measures=["cape_suez_share"]))
    if port_daily is not None and ports is not None:
        parts.append(widen(baselines(port_groups(port_daily, ports, port_value), [port_value], "port_group"), "port_group", groups or [], lag, "port_"))
    table = reduce(lambda t, p: t.join(p[0], "date", "left"), parts, prices)
    if fill:
        table = carry_forward(table, [c for _, cols in parts for c in cols])
    if ais_daily is not None:
        measures = [m for m in ais_values if m in ais_daily.columns]
        own, _ = widen(baselines(ais_daily.select("date", "zone_key", *measures), measures), "zone_key", zones, False, "ais_")
        table = table.join(own, "date", "left")
    if waiting is not None:
        table = table.join(widen(waiting, "zone_key", zones, False)[0], "date", "left")
    return event_dummies(table, events, categories or []) if events is not None else table
