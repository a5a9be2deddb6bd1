"""Vessel tracks: speed, quality flags, zones, transits, silences, waiting. Inputs have mmsi, ts, lon, lat.

Tracks are windows by vessel, or by zone and vessel. ``tracked`` is the one pass by zone and vessel that crossings, silences
and waiting are read from; ``transits``, ``dark_gaps`` and ``waiting_episodes`` make a pass of their own.
``tie`` breaks equal times, since Spark's sort isn't stable.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from straitline.config import Zone
from straitline.functions import geo

MAX_SPEED_KN, SPOOF_DECIMALS, SPOOF_VESSELS = 40.0, 4, 5
MAX_GAP_HOURS, DARK_HOURS, WAIT_SPEED_KN, WAIT_HOURS = 6.0, 12.0, 1.0, 6.0
ANCHORED = (1, 5)


def require(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"missing columns {missing}; there are {df.columns}")


def hours(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(3.6e9)


def along(df: DataFrame, by: list[str], tie: str | None) -> Window:
    order = ["ts", tie] if tie and tie in df.columns else ["ts"]
    return Window.partitionBy(*by).orderBy(*order)


def implied_speed(pos: DataFrame, tie: str | None = "event_id") -> DataFrame:
    """+ step_nm, step_hours, implied_speed_kn since the vessel's last fix; null first, and where no time passed."""
    require(pos, "mmsi", "ts", "lon", "lat")
    w = along(pos, ["mmsi"], tie)
    lon0, lat0, ts0 = (F.lag(c).over(w) for c in ("lon", "lat", "ts"))
    out = pos.withColumns({"step_nm": geo.haversine_nm(lon0, lat0, F.col("lon"), F.col("lat")), "step_hours": hours(ts0, F.col("ts"))})
    return out.withColumn("implied_speed_kn", F.col("step_nm") / F.nullif(F.col("step_hours"), F.lit(0.0)))


def shared_position(pos: DataFrame, decimals: int = SPOOF_DECIMALS, vessels: int = SPOOF_VESSELS, unit: str = "minute") -> DataFrame:
    """+ flag_shared_position: at least ``vessels`` ships report one rounded position in one ``unit`` of time.

    A distinct count isn't a window function, and a set per row would grow with a hot cell: cells are counted by an
    aggregation with map-side combine, and only cells that reach the minimum are joined back.
    """
    cell = {"_t": F.date_trunc(unit, F.col("ts")), "_y": F.bround("lat", decimals), "_x": F.bround("lon", decimals)}
    pos = pos.withColumns(cell)
    hot = pos.groupBy(*cell).agg(F.countDistinct("mmsi").alias("_n")).where(F.col("_n") >= vessels)
    return pos.join(hot, list(cell), "left").withColumn("flag_shared_position", F.col("_n").isNotNull()).drop(*cell, "_n")


def quality_flags(pos: DataFrame, max_speed: float = MAX_SPEED_KN, decimals: int = SPOOF_DECIMALS, vessels: int = SPOOF_VESSELS, unit: str = "minute", on_land: Callable[[DataFrame], Column] | Column | None = None, tie: str | None = "event_id") -> DataFrame:
    out = shared_position(implied_speed(pos, tie), decimals, vessels, unit)
    land = F.lit(False) if on_land is None else on_land(out) if callable(on_land) and not isinstance(on_land, Column) else on_land
    out = out.withColumns({"flag_impossible_speed": F.coalesce(F.col("implied_speed_kn") > max_speed, F.lit(False)), "flag_on_land": F.coalesce(land, F.lit(False))})
    return out.withColumn("flag_any", F.col("flag_impossible_speed") | F.col("flag_shared_position") | F.col("flag_on_land"))


def tag_zones(pos: DataFrame, zones: dict[str, Zone]) -> DataFrame:
    """zone_key filled where it is missing; a tag that is there stays."""
    found = geo.zone_of(zones, F.col("lon"), F.col("lat"))
    return pos.withColumn("zone_key", F.coalesce("zone_key", found) if "zone_key" in pos.columns else found)


def scope(pos: DataFrame, zones: dict[str, Zone], column: str = "scope") -> DataFrame:
    """A row for each zone whose box holds the fix: later windows see no jump from another region. Plain range filters."""
    keys = F.array_compact(F.array(*[F.when(geo.within_bounds(z, F.col("lon"), F.col("lat")), F.lit(k)) for k, z in zones.items()]))
    return pos.withColumn(column, F.explode(keys))


def _by_zone(zones: dict[str, Zone], of: Callable[[Zone], Column], column: str = "scope") -> Column:
    return F.coalesce(*[F.when(F.col(column) == k, of(z)) for k, z in zones.items()])


def tracked(pos: DataFrame, zones: dict[str, Zone], max_speed: float = WAIT_SPEED_KN, tie: str | None = "event_id") -> DataFrame:
    """One pass along the tracks: each fix of a zone's box with what crossings, silences and waiting need of its neighbours.

    One shuffle and one sort by (scope, mmsi) serve all three: ``_p`` is the fix before (with its place and whether it was
    inside), ``_in`` whether this one is inside the zone, ``_s`` whether it is stopped there, ``_run`` counts changes of
    ``_s``, and ``_c`` is the gate's crossing between the two fixes.
    """
    require(pos, "mmsi", "ts", "lon", "lat")
    names = [c for c in ("sog", "nav_status", tie) if c in pos.columns]
    p = scope(pos.dropna(subset=["lon", "lat", "ts"]).select("mmsi", "ts", "lon", "lat", *names), zones)
    w = along(p, ["scope", "mmsi"], tie)
    p = p.withColumn("_in", _by_zone(zones, lambda z: geo.inside(z, F.col("lon"), F.col("lat"))))
    p = p.withColumn("_s", F.col("_in") & (F.coalesce("sog", F.lit(99.0)) <= max_speed) if "sog" in names else F.lit(False))
    p = p.withColumn("_p", F.lag(F.struct("ts", "lon", "lat", F.col("_in").alias("inside"), F.col("_s").alias("stopped"))).over(w))
    turn = (~F.col("_s").eqNullSafe(F.col("_p.stopped"))).cast("int")
    p = p.withColumn("_run", F.sum(turn).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return p.withColumn("_c", _by_zone(zones, lambda z: geo.crossing(z, F.col("_p.lon"), F.col("_p.lat"), F.col("lon"), F.col("lat"))))


def silent(least_hours: float = DARK_HOURS) -> Column:
    """Both ends inside the zone, and at least so long apart."""
    return F.col("_in") & F.col("_p.inside") & (hours(F.col("_p.ts"), F.col("ts")) >= least_hours)


def crossings_of(track: DataFrame, zones: dict[str, Zone], max_gap_hours: float = MAX_GAP_HOURS, tie: str | None = "event_id") -> DataFrame:
    """Gate crossings of a track; time and place interpolated along the movement."""
    f, us, gap = F.col("_c.fraction"), F.timestamp_diff("MICROSECOND", F.col("_p.ts"), F.col("ts")), hours(F.col("_p.ts"), F.col("ts"))
    names = _by_zone(zones, lambda z: F.when(F.col("_c.sign") > 0, z.positive).otherwise(z.negative))
    return track.where("_c is not null").select(
        "mmsi",
        F.col("scope").alias("zone_key"),
        F.timestamp_add("MICROSECOND", F.round(us * f).cast("long"), F.col("_p.ts")).alias("crossing_time"),
        names.alias("direction"),
        gap.alias("gap_hours"),
        (F.col("_p.lon") + f * (F.col("lon") - F.col("_p.lon"))).alias("crossing_lon"),
        (F.col("_p.lat") + f * (F.col("lat") - F.col("_p.lat"))).alias("crossing_lat"),
        (gap > max_gap_hours).alias("ambiguous"),
        *([tie] if tie in track.columns else []),
    )


def transits(pos: DataFrame, zones: dict[str, Zone], max_gap_hours: float = MAX_GAP_HOURS, tie: str | None = "event_id") -> DataFrame:
    """Gate crossings of consecutive fixes, all zones in one pass."""
    return crossings_of(tracked(pos, zones, tie=tie), zones, max_gap_hours, tie)


def vessel_identity(crossings: DataFrame, static: DataFrame | None) -> DataFrame:
    """+ imo (the latest known of the mmsi) and vessel_id, ``imo:n`` or ``mmsi:n``."""
    if static is None:
        return crossings.withColumns({"imo": F.lit(None).cast("long"), "vessel_id": F.concat(F.lit("mmsi:"), F.col("mmsi").cast("string"))})
    order = F.struct("ts", "event_id") if "event_id" in static.columns else F.col("ts")
    latest = static.where("imo is not null").groupBy("mmsi").agg(F.max_by(F.col("imo").cast("long"), order).alias("imo"))
    known = F.concat(F.lit("imo:"), F.col("imo").cast("string"))
    return crossings.join(latest, "mmsi", "left").withColumn("vessel_id", F.coalesce(known, F.concat(F.lit("mmsi:"), F.col("mmsi").cast("string"))))


def deduplicate(crossings: DataFrame, separation_hours: float = MAX_GAP_HOURS, tie: str = "event_id") -> DataFrame:
    """Per zone, vessel and direction, drop a crossing within the separation of the last one *kept*.

    A crossing that far from its predecessor is kept in any case, so the fold runs inside bursts of closer crossings:
    its arrays are as short as a burst, not as long as a vessel's history.
    """
    by = ["zone_key", "vessel_id", "direction"]
    w = Window.partitionBy(*by).orderBy("crossing_time", tie)
    apart = F.coalesce(hours(F.lag("crossing_time").over(w), F.col("crossing_time")) >= separation_hours, F.lit(True))
    c = crossings.withColumn("_new", apart.cast("int"))
    c = c.withColumn("_burst", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    row = F.struct("crossing_time", tie, *[x for x in crossings.columns if x not in (*by, "crossing_time", tie)])
    bursts = c.groupBy(*by, "_burst").agg(F.sort_array(F.collect_list(row)).alias("_rows"))
    last = lambda acc: F.element_at(acc, -1)["crossing_time"]
    keep = F.aggregate(
        F.slice("_rows", 2, F.size("_rows")),
        F.slice("_rows", 1, 1),
        lambda acc, x: F.when(hours(last(acc), x["crossing_time"]) >= separation_hours, F.concat(acc, F.array(x))).otherwise(acc),
    )
    return bursts.select(*by, F.explode(keep).alias("_r")).select(*by, "_r.*").select(*crossings.columns)


def transits_daily(crossings: DataFrame, include_ambiguous: bool = False) -> DataFrame:
    rows = crossings if include_ambiguous else crossings.where(~F.col("ambiguous"))
    who = "vessel_id" if "vessel_id" in crossings.columns else "mmsi"
    return rows.groupBy(F.to_date("crossing_time").alias("date"), "zone_key", "direction").agg(F.count(F.lit(1)).alias("n_transits"), F.countDistinct(who).alias("n_vessels"))


def gaps_of(track: DataFrame, least_hours: float = DARK_HOURS) -> DataFrame:
    return track.where(silent(least_hours)).select("mmsi", F.col("scope").alias("zone_key"), F.col("_p.ts").alias("gap_start"), F.col("ts").alias("gap_end"), hours(F.col("_p.ts"), F.col("ts")).alias("gap_hours"), F.col("_p.lon").alias("start_lon"), F.col("_p.lat").alias("start_lat"))


def dark_gaps(pos: DataFrame, zones: dict[str, Zone], least_hours: float = DARK_HOURS, tie: str | None = "event_id") -> DataFrame:
    """Silences of at least ``least_hours`` whose both ends lie inside the zone."""
    return gaps_of(tracked(pos, zones, tie=tie), least_hours)


def waiting_of(track: DataFrame, least_hours: float = WAIT_HOURS) -> DataFrame:
    """Runs of stopped fixes of a track; anchored if at least half report an anchored or moored status."""
    moored = F.count_if(F.col("nav_status").isin(*ANCHORED)) if "nav_status" in track.columns else F.lit(None)
    runs = track.where("_s").groupBy("scope", "mmsi", "_run").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("n_fixes"), moored.alias("_m"))
    state = F.when(F.col("_m").isNull(), "unknown").when(F.col("_m") * 2 >= F.col("n_fixes"), "anchored").otherwise("drifting")
    out = runs.select("mmsi", F.col("scope").alias("zone_key"), "start", "end", hours(F.col("start"), F.col("end")).alias("hours"), state.alias("state"), "n_fixes")
    return out.where(F.col("hours") >= least_hours)


def waiting_episodes(pos: DataFrame, zones: dict[str, Zone], max_speed: float = WAIT_SPEED_KN, least_hours: float = WAIT_HOURS, tie: str | None = "event_id") -> DataFrame:
    """Runs of fixes in the zone at no more than ``max_speed``; none where speeds are not known."""
    return waiting_of(tracked(pos, zones, max_speed, tie), least_hours)


def waiting_daily(episodes: DataFrame) -> DataFrame:
    """Vessels waiting on each UTC day that an episode touches; of a vessel's episodes of a day the first gives the state."""
    days = episodes.withColumn("date", F.explode(F.sequence(F.to_date("start"), F.to_date("end"))))
    ship = days.groupBy("date", "zone_key", "mmsi").agg(F.min_by("state", F.struct("start", "state")).alias("state"))
    return ship.groupBy("date", "zone_key").agg(F.count(F.lit(1)).alias("n_waiting"), F.count_if(F.col("state") == "anchored").alias("n_anchored"), F.count_if(F.col("state") == "drifting").alias("n_drifting"))
