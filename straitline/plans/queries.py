"""Every query of the registry: a Spark plan, and DuckDB SQL that returns the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from straitline.config import ZONES
from straitline.functions import windows as W
from straitline.operators import dynamics, forecast, laden, polygons, series, study, tracks, zone_daily
from straitline.session import ensure_workers
from straitline.testbed import ZONE_KEYS, Bed, with_views

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}

#: Looser thresholds of the shared-position flag, so that the test tables have hits.
LOOSE = {"unit": "hour", "decimals": 1, "vessels": 2}


def query(oracle: str | None = None):
    def register(f: Callable[[Bed], DataFrame]):
        _QUERIES[f.__name__] = lambda spark, sf_dir: f(Bed(ensure_workers(spark), sf_dir))
        if oracle:
            _ORACLES[f.__name__] = oracle
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


def r6(*names: str) -> dict:
    return {n: F.round(n, 6) for n in names}


# ---- tracks ----

_HAV = "2*3440.065*asin(sqrt(greatest(0, least(1, pow(sin(radians({b1}-{b0})/2),2) + cos(radians({b0}))*cos(radians({b1}))*pow(sin(radians({a1}-{a0})/2),2)))))"
_LAG = "lag({0}) OVER (PARTITION BY mmsi ORDER BY ts, event_id)"
_SPEED = f"""sp0 AS (SELECT *, {_LAG.format('lon')} AS plon, {_LAG.format('lat')} AS plat, {_LAG.format('ts')} AS pts FROM positions),
sp AS (SELECT *, {_HAV.format(a0='plon', a1='lon', b0='plat', b1='lat')} AS step_nm, date_diff('microsecond', pts, ts)/3.6e9 AS step_hours FROM sp0)"""


@query(f"{with_views('positions')}, {_SPEED} SELECT event_id, round(step_nm,6) AS step_nm, round(step_hours,6) AS step_hours, round(step_nm/nullif(step_hours,0),6) AS implied_speed_kn FROM sp")
def implied_speed(bed: Bed) -> DataFrame:
    return tracks.implied_speed(bed.positions).select("event_id", "step_nm", "step_hours", "implied_speed_kn").withColumns(r6("step_nm", "step_hours", "implied_speed_kn"))


_FLAGS = f"""{_SPEED},
cell AS (SELECT date_trunc('hour', ts) AS h, round_even(lat,1) AS y, round_even(lon,1) AS x FROM positions GROUP BY 1,2,3 HAVING count(DISTINCT mmsi) >= 2),
fl0 AS (SELECT sp.event_id, mmsi, ts, lon, lat, sog, nav_status, coalesce(step_nm/nullif(step_hours,0) > 40, false) AS flag_impossible_speed, cell.h IS NOT NULL AS flag_shared_position
  FROM sp LEFT JOIN cell ON date_trunc('hour', ts) = h AND round_even(lat,1) = y AND round_even(lon,1) = x),
fl AS (SELECT *, false AS flag_on_land, flag_impossible_speed OR flag_shared_position AS flag_any,
  CASE WHEN lon > 55.6 AND lon < 57.3 AND lat > 25.6 AND lat < 27.2 THEN 'hormuz' END AS zone_key FROM fl0)"""


@query(f"{with_views('positions')}, {_FLAGS} SELECT event_id, flag_impossible_speed, flag_shared_position, flag_on_land, flag_any FROM fl")
def quality_flags(bed: Bed) -> DataFrame:
    return tracks.quality_flags(bed.positions, **LOOSE).select("event_id", "flag_impossible_speed", "flag_shared_position", "flag_on_land", "flag_any")


@query(f"{with_views('positions')} SELECT event_id, CASE WHEN lon > 55.6 AND lon < 57.3 AND lat > 25.6 AND lat < 27.2 THEN 'hormuz' END AS zone_key FROM positions")
def zone_tag(bed: Bed) -> DataFrame:
    return tracks.tag_zones(bed.positions, ZONES).select("event_id", "zone_key")


#: A diamond and one of half its size, the hole in it: center and half axes.
_DIAMOND = (56.45, 26.4, 0.8137, 0.7771)


@query(f"""{with_views('positions')} SELECT event_id, 'hormuz' AS polygon FROM positions WHERE lon > 55.6 AND lon < 57.3 AND lat > 25.6 AND lat < 27.2
UNION ALL SELECT event_id, 'ring' FROM positions WHERE abs(lon - {_DIAMOND[0]}) / {_DIAMOND[2]} + abs(lat - {_DIAMOND[1]}) / {_DIAMOND[3]} BETWEEN 0.5 AND 1""")
def polygon_holders(bed: Bed) -> DataFrame:
    x, y, a, b = _DIAMOND
    rings = [("ring", [(x - a * k, y), (x, y - b * k), (x + a * k, y), (x, y + b * k)]) for k in (1.0, 0.5)]
    zones = polygons.layer_of(bed.spark, ZONES)
    cells = polygons.cover(zones.unionByName(bed.spark.createDataFrame(rings, zones.schema)))
    return polygons.holders(bed.positions, cells).select("event_id", F.explode("polygons").alias("polygon"))


@query(f"{with_views('positions')} SELECT event_id, 'hormuz' AS scope FROM positions WHERE lon BETWEEN 55.6 AND 57.3 AND lat BETWEEN 25.6 AND 27.2")
def bbox_scope(bed: Bed) -> DataFrame:
    return tracks.scope(bed.positions, ZONES).select("event_id", "scope")


def _cross(source: str) -> str:
    """Gate crossings of ``source`` at the one zone that the test positions touch."""
    side = lambda x, y: f"((56.36-56.53)*({y}-26.50)-(26.85-26.50)*({x}-56.53))"
    return f"""cr0 AS (SELECT mmsi, event_id, ts, lon, lat, {_LAG.format('lon')} AS x0, {_LAG.format('lat')} AS y0, {_LAG.format('ts')} AS t0
  FROM {source} WHERE lon BETWEEN 55.6 AND 57.3 AND lat BETWEEN 25.6 AND 27.2),
cr1 AS (SELECT *, {side('x0', 'y0')} AS s0, {side('lon', 'lat')} AS s1, (lon-x0)*(26.50-y0)-(lat-y0)*(56.53-x0) AS g0, (lon-x0)*(26.85-y0)-(lat-y0)*(56.36-x0) AS g1 FROM cr0 WHERE t0 IS NOT NULL),
cr AS (SELECT mmsi, 'hormuz' AS zone_key, t0 + to_microseconds(CAST(round(date_diff('microsecond', t0, ts) * (s0/(s0-s1))) AS BIGINT)) AS crossing_time,
  CASE WHEN s1 > 0 THEN 'inbound' ELSE 'outbound' END AS direction, date_diff('microsecond', t0, ts)/3.6e9 AS gap_hours,
  x0 + s0/(s0-s1)*(lon-x0) AS crossing_lon, y0 + s0/(s0-s1)*(lat-y0) AS crossing_lat, date_diff('microsecond', t0, ts)/3.6e9 > 6 AS ambiguous, event_id
  FROM cr1 WHERE sign(s0)*sign(s1) < 0 AND sign(g0)*sign(g1) <= 0)"""


@query(f"{with_views('positions')}, {_cross('positions')} SELECT mmsi, zone_key, date_trunc('second', crossing_time) AS crossing_second, direction, round(gap_hours,6) AS gap_hours, round(crossing_lon,6) AS crossing_lon, round(crossing_lat,6) AS crossing_lat, ambiguous, event_id FROM cr")
def transits_raw(bed: Bed) -> DataFrame:
    t = tracks.transits(bed.positions, ZONES)
    return t.withColumns(r6("gap_hours", "crossing_lon", "crossing_lat")).withColumn("crossing_second", F.date_trunc("second", "crossing_time").cast("timestamp_ntz")).drop("crossing_time")


_IDENTITY = """im AS (SELECT mmsi, arg_max(imo, (ts, event_id)) AS imo FROM static_reports WHERE imo IS NOT NULL GROUP BY 1),
vi AS (SELECT cr.*, im.imo, CASE WHEN im.imo IS NULL THEN 'mmsi:' || cr.mmsi ELSE 'imo:' || im.imo END AS vessel_id FROM cr LEFT JOIN im ON im.mmsi = cr.mmsi)"""
_DEDUP = """nu AS (SELECT *, row_number() OVER (PARTITION BY zone_key, vessel_id, direction ORDER BY crossing_time, event_id) AS k FROM vi),
de AS (SELECT *, crossing_time AS kept_at, true AS kept FROM nu WHERE k = 1
  UNION ALL SELECT nu.*, CASE WHEN date_diff('microsecond', de.kept_at, nu.crossing_time)/3.6e9 >= 6 THEN nu.crossing_time ELSE de.kept_at END,
    date_diff('microsecond', de.kept_at, nu.crossing_time)/3.6e9 >= 6
  FROM de JOIN nu ON nu.k = de.k + 1 AND nu.zone_key = de.zone_key AND nu.vessel_id = de.vessel_id AND nu.direction = de.direction)"""


@query(f"{with_views('positions', 'static_reports')}, {_cross('positions')}, {_IDENTITY} SELECT event_id, CAST(imo AS BIGINT) AS imo, vessel_id FROM vi")
def vessel_identity(bed: Bed) -> DataFrame:
    return tracks.vessel_identity(tracks.transits(bed.positions, ZONES), bed.static_reports).select("event_id", "imo", "vessel_id")


def _kept(bed: Bed) -> DataFrame:
    return tracks.deduplicate(tracks.vessel_identity(tracks.transits(bed.positions, ZONES), bed.static_reports))


@query(f"{with_views('positions', 'static_reports', recursive=True)}, {_cross('positions')}, {_IDENTITY}, {_DEDUP} SELECT event_id, vessel_id, direction, ambiguous FROM de WHERE kept")
def transits_dedup(bed: Bed) -> DataFrame:
    return _kept(bed).select("event_id", "vessel_id", "direction", "ambiguous")


@query(f"{with_views('positions', 'static_reports', recursive=True)}, {_cross('positions')}, {_IDENTITY}, {_DEDUP} SELECT CAST(crossing_time AS DATE) AS date, zone_key, direction, count(*) AS n_transits, count(DISTINCT vessel_id) AS n_vessels FROM de WHERE kept AND NOT ambiguous GROUP BY 1,2,3")
def transits_daily(bed: Bed) -> DataFrame:
    return tracks.transits_daily(_kept(bed))


_GAPS = f"""dg0 AS (SELECT *, lon > 55.6 AND lon < 57.3 AND lat > 25.6 AND lat < 27.2 AS inz FROM {{0}} WHERE lon BETWEEN 55.6 AND 57.3 AND lat BETWEEN 25.6 AND 27.2),
dg1 AS (SELECT *, {_LAG.format('inz')} AS pin, {_LAG.format('ts')} AS gap_start, {_LAG.format('lon')} AS start_lon, {_LAG.format('lat')} AS start_lat FROM dg0),
dg AS (SELECT mmsi, 'hormuz' AS zone_key, gap_start, ts AS gap_end, date_diff('microsecond', gap_start, ts)/3.6e9 AS gap_hours, start_lon, start_lat FROM dg1 WHERE inz AND pin AND date_diff('microsecond', gap_start, ts)/3.6e9 >= 12)"""
_WAIT = f"""wa0 AS (SELECT *, (lon > 55.6 AND lon < 57.3 AND lat > 25.6 AND lat < 27.2) AND coalesce(sog, 99) <= 1 AS s FROM {{0}} WHERE lon BETWEEN 55.6 AND 57.3 AND lat BETWEEN 25.6 AND 27.2),
wa1 AS (SELECT *, CASE WHEN s IS NOT DISTINCT FROM {_LAG.format('s')} THEN 0 ELSE 1 END AS b FROM wa0),
wa2 AS (SELECT *, sum(b) OVER (PARTITION BY mmsi ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM wa1),
wa AS (SELECT mmsi, 'hormuz' AS zone_key, min(ts) AS start, max(ts) AS "end", date_diff('microsecond', min(ts), max(ts))/3.6e9 AS hours,
  CASE WHEN 2*count(*) FILTER (nav_status IN (1,5)) >= count(*) THEN 'anchored' ELSE 'drifting' END AS state, count(*) AS n_fixes
  FROM wa2 WHERE s GROUP BY mmsi, run HAVING date_diff('microsecond', min(ts), max(ts))/3.6e9 >= 6),
wd0 AS (SELECT mmsi, zone_key, state, start, CAST(unnest(generate_series(CAST(start AS DATE), CAST("end" AS DATE), INTERVAL 1 DAY)) AS DATE) AS date FROM wa),
wd1 AS (SELECT date, zone_key, mmsi, arg_min(state, (start, state)) AS state FROM wd0 GROUP BY 1,2,3),
wd AS (SELECT date, zone_key, count(*) AS n_waiting, count(*) FILTER (state = 'anchored') AS n_anchored, count(*) FILTER (state = 'drifting') AS n_drifting FROM wd1 GROUP BY 1,2)"""


@query(f"{with_views('positions')}, {_GAPS.format('positions')} SELECT mmsi, zone_key, gap_start, gap_end, round(gap_hours,6) AS gap_hours, start_lon, start_lat FROM dg")
def dark_gaps(bed: Bed) -> DataFrame:
    return tracks.dark_gaps(bed.positions, ZONES).withColumns(r6("gap_hours"))


@query(f"{with_views('positions')}, {_WAIT.format('positions')} SELECT mmsi, zone_key, start, \"end\", round(hours,6) AS hours, state, n_fixes FROM wa")
def waiting_episodes(bed: Bed) -> DataFrame:
    return tracks.waiting_episodes(bed.positions, ZONES).withColumns(r6("hours"))


@query(f"{with_views('positions')}, {_WAIT.format('positions')} SELECT * FROM wd")
def waiting_daily(bed: Bed) -> DataFrame:
    return tracks.waiting_daily(tracks.waiting_episodes(bed.positions, ZONES))


# ---- laden, daily tables ----

_CLASS = """lc0 AS (SELECT *, CASE WHEN draught > 0 THEN draught END AS d FROM static_reports),
lc AS (SELECT *, max(d) OVER (PARTITION BY mmsi) AS own, max(ts) OVER () AS last_ts,
  CASE WHEN length_m < 120 THEN 7.0 WHEN length_m < 180 THEN 12.2 WHEN length_m < 250 THEN 17.0 WHEN length_m < 330 THEN 22.0 ELSE 24.5 END::DOUBLE AS typical FROM lc0)"""


@query(f"{with_views('static_reports')}, {_CLASS} SELECT event_id, d AS draught, coalesce(own, typical) AS full_draught, CASE WHEN own IS NULL THEN 'class' ELSE 'observed' END AS draught_source, d/coalesce(own, typical) >= 0.75 AS is_laden, round(date_diff('microsecond', ts, last_ts)/3.6e9, 6) AS draught_age_hours FROM lc")
def laden_class(bed: Bed) -> DataFrame:
    return laden.classify(bed.static_reports).select("event_id", "draught", "full_draught", "draught_source", "is_laden", F.round("draught_age_hours", 6).alias("draught_age_hours"))


_LADEN = f"""{_CLASS},
kn AS (SELECT mmsi, ts AS rts, arg_max(d/coalesce(own, typical) >= 0.75, event_id) AS is_laden FROM lc WHERE d IS NOT NULL GROUP BY 1,2),
pr AS (SELECT DISTINCT mmsi, date_trunc('day', ts) AS day FROM {{0}} WHERE lon > 55.6 AND lon < 57.3 AND lat > 25.6 AND lat < 27.2),
jn0 AS (SELECT pr.*, kn.rts, kn.is_laden FROM pr ASOF LEFT JOIN kn ON pr.mmsi = kn.mmsi AND pr.day >= kn.rts),
jn AS (SELECT mmsi, day, CASE WHEN day - rts <= INTERVAL 30 DAY THEN is_laden END AS is_laden, CASE WHEN day - rts <= INTERVAL 30 DAY THEN date_diff('microsecond', rts, CAST(day AS TIMESTAMP))/8.64e10 END AS age FROM jn0),
ld AS (SELECT CAST(day AS DATE) AS date, 'hormuz' AS zone_key, count(*) AS n_present, count(is_laden) AS n_laden_known, count(*) FILTER (is_laden) AS n_laden, median(age) AS median_draught_age_days,
  count(*) FILTER (is_laden) / nullif(count(is_laden), 0)::DOUBLE AS laden_share FROM jn GROUP BY 1)"""


@query(f"{with_views('positions', 'static_reports')}, {_LADEN.format('positions')} SELECT date, zone_key, n_present, n_laden_known, n_laden, round(median_draught_age_days,6) AS median_draught_age_days, round(laden_share,6) AS laden_share FROM ld")
def laden_daily(bed: Bed) -> DataFrame:
    return laden.laden_daily(bed.positions, bed.static_reports, ZONES).withColumns(r6("median_draught_age_days", "laden_share"))


_QUALITY = """qd0 AS (SELECT CAST(ts AS DATE) AS date, coalesce(zone_key, 'outside_zones') AS zone_key, count(*) AS n_positions, count(DISTINCT mmsi) AS n_vessels, count(DISTINCT hour(ts)) AS hours_with_data,
  count(*) FILTER (flag_impossible_speed) AS n_impossible_speed, count(*) FILTER (flag_shared_position) AS n_shared_position, CAST(0 AS BIGINT) AS n_on_land, count(*) FILTER (flag_any) AS n_flagged_any FROM fl GROUP BY 1,2),
qd1 AS (SELECT CAST(gap_start AS DATE) AS date, zone_key, count(*) AS n_dark_gaps FROM dg GROUP BY 1,2),
qd AS (SELECT qd0.*, coalesce(n_dark_gaps, 0) AS n_dark_gaps FROM qd0 LEFT JOIN qd1 USING (date, zone_key))"""


@query(f"{with_views('positions')}, {_FLAGS}, cl AS (SELECT * FROM fl WHERE NOT flag_any), {_GAPS.format('cl')}, {_QUALITY} SELECT * FROM qd")
def quality_daily(bed: Bed) -> DataFrame:
    return zone_daily.ais_metrics(bed.positions, bed.static_reports, ZONES, **LOOSE)["quality_daily"]


_DIRECTIONS = ["eastbound", "inbound", "northbound", "northwestbound", "outbound", "southbound", "southeastbound", "westbound"]


@query(
    f"""{with_views('positions', 'static_reports', recursive=True)}, {_FLAGS}, cl AS (SELECT * FROM fl WHERE NOT flag_any), {_GAPS.format('cl')}, {_QUALITY}, {_WAIT.format('cl')}, {_LADEN.format('cl')},
{_cross('cl')}, {_IDENTITY}, {_DEDUP},
td AS (SELECT CAST(crossing_time AS DATE) AS date, zone_key, CAST(count(*) AS BIGINT) AS n_transits, {', '.join(f"count(*) FILTER (direction = '{d}') AS n_transits_{d}" for d in _DIRECTIONS)} FROM de WHERE kept AND NOT ambiguous GROUP BY 1,2)
SELECT date, zone_key, n_transits, {', '.join(f'n_transits_{d}' for d in _DIRECTIONS)}, n_waiting, n_anchored, n_drifting, n_present, n_laden_known, n_laden, round(median_draught_age_days,6) AS median_draught_age_days, round(laden_share,6) AS laden_share,
  n_positions, n_vessels, hours_with_data, n_impossible_speed, n_shared_position, n_on_land, n_flagged_any, n_dark_gaps
FROM td FULL JOIN wd USING (date, zone_key) FULL JOIN ld USING (date, zone_key) FULL JOIN qd USING (date, zone_key)"""
)
def ais_daily(bed: Bed) -> DataFrame:
    return zone_daily.ais_metrics(bed.positions, bed.static_reports, ZONES, **LOOSE)["ais_daily"].withColumns(r6("median_draught_age_days", "laden_share"))


# ---- series ----

_PANEL = """pp AS (SELECT date, b.value AS brent_spot, w.value AS wti_spot FROM brent b FULL JOIN wti w USING (date)),
pr1 AS (SELECT *, ln(brent_spot) - lag(ln(brent_spot)) OVER (ORDER BY date) AS r1 FROM pp)"""
_RET = ", ".join(f"round(ln(brent_spot) - lag(ln(brent_spot), {h}) OVER w, 6) AS brent_ret_{h}d, round(lead(ln(brent_spot), {h}) OVER w - ln(brent_spot), 6) AS brent_fwd_ret_{h}d" for h in (1, 5, 20))
_VOL = ", ".join(["CASE WHEN count(r1) OVER v = 20 THEN round(stddev_samp(r1) OVER v * sqrt(252), 6) END AS brent_rv_20d"] + [f"CASE WHEN count(r1) OVER f{h} = {h} THEN round(stddev_samp(r1) OVER f{h} * sqrt(252), 6) END AS brent_fwd_rv_{h}d" for h in (5, 20)])


@query(f"{with_views('brent', 'wti')}, {_PANEL} SELECT date, {_RET}, {_VOL} FROM pr1 WINDOW w AS (ORDER BY date), v AS (ORDER BY date ROWS 19 PRECEDING), f5 AS (ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), f20 AS (ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING)")
def returns_targets(bed: Bed) -> DataFrame:
    p = series.price_panel(bed.brent, bed.wti)
    cols = [c for c in p.columns if c.startswith("brent_") and ("ret" in c or "rv" in c)]
    return p.select("date", *[F.round(c, 6).alias(c) for c in cols])


@query(f"{with_views('brent', 'wti')}, {_PANEL}, s AS (SELECT date, brent_spot, wti_spot, brent_spot - wti_spot AS s FROM pp) SELECT date, round(brent_spot,6) AS brent_spot, round(wti_spot,6) AS wti_spot, round(s,6) AS brent_wti_spread, round(s - lag(s) OVER w, 6) AS brent_wti_spread_chg_1d, " + ", ".join(f"round(lead(s,{h}) OVER w - s, 6) AS brent_wti_spread_fwd_chg_{h}d" for h in (1, 5, 20)) + " FROM s WINDOW w AS (ORDER BY date)")
def price_panel(bed: Bed) -> DataFrame:
    p = series.price_panel(bed.brent, bed.wti)
    cols = ["brent_spot", "wti_spot", *[c for c in p.columns if "spread" in c]]
    return p.select("date", *[F.round(c, 6).alias(c) for c in cols])


def _z(n: int, v: str = "n_transits", g: str = "zone_key") -> str:
    w = f"(PARTITION BY {g} ORDER BY date ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN count({v}) OVER {w} >= {max(5, n // 4)} THEN ({v} - avg({v}) OVER {w}) / nullif(stddev_pop({v}) OVER {w}, 0) END"


_YOY_W = "(PARTITION BY zone_key ORDER BY date - DATE '1970-01-01' RANGE BETWEEN 378 PRECEDING AND 350 PRECEDING)"


@query(f"{with_views('chokepoint_daily')} SELECT date, zone_key, round({_z(28)}, 6) AS n_transits_z28d, round({_z(90)}, 6) AS n_transits_z90d, round((n_transits - avg(n_transits) OVER {_YOY_W}) / nullif(avg(n_transits) OVER {_YOY_W}, 0), 6) AS n_transits_yoy_dev FROM chokepoint_daily")
def baseline_features(bed: Bed) -> DataFrame:
    b = series.baselines(bed.chokepoint_daily, ["n_transits"])
    return b.select("date", "zone_key", *[F.round(c, 6).alias(c) for c in ("n_transits_z28d", "n_transits_z90d", "n_transits_yoy_dev")])


_PUB = "(date + 2 + CAST((2 - isodow(date + 2) + 7) % 7 AS INT))"


@query(f"{with_views('chokepoint_daily')} SELECT DISTINCT date, {_PUB} AS available_from FROM chokepoint_daily")
def publication_lag(bed: Bed) -> DataFrame:
    return series.published(bed.chokepoint_daily.select("date").distinct())


def _wide(names: tuple[str, ...] = ("n_transits", "n_total")) -> str:
    return f"wi AS (SELECT {_PUB} AS date, " + ", ".join(f"arg_max({m}, date) FILTER (zone_key = '{z}' AND {m} IS NOT NULL) AS {z}_{m}" for z in ZONE_KEYS for m in names) + " FROM chokepoint_daily GROUP BY 1)"


@query(f"{with_views('chokepoint_daily')}, {_wide()} SELECT * FROM wi")
def widen_daily(bed: Bed) -> DataFrame:
    return series.widen(bed.chokepoint_daily, "zone_key", ZONE_KEYS)[0]


@query(
    f"{with_views('brent', 'chokepoint_daily')}, {_wide(('n_transits',))}, j AS (SELECT b.date, "
    + ", ".join(f"{z}_n_transits" for z in ZONE_KEYS)
    + " FROM brent b LEFT JOIN wi ON wi.date = b.date) SELECT date, "
    + ", ".join(f"last_value({z}_n_transits IGNORE NULLS) OVER w AS {z}_n_transits, CAST(date - last_value(CASE WHEN {z}_n_transits IS NOT NULL THEN date END IGNORE NULLS) OVER w AS INT) AS {z}_n_transits_age_days" for z in ZONE_KEYS)
    + " FROM j WINDOW w AS (ORDER BY date ROWS UNBOUNDED PRECEDING)"
)
def carried_features(bed: Bed) -> DataFrame:
    wide, cols = series.widen(bed.chokepoint_daily, "zone_key", ZONE_KEYS, measures=["n_transits"])
    return series.carry_forward(bed.brent.select("date").join(wide, "date", "left"), cols)


@query(f"{with_views('chokepoint_daily')}, s AS (SELECT date, sum(n_transits) FILTER (zone_key = 'cape_of_good_hope') AS c, sum(n_transits) FILTER (zone_key = 'suez') AS s FROM chokepoint_daily GROUP BY 1) SELECT date, round(c / nullif(c + s, 0), 6) AS cape_suez_share FROM s")
def cross_route_share(bed: Bed) -> DataFrame:
    return series.cross_route(bed.chokepoint_daily, "n_transits").withColumns(r6("cape_suez_share"))


_MAP = "mp AS (SELECT DISTINCT port_key, port_group, port_id FROM port_cfg JOIN port_daily ON contains(lower(port_name), lower(match_name)))"


@query(f"{with_views('port_daily', 'port_cfg')}, {_MAP} SELECT port_key, port_id FROM mp UNION ALL SELECT port_key, NULL FROM port_cfg WHERE port_key NOT IN (SELECT port_key FROM mp)")
def port_resolution(bed: Bed) -> DataFrame:
    found, missing = series.resolve_ports(bed.port_daily, bed.port_cfg)
    return found.select("port_key", "port_id").unionByName(missing.select("port_key"), allowMissingColumns=True)


@query(f"{with_views('port_daily', 'port_cfg')}, {_MAP} SELECT date, port_group, sum(n_tanker) AS n_tanker FROM port_daily JOIN mp USING (port_id) GROUP BY 1,2")
def port_groups(bed: Bed) -> DataFrame:
    return series.port_groups(bed.port_daily, bed.port_cfg, "n_tanker")


_CATS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query(
    f"{with_views('brent', 'dated_events')} SELECT date, "
    + ", ".join(f"CAST(EXISTS (SELECT 1 FROM dated_events e WHERE e.date = b.date AND e.category = '{c}') AS INT) AS \"event_{c}\"" for c in _CATS)
    + ", CAST(date - (SELECT max(e.date) FROM dated_events e WHERE e.date <= b.date) AS INT) AS days_since_event FROM brent b"
)
def event_dummies(bed: Bed) -> DataFrame:
    return series.event_dummies(bed.brent.select("date"), bed.dated_events, _CATS)


@query()
def features_daily(bed: Bed) -> DataFrame:
    ais = zone_daily.ais_metrics(bed.positions, bed.static_reports, ZONES, **LOOSE)["ais_daily"]
    return series.feature_table(series.price_panel(bed.brent, bed.wti), bed.chokepoint_daily, zones=ZONE_KEYS, port_daily=bed.port_daily, ports=bed.port_cfg, groups=["gulf_export", "red_sea_export"], ais_daily=ais, events=bed.dated_events, categories=_CATS)


_XY = f"{with_views('brent', 'wti')}, {_PANEL}, xy AS (SELECT date, r1 AS x, ln(wti_spot) - lag(ln(wti_spot)) OVER (ORDER BY date) AS y0 FROM pr1), z AS (SELECT date, x, y0 AS y, CASE WHEN y0 IS NOT NULL THEN x END AS xm, CASE WHEN x IS NOT NULL THEN y0 END AS ym FROM xy)"


def _returns(bed: Bed) -> DataFrame:
    return series.price_panel(bed.brent, bed.wti).select("date", F.col("brent_ret_1d").alias("x"), F.col("wti_ret_1d").alias("y"))


@query(_XY + " SELECT date, " + ", ".join(f"CASE WHEN count(xm) OVER w{n} >= {n // 2} THEN round(covar_samp(xm, ym) OVER w{n} / nullif(stddev_samp(xm) OVER w{n} * stddev_samp(ym) OVER w{n}, 0), 6) END AS corr_{n}" for n in (60, 120)) + " FROM z WINDOW w60 AS (ORDER BY date ROWS 59 PRECEDING), w120 AS (ORDER BY date ROWS 119 PRECEDING)")
def rolling_corr(bed: Bed) -> DataFrame:
    w = Window.orderBy("date")
    return _returns(bed).select("date", *[F.round(W.rolling_corr(F.col("x"), F.col("y"), w, n), 6).alias(f"corr_{n}") for n in (60, 120)])


@query(_XY + " SELECT date, CASE WHEN count(xm) OVER w >= 60 THEN round(covar_samp(ym, xm) OVER w / nullif(var_samp(x) OVER w, 0), 6) END AS beta_120 FROM z WINDOW w AS (ORDER BY date ROWS 119 PRECEDING)")
def rolling_beta(bed: Bed) -> DataFrame:
    return _returns(bed).select("date", F.round(W.rolling_beta(F.col("y"), F.col("x"), Window.orderBy("date"), 120), 6).alias("beta_120"))


@query(f"{with_views('chokepoint_daily')} SELECT date, zone_key, CASE WHEN count(n_transits) OVER w >= 3 THEN round(avg(n_transits) OVER w, 6) END AS smoothed FROM chokepoint_daily WINDOW w AS (PARTITION BY zone_key ORDER BY date ROWS 6 PRECEDING)")
def smooth_mean(bed: Bed) -> DataFrame:
    return bed.chokepoint_daily.select("date", "zone_key", F.round(series.smooth(F.col("n_transits"), Window.partitionBy("zone_key").orderBy("date")), 6).alias("smoothed"))


# the first Tuesday two or more days after a date
@query(f"{with_views('chokepoint_daily')}, l AS (SELECT 2 + (2 - isodow(date + 2) + 7) % 7 AS d FROM chokepoint_daily) SELECT CAST(median(d) AS DOUBLE) AS median_lag_days, CAST(max(d) AS INT) AS max_lag_days FROM l")
def publication_lag_stats(bed: Bed) -> DataFrame:
    return series.lag_stats(series.published(bed.chokepoint_daily))


# ---- statistics ----

_STUDY = f"""{with_views('brent', 'wti', 'dated_events')}, {_PANEL},
ix AS (SELECT date, r1 AS ret, row_number() OVER (ORDER BY date) - 1 AS i FROM pr1),
ev AS (SELECT e.event, (SELECT min(i) FROM ix WHERE ix.date >= e.date) AS p FROM dated_events e),
ok AS (SELECT * FROM ev WHERE p - 5 - 10 - 120 >= 0 AND p + 20 <= (SELECT max(i) FROM ix)),
es AS (SELECT ok.event, ok.p, avg(ret) AS m, stddev_samp(ret) AS sd, count(ret) AS n FROM ok JOIN ix ON i >= p - 135 AND i < p - 15 GROUP BY 1,2),
pe AS (SELECT es.event, CAST(i - p AS INT) AS rel_day, ret, ret - m AS abnormal, CASE WHEN ret IS NOT NULL THEN sum(ret - m) OVER (PARTITION BY es.event ORDER BY i) END AS car
  FROM es JOIN ix ON i BETWEEN p - 5 AND p + 20 WHERE n >= 60 AND sd > 0)"""


def _study(bed: Bed) -> DataFrame:
    return study.per_event(series.price_panel(bed.brent, bed.wti), bed.dated_events, "brent_ret_1d")


@query(_STUDY + " SELECT event, rel_day, round(ret,6) AS ret, round(abnormal,6) AS abnormal, round(car,6) AS car FROM pe")
def event_study_per_event(bed: Bed) -> DataFrame:
    return _study(bed).withColumns(r6("ret", "abnormal", "car"))


@query(_STUDY + " SELECT rel_day, round(avg(car),6) AS mean_car, round(stddev_samp(car),6) AS std_car, count(car) AS n_events, round(avg(car)/nullif(stddev_samp(car)/sqrt(count(car)),0),6) AS t_stat FROM pe GROUP BY 1")
def event_study_avg(bed: Bed) -> DataFrame:
    return study.average(_study(bed)).withColumns(r6("mean_car", "std_car", "t_stat"))


@query()
def event_study_p(bed: Bed) -> DataFrame:
    return study.with_p(study.average(_study(bed)))


def _panel(bed: Bed) -> DataFrame:
    p = series.price_panel(bed.brent, bed.wti)
    return p.select("date", "brent_fwd_ret_5d", "brent_ret_1d", "brent_ret_5d", "brent_rv_20d", "wti_ret_1d")


_FOLDS = f"""{with_views('brent', 'wti')}, {_PANEL}, fp0 AS (SELECT date, lead(ln(brent_spot),5) OVER w - ln(brent_spot) AS y, r1 FROM pr1 WINDOW w AS (ORDER BY date)),
fp AS (SELECT date, y, row_number() OVER (ORDER BY date) - 1 AS i FROM fp0 WHERE y IS NOT NULL AND r1 IS NOT NULL),
cs AS (SELECT *, sum(y) OVER (ORDER BY i) AS c FROM fp),
fd AS (SELECT a.date, a.y AS y_true, b.c / (b.i + 1) AS y_pred, a.y - b.c / (b.i + 1) AS error, a.i - 5 AS n_train FROM cs a JOIN cs b ON b.i = 500 + 21*((a.i - 500)//21) - 5 - 1 WHERE a.i >= 500)"""


def _mean_forecast(bed: Bed) -> DataFrame:
    return forecast.walk_forward(_panel(bed).select("date", "brent_fwd_ret_5d", "brent_ret_1d"), "brent_fwd_ret_5d", ["brent_ret_1d"], forecast.Mean, 5)


def _zero_forecast(bed: Bed) -> DataFrame:
    return forecast.walk_forward(_panel(bed).select("date", "brent_fwd_ret_5d", "brent_ret_1d"), "brent_fwd_ret_5d", ["brent_ret_1d"], forecast.Zero, 5)


@query(_FOLDS + " SELECT date, round(y_true,6) AS y_true, round(y_pred,6) AS y_pred, round(error,6) AS error, n_train FROM fd")
def walk_forward_mean(bed: Bed) -> DataFrame:
    return _mean_forecast(bed).drop("n_train_fit").withColumns(r6("y_true", "y_pred", "error"))


@query(_FOLDS + " SELECT date, round(y_true,6) AS y_true, CAST(0 AS DOUBLE) AS y_pred, round(y_true,6) AS error, n_train FROM fd")
def walk_forward_zero(bed: Bed) -> DataFrame:
    return _zero_forecast(bed).drop("n_train_fit").withColumns(r6("y_true", "y_pred", "error"))


@query(_FOLDS + " SELECT round(sqrt(avg(error*error)),6) AS rmse, round(avg(abs(error)),6) AS mae, round(avg(CASE WHEN y_true <> 0 THEN CAST(sign(y_true) = sign(y_pred) AS INT) END),6) AS directional_accuracy, round(greatest(avg(CASE WHEN y_true <> 0 THEN CAST(y_true > 0 AS INT) END), 1 - avg(CASE WHEN y_true <> 0 THEN CAST(y_true > 0 AS INT) END)),6) AS majority_baseline, count(*) AS n FROM fd")
def scoreboard_mean(bed: Bed) -> DataFrame:
    return forecast.scores(_mean_forecast(bed)).withColumns(r6("rmse", "mae", "directional_accuracy", "majority_baseline"))


@query(
    _FOLDS
    + ", d AS (SELECT date, error*error - y_true*y_true AS d FROM fd), c AS (SELECT date, d - avg(d) OVER () AS c, avg(d) OVER () AS m, count(*) OVER () AS n FROM d), l AS (SELECT *, "
    + ", ".join(f"c * lag(c,{k}) OVER (ORDER BY date) AS p{k}" for k in range(1, 5))
    + " FROM c), s AS (SELECT n, m, (sum(c*c) + "
    + " + ".join(f"2*{1 - k / 5}*sum(p{k})" for k in range(1, 5))
    + ") / n AS v FROM l GROUP BY n, m) SELECT round(m / sqrt(v / n) * sqrt((n + 1 - 10 + 20.0 / n) / n), 6) AS dm_stat, round(m, 9) AS mean_loss_differential, n FROM s"
)
def dm_stat(bed: Bed) -> DataFrame:
    d = forecast.diebold_mariano(_mean_forecast(bed), _zero_forecast(bed), 5)
    return d.select(F.round("dm_stat", 6).alias("dm_stat"), F.round("mean_loss_differential", 9).alias("mean_loss_differential"), "n")


@query()
def forecast_ladder(bed: Bed) -> DataFrame:
    return forecast.compare(_panel(bed), "brent_fwd_ret_5d", ["brent_ret_1d", "brent_rv_20d"], ["wti_ret_1d"], 5)


@query()
def granger(bed: Bed) -> DataFrame:
    return dynamics.granger_both(_panel(bed), "brent_ret_1d", "wti_ret_1d")


_LAG_ONE = _XY + """, c AS (SELECT date, x, y0 AS y FROM xy WHERE x IS NOT NULL AND y0 IS NOT NULL), g0 AS (SELECT x, y, lag(x) OVER (ORDER BY date) AS x1, lag(y) OVER (ORDER BY date) AS y1 FROM c), g AS (SELECT * FROM g0 WHERE x1 IS NOT NULL),
m AS (SELECT count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(x1) AS mx1, avg(y1) AS my1, regr_sxy(x1,x1) AS s11, regr_sxy(y1,y1) AS s22, regr_sxy(x1,y1) AS s12, regr_sxy(x,x) AS sxx, regr_sxy(y,y) AS syy, regr_sxy(x,x1) AS sx1, regr_sxy(x,y1) AS sx2, regr_sxy(y,x1) AS sy1, regr_sxy(y,y1) AS sy2 FROM g),
k AS (SELECT *, (sx1*s22 - sx2*s12)/(s11*s22 - s12*s12) AS bx1, (sx2*s11 - sx1*s12)/(s11*s22 - s12*s12) AS bx2, (sy1*s22 - sy2*s12)/(s11*s22 - s12*s12) AS by1, (sy2*s11 - sy1*s12)/(s11*s22 - s12*s12) AS by2 FROM m)"""


@query(
    _LAG_ONE
    + """ SELECT 'brent_ret_1d' AS cause, 'wti_ret_1d' AS effect, round(((syy - sy2*sy2/s22) - (syy - by1*sy1 - by2*sy2)) / ((syy - by1*sy1 - by2*sy2) / (n - 3)), 4) AS f_stat, n AS n_obs FROM k
UNION ALL SELECT 'wti_ret_1d', 'brent_ret_1d', round(((sxx - sx1*sx1/s11) - (sxx - bx1*sx1 - bx2*sx2)) / ((sxx - bx1*sx1 - bx2*sx2) / (n - 3)), 4), n FROM k"""
)
def granger_lag1(bed: Bed) -> DataFrame:
    return dynamics.granger_both(_panel(bed), "brent_ret_1d", "wti_ret_1d", 1).select("cause", "effect", F.round("f_stat", 4).alias("f_stat"), "n_obs")


@query(
    _LAG_ONE
    + """ SELECT 'brent_ret_1d' AS equation, 'const' AS term, round(mx - bx1*mx1 - bx2*my1, 6) AS coef FROM k UNION ALL SELECT 'brent_ret_1d', 'L1.brent_ret_1d', round(bx1, 6) FROM k UNION ALL SELECT 'brent_ret_1d', 'L1.wti_ret_1d', round(bx2, 6) FROM k
UNION ALL SELECT 'wti_ret_1d', 'const', round(my - by1*mx1 - by2*my1, 6) FROM k UNION ALL SELECT 'wti_ret_1d', 'L1.brent_ret_1d', round(by1, 6) FROM k UNION ALL SELECT 'wti_ret_1d', 'L1.wti_ret_1d', round(by2, 6) FROM k"""
)
def var_one(bed: Bed) -> DataFrame:
    return dynamics.var_model(_panel(bed), ["brent_ret_1d", "wti_ret_1d"], lag=1).withColumns(r6("coef"))


@query(
    _XY
    + """, c AS (SELECT date, x, y0 AS s FROM xy WHERE x IS NOT NULL AND y0 IS NOT NULL), m AS (SELECT count(*) AS n, avg(x) AS mx, avg(s) AS ms, regr_sxy(x, s) / regr_sxy(s, s) AS b, regr_sxy(s, s) AS q FROM c),
v AS (SELECT date, n, b, ((x - mx) - b * (s - ms)) * (s - ms) / q AS v FROM c, m), w AS (SELECT n, b, v, lag(v) OVER (ORDER BY date) AS v1 FROM v), e AS (SELECT n, b, sqrt(sum(v*v) + sum(v*v1)) AS se FROM w GROUP BY n, b)
SELECT CAST(0 AS INT) AS horizon, round(b, 6) AS beta, round(se, 6) AS std_err, round(b / se, 4) AS t_stat, round(b - 1.96::DOUBLE * se, 6) AS ci_low, round(b + 1.96::DOUBLE * se, 6) AS ci_high, n AS n_obs FROM e"""
)
def local_projection_h0(bed: Bed) -> DataFrame:
    got = dynamics.local_projection(_panel(bed), "brent_ret_1d", "wti_ret_1d", 0, 0)
    return got.select("horizon", *[F.round(c, 6).alias(c) for c in ("beta", "std_err")], F.round("t_stat", 4).alias("t_stat"), *[F.round(c, 6).alias(c) for c in ("ci_low", "ci_high")], "n_obs")


@query()
def local_projection(bed: Bed) -> DataFrame:
    return dynamics.local_projection(_panel(bed), "brent_ret_1d", "wti_ret_1d", 10)


@query()
def var_lags(bed: Bed) -> DataFrame:
    return dynamics.var_lags(_panel(bed), ["brent_ret_1d", "wti_ret_1d"])


@query()
def var_model(bed: Bed) -> DataFrame:
    return dynamics.var_model(_panel(bed), ["brent_ret_1d", "wti_ret_1d"])


@query()
def stationarity(bed: Bed) -> DataFrame:
    return dynamics.stationarity(_panel(bed), ["brent_ret_1d", "brent_rv_20d", "wti_ret_1d"])


# ---- sources ----


@query(f"{with_views('port_daily')} SELECT port_id, port_name, count(DISTINCT date) AS n_days, min(date) AS first_date, max(date) AS last_date FROM port_daily GROUP BY 1,2")
def entity_directory(bed: Bed) -> DataFrame:
    return bed.port_daily.groupBy("port_id", "port_name").agg(F.countDistinct("date").alias("n_days"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@query(f"{with_views('brent', 'wti')}, {_PANEL} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS n, round(count({c})/count(*)::DOUBLE,6) AS share, min(date) FILTER ({c} IS NOT NULL) AS first_date, max(date) FILTER ({c} IS NOT NULL) AS last_date FROM pp" for c in ("brent_spot", "wti_spot")))
def coverage(bed: Bed) -> DataFrame:
    p = series.price_panel(bed.brent, bed.wti)
    parts = [p.agg(F.lit(c).alias("column"), F.count(c).alias("n"), F.round(F.count(c) / F.count(F.lit(1)), 6).alias("share"), F.min(F.when(F.col(c).isNotNull(), F.col("date"))).alias("first_date"), F.max(F.when(F.col(c).isNotNull(), F.col("date"))).alias("last_date")) for c in ("brent_spot", "wti_spot")]
    return parts[0].unionByName(parts[1])


def ship_category(code):
    """Tanker, cargo, other or unknown of a ship type code."""
    return F.when(code.isNull(), "unknown").when(code.between(80, 89), "tanker").when(code.between(70, 79), "cargo").otherwise("other")


@query(f"{with_views('static_reports')} SELECT event_id, CASE WHEN ship_type IS NULL THEN 'unknown' WHEN ship_type BETWEEN 80 AND 89 THEN 'tanker' WHEN ship_type BETWEEN 70 AND 79 THEN 'cargo' ELSE 'other' END AS ship_category FROM static_reports")
def ship_categories(bed: Bed) -> DataFrame:
    return bed.static_reports.select("event_id", ship_category(F.col("ship_type")).alias("ship_category"))
