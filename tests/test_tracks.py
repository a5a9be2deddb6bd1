"""Hand-made tracks around the Hormuz gate."""

import datetime as dt

from pyspark.sql import functions as F

from straitline.config import ZONES
from straitline.operators import laden, tracks, zone_daily

HORMUZ = {"hormuz": ZONES["hormuz"]}
T0 = dt.datetime(2026, 3, 2)
(AX, AY), (BX, BY) = ZONES["hormuz"].gate
MX, MY = (AX + BX) / 2, (AY + BY) / 2
NX, NY = -(BY - AY) / 0.3891, (BX - AX) / 0.3891  # unit normal, to the positive side
PLUS, MINUS = (MX + 0.1 * NX, MY + 0.1 * NY), (MX - 0.1 * NX, MY - 0.1 * NY)
POS = "event_id long, mmsi long, ts timestamp_ntz, lon double, lat double, sog double, nav_status int"


def track(spark, points, mmsi=1, sog=10.0, status=0):
    return spark.createDataFrame([(i, mmsi, T0 + dt.timedelta(hours=h), float(x), float(y), sog, status) for i, (h, (x, y)) in enumerate(points)], POS)


def kept(df):
    return tracks.deduplicate(tracks.vessel_identity(df, None)).collect()


def test_both_directions_and_interpolated_time(spark):
    rows = tracks.transits(track(spark, [(0, MINUS), (2, PLUS), (4, MINUS)]), HORMUZ).orderBy("crossing_time").collect()
    assert [r.direction for r in rows] == ["inbound", "outbound"]
    assert abs((rows[0].crossing_time - T0).total_seconds() - 3600) < 1 and not rows[0].ambiguous
    assert abs(rows[0].crossing_lon - MX) < 1e-6 and rows[0].gap_hours == 2.0


def test_long_gap_is_ambiguous_and_kept(spark):
    rows = tracks.transits(track(spark, [(0, MINUS), (12, PLUS)]), HORMUZ)
    assert [r.ambiguous for r in rows.collect()] == [True]
    daily = tracks.transits_daily(tracks.vessel_identity(rows, None))
    assert daily.count() == 0 and tracks.transits_daily(rows, include_ambiguous=True).count() == 1


def test_touching_or_passing_beside_is_no_crossing(spark):
    for points in ([(0, MINUS), (1, (AX, AY)), (2, MINUS)], [(0, MINUS), (1, (MINUS[0] + 0.01, MINUS[1]))], [(0, (55.7, 25.7)), (1, (55.8, 25.8))]):
        assert tracks.transits(track(spark, points), HORMUZ).count() == 0


def test_oscillation_and_second_voyage(spark):
    steps = [(k / 3, PLUS if k % 2 else MINUS) for k in range(8)]
    assert sorted(r.direction for r in kept(tracks.transits(track(spark, steps), HORMUZ))) == ["inbound", "outbound"]
    again = [(0, MINUS), (1, PLUS), (73, MINUS), (74, PLUS)]
    inbound = [r for r in kept(tracks.transits(track(spark, again), HORMUZ)) if r.direction == "inbound"]
    assert len(inbound) == 2


def test_separation_counts_from_the_last_kept(spark):
    rows = [(i, 1, "hormuz", T0 + dt.timedelta(hours=h), "inbound", "v") for i, h in enumerate((0, 1, 7, 8, 14, 19, 25))]
    df = spark.createDataFrame(rows, "event_id long, mmsi long, zone_key string, crossing_time timestamp_ntz, direction string, vessel_id string")
    assert sorted(r.event_id for r in tracks.deduplicate(df).collect()) == [0, 2, 4, 6]


def test_identity_takes_the_latest_known_imo(spark):
    t = tracks.transits(track(spark, [(0, MINUS), (2, PLUS)]), HORMUZ)
    s = spark.createDataFrame([(1, 1, T0, 111), (2, 1, T0 + dt.timedelta(days=1), 222), (3, 1, T0 + dt.timedelta(days=2), None)], "event_id long, mmsi long, ts timestamp_ntz, imo long")
    assert [r.vessel_id for r in tracks.vessel_identity(t, s).collect()] == ["imo:222"]


def test_waiting_gaps_and_daily_fleet(spark):
    inside = (56.2, 26.6)
    e = tracks.waiting_episodes(track(spark, [(h, inside) for h in range(10)], sog=0.2, status=1), HORMUZ).collect()
    assert [(r.hours, r.state, r.n_fixes) for r in e] == [(9.0, "anchored", 10)]
    assert tracks.waiting_episodes(track(spark, [(h, inside) for h in range(5)], sog=0.2), HORMUZ).count() == 0
    assert tracks.waiting_episodes(track(spark, [(0, inside)]).drop("sog"), HORMUZ).count() == 0
    three = tracks.waiting_daily(tracks.waiting_episodes(track(spark, [(h, inside) for h in (20, 30, 50)], sog=0.5), HORMUZ))
    assert three.count() == 3 and {r.n_drifting for r in three.collect()} == {1}
    gap = tracks.dark_gaps(track(spark, [(0, inside), (15, inside)]), HORMUZ).collect()
    assert [g.gap_hours for g in gap] == [15.0]
    assert tracks.dark_gaps(track(spark, [(0, (55.6, 26.6)), (15, inside)]), HORMUZ).count() == 0  # an edge is outside


def test_flags(spark):
    fast = tracks.quality_flags(track(spark, [(0, (56.0, 26.0)), (1, (57.0, 27.0))])).orderBy("ts").collect()
    assert [r.flag_impossible_speed for r in fast] == [False, True] and [r.flag_any for r in fast] == [False, True]
    crowd = track(spark, [(0, (56.00004, 26.0))], mmsi=1)
    for m in range(2, 6):
        crowd = crowd.union(track(spark, [(0, (56.00003, 26.0))], mmsi=m))
    assert {r.flag_shared_position for r in tracks.quality_flags(crowd).collect()} == {True}
    land = tracks.quality_flags(crowd, on_land=F.col("mmsi") == 3)
    assert land.where("flag_on_land").count() == 1
    try:
        tracks.implied_speed(crowd.drop("lat"))
        raise AssertionError
    except KeyError as e:
        assert "lat" in str(e)


def test_laden(spark):
    s = spark.createDataFrame([(i, 1, T0 + dt.timedelta(days=i), d, 330.0) for i, d in enumerate((22.0, 21.5, 9.0, 0.0))] + [(9, 2, T0, 0.0, 330.0)], "event_id long, mmsi long, ts timestamp_ntz, draught double, length_m double")
    assert [r.is_laden for r in laden.classify(s).orderBy("event_id").collect()] == [True, True, False, None, None]
    assert {r.full_draught for r in laden.classify(s).where("mmsi = 2").collect()} == {24.5}
    pos = track(spark, [(24 * 10 + 5, (56.2, 26.6)), (24 * 60 + 5, (56.2, 26.6)), (-48, (56.2, 26.6))])
    got = {r.date: (r.n_present, r.n_laden_known, r.laden_share) for r in laden.laden_daily(pos, s, HORMUZ).collect()}
    assert got == {dt.date(2026, 3, 12): (1, 1, 0.0), dt.date(2026, 5, 1): (1, 0, None), dt.date(2026, 2, 28): (1, 0, None)}


def test_one_row_a_zone_day_and_fixed_columns(spark):
    pos = track(spark, [(h, MINUS if h % 2 else PLUS) for h in range(0, 48, 2)])
    out = zone_daily.ais_metrics(pos, None, ZONES)["ais_daily"]
    assert out.count() == out.select("date", "zone_key").distinct().count()
    assert "n_transits_eastbound" in out.columns
    tagged = tracks.tag_zones(pos.withColumn("zone_key", F.lit("mine")), ZONES)
    assert {r.zone_key for r in tagged.collect()} == {"mine"}


def test_a_jump_between_regions_is_no_transit(spark):
    pos = track(spark, [(0, MINUS), (1, (32.35, 30.4)), (2, PLUS), (3, (32.35, 30.6))])
    rows = {(r.zone_key, r.direction) for r in tracks.transits(pos, ZONES).collect()}
    assert rows == {("hormuz", "inbound"), ("suez", "northbound")}
