"""Snapshots, the lake, paging, and the feed in batch and as a stream."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from straitline.config import ZONES
from straitline.operators import tracks
from straitline.sources import rest
from straitline.sources.catalog import Catalog, decode, encode
from straitline.streaming import feed

UTC = dt.timezone.utc


def test_vintages(spark, tmp_path):
    """Three snapshots written out of order, one of them by a clock without a zone; each day sees the newest that existed."""
    c = Catalog(spark, str(tmp_path))
    rows = lambda *names: spark.createDataFrame([(n,) for n in names], "port string")
    noon = dt.datetime(2019, 12, 31, 12, 0, 0, tzinfo=UTC)
    c.write_vintage(rows("basrah", "jebel ali", "yanbu"), "harbours", noon + dt.timedelta(days=40))
    c.write_vintage(rows("basrah"), "harbours", noon.astimezone(dt.timezone(dt.timedelta(hours=5))))
    c.write_vintage(rows("basrah", "yanbu"), "harbours", dt.datetime(2020, 1, 5, 23, 59, 59))
    assert c.vintages("harbours") == sorted(c.vintages("harbours")) and [decode(v) for v in c.vintages("harbours")][0] == noon
    seen = {day: c.read_vintage("harbours", dt.date.fromisoformat(day)).count() for day in ("2019-12-31", "2020-01-04", "2020-01-05", "2020-02-08", "2020-02-09")}
    assert list(seen.values()) == [1, 1, 2, 2, 3] and c.read_vintage("harbours").count() == 3
    assert c.resolve("harbours", noon) == encode(noon)
    with pytest.raises(FileNotFoundError, match="harbours"):
        c.resolve("harbours", noon - dt.timedelta(seconds=1))
    with pytest.raises(Exception, match="(?i)exist"):  # the same second from another zone
        c.write_vintage(rows("other"), "harbours", noon.astimezone(dt.timezone(-dt.timedelta(hours=3))))
    with pytest.raises(FileNotFoundError):
        c.resolve("berths")


def test_lake_and_views(spark, tmp_path):
    c = Catalog(spark, str(tmp_path))
    rows = spark.createDataFrame([(i, dt.datetime(2026, 3, 1 + i, 5)) for i in range(4)], "mmsi long, ts timestamp_ntz")
    c.append(rows, "ais")
    assert {r.mmsi for r in c.read_partitions("ais", dt.date(2026, 3, 2), dt.date(2026, 3, 3)).collect()} == {1, 2}
    for day in ("2026-03-01", "2026-03-02", "notes"):
        rows.limit(1).write.parquet(f"{tmp_path}/raw/old/{day}/05")
    assert c.read_legacy("old", "mmsi long, ts timestamp_ntz", dt.date(2026, 3, 2)).count() == 1
    assert c.read_legacy("none", "mmsi long").count() == 0
    c.write_processed(rows, "tracks")
    assert c.register_views() == ["tracks"] and spark.sql("select count(*) n from tracks").first().n == 4
    with pytest.raises(FileNotFoundError):
        c.read_processed("nothing")


def test_paging_and_retry():
    calls = []

    def layer(url, params):
        calls.append(params)
        at, n = params["resultOffset"], params["resultRecordCount"]
        return {"features": [{"attributes": {"ObjectId": i}} for i in range(at, min(at + n, 25))], "exceededTransferLimit": at + n < 25}

    assert [len(p) for p in rest.layer_pages(layer, "u", page_size=10)] == [10, 10, 5] and calls[0]["orderByFields"] == "ObjectId ASC"
    with pytest.raises(RuntimeError, match="narrow"):
        list(rest.layer_pages(layer, "u", page_size=10, max_records=20))
    waits, fails = [], iter([rest.ServerError("503"), rest.ServerError("503"), None])

    def flaky(url, params):
        e = next(fails)
        if e:
            raise e
        return {"response": {"data": [1, 2]}}

    assert list(rest.price_pages(flaky, "u", {}, 5, sleep=waits.append)) == [[1, 2]] and waits == [3.0, 6.0]
    with pytest.raises(ValueError):
        rest.with_retry(lambda u, p: (_ for _ in ()).throw(ValueError("400")), "u", {}, sleep=waits.append)
    with pytest.raises(RuntimeError, match="bad"):
        rest.with_retry(lambda u, p: {"error": "bad"}, "u", {})


def test_price_csv_and_fallback(spark, tmp_path, caplog):
    (tmp_path / "p.csv").write_text("DATE,V\n2024-01-02,77.5\n2024-01-03,.\n2024-01-04,-3\n")
    df = rest.read_price_csv(spark, str(tmp_path / "p.csv"))
    assert [(r.date.day, r.value) for r in df.orderBy("date").collect()] == [(2, 77.5), (4, -3.0)]

    def down():
        raise RuntimeError("set EIA_API_KEY in the environment")

    got = rest.spot(down, lambda: df, "2024-01-03")
    assert "EIA_API_KEY" in caplog.text and "fallback" in caplog.text
    assert got.count() == 1 and rest.spot(lambda: df.limit(0), lambda: df).count() == 0


def test_normalise(spark):
    raw = spark.createDataFrame([("1704153600000", "c1", "Suez", 3), ("2024-01-03", "c1", "Suez", 4), ("soon", "c2", "X", 5)], "date string, portid string, portname string, n int")
    out = rest.normalise_daily(raw, "chokepoint").orderBy("n").collect()
    assert [r.date for r in out] == [dt.date(2024, 1, 2), dt.date(2024, 1, 3), None] and out[0].chokepoint_id == "c1"


def message(kind, body, **meta):
    return json.dumps({"MessageType": kind, "MetaData": {"MMSI": 7, "ShipName": " A ", "latitude": 26.6, "longitude": 56.2, "time_utc": "2026-03-02 10:00:00.123456789 +0000 UTC"} | meta, "Message": {kind: body}})


def test_envelopes(spark):
    raw = spark.createDataFrame([(message("PositionReport", {"UserID": 7, "Latitude": 26.6, "Longitude": 56.2, "Sog": 3.5, "NavigationalStatus": 1}),), (message("ShipStaticData", {"UserID": 7, "ImoNumber": 0, "Name": " ", "Type": 84, "MaximumStaticDraught": 11.0, "Dimension": {"A": 200.0, "B": 30.0}}),), (message("StaticDataReport", {"UserID": 8, "ReportB": {"ShipType": 70}}),), ("not json",), (message("PositionReport", {"UserID": 9}, latitude=0.0, longitude=0.0, time_utc="?"),)], "value string")
    env = feed.envelopes(raw)
    p = {r.mmsi: r for r in feed.positions(env).collect()}
    assert p[7].zone_key == "hormuz" and p[7].ship_name == "A" and p[7].ts.microsecond == 123456 and p[9].zone_key is None and p[9].ts is not None
    s = {r.mmsi: r for r in feed.static_reports(env).collect()}
    assert s[7].imo is None and s[7].name is None and s[7].length_m == 230.0 and s[8].ship_type == 70
    assert "APIKey" in feed.subscription(ZONES, "k")


def test_live_transits_equal_the_batch(spark, tmp_path):
    (ax, ay), (bx, by) = ZONES["hormuz"].gate
    mx, my, nx, ny = (ax + bx) / 2, (ay + by) / 2, -(by - ay), bx - ax
    rows = [(i, i % 3, dt.datetime(2026, 3, 1 + i // 24, i % 24), mx + nx * 0.2 * (-1) ** (i // 4), my + ny * 0.2 * (-1) ** (i // 4)) for i in range(72)]
    df = spark.createDataFrame(rows, "event_id long, mmsi long, ts timestamp_ntz, lon double, lat double")
    for day in range(3):
        df.where(F.dayofmonth("ts") == day + 1).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = feed.live_transits(stream, ZONES["hormuz"]).writeStream.format("memory").queryName("live").outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    key = lambda r: (r.mmsi, r.direction, round(r.gap_hours, 6), r.ambiguous)
    batch = tracks.transits(df, {"hormuz": ZONES["hormuz"]}).collect()
    assert sorted(map(key, spark.table("live").collect())) == sorted(map(key, batch)) and batch
