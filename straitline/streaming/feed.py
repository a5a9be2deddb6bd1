"""Live position feed: envelopes parsed by expressions, a file sink by hour, live transits with keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from straitline.config import ZONES, Zone
from straitline.functions import geo

ENVELOPE = "MessageType string, MetaData struct<MMSI:bigint,ShipName:string,latitude:double,longitude:double,time_utc:string>, Message map<string,string>, error string"
POSITION = "UserID bigint, Latitude double, Longitude double, Sog double, Cog double, TrueHeading int, NavigationalStatus int"
STATIC = "UserID bigint, ImoNumber bigint, Name string, CallSign string, Type int, MaximumStaticDraught double, Dimension struct<A:double,B:double,C:double,D:double>, Destination string, ReportA struct<Name:string>, ReportB struct<CallSign:string,ShipType:int,Dimension:struct<A:double,B:double,C:double,D:double>>"
POSITION_TYPES = ("PositionReport", "StandardClassBPositionReport", "ExtendedClassBPositionReport")
STATIC_TYPES = ("ShipStaticData", "StaticDataReport")


def envelopes(raw: DataFrame, column: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Parsed envelopes with their body as JSON text under the message's own type, and the columns to ``keep``."""
    return raw.select(F.from_json(F.col(column).cast("string"), ENVELOPE).alias("e"), *keep).select("e.*", *keep).withColumn("body", F.element_at("Message", F.col("MessageType")))


def feed_time(text: Column) -> Column:
    """The feed's time without its zone words; arrival time if it doesn't parse. Nanoseconds are cut to micros."""
    clean = F.regexp_replace(F.regexp_replace(text, r" \+0000 UTC$", ""), r"(\.\d{6})\d+", "$1")
    return F.coalesce(F.try_to_timestamp(clean), F.current_timestamp())


def positions(env: DataFrame, zones: dict[str, Zone] = ZONES, keep: tuple[str, ...] = ()) -> DataFrame:
    """Position rows; those outside all zones stay, with a null zone."""
    p = env.where(F.col("MessageType").isin(*POSITION_TYPES)).withColumn("b", F.from_json("body", POSITION))
    p = p.select(F.coalesce("b.UserID", "MetaData.MMSI").alias("mmsi"), feed_time(F.col("MetaData.time_utc")).alias("ts"), F.coalesce("b.Latitude", "MetaData.latitude").alias("lat"), F.coalesce("b.Longitude", "MetaData.longitude").alias("lon"), F.col("b.Sog").alias("sog"), F.col("b.Cog").alias("cog"), F.col("b.TrueHeading").alias("heading"), F.col("b.NavigationalStatus").alias("nav_status"), F.col("MessageType").alias("message_type"), F.nullif(F.trim("MetaData.ShipName"), F.lit("")).alias("ship_name"), *keep)
    return p.where("mmsi is not null and lat is not null and lon is not null").withColumn("zone_key", geo.zone_of(zones, F.col("lon"), F.col("lat")))


def static_reports(env: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Static rows of both report shapes; length is bow plus stern."""
    s = env.where(F.col("MessageType").isin(*STATIC_TYPES)).withColumn("b", F.from_json("body", STATIC))
    dim = F.coalesce("b.Dimension", "b.ReportB.Dimension")
    return s.select(F.coalesce("b.UserID", "MetaData.MMSI").alias("mmsi"), feed_time(F.col("MetaData.time_utc")).alias("ts"), F.nullif("b.ImoNumber", F.lit(0)).alias("imo"), F.nullif(F.trim(F.coalesce("b.Name", "b.ReportA.Name")), F.lit("")).alias("name"), F.nullif(F.trim(F.coalesce("b.CallSign", "b.ReportB.CallSign")), F.lit("")).alias("call_sign"), F.coalesce("b.Type", "b.ReportB.ShipType").alias("ship_type"), F.col("b.MaximumStaticDraught").alias("draught"), (dim["A"] + dim["B"]).alias("length_m"), F.nullif(F.trim("b.Destination"), F.lit("")).alias("destination"), F.col("MessageType").alias("message_type"), *keep)


def subscription(zones: dict[str, Zone], key: str) -> dict:
    """The message that opens the feed; never log it, it holds the key."""
    return {"APIKey": key, "BoundingBoxes": [z.feed_box for z in zones.values()], "FilterMessageTypes": [*POSITION_TYPES, *STATIC_TYPES]}


def write_hourly(stream: DataFrame, path: str, checkpoint: str, every: str = "5 minutes"):
    """File sink by date and hour; offsets in ``checkpoint`` make a restart exact."""
    parts = stream.withColumns({"date": F.to_date("ts"), "hour": F.hour("ts")})
    return parts.writeStream.format("parquet").partitionBy("date", "hour").option("path", path).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


TRANSIT = "mmsi bigint, zone_key string, crossing_time timestamp, direction string, gap_hours double, ambiguous boolean"
SILENT_MS = 86_400_000
_STATE = "ts timestamp, lon double, lat double"


def live_transits(stream: DataFrame, zone: Zone, max_gap_hours: float = 6.0, late: str = "1 hour") -> DataFrame:
    """Crossings of one gate as fixes arrive; the last fix of each vessel is the state.

    Rows of a vessel are taken in time order within a batch; a fix older than the state is late and ignored, as the batch
    plan would have placed it before. State of a vessel that the watermark leaves a day behind is dropped.
    """
    s, w, n, e = zone.bounds
    gate = list(zip(zone.gate, zone.gate[1:]))

    def cross(x0, y0, x1, y1):
        hits = []
        for (ax, ay), (bx, by) in gate:
            s0, s1 = (bx - ax) * (y0 - ay) - (by - ay) * (x0 - ax), (bx - ax) * (y1 - ay) - (by - ay) * (x1 - ax)
            g0, g1 = (x1 - x0) * (ay - y0) - (y1 - y0) * (ax - x0), (x1 - x0) * (by - y0) - (y1 - y0) * (bx - x0)
            if s0 * s1 < 0 and g0 * g1 <= 0:
                hits.append((s0 / (s0 - s1), 1 if s1 > 0 else -1))
        return min(hits) if hits else None

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(parts)).sort_values("ts")
        last = state.get if state.exists else None
        out = []
        for ts, x, y in zip(rows["ts"], rows["lon"], rows["lat"]):
            if last is not None:
                if ts <= pd.Timestamp(last[0]):
                    continue
                hit = cross(last[1], last[2], x, y)
                if hit:
                    gap = ts - pd.Timestamp(last[0])
                    hours = gap.total_seconds() / 3600
                    out.append((key[0], zone.key, pd.Timestamp(last[0]) + gap * hit[0], zone.direction(hit[1]), hours, hours > max_gap_hours))
            last = (ts, float(x), float(y))
        if last is not None:
            state.update((pd.Timestamp(last[0]).to_pydatetime(), last[1], last[2]))
            state.setTimeoutTimestamp(max(int(pd.Timestamp(last[0]).timestamp() * 1000) + SILENT_MS, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["mmsi", "zone_key", "crossing_time", "direction", "gap_hours", "ambiguous"])

    near = stream.where(F.col("lon").between(w, e) & F.col("lat").between(s, n)).select("mmsi", F.col("ts").cast("timestamp").alias("ts"), "lon", "lat").withWatermark("ts", late)
    return near.groupBy("mmsi").applyInPandasWithState(step, TRANSIT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def deduplicated(stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Repeated messages within the watermark once."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["mmsi", "ts", "message_type"])


def windowed_counts(stream: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", size), "zone_key").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("mmsi").alias("n_vessels"))
