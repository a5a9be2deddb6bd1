"""Daily tables by zone: data quality, and the combination of all measures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from straitline.config import ZONES, Zone, directions
from straitline.session import written

from . import laden, tracks

OUTSIDE = "outside_zones"


def quality_daily(flagged: DataFrame, gaps: DataFrame | None = None) -> DataFrame:
    """Counts of a zone-day; hours_with_data tells a dead collector from calm traffic. Days with gaps only are left out."""
    rows = flagged.withColumns({"date": F.to_date("ts"), "zone_key": F.coalesce("zone_key", F.lit(OUTSIDE))})
    hit = lambda c: F.count_if(F.col(f"flag_{c}")).alias(f"n_{c}" if c != "any" else "n_flagged_any")
    daily = rows.groupBy("date", "zone_key").agg(F.count(F.lit(1)).alias("n_positions"), F.countDistinct("mmsi").alias("n_vessels"), F.bit_count(F.bit_or(F.expr("shiftleft(1, hour(ts))"))).cast("long").alias("hours_with_data"), *map(hit, ("impossible_speed", "shared_position", "on_land", "any")))
    if gaps is None:
        return daily.withColumn("n_dark_gaps", F.lit(0).cast("long"))
    dark = gaps.groupBy(F.to_date("gap_start").alias("date"), "zone_key").agg(F.count(F.lit(1)).alias("n_dark_gaps"))
    return daily.join(dark, ["date", "zone_key"], "left").withColumn("n_dark_gaps", F.coalesce("n_dark_gaps", F.lit(0)))


def pivot_transits(daily: DataFrame, names: list[str] | None = None) -> DataFrame:
    """n_transits and n_transits_<direction>; the directions come from the configuration, so the schema is fixed."""
    names = directions() if names is None else names
    wide = daily.groupBy("date", "zone_key").agg(F.sum("n_transits").alias("n_transits"), *[F.coalesce(F.sum(F.when(F.col("direction") == d, F.col("n_transits"))), F.lit(0)).alias(f"n_transits_{d}") for d in names])
    return wide


def combine(*tables: DataFrame) -> DataFrame:
    """Full outer join by date and zone; columns that the left side has are dropped from the right; gaps stay null."""
    out, keys = tables[0], ["date", "zone_key"]
    for t in tables[1:]:
        out = out.join(t.select(*keys, *[c for c in t.columns if c not in out.columns]), keys, "full_outer")
    return out


def ais_metrics(pos: DataFrame, static: DataFrame | None = None, zones: dict[str, Zone] = ZONES, *, separation_hours: float = tracks.MAX_GAP_HOURS, threshold: float = laden.THRESHOLD, unit: str = "minute", decimals: int = tracks.SPOOF_DECIMALS, vessels: int = tracks.SPOOF_VESSELS) -> dict[str, DataFrame]:
    """All tables of a run: flags over all rows first, then everything on the rows without flags, zones in one pass.

    Two tables are written to the shared folder and read by all that follows: positions with their flags, and of the tracks
    the fixes that end a crossing or a silence or belong to a stop.
    """
    flagged = written(tracks.quality_flags(tracks.tag_zones(pos, zones), decimals=decimals, vessels=vessels, unit=unit), "flagged")
    clean = flagged.where(~F.col("flag_any"))
    track = tracks.tracked(clean, zones)
    track = written(track.where(F.col("_c").isNotNull() | F.col("_s") | tracks.silent()), "track")
    crossings = tracks.deduplicate(tracks.vessel_identity(tracks.crossings_of(track, zones, separation_hours), static), separation_hours)
    gaps = tracks.gaps_of(track)
    out = {"transits": crossings, "transits_daily": tracks.transits_daily(crossings), "dark_gaps": gaps, "waiting_daily": tracks.waiting_daily(tracks.waiting_of(track)), "quality_daily": quality_daily(flagged, gaps)}
    parts = [pivot_transits(out["transits_daily"], directions(zones)), out["waiting_daily"]]
    if static is not None:
        out["laden_daily"] = laden.laden_daily(clean, static, zones, threshold)
        parts.append(out["laden_daily"])
    return out | {"ais_daily": combine(*parts, out["quality_daily"])}
