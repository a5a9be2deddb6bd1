"""Polygon layers by a grid of cells: most points are answered by an equi join, those near an outline by its edges there.

A layer has a row a ring: ``key`` and ``ring``, an array of struct(lon, lat), closed or not. All rings of a key count by the
even-odd rule, so an inner ring is a hole. ``cover`` turns it into a row a cell of ``step`` degrees: each polygon that meets
the cell, whether the cell's reference point lies in it, and the edges that touch the cell, none for an inner cell. A point
of a cell is inside if the path from the reference point, first along its meridian, then along its parallel, crosses an
odd number of those edges; the path stays in the cell, so no other edge matters.

The cover is a table to write once: its size goes with the length of the outlines and the area in cells, and a cell's edges
with the detail of the map inside ``step`` degrees. Spark broadcasts it or shuffles by cell, as its size says.

Cases: the interior is strict (edges and vertices are outside); a point without finite coordinates has no polygon; rings of
fewer than three points and null rings hold nothing; an empty layer gives empty arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from straitline.config import Zone

STEP = 0.25
#: Place of a reference point in its cell: two irrational parts, so that no vertex has its coordinates and no edge between
#: vertices of short decimals goes through it.
REFERENCE = (0.6180339887498949, 0.41421356237309515)
#: Part of a cell by which an edge's cells are widened against rounding.
MARGIN = 1e-6


def layer_of(spark, zones: dict[str, Zone]) -> DataFrame:
    """The zones as a layer."""
    return spark.createDataFrame([(k, [(float(x), float(y)) for x, y in z.zone]) for k, z in zones.items()], "key string, ring array<struct<lon:double,lat:double>>")


def edges(layer: DataFrame) -> DataFrame:
    """(key, ax, ay, bx, by): a row an edge, the one that closes the ring too, without those of no length."""
    ring = layer.where(F.size("ring") >= 3).select("key", "ring", F.posexplode("ring").alias("i", "a"))
    b = F.element_at("ring", (F.col("i") + 1) % F.size("ring") + 1)
    out = ring.select("key", F.col("a.lon").alias("ax"), F.col("a.lat").alias("ay"), b["lon"].alias("bx"), b["lat"].alias("by"))
    return out.where("ax <> bx or ay <> by")


def _x_at(y: Column) -> Column:
    """Longitude of the edge at a latitude between its ends; null if it runs along a parallel."""
    ax, ay, bx, by = (F.col(c) for c in ("ax", "ay", "bx", "by"))
    x = ax + (y - ay) * (bx - ax) / F.nullif(by - ay, F.lit(0.0))
    return F.when(ay != by, F.greatest(F.least(ax, bx), F.least(F.greatest(ax, bx), x)))


def _cell(v: Column) -> Column:
    return F.floor(v).cast("long")


def cover(layer: DataFrame, step: float = STEP) -> DataFrame:
    """(cell_x, cell_y, polygons array<struct<key, reference, edges>>): one row a cell that some polygon meets."""
    low, high = F.least("ay", "by"), F.greatest("ay", "by")
    rows = edges(layer).withColumn("cell_y", F.explode(F.sequence(_cell(low / step - MARGIN), _cell(high / step + MARGIN))))
    south, north = F.col("cell_y") * F.lit(step), (F.col("cell_y") + 1) * F.lit(step)
    # the part of an edge inside the row, or all of it if it runs along the row
    x0 = F.coalesce(_x_at(F.greatest(south - step * MARGIN, low)), F.col("ax"))
    x1 = F.coalesce(_x_at(F.least(north + step * MARGIN, high)), F.col("bx"))
    span = F.sequence(_cell(F.least(x0, x1) / step - MARGIN), _cell(F.greatest(x0, x1) / step + MARGIN))
    border = rows.withColumn("cell_x", F.explode(span)).groupBy("key", "cell_x", "cell_y").agg(F.collect_list(F.struct("ax", "ay", "bx", "by")).alias("edges"))
    # along each row's reference line, the stretches between an odd crossing and the next are inside
    line = (F.col("cell_y") + REFERENCE[1]) * F.lit(step)
    met = rows.where((F.col("ay") > line) != (F.col("by") > line)).select("key", "cell_y", _x_at(line).alias("x"))
    w = Window.partitionBy("key", "cell_y").orderBy("x")
    stretch = met.select("key", "cell_y", "x", F.lead("x").over(w).alias("to"), F.row_number().over(w).alias("n")).where("n % 2 = 1 and to is not null")
    start, stop = (F.ceil(F.col(c) / step - REFERENCE[0]).cast("long") for c in ("x", "to"))
    held = stretch.where(start < stop).select("key", "cell_y", F.explode(F.sequence(start, stop - 1)).alias("cell_x"), F.lit(True).alias("reference"))
    cells = border.join(held, ["key", "cell_x", "cell_y"], "full")
    one = F.struct("key", F.coalesce("reference", F.lit(False)).alias("reference"), F.coalesce("edges", F.array().cast("array<struct<ax:double,ay:double,bx:double,by:double>>")).alias("edges"))
    return cells.groupBy("cell_x", "cell_y").agg(F.collect_list(one).alias("polygons"))


def _odd(p: Column, lon: Column, lat: Column, cx: Column, cy: Column) -> Column:
    """Whether the polygon's parity at the point is odd: that of the reference point, changed by each edge on the path."""

    def crossed(e: Column) -> Column:
        dx, dy = e["bx"] - e["ax"], e["by"] - e["ay"]
        y = e["ay"] + (cx - e["ax"]) * dy / F.nullif(dx, F.lit(0.0))
        x = e["ax"] + (lat - e["ay"]) * dx / F.nullif(dy, F.lit(0.0))
        up = ((e["ax"] > cx) != (e["bx"] > cx)) & ((y > cy) != (y > lat))
        across = ((e["ay"] > lat) != (e["by"] > lat)) & ((x > cx) != (x > lon))
        return F.coalesce(up, F.lit(False)).cast("int") + F.coalesce(across, F.lit(False)).cast("int")

    n = F.aggregate(p["edges"], F.lit(0), lambda s, e: s + crossed(e))
    return (n + p["reference"].cast("int")) % 2 == 1


def _on(e: Column, lon: Column, lat: Column) -> Column:
    side = (e["bx"] - e["ax"]) * (lat - e["ay"]) - (e["by"] - e["ay"]) * (lon - e["ax"])
    return (side == 0) & lon.between(F.least(e["ax"], e["bx"]), F.greatest(e["ax"], e["bx"])) & lat.between(F.least(e["ay"], e["by"]), F.greatest(e["ay"], e["by"]))


def holders(pos: DataFrame, covered: DataFrame, step: float = STEP, column: str = "polygons") -> DataFrame:
    """``pos`` (lon, lat) with ``column``: sorted keys of the polygons of a cover, made with the same step, that hold the point."""
    lon, lat = F.col("lon"), F.col("lat")
    placed = lon.between(-360.0, 360.0) & lat.between(-90.0, 90.0)
    cells = covered.select(F.col("cell_x").alias("_cell_x"), F.col("cell_y").alias("_cell_y"), F.col("polygons").alias("_polygons"))
    p = pos.withColumns({"_cell_x": F.when(placed, _cell(lon / step)), "_cell_y": F.when(placed, _cell(lat / step))})
    p = p.join(cells, ["_cell_x", "_cell_y"], "left")
    cx, cy = ((F.col(c) + r) * F.lit(step) for c, r in zip(("_cell_x", "_cell_y"), REFERENCE))
    inside = F.filter("_polygons", lambda g: _odd(g, lon, lat, cx, cy) & ~F.exists(g["edges"], lambda e: _on(e, lon, lat)))
    keys = F.array_sort(F.array_distinct(F.transform(inside, lambda g: g["key"])))
    return p.withColumn(column, F.coalesce(keys, F.array().cast("array<string>"))).drop("_cell_x", "_cell_y", "_polygons")


def on_land(pos: DataFrame, land: DataFrame, step: float = STEP) -> DataFrame:
    """``pos`` with on_land: some polygon of the cover holds the point. For ``quality_flags(on_land=F.col("on_land"))``."""
    return holders(pos, land, step, "_land").withColumn("on_land", F.size("_land") > 0).drop("_land")
