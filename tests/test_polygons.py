"""Points in polygon layers against a plain ray cast."""

import random

import pytest
from pyspark.sql import functions as F

from straitline.config import ZONES
from straitline.operators import polygons, tracks

LAYER = "key string, ring array<struct<lon:double,lat:double>>"


def brute(rings, x, y):
    odd = False
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            if (bx - ax) * (y - ay) == (by - ay) * (x - ax) and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by):
                return False
            if (ay > y) != (by > y) and x < ax + (y - ay) * (bx - ax) / (by - ay):
                odd = not odd
    return odd


def check(spark, layer, points, step):
    df = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(points)], "i long, lon double, lat double")
    got = {r.i: r.polygons for r in polygons.holders(df, polygons.cover(spark.createDataFrame([(k, r) for k, rs in layer.items() for r in rs], LAYER), step), step).collect()}
    assert got == {i: sorted(k for k, rs in layer.items() if brute(rs, x, y)) for i, (x, y) in enumerate(points)}
    return sum(map(len, got.values()))


@pytest.mark.parametrize("step", [0.1, 0.5, 3.0])
def test_random_polygons_equal_brute_force(spark, step):
    r = random.Random(4)
    layer = {}
    for k in range(1000 if step == 0.5 else 100):  # any order of points: outlines cross themselves
        x, y, size = r.uniform(-10, 10), r.uniform(-10, 10), r.uniform(0.05, 2)
        layer[f"p{k}"] = [[(x + r.uniform(-size, size), y + r.uniform(-size, size)) for _ in range(r.randrange(3, 12))] for _ in range(r.choice((1, 1, 2)))]
    points = [(r.uniform(-12, 12), r.uniform(-12, 12)) for _ in range(400)] + [p for k in list(layer)[:20] for p in layer[k][0]]
    assert check(spark, layer, points, step) > 100


@pytest.mark.parametrize("step", [0.25, 1.0, 2.0])
def test_points_on_outlines_vertices_and_cell_limits(spark, step):
    layer = {
        "box": [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]],
        "holed": [[(-3.0, -3.0), (3.0, -3.0), (3.0, 3.0), (-3.0, 3.0), (-3.0, -3.0)], [(-1.0, -1.0), (1.0, -1.0), (1.0, 1.0), (-1.0, 1.0)]],
        "diamond": [[(0.0, -2.0), (2.0, 0.0), (0.0, 2.0), (-2.0, 0.0)]],
        "steps": [[(0.0, 0.0), (2.0, 0.0), (2.0, 1.0), (1.0, 1.0), (1.0, 2.0), (0.0, 2.0)]],
        "line": [[(0.0, 0.0), (3.0, 3.0), (3.0, 3.0)]],
        "short": [[(0.0, 0.0), (3.0, 3.0)]],
    }
    assert check(spark, layer, [(x / 4, y / 4) for x in range(-16, 19) for y in range(-16, 19)], step) > 500


def test_points_without_place_and_empty_layers(spark):
    pos = spark.createDataFrame([(None, 1.0, "a"), (float("nan"), 1.0, "b"), (float("inf"), 1.0, "c"), (1.0, 200.0, "d"), (1.0, 1.0, "e")], "lon double, lat double, cell_x string")
    box = polygons.cover(spark.createDataFrame([("box", [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0)]), ("none", None)], LAYER))
    assert {r.cell_x: r.polygons for r in polygons.holders(pos, box).collect()} == {"a": [], "b": [], "c": [], "d": [], "e": []}
    assert polygons.holders(pos.withColumn("lat", F.col("lat") / 2), box).where("cell_x = 'e'").first().polygons == ["box"]
    none = polygons.cover(spark.createDataFrame([], LAYER))
    assert all(not r.polygons for r in polygons.holders(pos, none).collect())


def test_zones_agree_with_the_tag_and_land_feeds_the_flags(spark):
    pos = spark.range(3000).select(F.col("id").alias("event_id"), F.lit(1).alias("mmsi"), F.timestamp_seconds("id").cast("timestamp_ntz").alias("ts"), (55 + F.col("id") % 60 / 20).alias("lon"), (25 + F.col("id") / 1200).alias("lat"))
    cells = polygons.cover(polygons.layer_of(spark, ZONES))
    got = polygons.holders(pos, cells)
    want = tracks.tag_zones(pos, ZONES)
    assert {(r.event_id, r.polygons[0]) for r in got.collect() if r.polygons} == {(r.event_id, r.zone_key) for r in want.collect() if r.zone_key}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    flagged = tracks.quality_flags(polygons.on_land(pos, cells), on_land=F.col("on_land"))
    assert flagged.where("flag_on_land").count() == want.where("zone_key is not null").count() > 0
