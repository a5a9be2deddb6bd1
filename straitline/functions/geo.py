"""Geometry as Column expressions: everything stays inside whole-stage codegen."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from straitline.config import Point, Zone

EARTH_RADIUS_NM = 3440.065


def haversine_nm(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance; the root's argument is clipped, as rounding can leave [0, 1] and ``asin`` would be NaN."""
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    h = F.pow(F.sin(dlat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon), 2)
    return F.lit(2 * EARTH_RADIUS_NM) * F.asin(F.sqrt(F.greatest(F.lit(0.0), F.least(F.lit(1.0), h))))


def side(a: Point, b: Point, lon: Column, lat: Column) -> Column:
    """Cross product of the gate a->b with the point: positive on its left."""
    return F.lit(b[0] - a[0]) * (lat - F.lit(a[1])) - F.lit(b[1] - a[1]) * (lon - F.lit(a[0]))


def within_bounds(zone: Zone, lon: Column, lat: Column) -> Column:
    s, w, n, e = zone.bounds
    return lon.between(w, e) & lat.between(s, n)


def inside(zone: Zone, lon: Column, lat: Column) -> Column:
    """Strict interior. A rectangle needs four comparisons; other polygons are ray-cast, less their edges."""
    s, w, n, e = zone.bounds
    ring = list(zip(zone.zone, zone.zone[1:] + zone.zone[:1]))
    if len(ring) == 4 and all(a[0] == b[0] or a[1] == b[1] for a, b in ring):
        return (lon > w) & (lon < e) & (lat > s) & (lat < n)
    flips, edges = [], []
    for (ax, ay), (bx, by) in ring:
        spans = (F.lit(ay) > lat) != (F.lit(by) > lat)
        if ay != by:
            flips.append(F.when(spans & (lon < (lat - ay) * ((bx - ax) / (by - ay)) + ax), 1).otherwise(0))
        edges.append((side((ax, ay), (bx, by), lon, lat) == 0) & lon.between(min(ax, bx), max(ax, bx)) & lat.between(min(ay, by), max(ay, by)))
    return (reduce(lambda x, y: x + y, flips) % 2 == 1) & ~reduce(or_, edges)


def zone_of(zones: dict[str, Zone], lon: Column, lat: Column) -> Column:
    """Key of the first zone, in order, that holds the point; null outside all."""
    return F.coalesce(*[F.when(inside(z, lon, lat), F.lit(k)) for k, z in zones.items()], F.lit(None).cast("string"))


def crossing(zone: Zone, lon0: Column, lat0: Column, lon1: Column, lat1: Column) -> Column:
    """struct(fraction, sign) of the first crossing along the movement, or null.

    A gate segment is crossed if the two ends lie strictly on opposite sides of it and its own ends aren't strictly on
    one side of the movement. ``fraction`` is the part of the movement before the crossing, ``sign`` the side after.
    """
    found = []
    for a, b in zip(zone.gate, zone.gate[1:]):
        s0, s1 = side(a, b, lon0, lat0), side(a, b, lon1, lat1)
        dx, dy = lon1 - lon0, lat1 - lat0
        g0 = dx * (F.lit(a[1]) - lat0) - dy * (F.lit(a[0]) - lon0)
        g1 = dx * (F.lit(b[1]) - lat0) - dy * (F.lit(b[0]) - lon0)
        hit = (F.signum(s0) * F.signum(s1) < 0) & (F.signum(g0) * F.signum(g1) <= 0)
        found.append(F.when(hit, F.struct((s0 / (s0 - s1)).alias("fraction"), F.signum(s1).cast("int").alias("sign"))))
    return found[0] if len(found) == 1 else F.array_min(F.array_compact(F.array(*found)))
