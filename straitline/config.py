"""Zones and ports: small fixed dimensions that plans are generated from."""

from __future__ import annotations

import os
from dataclasses import dataclass

Point = tuple[float, float]  # (lon, lat)


@dataclass(frozen=True)
class Zone:
    """A chokepoint: a gate line, a polygon, and the names of the two directions across the gate."""

    key: str
    name: str
    portwatch_id: str
    gate: tuple[Point, ...]
    zone: tuple[Point, ...]
    positive: str
    negative: str
    live: bool

    def __post_init__(self) -> None:
        for lon, lat in (*self.gate, *self.zone):
            if not (-180 <= lon <= 180 and -90 <= lat <= 90):
                raise ValueError(f"{self.key}: ({lon}, {lat}) is not a lon/lat pair")
        if len(self.gate) < 2 or len(self.zone) < 3:
            raise ValueError(f"{self.key}: a gate needs two points and a zone three")
        s, w, n, e = self.bounds
        if not any(w <= lon <= e and s <= lat <= n for lon, lat in self.gate):
            raise ValueError(f"{self.key}: the gate lies outside the zone")

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        """(south, west, north, east)."""
        lons, lats = zip(*self.zone)
        return min(lats), min(lons), max(lats), max(lons)

    @property
    def feed_box(self) -> list[list[float]]:
        """The box in the feed's order, [[lat, lon], [lat, lon]]."""
        s, w, n, e = self.bounds
        return [[s, w], [n, e]]

    def direction(self, sign: int) -> str:
        return self.positive if sign > 0 else self.negative


@dataclass(frozen=True)
class Port:
    key: str
    match_name: str
    group: str
    portwatch_id: str | None = None


def _box(w: float, s: float, e: float, n: float) -> tuple[Point, ...]:
    return ((w, s), (e, s), (e, n), (w, n))


#: Gates, zones and direction names.
ZONES: dict[str, Zone] = {
    z.key: z
    for z in (
        Zone("hormuz", "Strait of Hormuz", "chokepoint6", ((56.53, 26.50), (56.36, 26.85)), _box(55.60, 25.60, 57.30, 27.20), "inbound", "outbound", True),
        Zone("bab_el_mandeb", "Bab el-Mandeb", "chokepoint4", ((43.20, 12.45), (43.48, 12.70)), _box(42.60, 11.80, 44.20, 13.40), "northbound", "southbound", True),
        Zone("suez", "Suez Canal", "chokepoint1", ((32.30, 30.50), (32.42, 30.50)), _box(32.20, 29.90, 32.65, 31.30), "northbound", "southbound", True),
        Zone("cape_of_good_hope", "Cape of Good Hope", "chokepoint7", ((18.47, -34.36), (18.47, -37.50)), _box(17.00, -38.00, 20.00, -33.80), "eastbound", "westbound", False),
        Zone("malacca", "Strait of Malacca", "chokepoint5", ((101.25, 3.05), (100.55, 2.45)), _box(99.80, 1.80, 102.00, 3.80), "southeastbound", "northwestbound", False),
        Zone("bosporus", "Bosporus Strait", "chokepoint3", ((29.00, 41.10), (29.12, 41.10)), _box(28.90, 40.90, 29.30, 41.40), "northbound", "southbound", False),
        Zone("panama", "Panama Canal", "chokepoint2", ((-79.80, 9.15), (-79.68, 9.10)), _box(-80.10, 8.70, -79.40, 9.50), "northbound", "southbound", False),
    )
}


def load_zones(path: str) -> dict[str, Zone]:
    """Zones of a YAML file ``chokepoints: {key: {name, portwatch_id, gate, zone, direction_positive, ..}}``, checked."""
    points = lambda ps: tuple((float(x), float(y)) for x, y in ps)
    out = {}
    for key, z in (_yaml(path).get("chokepoints") or {}).items():
        out[key] = Zone(key, z.get("name", key), z["portwatch_id"], points(z["gate"]), points(z["zone"]), z["direction_positive"], z["direction_negative"], bool(z.get("collect_live", False)))
    return out


def load_ports(path: str) -> dict[str, Port]:
    """Ports of a YAML file ``ports: [{key, match_name, group, portwatch_id}]``."""
    return {p["key"]: Port(p["key"], p["match_name"], p["group"], p.get("portwatch_id")) for p in _yaml(path).get("ports") or []}


def _yaml(path: str) -> dict:
    import yaml  # only files of this kind need it

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


def live_zones() -> dict[str, Zone]:
    return {k: z for k, z in ZONES.items() if z.live}


def directions(zones: dict[str, Zone] = ZONES) -> list[str]:
    """All direction names, so pivots have a fixed schema."""
    return sorted({d for z in zones.values() for d in (z.positive, z.negative)})


def require_setting(name: str) -> str:
    """A secret from the environment, or an error that names it."""
    value = os.environ.get(name)
    if not value:
        raise RuntimeError(f"set {name} in the environment")
    return value
