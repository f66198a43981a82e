"""Planar geometry as column expressions.

Points are (x, y) in feet.  A ring or line is ``array<struct<x:double,y:double>>``,
a polygon ``array<ring>`` (outer ring first, holes after), all folded inside the JVM.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
MPS_TO_MPH = 2.23694
US_FOOT_M = 0.3048006096

# Public definition of the projected plane (Lambert conformal conic, GRS80).
LCC_A = 6_378_137.0
LCC_F = 1.0 / 298.257222101
LCC_PHI1 = 40.0 + 40.0 / 60.0
LCC_PHI2 = 41.0 + 2.0 / 60.0
LCC_PHI0 = 40.0 + 10.0 / 60.0
LCC_LON0 = -74.0
LCC_X0_M = 300_000.0


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(
        F.radians(lat2)
    ) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    return F.lit(2 * EARTH_M) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def _e() -> float:
    return math.sqrt(2 * LCC_F - LCC_F * LCC_F)


def _t(phi: float) -> float:
    e, s = _e(), math.sin(phi)
    return math.tan(math.pi / 4 - phi / 2) / ((1 - e * s) / (1 + e * s)) ** (e / 2)


def _m(phi: float) -> float:
    e, s = _e(), math.sin(phi)
    return math.cos(phi) / math.sqrt(1 - e * e * s * s)


def lcc_constants() -> tuple[float, float, float]:
    """Cone constant n, scale F and origin radius rho0 of the projection."""
    p1, p2, p0 = (math.radians(v) for v in (LCC_PHI1, LCC_PHI2, LCC_PHI0))
    n = (math.log(_m(p1)) - math.log(_m(p2))) / (math.log(_t(p1)) - math.log(_t(p2)))
    f = _m(p1) / (n * _t(p1) ** n)
    return n, f, LCC_A * f * _t(p0) ** n


def to_feet(lon: Column, lat: Column) -> Column:
    """Longitude/latitude in degrees -> struct(x, y) in US survey feet."""
    n, f, rho0 = lcc_constants()
    e = _e()
    phi = F.radians(lat)
    es = F.lit(e) * F.sin(phi)
    t = F.tan(F.lit(math.pi / 4) - phi / 2) / F.pow((1 - es) / (1 + es), F.lit(e / 2))
    rho = F.lit(LCC_A * f) * F.pow(t, F.lit(n))
    theta = F.lit(n) * F.radians(lon - F.lit(LCC_LON0))
    x = (F.lit(LCC_X0_M) + rho * F.sin(theta)) / F.lit(US_FOOT_M)
    y = (F.lit(rho0) - rho * F.cos(theta)) / F.lit(US_FOOT_M)
    return F.struct(x.alias("x"), y.alias("y"))


def to_lonlat(x: Column, y: Column) -> Column:
    """Inverse of ``to_feet``: struct(lon, lat); five fixed-point steps reach double precision."""
    n, f, rho0 = lcc_constants()
    e = _e()
    xm = x * F.lit(US_FOOT_M) - F.lit(LCC_X0_M)
    ym = F.lit(rho0) - y * F.lit(US_FOOT_M)
    rho = F.sqrt(xm * xm + ym * ym)
    t = F.pow(rho / F.lit(LCC_A * f), F.lit(1.0 / n))
    phi = F.lit(math.pi / 2) - 2 * F.atan(t)
    steps = F.sequence(F.lit(1), F.lit(5))
    phi = F.aggregate(
        steps, phi,
        lambda acc, _: F.lit(math.pi / 2)
        - 2 * F.atan(t * F.pow((1 - F.lit(e) * F.sin(acc)) / (1 + F.lit(e) * F.sin(acc)), F.lit(e / 2))),
    )
    lon = F.degrees(F.atan2(xm, ym) / F.lit(n)) + F.lit(LCC_LON0)
    return F.struct(lon.alias("lon"), F.degrees(phi).alias("lat"))


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def rectangle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Closed counter-clockwise ring of an axis-aligned box."""
    return F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1), point(x0, y0))


def edges(ring: Column) -> Column:
    """Consecutive vertex pairs of a ring or line."""
    n = F.size(ring)
    a, b = F.slice(ring, F.lit(1), n - 1), F.slice(ring, F.lit(2), n - 1)
    return F.zip_with(a, b, lambda p, q: F.struct(p.x.alias("x0"), p.y.alias("y0"), q.x.alias("x1"), q.y.alias("y1")))


def _fold(items: Column, term) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda acc, e: acc + term(e))


def line_length(line: Column) -> Column:
    return _fold(edges(line), lambda e: F.hypot(e.x1 - e.x0, e.y1 - e.y0))


def ring_signed_area(ring: Column) -> Column:
    return _fold(edges(ring), lambda e: e.x0 * e.y1 - e.x1 * e.y0) / 2


def polygon_area(rings: Column) -> Column:
    """Outer area minus the holes; winding does not matter."""
    areas = F.transform(rings, lambda r: F.abs(ring_signed_area(r)))
    return 2 * F.get(areas, 0) - F.aggregate(areas, F.lit(0.0), lambda acc, a: acc + a)


def polygon_perimeter(rings: Column) -> Column:
    return F.aggregate(F.transform(rings, line_length), F.lit(0.0), lambda acc, a: acc + a)


def ring_centroid(ring: Column) -> Column:
    """Area centroid; taken relative to the first vertex to keep digits."""
    ox, oy = ring[0].x, ring[0].y
    local = F.transform(ring, lambda p: point(p.x - ox, p.y - oy))
    area = ring_signed_area(local)
    sx = _fold(edges(local), lambda e: (e.x0 + e.x1) * (e.x0 * e.y1 - e.x1 * e.y0))
    sy = _fold(edges(local), lambda e: (e.y0 + e.y1) * (e.x0 * e.y1 - e.x1 * e.y0))
    return point(ox + sx / (6 * area), oy + sy / (6 * area))


def bbox(points: Column) -> Column:
    xs, ys = F.transform(points, lambda p: p.x), F.transform(points, lambda p: p.y)
    return F.struct(
        F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1")
    )


def _crossings(ring: Column, x: Column, y: Column) -> Column:
    def hit(e):
        spans = (e.y0 > y) != (e.y1 > y)
        left = x < (e.x1 - e.x0) * (y - e.y0) / (e.y1 - e.y0) + e.x0
        return F.when(spans & left, 1).otherwise(0)

    return F.aggregate(edges(ring), F.lit(0), lambda acc, e: acc + hit(e))


def contains(rings: Column, x: Column, y: Column) -> Column:
    """Even-odd test over all rings, so holes and disjoint parts work alike."""
    total = F.aggregate(F.transform(rings, lambda r: _crossings(r, x, y)), F.lit(0), lambda acc, n: acc + n)
    return total % 2 == 1


def segment_position(x: Column, y: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Fraction along the segment of the nearest point, clamped to [0, 1]."""
    dx, dy = x1 - x0, y1 - y0
    raw = ((x - x0) * dx + (y - y0) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0))
    return F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw)), F.lit(0.0))


def segment_distance(x: Column, y: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    u = segment_position(x, y, x0, y0, x1, y1)
    return F.hypot(x - (x0 + u * (x1 - x0)), y - (y0 + u * (y1 - y0)))


def cross_sign(x: Column, y: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Positive when the point lies left of the directed segment."""
    return (x1 - x0) * (y - y0) - (y1 - y0) * (x - x0)


def parse_wkt_rings(col: Column) -> Column:
    """Rings (or one line) of a POINT/LINESTRING/POLYGON/MULTI* text as coordinate arrays."""
    rings = F.regexp_extract_all(col, F.lit(r"\(([^()]+)\)"), F.lit(1))

    def pts(ring):
        return F.transform(
            F.split(F.trim(ring), r"\s*,\s*"),
            lambda p: point(F.split_part(p, F.lit(" "), F.lit(1)).try_cast("double"),
                            F.split_part(p, F.lit(" "), F.lit(2)).try_cast("double")),
        )

    return F.transform(rings, pts)


def parse_wkt_parts(col: Column) -> Column:
    """Parts of a geometry text, each an array of rings: polygons keep their holes, other lines and points are a part each."""
    kind = F.upper(F.regexp_extract(col, r"([A-Za-z]+)\s*[ZM]*\s*\(", 1))
    polygons = F.regexp_extract_all(col, F.lit(r"\(\s*(\([^()]+\)(?:\s*,\s*\([^()]+\))*)\s*\)"), F.lit(1))
    return F.when(kind.endswith("POLYGON"), F.transform(polygons, parse_wkt_rings)).otherwise(F.transform(parse_wkt_rings(col), lambda r: F.array(r)))


def parts_area(parts: Column) -> Column:
    """Area of all polygons of a geometry, holes taken out of their own polygon."""
    return F.aggregate(F.transform(parts, polygon_area), F.lit(0.0), lambda acc, a: acc + a)
