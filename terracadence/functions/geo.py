"""Distances, projections and polygons as column expressions (F-22 to F-29)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM, EARTH_M = 6371.0088, 6371008.8
# WGS84 axes, transverse Mercator of zone 43 N.
A, FLATTENING, SCALE, CENTRAL, EASTING = 6378137.0, 1 / 298.257223563, 0.9996, 75.0, 500000.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_KM) -> Column:
    """F-22: great-circle distance, the root clamped to its domain."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.least(F.greatest(h, F.lit(0.0)), F.lit(1.0))))


def degree_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """F-23: equirectangular, 111.2 km a degree."""
    return 111.2 * F.sqrt(F.pow(lat1 - lat2, 2) + F.pow((lon1 - lon2) * F.cos(F.radians(lat1)), 2))


def utm_xy(lat: Column, lon: Column, central: float = CENTRAL) -> tuple[Column, Column]:
    """F-24: northern-hemisphere transverse Mercator by the third-order series in the third flattening (millimetres within a zone)."""
    n = FLATTENING / (2 - FLATTENING)
    radius = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * math.sqrt(n) / (1 + n)
    s, dl = F.sin(F.radians(lat)), F.radians(lon - central)
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    xi, eta = F.atan2(t, F.cos(dl)), F.atanh(F.sin(dl) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for k, a in enumerate(alpha, 1):
        x = x + a * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
        y = y + a * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
    return EASTING + SCALE * radius * x, SCALE * radius * y


def geodesic(lat1: Column, lon1: Column, lat2: Column, lon2: Column, rounds: int = 6) -> tuple[Column, Column]:
    """F-26: metres along the ellipsoid from the first place to the second, and the direction there in radians from north; the inverse series of the great ellipse, for places that are not opposite each other.

    The longitude on the auxiliary sphere is found by a fixed number of rounds: within a few hundred km three leave less
    than a micrometre. Equal places are 0 apart, to the north.
    """
    b = A * (1 - FLATTENING)
    reduced = lambda lat: F.atan((1 - FLATTENING) * F.tan(F.radians(lat)))
    u1, u2 = reduced(lat1), reduced(lat2)
    s1, c1, s2, c2 = F.sin(u1), F.cos(u1), F.sin(u2), F.cos(u2)
    turn = F.radians(F.pmod(lon2 - lon1 + 540, F.lit(360.0)) - 180)
    start = F.struct(turn.alias("l"), *[F.lit(0.0).alias(n) for n in ("sin", "cos", "sigma", "alpha2", "middle")])

    def again(state: Column, _: Column) -> Column:
        sl, cl = F.sin(state["l"]), F.cos(state["l"])
        sin = F.sqrt(F.pow(c2 * sl, 2) + F.pow(c1 * s2 - s1 * c2 * cl, 2))
        cos = s1 * s2 + c1 * c2 * cl
        sigma = F.atan2(sin, cos)
        sin_alpha = F.coalesce(F.try_divide(c1 * c2 * sl, sin), F.lit(0.0))
        alpha2 = 1 - sin_alpha * sin_alpha
        middle = cos - F.coalesce(F.try_divide(2 * s1 * s2, alpha2), F.lit(0.0))
        c = FLATTENING / 16 * alpha2 * (4 + FLATTENING * (4 - 3 * alpha2))
        longer = turn + (1 - c) * FLATTENING * sin_alpha * (sigma + c * sin * (middle + c * cos * (2 * middle * middle - 1)))
        return F.struct(longer.alias("l"), sin.alias("sin"), cos.alias("cos"), sigma.alias("sigma"), alpha2.alias("alpha2"), middle.alias("middle"))

    def finish(done: Column) -> Column:
        q = done["alpha2"] * (A * A - b * b) / (b * b)
        big = 1 + q / 16384 * (4096 + q * (q * (320 - 175 * q) - 768))
        small = q / 1024 * (256 + q * (q * (74 - 47 * q) - 128))
        m, cos, sin = done["middle"], done["cos"], done["sin"]
        off = small * sin * (m + small / 4 * (cos * (2 * m * m - 1) - small / 6 * m * (4 * sin * sin - 3) * (4 * m * m - 3)))
        towards = F.atan2(c2 * F.sin(done["l"]), c1 * s2 - s1 * c2 * F.cos(done["l"]))
        return F.struct((b * big * (done["sigma"] - off)).alias("away"), towards.alias("towards"))

    # by transform, so that the rounds are run once for both
    line = F.transform(F.array(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, again)), finish)[0]
    return line["away"], line["towards"]


def local_xy(lat: Column, lon: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """F-26: metres east and north of a centre, true in distance and direction from it (azimuthal equidistant on the ellipsoid)."""
    away, towards = geodesic(lat0, lon0, lat, lon)
    return away * F.sin(towards), away * F.cos(towards)


def cell(x: Column, origin: float | Column, size: float) -> Column:
    """F-29: index of the grid cell."""
    return F.floor((x - origin) / size).cast("long")


# Rings: ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>, closed or not.
def _edges(ring: Column) -> Column:
    following = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    return F.arrays_zip(ring.alias("a"), following.alias("b"))


def _from_corner(ring: Column, measure) -> Column:
    """A measure of the ring as seen from its first corner: products of large coordinates would swallow a small area. By transform, so that the ring is made once."""
    away = lambda r: F.transform(r, lambda p: F.struct(*[(p[k] - F.get(r, F.lit(0))[k]).alias(k) for k in "xy"]))
    return F.transform(F.transform(F.array(ring), away), measure)[0]


def ring_area(ring: Column) -> Column:
    """F-25: signed shoelace area (counter-clockwise positive)."""
    return _from_corner(ring, lambda r: F.aggregate(_edges(r), F.lit(0.0), lambda s, e: s + (e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]) / 2))


def ring_centroid(ring: Column) -> tuple[Column, Column]:
    """F-25: NULL for a ring without area."""
    cross = lambda e: e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]
    area = ring_area(ring)
    moment = lambda c: _from_corner(ring, lambda r: F.aggregate(_edges(r), F.lit(0.0), lambda s, e: s + (e["a"][c] + e["b"][c]) * cross(e)))
    mean = lambda c: F.get(ring, F.lit(0))[c] + F.try_divide(moment(c), 6 * area)
    return mean("x"), mean("y")


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """F-27: even-odd rule; points on an edge count as inside."""
    crosses = lambda e: ((e["a"]["y"] > y) != (e["b"]["y"] > y)) & (x < F.try_divide((e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]), e["b"]["y"] - e["a"]["y"]) + e["a"]["x"])
    odd = F.aggregate(_edges(ring), F.lit(False), lambda s, e: s != F.coalesce(crosses(e), F.lit(False)))
    return odd | (ring_distance(x, y, ring) == 0)


def ring_distance(x: Column, y: Column, ring: Column) -> Column:
    """F-27: distance to the nearest edge."""
    def to_edge(e: Column) -> Column:
        dx, dy = e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]
        t = F.coalesce(F.try_divide((x - e["a"]["x"]) * dx + (y - e["a"]["y"]) * dy, dx * dx + dy * dy), F.lit(0.0))
        t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
        return F.sqrt(F.pow(x - e["a"]["x"] - t * dx, 2) + F.pow(y - e["a"]["y"] - t * dy, 2))

    return F.array_min(F.transform(_edges(ring), to_edge))


def polygon_distance(x: Column, y: Column, ring: Column) -> Column:
    """F-27: 0 inside."""
    return F.when(in_ring(x, y, ring), F.lit(0.0)).otherwise(ring_distance(x, y, ring))


def upright(ring: Column) -> Column:
    """Whether a ring is a rectangle of level and upright edges, given by its four corners: it is its own box then."""
    level = lambda e: (e["a"]["x"] == e["b"]["x"]) != (e["a"]["y"] == e["b"]["y"])
    return F.coalesce((F.size(ring) == 4) & (F.size(F.array_distinct(ring)) == 4) & F.forall(_edges(ring), level), F.lit(False))
