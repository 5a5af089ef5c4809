"""Ellipsoidal distances against published and integrated ones."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terracadence.functions import geo


def lengths(spark, rows):
    df = spark.createDataFrame([tuple(map(float, r)) for r in rows], "a double, b double, c double, d double")
    cols = [F.col(x) for x in "abcd"]
    away, towards = geo.geodesic(*cols)
    x, y = geo.local_xy(F.col("c"), F.col("d"), F.col("a"), F.col("b"))
    return [tuple(r) for r in df.select(away, F.degrees(towards), x, y).collect()]


def dms(d, m, s):
    return math.copysign(abs(d) + m / 60 + s / 3600, d)


def test_a_published_line(spark):
    """Flinders Peak to Buninyon: 54972.271 m at 306 52 05.37 (the national datum's ellipsoid differs by less than a tenth of a millimetre here)."""
    away, towards, *_ = lengths(spark, [(dms(-37, 57, 3.7203), dms(144, 25, 29.5244), dms(-37, 39, 10.1561), dms(143, 55, 35.3839))])[0]
    assert away == pytest.approx(54972.271, abs=1e-3) and towards % 360 == pytest.approx(dms(306, 52, 5.37), abs=5e-6)


def test_meridians_and_equator_by_integration(spark):
    """Along a meridian the length is the integral of the radius of curvature; along the equator it is the axis times the angle."""
    e2 = geo.FLATTENING * (2 - geo.FLATTENING)
    rows = [(30.0, 75.0, 30.4, 75.0), (30.4, 75.0, 30.0, 75.0), (-0.2, 10.0, 0.2, 10.0), (88.0, 0.0, 88.4, 0.0)]
    for (a, _, c, _), (away, towards, x, y) in zip(rows, lengths(spark, rows), strict=True):
        nodes, weights = np.polynomial.legendre.leggauss(40)
        lat = np.radians((a + c) / 2 + nodes * (c - a) / 2)
        want = abs(math.radians(c - a)) / 2 * float(weights @ (geo.A * (1 - e2) / (1 - e2 * np.sin(lat) ** 2) ** 1.5))
        assert away == pytest.approx(want, abs=1e-4) and y == pytest.approx(math.copysign(want, c - a), abs=1e-4) and x == pytest.approx(0, abs=1e-6)
    away, towards, x, y = lengths(spark, [(0.0, 179.9, 0.0, -179.8)])[0]
    assert away == pytest.approx(geo.A * math.radians(0.3), abs=1e-4) and towards == pytest.approx(90) and x == pytest.approx(away) and y == pytest.approx(0, abs=1e-6)


def test_within_fifty_kilometres_distances_add_up(spark):
    """Chords through space, bent to the local radius, agree to a millimetre; there and back are equally long; equal places are nowhere apart."""
    rnd = np.random.default_rng(3)
    e2 = geo.FLATTENING * (2 - geo.FLATTENING)
    rows = [(30 + dy, 75 + dx, 30.1, 75.2) for dy, dx in rnd.uniform(-0.3, 0.3, (40, 2))]

    def space(lat, lon):
        p, q = math.radians(lat), math.radians(lon)
        n = geo.A / math.sqrt(1 - e2 * math.sin(p) ** 2)
        return np.array([n * math.cos(p) * math.cos(q), n * math.cos(p) * math.sin(q), n * (1 - e2) * math.sin(p)])

    for (a, b, c, d), (away, towards, x, y), (back, *_) in zip(rows, lengths(spark, rows), lengths(spark, [(c, d, a, b) for a, b, c, d in rows]), strict=True):
        chord, p, t = float(np.linalg.norm(space(a, b) - space(c, d))), math.radians((a + c) / 2), math.radians(towards)
        m, n = geo.A * (1 - e2) / (1 - e2 * math.sin(p) ** 2) ** 1.5, geo.A / math.sqrt(1 - e2 * math.sin(p) ** 2)
        radius = 1 / (math.cos(t) ** 2 / m + math.sin(t) ** 2 / n)
        assert away == pytest.approx(2 * radius * math.asin(chord / 2 / radius), abs=1e-3) and back == pytest.approx(away, abs=1e-6) and math.hypot(x, y) == pytest.approx(away)
    assert lengths(spark, [(30.0, 75.0, 30.0, 75.0)])[0][0] == 0


def test_degrees_as_kilometres(spark):
    df = spark.createDataFrame([(30.0, 75.0, 30.5, 75.0), (60.0, 10.0, 60.0, 11.0)], "a double, b double, c double, d double")
    got = [r[0] for r in df.select(geo.degree_km(*[F.col(x) for x in "abcd"])).collect()]
    assert got == pytest.approx([55.6, 55.6])
