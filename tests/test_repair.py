"""Polygons against plain areas, and the twelve issues of an import."""

import json
import random

import pytest
from pyspark.sql import functions as F

from terracadence.functions.repair import area, inside, repair
from terracadence.plans.fields import import_fields


def square(x, y, s):
    return [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]


def total(polygons):
    return sum(area(r) for rings in polygons for r in rings)


CASES = {
    "square": ([[square(0.0, 0.0, 2.0)]], "VALID", 4),
    "clockwise": ([[square(0.0, 0.0, 2.0)[::-1]]], "VALID", 4),
    "bow tie": ([[[(0.0, 0.0), (2.0, 2.0), (2.0, 0.0), (0.0, 2.0)]]], "REPAIRED", 2),
    "figure eight": ([[[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0), (1.0, 1.0), (0.0, 1.0)]]], "REPAIRED", 2),
    "spike": ([[[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 4.0), (2.0, 9.0), (2.0, 4.0), (0.0, 4.0)]]], "UNSAFE", 16),
    "inner spike": ([[[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 4.0), (2.0, 2.0), (2.0, 4.0), (0.0, 4.0)]]], "REPAIRED", 16),
    "flat": ([[[(0.0, 0.0), (1.0, 0.0), (2.0, 0.0)]]], "UNSAFE", 0),
    "hole": ([[square(0.0, 0.0, 9.0), square(2.0, 2.0, 3.0)]], "VALID", 72),
    "hole at the edge": ([[square(0.0, 0.0, 9.0), [(0.0, 5.0), (3.0, 4.0), (3.0, 6.0)]]], "VALID", 78),
    "hole across the edge": ([[square(0.0, 0.0, 9.0), square(7.0, 7.0, 4.0)]], "REPAIRED", 81 + 16 - 8),
    "hole outside": ([[square(0.0, 0.0, 2.0), square(5.0, 5.0, 1.0)]], "REPAIRED", 5),
    "two apart": ([[square(0.0, 0.0, 1.0)], [square(3.0, 0.0, 1.0)]], "VALID", 2),
    "two that touch": ([[square(0.0, 0.0, 1.0)], [square(1.0, 1.0, 1.0)]], "VALID", 2),
    "two along an edge": ([[square(0.0, 0.0, 1.0)], [square(1.0, 0.0, 1.0)]], "REPAIRED", 2),
    "twice the same": ([[square(0.0, 0.0, 1.0)], [square(0.0, 0.0, 1.0)]], "UNSAFE", 0),
}


@pytest.mark.parametrize("name", CASES)
def test_cases(name):
    polygons, status, size = CASES[name]
    got, out = repair(polygons)
    assert got == status and total(out) == pytest.approx(size)
    if out:
        assert repair(out)[0] == "VALID"


@pytest.mark.parametrize("seed", range(12))
def test_random_rings_keep_their_even_odd_area(seed):
    """Grid cells whose centres lie inside by the rays of the ring as given."""
    rnd = random.Random(seed)
    ring = [(float(rnd.randrange(9)), float(rnd.randrange(9))) for _ in range(rnd.randrange(4, 12))]
    ring = [p for k, p in enumerate(ring) if p != ring[k - 1]]
    _, out = repair([[ring]])
    n = 400
    raw = list(zip(ring, ring[1:] + ring[:1], strict=True))
    done = [e for rings in out for r in rings for e in zip(r, r[1:] + r[:1], strict=True)]
    spots = [(rnd.uniform(0, 8), rnd.uniform(0, 8)) for _ in range(n)]
    assert all(inside(*p, raw) == inside(*p, done) for p in spots)
    assert all((area(r) > 0) == (k == 0) for rings in out for k, r in enumerate(rings))
    hits = sum(inside(x / 40 + 1 / 80, y / 40 + 1 / 80, raw) for x in range(320) for y in range(320)) / 1600
    assert total(out) == pytest.approx(hits, abs=0.25)


def test_the_twelve_issues(spark):
    ring = lambda x, y, s: [[*map(list, square(x, y, s)), [x, y]]]
    shape = lambda coordinates, kind="Polygon": json.dumps({"type": kind, "coordinates": coordinates})
    bow = [[[75.2, 30.0], [75.201, 30.001], [75.201, 30.0], [75.2, 30.001], [75.2, 30.0]]]
    rows = [
        (1, "a", shape(ring(75.0, 30.0, 0.001)), []), (2, None, shape(ring(75.1, 30.0, 0.001)), ["missing_required_attribute:field_id"]), (3, "a", shape(ring(75.3, 30.0, 0.001)), ["duplicate_field_id"]),
        (4, "d", None, ["missing_required_attribute:geometry", "empty_geometry"]), (5, "e", '{"type": "Polygon", "coordinates": [[[1, ', ["unreadable_geometry", "empty_geometry"]), (6, "f", shape([]), ["empty_geometry"]),
        (7, "g", shape([75.0, 30.0], "Point"), ["geometry_not_polygon"]), (8, "h", shape(ring(179.9995, 30.0, 0.001)), ["coordinates_outside_valid_wgs84_bounds"]), (9, "i", shape([[[75.4, 30.0], [75.5, 30.0], [75.6, 30.0], [75.4, 30.0]]]), ["invalid_geometry_not_safely_repairable"]),
        (10, "j", shape(ring(75.7, 30.0, 0.001)).replace("75.7", "1e999"), ["coordinates_outside_valid_wgs84_bounds", "invalid_geometry_repair_failed"]), (11, "k", shape([ring(75.0, 30.0, 0.001)], "MultiPolygon"), ["duplicate_geometry"]),
        (12, "l", shape(ring(75.8, 30.0, 0.00001)), ["area_below_minimum"]), (13, "m", shape(bow), []), (14, "n", shape([[[75.0, 30.0], [75.1, 30.0]]]), ["unreadable_geometry", "empty_geometry"]), (15, "", "null", ["missing_required_attribute:field_id", "missing_required_attribute:geometry", "empty_geometry"]),
    ]
    df = spark.createDataFrame([(*r[:3], "clash") for r in rows], "feature_index long, field_id string, geometry string, kind string")
    got = {r.feature_index: r for r in import_fields(df).collect()}
    assert {k: list(r.issues) for k, r in got.items()} == {r[0]: r[3] for r in rows}
    assert [k for k, r in got.items() if r.geometry_repaired] == [13]
    assert got[13].area_ha == pytest.approx(got[1].area_ha / 2, rel=1e-3) and len(got[13].polygons) == 2
    assert got[1].kind == "clash" and import_fields(df.limit(0)).count() == 0


def test_small_areas_far_from_the_origin(spark):
    """Products of coordinates of millions of metres do not swallow a ring of a hand's breadth."""
    from terracadence.functions import geo as G

    ring = F.array(*[F.struct(F.lit(500_000.0 + x).alias("x"), F.lit(9_990_000.0 + y).alias("y")) for x, y in ((0, 0), (0.0078125, 0), (0.0078125, 0.0078125), (0, 0.0078125))])
    x, y = G.ring_centroid(ring)
    r = spark.range(1).select(G.ring_area(ring).alias("a"), x.alias("x"), y.alias("y")).first()
    assert r.a == 0.0078125**2 and (r.x, r.y) == (500_000.00390625, 9_990_000.00390625)
