"""Rasters that come back as they were written, windows that read their tiles only, and painted pixels."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terracadence.operators.paint import paint, paint_order
from terracadence.sources import raster


@pytest.fixture(scope="module")
def image(tmp_path_factory):
    rnd = np.random.default_rng(0)
    pixels = rnd.integers(0, 1000, (53, 75, 2)).astype(float)
    pixels[5:9, 10:30] = np.nan
    path = str(tmp_path_factory.mktemp("raster") / "a.tif")
    with open(path, "wb") as f:
        f.write(raster.encode_raster(pixels, 16, scale=(10.0, 10.0), origin=(500_000.0, 3_300_000.0)))
    return path, pixels


def grid(df, n, m, band):
    out = np.full((n, m), np.nan)
    for r in df.collect():
        assert np.isnan(out[r.row, r.col])
        out[r.row, r.col] = np.nan if r.bands[band] is None else r.bands[band]
    return out


@pytest.mark.parametrize("deflate", [True, False])
def test_round_trip(spark, tmp_path, image, deflate):
    path, pixels = str(tmp_path / "b.tif"), image[1]
    with open(path, "wb") as f:
        f.write(raster.encode_raster(pixels, 32, deflate))
    df = raster.read_raster(spark, [path])
    for band in (0, 1):
        assert np.array_equal(grid(df, 53, 75, band), pixels[:, :, band], equal_nan=True)


@pytest.mark.parametrize("factor, window", [(1, (3, 20, 40, 61)), (4, (0, 0, 53, 75)), (5, (7, 9, 52, 70)), (16, None), (100, None)])
def test_windows_and_downsampling(spark, image, factor, window):
    path, pixels = image
    t, l, b, r = window or (0, 0, 53, 75)
    part, k = pixels[t:b, l:r, 1], factor
    n, m = math.ceil(part.shape[0] / k), math.ceil(part.shape[1] / k)
    cells = [[part[i * k : (i + 1) * k, j * k : (j + 1) * k] for j in range(m)] for i in range(n)]
    mean = np.array([[np.nan if np.isnan(c).all() else np.nanmean(c) for c in row] for row in cells])
    near = np.array([[c[min(k // 2, c.shape[0] - 1), min(k // 2, c.shape[1] - 1)] for c in row] for row in cells])
    assert np.allclose(grid(raster.read_raster(spark, [path], window, k, "average"), n, m, 1), mean, equal_nan=True)
    assert np.array_equal(grid(raster.read_raster(spark, [path], window, k), n, m, 1), near, equal_nan=True)


def test_a_window_reads_its_own_tiles(image, monkeypatch):
    path, _ = image
    reader = raster.RasterReader({"path": path, "window": "17,33,31,47", "factor": "1"})
    blocks = reader.partitions()
    seen = []
    tile = raster.read_tile
    monkeypatch.setattr(raster, "read_tile", lambda p, layout, i, j: seen.append((i, j)) or tile(p, layout, i, j))
    rows = sum(len(b) for block in blocks for b in reader.read(block))
    assert len(blocks) == 1 and set(seen) == {(1, 2)} and rows == 14 * 14
    whole = raster.RasterReader({"path": path}).partitions()
    assert len(whole) == 4 * 5 and sum((b.bottom - b.top) * (b.right - b.left) for b in whole) == 53 * 75


def test_places_and_nodata(spark, image):
    path, pixels = image
    first = raster.read_raster(spark, [path], factor=2, resampling="average", nodata=pixels[0, 0, 0]).where("row = 0 and col = 0").first()
    assert (first.x, first.y) == (500_010.0, 3_299_990.0)
    assert first.bands[0] == pytest.approx(np.mean([v for v in pixels[:2, :2, 0].ravel() if v != pixels[0, 0, 0]]))


def test_rows_written_as_rasters(spark, tmp_path):
    rows = [(k % 2, k // 7, k % 7, float(k)) for k in range(0, 70, 3)]
    paths = raster.write_rasters(spark.createDataFrame(rows, "k int, r int, c int, v double"), str(tmp_path / "out"), "k", "r", "c", ["v"], 10, 7, tile=16)
    got = {(r.path[-5], r.row, r.col, r.bands[0]) for r in raster.read_raster(spark, paths).collect() if r.bands[0] is not None}
    assert got == {(str(k), r, c, v) for k, r, c, v in rows}


def test_painted_pixels(spark):
    """Random rings with holes against the even-odd rule at every middle; the greatest class wins."""
    rnd = random.Random(4)
    shapes = []
    for k in range(30):
        x, y = rnd.uniform(-5, 60), rnd.uniform(-5, 45)
        ring = lambda s, x=x, y=y: [(x + s * rnd.uniform(-9, 9), y + s * rnd.uniform(-9, 9)) for _ in range(rnd.randrange(3, 7))]
        shapes.append(([ring(1), ring(0.4)] if k % 2 else [ring(1)], ["CROP", "LOOSE", "STRICT", "OTHER"][k % 4]))
    df = spark.createDataFrame(shapes, "rings array<array<struct<x:double,y:double>>>, tier string").repartition(3)
    got = {(r.row, r.col): r.value for r in paint(df, "rings", paint_order(F.col("tier")), 40, 55, tile=16).collect()}

    def inside(rings, px, py):
        odd = False
        for ring in rings:
            for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
                if (ay <= py) != (by <= py) and px >= ax + (py - ay) * (bx - ax) / (by - ay):
                    odd = not odd
        return odd

    want = {}
    for rings, tier in shapes:
        rank = {"CROP": 1, "LOOSE": 2, "STRICT": 3}.get(tier)
        for i in range(40):
            for j in range(55):
                if rank and inside(rings, j + 0.5, i + 0.5):
                    want[i, j] = max(rank, want.get((i, j), 0))
    assert got == want and len(set(got.values())) == 3


def test_shapes_side_by_side_share_no_pixel(spark):
    square = lambda x, y: [[(float(x), float(y)), (x + 4.0, float(y)), (x + 4.0, y + 4.0), (float(x), y + 4.0)]]
    df = spark.createDataFrame([(square(4 * a, 4 * b),) for a in range(3) for b in range(3)] + [([],), (None,)], "rings array<array<struct<x:double,y:double>>>")
    from terracadence.operators.paint import scan_lines

    assert scan_lines(df, "rings").agg(F.sum(F.col("last") - F.col("first") + 1)).first()[0] == 144
    assert paint(df, "rings", F.lit(1), 12, 12).count() == 144
