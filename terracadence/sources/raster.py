"""Tiled rasters as a Spark source (S-07): partitions by tile, windows and downsampling inside the reader, and a writer of the same files.

Files are baseline TIFF: tiles of float64 bands, pixel by pixel, stored or deflated, placed by a scale and a tie point.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..shipping import ship

# Tags of the file format, and the sizes of its number types.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, SAMPLES, PLANAR, TILE_WIDTH, TILE_HEIGHT, OFFSETS, COUNTS, FORMAT, SCALE, TIE = 256, 257, 258, 259, 262, 277, 284, 322, 323, 324, 325, 339, 33550, 33922
TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 11: "f", 12: "d", 16: "Q"}
STORED, DEFLATED = 1, 8


@dataclass
class Layout:
    """What a raster's head says."""

    height: int
    width: int
    bands: int
    tile_height: int
    tile_width: int
    deflated: bool
    dtype: str
    offsets: tuple[int, ...]
    counts: tuple[int, ...]
    scale: tuple[float, ...]
    tie: tuple[float, ...]

    @property
    def across(self) -> int:
        return -(-self.width // self.tile_width)


def _file(path: str):
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return store.open_input_file(name)


def read_layout(path: str) -> Layout:
    """The head alone; pixels are not touched."""
    with _file(path) as f:
        head = f.read_at(8, 0)
        order = {b"II": "<", b"MM": ">"}[head[:2]]
        magic, at = struct.unpack(f"{order}HI", head[2:])
        if magic != 42:
            raise ValueError(f"{path} is no baseline TIFF")
        (n,) = struct.unpack(f"{order}H", f.read_at(2, at))
        tags = {}
        for k in range(n):
            tag, kind, count, inline = struct.unpack(f"{order}HHI4s", f.read_at(12, at + 2 + 12 * k))
            if kind not in TYPES:
                continue
            shape = f"{order}{count}{TYPES[kind]}" if len(TYPES[kind]) == 1 else f"{order}{2 * count}I"
            size = struct.calcsize(shape)
            data = inline[:size] if size <= 4 else f.read_at(size, struct.unpack(f"{order}I", inline)[0])
            tags[tag] = struct.unpack(shape, data)
    if TILE_WIDTH not in tags or tags.get(PLANAR, (1,))[0] != 1 or tags.get(COMPRESSION, (1,))[0] not in (STORED, DEFLATED):
        raise ValueError(f"{path}: tiles of whole pixels, stored or deflated, are needed")
    kind = {1: "u", 2: "i", 3: "f"}[tags.get(FORMAT, (1,))[0]]
    return Layout(tags[HEIGHT][0], tags[WIDTH][0], tags.get(SAMPLES, (1,))[0], tags[TILE_HEIGHT][0], tags[TILE_WIDTH][0], tags.get(COMPRESSION, (1,))[0] == DEFLATED, f"{order}{kind}{tags[BITS][0] // 8}", tags[OFFSETS], tags[COUNTS], tags.get(SCALE, (1.0, 1.0, 0.0)), tags.get(TIE, (0.0,) * 6))


def read_tile(path: str, layout: Layout, i: int, j: int) -> np.ndarray:
    """Rows, columns, bands of one tile, what lies beyond the raster's edges cut off."""
    k = i * layout.across + j
    with _file(path) as f:
        data = f.read_at(layout.counts[k], layout.offsets[k])
    data = zlib.decompress(data) if layout.deflated else data
    tile = np.frombuffer(data, layout.dtype).reshape(layout.tile_height, layout.tile_width, layout.bands)
    return tile[: layout.height - i * layout.tile_height, : layout.width - j * layout.tile_width].astype(np.float64)


def read_box(path: str, layout: Layout, top: int, left: int, bottom: int, right: int) -> np.ndarray:
    """Pixels of a box from the tiles it touches, no others."""
    out = np.full((bottom - top, right - left, layout.bands), np.nan)
    for i in range(top // layout.tile_height, -(-bottom // layout.tile_height)):
        for j in range(left // layout.tile_width, -(-right // layout.tile_width)):
            tile = read_tile(path, layout, i, j)
            r, c = i * layout.tile_height, j * layout.tile_width
            a, b = max(top, r), max(left, c)
            part = tile[a - r : bottom - r, b - c : right - c]
            out[a - top : a - top + part.shape[0], b - left : b - left + part.shape[1]] = part
    return out


@dataclass
class Block(InputPartition):
    """Output pixels [top, bottom) x [left, right) of one file."""

    path: str
    layout: Layout
    top: int
    left: int
    bottom: int
    right: int


class RasterReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options["path"].split("\n") if p]
        self.window = tuple(int(x) for x in options["window"].split(",")) if "window" in options else None
        self.factor, self.average = int(options.get("factor", 1)), options.get("resampling", "nearest") == "average"
        self.nodata = float(options["nodata"]) if "nodata" in options else None

    def _window(self, layout: Layout) -> tuple[int, int, int, int]:
        top, left, bottom, right = self.window or (0, 0, layout.height, layout.width)
        return max(0, top), max(0, left), min(layout.height, bottom), min(layout.width, right)

    def partitions(self) -> list[Block]:
        """A block for each tile that the window touches: the output pixels whose first input pixel lies in it."""
        out, k = [], self.factor
        for path in self.paths:
            layout = read_layout(path)
            top, left, bottom, right = self._window(layout)
            cuts = lambda a, b, size: sorted({0, -(-(b - a) // k), *(-(-(t - a) // k) for t in range((a // size + 1) * size, b, size))})
            rows, cols = cuts(top, bottom, layout.tile_height), cuts(left, right, layout.tile_width)
            out += [Block(path, layout, r, c, s, d) for r, s in zip(rows, rows[1:], strict=False) for c, d in zip(cols, cols[1:], strict=False)]
        return out

    def read(self, block: Block) -> Iterator[pa.RecordBatch]:
        """Output row and column, the place of the pixel's middle, and its bands: the value at its middle, or the mean of what holds one."""
        layout, k = block.layout, self.factor
        top, left, bottom, right = self._window(layout)
        box = (top + block.top * k, left + block.left * k, min(bottom, top + block.bottom * k), min(right, left + block.right * k))
        pixels = read_box(block.path, layout, *box)
        if self.nodata is not None:
            pixels[pixels == self.nodata] = np.nan
        n, m = block.bottom - block.top, block.right - block.left
        if self.average:
            whole = np.full((n * k, m * k, layout.bands), np.nan)
            whole[: pixels.shape[0], : pixels.shape[1]] = pixels
            cells = whole.reshape(n, k, m, k, layout.bands)
            there = ~np.isnan(cells)
            count = there.sum((1, 3))
            values = np.where(count > 0, np.where(there, cells, 0).sum((1, 3)) / np.maximum(count, 1), np.nan)
        else:
            at = lambda size, limit: np.minimum(np.arange(size) * k + k // 2, limit - 1)
            values = pixels[at(n, pixels.shape[0])][:, at(m, pixels.shape[1])]
        row, col = (g.ravel() for g in np.meshgrid(np.arange(block.top, block.bottom), np.arange(block.left, block.right), indexing="ij"))
        x = layout.tie[3] + layout.scale[0] * (left + (col + 0.5) * k - layout.tie[0])
        y = layout.tie[4] - layout.scale[1] * (top + (row + 0.5) * k - layout.tie[1])
        bands = pa.FixedSizeListArray.from_arrays(pa.array(values.reshape(-1, layout.bands).ravel(), pa.float64(), from_pandas=True), layout.bands).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array([block.path] * len(row)), pa.array(row, pa.int64()), pa.array(col, pa.int64()), pa.array(x), pa.array(y), bands], ["path", "row", "col", "x", "y", "bands"])


class RasterSource(DataSource):
    """Options: path (one a line), window (top,left,bottom,right in pixels), factor, resampling (nearest or average), nodata."""

    @classmethod
    def name(cls) -> str:
        return "tiled_raster"

    def schema(self) -> str:
        return "path string, row long, col long, x double, y double, bands array<double>"

    def reader(self, schema) -> RasterReader:
        return RasterReader(self.options)


def read_raster(spark: SparkSession, paths: list[str], window: tuple[int, int, int, int] | None = None, factor: int = 1, resampling: str = "nearest", nodata: float | None = None) -> DataFrame:
    """Pixels of rasters as rows: path, row and col (within the window, downsampled), place of the middle, bands (NULL without a value). Each task reads the tiles of its own block."""
    ship(spark)
    spark.dataSource.register(RasterSource)
    reader = spark.read.format("tiled_raster").option("path", "\n".join(paths)).option("factor", factor).option("resampling", resampling)
    reader = reader.option("window", ",".join(map(str, window))) if window else reader
    return (reader.option("nodata", nodata) if nodata is not None else reader).load()


def encode_raster(pixels: np.ndarray, tile: int = 256, deflate: bool = True, scale: tuple[float, float] = (1.0, 1.0), origin: tuple[float, float] = (0.0, 0.0)) -> bytes:
    """A raster file of rows x columns x bands. tile: a multiple of 16; origin: place of the first pixel's outer corner."""
    height, width, bands = pixels.shape
    down, across = -(-height // tile), -(-width // tile)
    padded = np.full((down * tile, across * tile, bands), np.nan)
    padded[:height, :width] = pixels
    tiles = [padded[i * tile : (i + 1) * tile, j * tile : (j + 1) * tile].astype("<f8").tobytes() for i in range(down) for j in range(across)]
    tiles = [zlib.compress(t) for t in tiles] if deflate else tiles
    tags = [
        (WIDTH, "I", [width]), (HEIGHT, "I", [height]), (BITS, "H", [64] * bands), (COMPRESSION, "H", [DEFLATED if deflate else STORED]), (PHOTOMETRIC, "H", [1]), (SAMPLES, "H", [bands]), (PLANAR, "H", [1]),
        (TILE_WIDTH, "I", [tile]), (TILE_HEIGHT, "I", [tile]), (OFFSETS, "I", [0] * len(tiles)), (COUNTS, "I", [len(t) for t in tiles]), (FORMAT, "H", [3] * bands), (SCALE, "d", [*scale, 0.0]), (TIE, "d", [0.0, 0.0, 0.0, *origin, 0.0]),
    ]
    kinds = {"H": 3, "I": 4, "d": 12}
    at = 8 + 2 + 12 * len(tags) + 4
    long_ = {}
    for tag, kind, values in tags:
        size = len(values) * struct.calcsize(kind)
        if size > 4:
            long_[tag], at = at, at + size + size % 2
    starts = []
    for t in tiles:
        starts.append(at)
        at += len(t)
    entries, data = b"", b""
    for tag, kind, values in tags:
        values = starts if tag == OFFSETS else values
        raw = struct.pack(f"<{len(values)}{kind}", *values)
        entries += struct.pack("<HHI", tag, kinds[kind], len(values)) + (struct.pack("<I", long_[tag]) if tag in long_ else raw.ljust(4, b"\0"))
        data += raw + b"\0" * (len(raw) % 2) if tag in long_ else b""
    return b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", len(tags)) + entries + b"\0\0\0\0" + data + b"".join(tiles)


def write_rasters(pixels: DataFrame, folder: str, key: str, row: str, col: str, bands: list[str], height: int, width: int, tile: int = 256, **options) -> list[str]:
    """A raster for each key, by the task that holds its pixels; missing pixels have no value, of repeated ones the last counts. Returns the paths. A raster is as large as one task can hold; larger areas take several keys."""
    ship(pixels.sparkSession)

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        from pyarrow import fs

        out = np.full((height, width, len(bands)), np.nan)
        out[rows[row].to_numpy(), rows[col].to_numpy()] = rows[bands].to_numpy(np.float64)
        path = f"{folder}/{rows[key].iloc[0]}.tif"
        store, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        store.create_dir(name.rsplit("/", 1)[0], recursive=True)
        with store.open_output_stream(name) as f:
            f.write(encode_raster(out, tile, **options))
        return pd.DataFrame({"path": [path]})

    return sorted(r.path for r in pixels.select(key, row, col, *bands).groupBy(key).applyInPandas(one, "path string").collect())
