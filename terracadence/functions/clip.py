"""Overlap of polygons (J-22), as an Arrow function: polygon clipping has no column form."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def _area(p: np.ndarray) -> float:
    if len(p) < 3:
        return 0.0
    x, y = p[:, 0], p[:, 1]
    return float(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2


def _clip(subject: list, a, b) -> list:
    """The part of a polygon on the left of the line a -> b."""
    out = []
    side = [(b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0]) for p in subject]
    for i, p in enumerate(subject):
        q, s, t = subject[(i + 1) % len(subject)], side[i], side[(i + 1) % len(subject)]
        if s >= 0:
            out.append(p)
        if s * t < 0:
            k = s / (s - t)
            out.append((p[0] + k * (q[0] - p[0]), p[1] + k * (q[1] - p[1])))
    return out


def _overlap(first: np.ndarray, second: np.ndarray) -> float:
    """Signed triangles of a fan of each polygon, clipped pairwise: exact for any simple polygons."""
    total = 0.0
    fans = [[(p[0], p[i], p[i + 1]) for i in range(1, len(p) - 1)] for p in (first, second)]
    for s in fans[0]:
        sa = _area(np.array(s))
        for t in fans[1]:
            ta = _area(np.array(t))
            if sa == 0 or ta == 0:
                continue
            piece = [tuple(p) for p in (s if sa > 0 else s[::-1])]
            tri = t if ta > 0 else t[::-1]
            for k in range(3):
                piece = _clip(piece, tri[k], tri[(k + 1) % 3]) if piece else piece
            if piece:
                total += abs(_area(np.array(piece))) * (1 if sa > 0 else -1) * (1 if ta > 0 else -1)
    return abs(total)


def overlap_area(a: str, b: str):
    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        points = lambda ring: np.array([(p["x"], p["y"]) for p in ring], float)
        return pd.Series([_overlap(points(p), points(q)) if p is not None and q is not None else None for p, q in zip(x, y, strict=True)], dtype="float64")

    return run(F.col(a), F.col(b))
