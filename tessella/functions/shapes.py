"""Ring functions whose steps depend on each other, as Arrow-fed column functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .grids import EPS, inside_many, ring_centroid

_POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])


def _array(ring) -> np.ndarray:
    return np.array([[p["x"], p["y"]] for p in ring], float).reshape(-1, 2)


def without_degeneracies(ring: np.ndarray, eps: float = EPS) -> np.ndarray:
    """A ring without repeated vertices and without those on the segment between their neighbours, all within ``eps``.

    Of a run of equal vertices the first stays. Whole passes are made until one finds nothing;
    a pass that would leave fewer than three vertices isn't made.
    """
    while len(ring) > 3:
        before, after = np.roll(ring, 1, 0), np.roll(ring, -1, 0)
        drop = np.hypot(*(ring - before).T) <= eps
        drop[0] = False
        if not drop.any():
            d = after - before
            t = np.clip(((ring - before) * d).sum(1) / np.maximum((d * d).sum(1), 1e-300), 0, 1)
            drop = np.hypot(*(before + t[:, None] * d - ring).T) <= eps
        if not drop.any() or (~drop).sum() < 3:
            break
        ring = ring[~drop]
    return ring


def _clearance(ring: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Distance of each point to the ring, negative outside."""
    d = np.roll(ring, -1, 0) - ring
    off = points[:, None] - ring[None]
    t = np.clip((off * d).sum(-1) / np.maximum((d * d).sum(-1), 1e-300), 0, 1)
    far = np.sqrt(((off - t[..., None] * d) ** 2).sum(-1)).min(1)
    return np.where(inside_many(ring, points[:, 0], points[:, 1]), far, -far)


def label_place(ring: np.ndarray, side: int = 12, rounds: int = 16) -> np.ndarray:
    """Where a label has room: a point inside, far from the ring (in narrow shapes not always the farthest).

    The search starts from the middle of the widest piece of every scan line between two
    heights of vertices, of which one at least is inside, and from a lattice over the box;
    then lattices close in on the best point, each half as wide. Of equal points the first holds.
    """
    lo, hi = ring.min(0), ring.max(0)
    heights = np.unique(ring[:, 1])
    a, b = ring, np.roll(ring, -1, 0)
    starts = [ring_centroid(ring)]
    for y in (heights[1:] + heights[:-1]) / 2:
        up = (a[:, 1] > y) != (b[:, 1] > y)
        x = np.sort(a[up, 0] + (y - a[up, 1]) * (b[up, 0] - a[up, 0]) / (b[up, 1] - a[up, 1]))
        wide = int(np.argmax(x[1::2] - x[::2]))
        starts.append(np.array([(x[2 * wide] + x[2 * wide + 1]) / 2, y]))
    unit = (np.stack(np.meshgrid(np.arange(side), np.arange(side)), -1).reshape(-1, 2) + 0.5) / side
    points = np.concatenate([np.array(starts), lo + unit * (hi - lo)])
    span = hi - lo
    best, room = points[0], -np.inf
    for _ in range(rounds):
        far = _clearance(ring, points)
        if far.max() > room + EPS:
            best, room = points[int(far.argmax())], float(far.max())
        span = span / 2
        points = best + (unit - 0.5) * span
    return best


@F.pandas_udf(T.ArrayType(_POINT))
def remove_degeneracies(rings: pd.Series) -> pd.Series:
    return rings.map(lambda r: None if r is None else [{"x": float(x), "y": float(y)} for x, y in without_degeneracies(_array(r))])


@F.pandas_udf(_POINT)
def label_point(rings: pd.Series) -> pd.DataFrame:
    got = [label_place(_array(r)) if r is not None and len(r) > 2 else (None, None) for r in rings]
    return pd.DataFrame({"x": [p[0] for p in got], "y": [p[1] for p in got]})
