"""Questions about whole cell sets that need a walk: parts, holes, boundary rings, distances.

Each set is one drawn region, so a grouped kernel holds one set; sets are handled in parallel.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.grids import Grid, grid
from . import cells as C
from . import guide


def _schema(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in keys)


def _members(pdf: pd.DataFrame) -> set[guide.Cell]:
    return {(int(x), int(y)) for x, y in zip(pdf.x, pdf.y, strict=True)}


def parts(df: DataFrame, g: Grid, keys: list[str]) -> DataFrame:
    """Cells with ``part``, the number of their rook-connected part, in the order of the parts' smallest cells."""
    name = g.name

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(*key, x, y, k) for k, part in enumerate(guide.parts_of(_members(pdf), grid(name))) for x, y in sorted(part)]
        return pd.DataFrame(rows, columns=[*keys, "x", "y", "part"])

    return df.select(*keys, "x", "y").groupBy(*keys).applyInPandas(run, f"{_schema(df, keys)}, x int, y int, part int")


def connected(df: DataFrame, g: Grid, keys: list[str]) -> DataFrame:
    """Per set its number of parts and whether it is in one piece."""
    return parts(df, g, keys).groupBy(*keys).agg((F.max("part") + 1).alias("parts")).withColumn("connected", F.col("parts") == 1)


def holes(df: DataFrame, g: Grid, keys: list[str]) -> DataFrame:
    """Cells that each set encloses, with ``hole``, the number of the hole."""
    name = g.name

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own = grid(name)
        found = guide.holes(_members(pdf), own)
        rows = [(*key, x, y, k) for k, part in enumerate(guide.parts_of(found, own)) for x, y in sorted(part)]
        return pd.DataFrame(rows, columns=[*keys, "x", "y", "hole"])

    return df.select(*keys, "x", "y").groupBy(*keys).applyInPandas(run, f"{_schema(df, keys)}, x int, y int, hole int")


def filled(df: DataFrame, g: Grid, keys: list[str]) -> DataFrame:
    """Each set with its holes."""
    return C.union(df, holes(df, g, keys), keys)


def hole_borders(df: DataFrame, g: Grid, keys: list[str]) -> DataFrame:
    """The cells of each set that touch one of its holes."""
    around = C.contacts(holes(df, g, keys), g, "rook").select(*keys, F.col("nx").alias("x"), F.col("ny").alias("y"))
    return C.intersection(df, around, keys)


def boundary_rings(df: DataFrame, g: Grid, keys: list[str]) -> DataFrame:
    """The closed boundary lines of each set as rings: outer ones counter-clockwise, those of holes clockwise.

    Edges that occur once come from a native aggregate, their chaining from a kernel. At a
    point where lines meet, a line stays with its cell (it takes the sharpest left turn).
    """
    edges = C.outline_edges(df, g, keys)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        import math

        out: dict[tuple[float, float], list[tuple[float, float]]] = {}
        for a, b, c, d in zip(pdf.ax, pdf.ay, pdf.bx, pdf.by, strict=True):
            out.setdefault((a, b), []).append((c, d))
        rows = []
        while any(out.values()):
            start = min(p for p, to in out.items() if to)
            ring, at, came = [], start, None
            while True:
                options = out[at]
                if came is None or len(options) == 1:
                    nxt = min(options)
                else:
                    back = math.atan2(came[1] - at[1], came[0] - at[0])
                    nxt = min(options, key=lambda q: (back - math.atan2(q[1] - at[1], q[0] - at[0])) % (2 * math.pi))
                options.remove(nxt)
                ring.append({"x": at[0], "y": at[1]})
                came, at = at, nxt
                if at == start:
                    break
            rows.append((*key, len(rows), ring))
        return pd.DataFrame(rows, columns=[*keys, "ring_id", "ring"])

    return edges.groupBy(*keys).applyInPandas(run, f"{_schema(df, keys)}, ring_id int, ring array<struct<x:double,y:double>>")


def distance(a: DataFrame, b: DataFrame, g: Grid, keys: list[str]) -> DataFrame:
    """Steps between two sets of each key: 0 if they share a cell, 1 if they touch, else two more than the least norm between their neighbours."""
    meet = C.overlapping(a, b, keys).select(*keys, F.lit(0).alias("steps"))
    touch = C.touching(a, b, g, keys, "rook").select(*keys, F.lit(1).alias("steps"))
    near = C.neighbours(a, g, keys).join(C.neighbours(b, g, keys).withColumnsRenamed({"x": "u", "y": "v"}), keys)
    far = near.groupBy(*keys).agg((F.min(G.norm(F.col("x"), F.col("y"), F.col("u"), F.col("v"), g)) + 2).alias("steps"))
    return meet.unionByName(touch).unionByName(far).groupBy(*keys).agg(F.min("steps").alias("steps"))
