"""Geometry as column expressions: rings, cells, norms, transforms. All but the search of irregular tiles stay in the JVM.

Points are struct<x,y> of doubles, cells struct<x,y> of ints, rings open arrays of points.
Whole numbers come from ``floor(v + 0.5)``: ``round`` would turn -0.5 into -1. Quotients
by zero are null. Nulls in, null out.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .grids import EPS, Grid, grid


def half_up(v: Column) -> Column:
    return F.floor(v + 0.5).cast("int")


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def cell(x: Column, y: Column) -> Column:
    return F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))


# rings


def edges(ring: Column) -> Column:
    """The edges of an open ring as an array of (a, b)."""
    nxt = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.zip_with(ring, nxt, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _total(items: Column, f) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda s, e: s + f(e))


def signed_area(ring: Column) -> Column:
    """Area, positive for counter-clockwise rings."""
    return _total(edges(ring), lambda e: e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]) / 2


def area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def perimeter(ring: Column) -> Column:
    return _total(edges(ring), lambda e: F.hypot(e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]))


def counter_clockwise(ring: Column) -> Column:
    return F.when(signed_area(ring) < 0, F.reverse(ring)).otherwise(ring)


def ring_centroid(ring: Column) -> Column:
    """Centroid by area; null for a ring without area."""
    six = signed_area(ring) * 6

    def part(axis: str) -> Column:
        return F.try_divide(_total(edges(ring), lambda e: (e["a"][axis] + e["b"][axis]) * (e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])), six)

    return F.when(six != 0, point(part("x"), part("y")))


def box(ring: Column) -> Column:
    """left, bottom, right, top of a ring."""
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("left"), F.array_min(ys).alias("bottom"), F.array_max(xs).alias("right"), F.array_max(ys).alias("top"))


def fatness(ring: Column) -> Column:
    """2 sqrt(pi · area) / perimeter: one for a disc, near zero for a thread."""
    return F.try_divide(2 * F.sqrt(F.lit(math.pi) * area(ring)), perimeter(ring))


def on_segment(a: Column, b: Column, px: Column, py: Column, eps: float = EPS) -> Column:
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    t = F.coalesce(F.try_divide((px - a["x"]) * dx + (py - a["y"]) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return F.hypot(a["x"] + t * dx - px, a["y"] + t * dy - py) <= eps


def contains(ring: Column, px: Column, py: Column, eps: float = EPS) -> Column:
    """Whether a ring holds a point: the boundary counts for eps >= 0, for eps < 0 the point must lie that far inside."""
    if eps < 0:
        return contains(ring, px, py, 0.0) & ~F.exists(edges(ring), lambda e: on_segment(e["a"], e["b"], px, py, -eps))

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        at = a["x"] + F.try_divide((py - a["y"]) * (b["x"] - a["x"]), b["y"] - a["y"])
        return F.when((a["y"] > py) != (b["y"] > py), (px < at).cast("int")).otherwise(0)

    odd = F.aggregate(edges(ring), F.lit(0), lambda s, e: s + crosses(e)) % 2 == 1
    return odd | F.exists(edges(ring), lambda e: on_segment(e["a"], e["b"], px, py, eps))


def segment_distance(px: Column, py: Column, a: Column, b: Column) -> Column:
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    t = F.coalesce(F.try_divide((px - a["x"]) * dx + (py - a["y"]) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return F.hypot(a["x"] + t * dx - px, a["y"] + t * dy - py)


def ring_distance(p: Column, q: Column) -> Column:
    """Smallest vertex-to-edge distance between two rings, both ways."""

    def one_way(r: Column, s: Column) -> Column:
        return F.array_min(F.transform(r, lambda v: F.array_min(F.transform(edges(s), lambda e: segment_distance(v["x"], v["y"], e["a"], e["b"])))))

    return F.least(one_way(p, q), one_way(q, p))


def orientation(a: Column, b: Column, c: Column, eps: float = EPS) -> Column:
    """1 if a, b, c turn left, -1 if right, 0 if straight."""
    turn = (b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"])
    return F.when(turn > eps, 1).when(turn < -eps, -1).otherwise(0)


def segments_cross(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Whether two segments cross at an inner point of both."""
    return (orientation(a, b, c) * orientation(a, b, d) < 0) & (orientation(c, d, a) * orientation(c, d, b) < 0)


def quadrant(dx: Column, dy: Column) -> Column:
    """1 to 4, counter-clockwise; each begins with its clockwise axis; 0 for the null vector."""
    return F.when((dx > 0) & (dy >= 0), 1).when((dx <= 0) & (dy > 0), 2).when((dx < 0) & (dy <= 0), 3).when((dx >= 0) & (dy < 0), 4).otherwise(0)


def angle_difference(a: Column, b: Column) -> Column:
    """Unsigned difference of two angles, at most pi."""
    d = F.pmod(a - b, F.lit(2 * math.pi))
    return F.least(d, F.lit(2 * math.pi) - d)


# grids


def variant(x: Column, g: Grid) -> Column:
    return F.pmod(x, F.lit(g.pc)).cast("int")


def pattern_column(x: Column, g: Grid) -> Column:
    return F.floor(x / g.pc).cast("int")


def _by_variant(x: Column, g: Grid, values: list[float]) -> Column:
    if g.pc == 1:
        return F.lit(float(values[0]))
    return F.element_at(F.array(*(F.lit(float(v)) for v in values)), variant(x, g) + 1)


def cell_centroid(x: Column, y: Column, g: Grid) -> Column:
    column = pattern_column(x, g)
    return point(
        _by_variant(x, g, list(g.centroids[:, 0])) + column * g.right[0] + y * g.up[0],
        _by_variant(x, g, list(g.centroids[:, 1])) + column * g.right[1] + y * g.up[1],
    )


def cell_boundary(x: Column, y: Column, g: Grid) -> Column:
    """The tile of a cell as a ring."""
    rings = F.array(*(F.array(*(point(F.lit(float(px)), F.lit(float(py))) for px, py in r)) for r in g.tiles))
    column = pattern_column(x, g)
    dx, dy = column * g.right[0] + y * g.up[0], column * g.right[1] + y * g.up[1]
    return F.transform(F.element_at(rings, variant(x, g) + 1), lambda p: point(p["x"] + dx, p["y"] + dy))


def cell_area(x: Column, g: Grid) -> Column:
    return _by_variant(x, g, [float(a) for a in g.areas])


def containing_cell(px: Column, py: Column, g: Grid) -> Column:
    """The cell that holds a point, in closed form where the grid has one; else by a search of the tiles around it."""
    a, b, c, d, e, f = (float(v) for v in g.inverse)
    ix, iy = (px * a + py * c + e, px * b + py * d + f) if g.matrix != (1.0, 0.0, 0.0, 1.0, 0.0, 0.0) else (px, py)
    if g.base == "SQUARE":
        return cell(half_up(ix), half_up(iy))
    if g.base == "STAGSQUARE":
        y = half_up(iy)
        return cell(half_up(ix + y * 0.5), y)
    if g.base == "TRIANGLE":
        x, y = half_up(ix), half_up(iy)
        return cell(2 * x + F.when(ix - x >= iy - y, 0).otherwise(1), y)
    if g.base == "HEXAGON":
        v = iy / 1.5
        u = ix / math.sqrt(3) + v / 2
        q, r, t = u - v, v, -u  # one coordinate per direction of rows, see nearest_hexagon
        i, j, k = (F.floor(w + 0.5) for w in (q, r, t))
        di, dj, dk = F.abs(i - q), F.abs(j - r), F.abs(k - t)
        third = (dk > di) & (dk > dj)
        return cell(F.when(third, i + j).otherwise(-k), F.when(~third & (dj > di), -i - k).otherwise(j))
    return _holding(g.name)(px.cast("double"), py.cast("double"))


def _holding(name: str) -> Callable[[Column, Column], Column]:
    """The search of tiles around a point as an Arrow function: a batch of points at once; null where no tile holds one."""

    @F.pandas_udf("x int, y int")
    def find(px: pd.Series, py: pd.Series) -> pd.DataFrame:
        x, y, found = grid(name).containing_many(px.to_numpy(float), py.to_numpy(float))
        return pd.DataFrame({"x": pd.Series(x).where(found).astype("Int32"), "y": pd.Series(y).where(found).astype("Int32")})

    return lambda px, py: F.when(px.isNotNull() & py.isNotNull(), _whole(find(px, py)))


def _whole(c: Column) -> Column:
    return F.when(c["x"].isNotNull(), c)


def norm(ax: Column, ay: Column, bx: Column, by: Column, g: Grid) -> Column:
    """Steps between two cells as the grid counts them."""
    dx, dy = bx - ax, by - ay

    def hexagonal(p: Column, q: Column) -> Column:
        return F.when(p * q >= 0, F.greatest(F.abs(p), F.abs(q))).otherwise(F.abs(p) + F.abs(q))

    if g.base == "SQUARE":
        out = F.abs(dx) + F.abs(dy)
    elif g.base in ("HEXAGON", "STAGSQUARE"):
        out = hexagonal(dx, dy)
    elif g.base == "TRIANGLE":
        out = 2 * hexagonal(F.when(dx >= 0, F.floor(dx / 2)).otherwise(-F.floor(-dx / 2)), dy) + (F.pmod(ax, F.lit(2)) != F.pmod(bx, F.lit(2))).cast("int")
    else:
        p, q = cell_centroid(ax, ay, g), cell_centroid(bx, by, g)
        out = half_up(F.hypot(q["x"] - p["x"], q["y"] - p["y"]))
    return out.cast("int")


def lattice_steps(vx: Column, vy: Column, g: Grid) -> Column:
    """The lattice translation nearest to a vector, as a cell offset."""
    det = g.right[0] * g.up[1] - g.right[1] * g.up[0]
    return cell(half_up((vx * g.up[1] - vy * g.up[0]) / det) * g.pc, half_up((vy * g.right[0] - vx * g.right[1]) / det))


def plus(a: Column, b: Column) -> Column:
    return cell(a["x"] + b["x"], a["y"] + b["y"])


def minus(a: Column, b: Column) -> Column:
    return cell(a["x"] - b["x"], a["y"] - b["y"])


def times(a: Column, k: Column | float) -> Column:
    """A cell offset times a number, rounded half up."""
    return cell(half_up(a["x"] * k), half_up(a["y"] * k))


def inverse(a: Column) -> Column:
    return cell(-a["x"], -a["y"])


def local_root(a: Column, g: Grid) -> Column:
    """Variant 0 of the cell's pattern."""
    return cell(pattern_column(a["x"], g) * g.pc, a["y"])


def is_lattice_offset(a: Column, g: Grid) -> Column:
    """Whether an offset keeps every cell's variant."""
    return F.pmod(a["x"], F.lit(g.pc)) == 0


def shift_variant(a: Column, to: Column | int, g: Grid) -> Column:
    return cell(pattern_column(a["x"], g) * g.pc + F.lit(to) if isinstance(to, int) else pattern_column(a["x"], g) * g.pc + to, a["y"])


def refine(x: Column, y: Column, g: Grid) -> Column:
    """The cells of a grid twice as fine that a cell becomes (square and hexagonal grids)."""
    if g.base not in ("SQUARE", "HEXAGON"):
        raise ValueError(f"{g.name} has no rule for refinement")
    steps = [(i, j) for i in (0, 1) for j in (0, 1)] if g.base == "SQUARE" else [(0, 0), (0, 1), (1, 1), (1, 2)]
    return F.array(*(cell(2 * x + i, 2 * y + j) for i, j in steps))


# transforms: struct<sx,sy,tx,ty>, scaling about the origin, then moving


def transform(sx: Column, sy: Column, tx: Column, ty: Column) -> Column:
    return F.struct(sx.cast("double").alias("sx"), sy.cast("double").alias("sy"), tx.cast("double").alias("tx"), ty.cast("double").alias("ty"))


def apply(t: Column, x: Column, y: Column) -> Column:
    return point(x * t["sx"] + t["tx"], y * t["sy"] + t["ty"])


def unapply(t: Column, x: Column, y: Column) -> Column:
    return point(F.try_divide(x - t["tx"], t["sx"]), F.try_divide(y - t["ty"], t["sy"]))


def fit_box(source: Column, target: Column) -> Column:
    """The transform that puts one box into another: one scale, centred."""
    s = F.least(F.try_divide(target["right"] - target["left"], source["right"] - source["left"]), F.try_divide(target["top"] - target["bottom"], source["top"] - source["bottom"]))
    return transform(s, s, (target["left"] + target["right"]) / 2 - s * (source["left"] + source["right"]) / 2, (target["bottom"] + target["top"]) / 2 - s * (source["bottom"] + source["top"]) / 2)


def guide_point(cx: Column, cy: Column, factor: Column, tx: Column, ty: Column) -> Column:
    """The map point of a place in a guide: (place - translation) / factor."""
    return point(F.try_divide(cx - tx, factor), F.try_divide(cy - ty, factor))
