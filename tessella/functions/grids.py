"""Regular tilings: their tiles, lattices, transforms, neighbourhoods and lookup tables.

A cell (x, y) of a grid with ``pc`` tiles per pattern has variant ``x mod pc`` and pattern
column ``floor(x / pc)``; its place is the variant's tile shifted by column · right + y · up.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession

EPS = 1e-6
CONTACT = 1e-3

# The two goose tiles, before centring, and their lattice.
GOOSE_LOWER = [(300, 272), (282, 268), (254, 266), (216, 254), (200, 222), (178, 218), (152, 224), (112, 208), (126, 230), (144, 248), (160, 256), (134, 274), (112, 296), (142, 292), (158, 296), (144, 318), (112, 336), (130, 332), (158, 330), (196, 318), (212, 286), (234, 282), (260, 288)]
GOOSE_UPPER = [(300, 272), (260, 288), (234, 282), (212, 286), (196, 318), (158, 330), (130, 332), (112, 336), (152, 352), (178, 346), (200, 350), (216, 382), (254, 394), (282, 396), (300, 400), (284, 392), (266, 374), (252, 352), (284, 334), (298, 312), (282, 308), (252, 312), (274, 290)]
GOOSE_RIGHT, GOOSE_UP = (140.0, 16.0), (0.0, 128.0)


def ring_area(ring: np.ndarray) -> float:
    """Signed area, positive for counter-clockwise rings."""
    x, y = ring[:, 0], ring[:, 1]
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2)


def ring_centroid(ring: np.ndarray) -> np.ndarray:
    """Centroid by area; the mean vertex where the area is zero."""
    nxt = np.roll(ring, -1, 0)
    cross = ring[:, 0] * nxt[:, 1] - nxt[:, 0] * ring[:, 1]
    area = cross.sum()
    if abs(area) < 1e-12:
        return ring.mean(0)
    return ((ring + nxt) * cross[:, None]).sum(0) / (3 * area)


@dataclass(frozen=True)
class Grid:
    """A tiling. ``rings`` and the lattice are transformed; ``matrix`` (2x3) is the transform; ``base`` names the untransformed grid."""

    name: str
    base: str
    rings: tuple[tuple[tuple[float, float], ...], ...]
    right: tuple[float, float]
    up: tuple[float, float]
    coarse: str | None = None
    matrix: tuple[float, ...] = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)

    @property
    def pc(self) -> int:
        return len(self.rings)

    @cached_property
    def lattice(self) -> np.ndarray:
        """Columns right and up."""
        return np.array([self.right, self.up]).T

    @cached_property
    def inverse(self) -> tuple[float, ...]:
        """The inverse transform as (m00, m10, m01, m11, m02, m12)."""
        a, b, c, d, e, f = self.matrix
        det = a * d - b * c
        return (d / det, -b / det, -c / det, a / det, (c * f - d * e) / det, (b * e - a * f) / det)

    @cached_property
    def tiles(self) -> list[np.ndarray]:
        return [np.array(r) for r in self.rings]

    @cached_property
    def centroids(self) -> np.ndarray:
        return np.array([ring_centroid(r) for r in self.tiles])

    @cached_property
    def areas(self) -> np.ndarray:
        return np.array([abs(ring_area(r)) for r in self.tiles])

    @property
    def average_area(self) -> float:
        return abs(self.right[0] * self.up[1] - self.right[1] * self.up[0]) / self.pc

    def _changed(self, m: np.ndarray, suffix: str) -> Grid:
        def go(p: tuple[float, float]) -> tuple[float, float]:
            q = m @ np.array(p)
            return float(q[0]), float(q[1])

        a, b, c, d, e, f = self.matrix
        both = m @ np.array([[a, c, e], [b, d, f]])
        matrix = tuple(float(both[i, j]) for j in range(3) for i in range(2))
        return Grid(self.name + suffix, self.base, tuple(tuple(go(p) for p in r) for r in self.rings), go(self.right), go(self.up), self.coarse and self.coarse + suffix, matrix)

    def rotate(self, degrees: float) -> Grid:
        a = math.radians(degrees)
        return self._changed(np.array([[math.cos(a), -math.sin(a)], [math.sin(a), math.cos(a)]]), f"!r!{float(degrees)}")

    def scale(self, sx: float, sy: float) -> Grid:
        return self._changed(np.array([[sx, 0.0], [0.0, sy]]), f"!s!{float(sx)}!{float(sy)}")

    def shear(self, hx: float, hy: float) -> Grid:
        return self._changed(np.array([[1.0, hx], [hy, 1.0]]), f"!h!{float(hx)}!{float(hy)}")

    def renamed(self, name: str) -> Grid:
        return Grid(name, self.base, self.rings, self.right, self.up, self.coarse, self.matrix)

    # cells

    def offset(self, x: int, y: int) -> np.ndarray:
        return (x // self.pc) * np.array(self.right) + y * np.array(self.up)

    def centroid(self, x: int, y: int) -> np.ndarray:
        return self.centroids[x % self.pc] + self.offset(x, y)

    def boundary(self, x: int, y: int) -> np.ndarray:
        return self.tiles[x % self.pc] + self.offset(x, y)

    def closest_lattice(self, v: np.ndarray) -> tuple[int, int]:
        """The lattice translation nearest to a vector, as a cell offset."""
        a, b = np.floor(np.linalg.solve(self.lattice, v) + 0.5)
        return int(a) * self.pc, int(b)

    def containing(self, px: float, py: float) -> tuple[int, int] | None:
        """The cell that holds a point: the grid's own rule, else a search of the patterns around it."""
        a, b, c, d, e, f = self.inverse
        ix, iy = a * px + c * py + e, b * px + d * py + f
        if self.base == "SQUARE":
            return math.floor(ix + 0.5), math.floor(iy + 0.5)
        if self.base == "STAGSQUARE":
            y = math.floor(iy + 0.5)
            return math.floor(ix + y / 2 + 0.5), y
        if self.base == "TRIANGLE":
            x, y = math.floor(ix + 0.5), math.floor(iy + 0.5)
            return 2 * x + (0 if ix - x >= iy - y else 1), y
        if self.base == "HEXAGON":
            return nearest_hexagon(ix, iy)
        x, y, found = self.containing_many(np.array([px]), np.array([py]))
        return (int(x[0]), int(y[0])) if found[0] else None

    def containing_many(self, px: np.ndarray, py: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each point the cell whose tile holds it (x, y) and whether there is one, by trying the tiles around it.

        Tiles are tried in the order of their patterns' distance from the point's own pattern. The tile whose
        edges a ray from the point crosses an odd number of times holds it; points that are in none so are on a border, within
        EPS, and go to the first tile there. A tile is tested against the points in its box alone.
        """
        px, py = np.asarray(px, float), np.asarray(py, float)
        at = np.floor(np.linalg.solve(self.lattice, np.array([px, py])) + 0.5)
        x, y, open_ = np.zeros(len(px), np.int64), np.zeros(len(px), np.int64), np.isfinite(px) & np.isfinite(py)
        at[:, ~open_] = 0
        found = np.zeros(len(px), bool)
        for holds in (crossed_oddly, inside_many):
            for i, j in AROUND:
                if not open_.any():
                    return x, y, found
                p, q = at[0] + i, at[1] + j
                qx, qy = px - p * self.right[0] - q * self.up[0], py - p * self.right[1] - q * self.up[1]
                for v, tile in enumerate(self.tiles):
                    lo, hi = tile.min(0) - EPS, tile.max(0) + EPS
                    near = np.flatnonzero(open_ & (qx >= lo[0]) & (qx <= hi[0]) & (qy >= lo[1]) & (qy <= hi[1]))
                    hit = near[holds(tile, qx[near], qy[near])]
                    x[hit], y[hit] = p[hit] * self.pc + v, q[hit]
                    found[hit], open_[hit] = True, False
        return x, y, found

    def norm(self, ax: int, ay: int, bx: int, by: int) -> int:
        """Steps between cells as this grid counts them."""
        dx, dy = bx - ax, by - ay

        def hexagonal(p: int, q: int) -> int:
            return max(abs(p), abs(q)) if p * q >= 0 else abs(p) + abs(q)

        if self.base == "SQUARE":
            return abs(dx) + abs(dy)
        if self.base in ("HEXAGON", "STAGSQUARE"):
            return hexagonal(dx, dy)
        if self.base == "TRIANGLE":
            return 2 * hexagonal(int(dx / 2), dy) + (ax % 2 != bx % 2)
        return math.floor(float(np.hypot(*(self.centroid(bx, by) - self.centroid(ax, ay)))) + 0.5)

    @cached_property
    def neighbours(self) -> list[list[tuple[int, int, str]]]:
        """Per variant: (dx, dy, rook or bishop) of the touching cells, counter-clockwise.

        Cells that share a piece of an edge are rook neighbours, those that share only a
        point are bishop neighbours.
        """
        out = []
        for v in range(self.pc):
            found = []
            own = self.tiles[v]
            for i in (-1, 0, 1):
                for j in (-1, 0, 1):
                    for w in range(self.pc):
                        dx, dy = i * self.pc + w - v, j
                        if (dx, dy) == (0, 0):
                            continue
                        touch = contact(own, self.boundary(v + dx, dy))
                        if touch:
                            kind, at = touch
                            angle = math.atan2(*(at - self.centroids[v])[::-1])
                            found.append((angle, dx, dy, kind))
            out.append([(dx, dy, kind) for _, dx, dy, kind in sorted(found)])
        return out

    def adjacent(self, x: int, y: int, kind: str = "rook") -> list[tuple[int, int]]:
        """Neighbour cells: rook, bishop or queen (both)."""
        return [(x + dx, y + dy) for dx, dy, k in self.neighbours[x % self.pc] if kind in ("queen", k)]

    @cached_property
    def unit_vectors(self) -> list[tuple[int, int]]:
        """Lattice steps between touching patterns, as cell offsets, counter-clockwise."""
        steps = {((v + dx) // self.pc, dy) for v in range(self.pc) for dx, dy, _ in self.neighbours[v]} - {(0, 0)}
        return [(i * self.pc, j) for i, j in sorted(steps, key=lambda s: math.atan2(*(self.lattice @ np.array(s))[::-1]))]

    def nonneighbour_distance(self, v: int = 0) -> float:
        """Smallest centroid distance from a variant's cell to one that doesn't touch it."""
        near = {(dx, dy) for dx, dy, _ in self.neighbours[v]} | {(0, 0)}
        far = [(dx, dy) for dx in range(-3 * self.pc, 3 * self.pc + 1) for dy in range(-3, 4) if (dx, dy) not in near]
        return min(float(np.hypot(*(self.centroid(v + dx, dy) - self.centroids[v]))) for dx, dy in far)

    def refined(self, x: int, y: int) -> list[tuple[int, int]] | None:
        """The four cells that a cell becomes on a grid twice as fine; None where the grid has no such rule."""
        if self.base == "SQUARE":
            return [(2 * x + i, 2 * y + j) for i in (0, 1) for j in (0, 1)]
        if self.base == "HEXAGON":
            return [(2 * x, 2 * y), (2 * x, 2 * y + 1), (2 * x + 1, 2 * y + 1), (2 * x + 1, 2 * y + 2)]
        return None


#: patterns around a point's own, near ones first
AROUND = sorted(((i, j) for i in range(-2, 3) for j in range(-2, 3)), key=lambda s: (max(map(abs, s)), s))


def nearest_hexagon(px: float, py: float) -> tuple[int, int]:
    """The cell whose centre is nearest, on the hexagonal grid of side one.

    With right and up as axes a point has three coordinates of sum zero, one per direction
    of rows; all are rounded (halves up), and the one that rounding changed most follows
    from the other two. Of equal changes the first direction keeps its value, then the second.
    """
    v = py / 1.5
    u = px / math.sqrt(3) + v / 2
    q, r, s = u - v, v, -u
    a, b, c = (math.floor(k + 0.5) for k in (q, r, s))
    da, db, dc = abs(a - q), abs(b - r), abs(c - s)
    if dc > da and dc > db:
        return a + b, b
    return (-c, -a - c) if db > da else (-c, b)


def crossed_oddly(ring: np.ndarray, px: np.ndarray, py: np.ndarray) -> np.ndarray:
    """Which points have an odd number of a ring's edges to their right: of tiles that share a border, one holds a point on it."""
    x1, y1 = ring.T
    x2, y2 = np.roll(ring, -1, 0).T
    x, y = px[:, None], py[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        right = x < x1 + (y - y1) * (x2 - x1) / (y2 - y1)
    return (((y1 > y) != (y2 > y)) & right).sum(1) % 2 == 1


def inside_many(ring: np.ndarray, px: np.ndarray, py: np.ndarray) -> np.ndarray:
    """Which points a ring holds, its boundary included (within EPS)."""
    if not len(px):
        return np.zeros(0, bool)
    a, d = ring[None], (np.roll(ring, -1, 0) - ring)[None]
    x, y = px[:, None] - a[..., 0], py[:, None] - a[..., 1]
    t = np.clip((x * d[..., 0] + y * d[..., 1]) / np.maximum((d * d).sum(-1), 1e-300), 0, 1)
    edge = (np.hypot(x - t * d[..., 0], y - t * d[..., 1]) <= EPS).any(1)
    cross = (y < 0) != (y - d[..., 1] < 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        right = x < y * d[..., 0] / d[..., 1]
    return edge | ((cross & right).sum(1) % 2 == 1)


def inside(ring: np.ndarray, px: float, py: float) -> bool:
    """Whether a ring holds a point, its boundary included (within EPS)."""
    a, b = ring, np.roll(ring, -1, 0)
    d = b - a
    t = np.clip(((px - a[:, 0]) * d[:, 0] + (py - a[:, 1]) * d[:, 1]) / np.maximum((d * d).sum(1), 1e-300), 0, 1)
    near = a + t[:, None] * d
    if (np.hypot(near[:, 0] - px, near[:, 1] - py) <= EPS).any():
        return True
    cross = (a[:, 1] > py) != (b[:, 1] > py)
    with np.errstate(divide="ignore", invalid="ignore"):
        at = a[:, 0] + (py - a[:, 1]) * d[:, 0] / d[:, 1]
    return bool((cross & (px < at)).sum() % 2)


def contact(p: np.ndarray, q: np.ndarray, eps: float = CONTACT) -> tuple[str, np.ndarray] | None:
    """How two tiles touch and where: ``rook`` along an edge (its longest common piece's middle), ``bishop`` at a point."""
    best, where, point = 0.0, None, None
    for i in range(len(p)):
        a, b = p[i], p[(i + 1) % len(p)]
        d = b - a
        length = float(np.hypot(*d))
        u = d / length
        for j in range(len(q)):
            c, e = q[j], q[(j + 1) % len(q)]
            off = [abs(float(u[0] * (z - a)[1] - u[1] * (z - a)[0])) for z in (c, e)]
            t = [float(u @ (z - a)) for z in (c, e)]
            if max(off) <= eps:
                lo, hi = max(0.0, min(t)), min(length, max(t))
                if hi - lo > best and hi - lo > eps:
                    best, where = hi - lo, a + u * (lo + hi) / 2
            if off[0] <= eps and -eps <= t[0] <= length + eps:
                point = c
            f = e - c
            s = float(np.clip(f @ (a - c) / (f @ f), 0, 1))
            if np.hypot(*(c + s * f - a)) <= eps:
                point = a
    if where is not None:
        return "rook", where
    return ("bishop", point) if point is not None else None


def _ring(points: np.ndarray) -> tuple[tuple[float, float], ...]:
    return tuple((float(x), float(y)) for x, y in points)


def _square(cx: float = 0.0, cy: float = 0.0, side: float = 1.0) -> tuple[tuple[float, float], ...]:
    h = side / 2
    return ((cx + h, cy - h), (cx + h, cy + h), (cx - h, cy + h), (cx - h, cy - h))


def _nested(k: int) -> Grid:
    tiles = tuple(_square((i + 0.5) / k - 0.5, (j + 0.5) / k - 0.5, 1 / k) for j in range(k) for i in range(k))
    return Grid(f"NS{k}", f"NS{k}", tiles, (1.0, 0.0), (0.0, 1.0), "SQUARE")


def _geese() -> Grid:
    both = np.array(GOOSE_LOWER + GOOSE_UPPER, float)
    mid = (both.min(0) + both.max(0)) / 2
    return Grid("GEESE", "GEESE", tuple(_ring(np.array(g, float) - mid) for g in (GOOSE_LOWER, GOOSE_UPPER)), GOOSE_RIGHT, GOOSE_UP, "STAGSQUARE")


def _mixed(side: float = 10.0) -> Grid:
    """Two triangles and three squares around the origin, edges of one length."""
    spoke = {k: side * np.array([math.cos(math.radians(a)), math.sin(math.radians(a))]) for k, a in (("n", 90), ("nw", 150), ("sw", 240), ("se", 300), ("ne", 30))}
    o = np.zeros(2)
    tiles = ([o, spoke["n"], spoke["nw"]], [o, spoke["nw"], spoke["nw"] + spoke["sw"], spoke["sw"]], [o, spoke["sw"], spoke["sw"] + spoke["se"], spoke["se"]], [o, spoke["se"], spoke["se"] + spoke["ne"], spoke["ne"]], [o, spoke["ne"], spoke["n"]])
    return Grid("MIXED", "MIXED", tuple(_ring(np.array(t)) for t in tiles), tuple(map(float, spoke["ne"] - spoke["sw"])), tuple(map(float, spoke["nw"] - spoke["se"])), "SQUARE")


def _bases() -> dict[str, Grid]:
    s3 = math.sqrt(3)
    hexagon = tuple((math.cos(math.radians(60 * i - 30)), math.sin(math.radians(60 * i - 30))) for i in range(6))
    low, high = ((-0.5, -0.5), (0.5, -0.5), (0.5, 0.5)), ((-0.5, -0.5), (0.5, 0.5), (-0.5, 0.5))
    triangle = Grid("TRIANGLE", "TRIANGLE", (low, high), (1.0, 0.0), (0.0, 1.0), "SQUARE")
    grids = [
        Grid("SQUARE", "SQUARE", (_square(),), (1.0, 0.0), (0.0, 1.0)),
        Grid("HEXAGON", "HEXAGON", (hexagon,), (s3, 0.0), (-s3 / 2, 1.5)),
        triangle,
        triangle.shear(-0.5, 0).scale(1, s3 / 2).renamed("EQUILATERAL"),
        Grid("STAGSQUARE", "STAGSQUARE", (_square(),), (1.0, 0.0), (-0.5, 1.0)),
        _geese(),
        _nested(2),
        _nested(3),
        _mixed(),
    ]
    return {g.name: g for g in grids}


BASES = _bases()


@lru_cache(maxsize=256)
def grid(name: str) -> Grid:
    """A grid by name: a base and transforms ``!r!degrees``, ``!s!x!y``, ``!h!x!y`` in order; unknown transforms are skipped with a warning."""
    base, *rest = name.split("!")
    if base not in BASES:
        raise ValueError(f"unknown grid {base!r}; known: {', '.join(BASES)}")
    out, i = BASES[base], 0
    while i < len(rest):
        if rest[i] == "r":
            out, i = out.rotate(float(rest[i + 1])), i + 2
        elif rest[i] == "s":
            out, i = out.scale(float(rest[i + 1]), float(rest[i + 2])), i + 3
        elif rest[i] == "h":
            out, i = out.shear(float(rest[i + 1]), float(rest[i + 2])), i + 3
        else:
            import warnings

            warnings.warn(f"unknown grid transform {rest[i]!r}", stacklevel=2)
            i += 1
    return out


# lookup tables: a few rows per grid, bounded by the grid's definition, so they may be broadcast


def tile_table(spark: SparkSession, g: Grid) -> DataFrame:
    """variant, centroid and ring of each tile."""
    rows = [(v, float(g.centroids[v][0]), float(g.centroids[v][1]), float(g.areas[v]), [{"x": float(x), "y": float(y)} for x, y in r]) for v, r in enumerate(g.tiles)]
    return spark.createDataFrame(rows, "variant int, cx double, cy double, area double, ring array<struct<x:double,y:double>>")


def neighbour_table(spark: SparkSession, g: Grid) -> DataFrame:
    """variant, dx, dy, kind (rook or bishop) and ord (counter-clockwise) of all neighbours."""
    rows = [(v, dx, dy, kind, k) for v, near in enumerate(g.neighbours) for k, (dx, dy, kind) in enumerate(near)]
    return spark.createDataFrame(rows, "variant int, dx int, dy int, kind string, ord int")
