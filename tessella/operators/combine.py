"""Placing a map's components next to each other so that their cells don't touch."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..durable import durable
from ..functions import geometry as G
from ..functions.grids import Grid, grid
from ..schema import ASSIGNED, DEFORMED, PARTITION_KEY, TileMap
from . import dual

METHODS = ("Agnostic", "ClosestAssigned", "AgglomerativeAssigned", "AgglomerativePartitionAssigned")
ALIASES = {"ASSIGN": "ClosestAssigned", "ASSIGNED": "ClosestAssigned", "AGNOSTIC": "Agnostic", "AgglomerativePartition": "AgglomerativePartitionAssigned", "Agglomerative": "AgglomerativeAssigned"}
Cell = tuple[int, int]


def blocked_offsets(still: set[Cell], moving: set[Cell]) -> tuple[np.ndarray, Cell]:
    """Which offsets put a moving cell on a still one, as an array over all that can, and the offset at its corner.

    This is the Minkowski difference of the two sets: how many pairs of cells meet at each offset is the correlation
    of their pictures, by Fourier transforms, so it costs the area of the drawing and not the pairs of cells.
    """
    a, b = np.array(sorted(still)), np.array(sorted(moving))
    low_a, low_b = a.min(axis=0), b.min(axis=0)
    a, b = a - low_a, b - low_b
    high = b.max(axis=0)
    size = tuple((a.max(axis=0) + high + 1).tolist())
    one, two = np.zeros(size), np.zeros(size)
    one[tuple(a.T)] = 1
    two[tuple((high - b).T)] = 1
    met = np.fft.irfft2(np.fft.rfft2(one) * np.fft.rfft2(two), size)
    return met > 0.5, tuple((low_a - low_b - high).tolist())


def free_offset(g: Grid, placed: set[Cell], moving: set[Cell], at: Cell, of: Cell, direction: np.ndarray) -> Cell:
    """Lattice offset that puts ``moving`` beside ``placed``: cell ``of`` comes as near to cell ``at`` as it can, on the side of ``direction``.

    Of all lattice offsets by which no cell overlaps or rook-touches, and by which ``of`` lies in the direction's open half-plane
    as seen from ``at`` (or on its place), the one of least distance there; equal ones the farther along the direction, then
    the smaller. Without a direction (points in one place) all sides count.
    """
    step = np.array([g.pc, 1])
    base = (np.array(at) - np.array(of)) // step * step
    blocked, corner = blocked_offsets(placed | {n for c in placed for n in g.adjacent(*c)}, moving)
    # beyond the blocked offsets all are free, and the nearest of those stand right beside them
    low = np.minimum(np.array(corner) - base, 0) // step - 4
    high = np.maximum(np.array(corner) + blocked.shape - base, 0) // step + 5
    o = np.stack(np.meshgrid(*(np.arange(s, e) for s, e in zip(low, high, strict=True)), indexing="ij"), axis=-1).reshape(-1, 2)
    spot = base + o * step - corner
    known = ((spot >= 0) & (spot < blocked.shape)).all(axis=1)
    free = np.ones(len(o), bool)
    free[known] = ~blocked[tuple(spot[known].T)]
    moved = o @ g.lattice.T
    along = moved @ direction
    if float(np.hypot(*direction)) > 1e-12:
        free &= (along > 1e-12) | ~o.any(axis=1)
    best = np.flatnonzero(free)
    far = np.round(np.hypot(*moved[best].T), 9)
    k = best[np.lexsort((o[best, 1], o[best, 0], -np.round(along[best], 9), far))[0]]
    dx, dy = base + o[k] * step
    return int(dx), int(dy)


class Part:
    """A component while components are placed: its cells, sites with cells, and partitions."""

    def __init__(self, key: tuple, weight: int, cells: set[Cell], sites: np.ndarray, site_cells: np.ndarray, rings: list[np.ndarray], centroids: np.ndarray, middles: list[Cell], owners: np.ndarray):
        self.key, self.weight, self.cells = key, weight, cells
        self.sites, self.site_cells, self.rings, self.centroids, self.middles, self.owners = sites, site_cells, rings, centroids, middles, owners
        self.offset = (0, 0)

    def shift(self, dx: int, dy: int) -> None:
        self.cells = {(x + dx, y + dy) for x, y in self.cells}
        self.site_cells = self.site_cells + np.array([dx, dy])
        self.middles = [(x + dx, y + dy) for x, y in self.middles]
        self.offset = (self.offset[0] + dx, self.offset[1] + dy)


def _nearest(p: np.ndarray, q: np.ndarray) -> tuple[float, int, int]:
    d = ((p[:, None] - q[None]) ** 2).sum(2)
    i, j = np.unravel_index(int(d.argmin()), d.shape)
    return float(d[i, j]), int(i), int(j)


def _ring_distance(p: np.ndarray, q: np.ndarray) -> float:
    def one_way(r: np.ndarray, s: np.ndarray) -> float:
        a, d = s, np.roll(s, -1, 0) - s
        t = np.clip(((r[:, None] - a) * d).sum(2) / np.maximum((d * d).sum(1), 1e-300), 0, 1)
        return float(np.hypot(*np.moveaxis(a + t[:, :, None] * d - r[:, None], 2, 0)).min())

    return min(one_way(p, q), one_way(q, p))


def place(parts: list[Part], g: Grid, method: str) -> dict[tuple, Cell]:
    """The offset of each component."""
    if method.startswith("Agglomerative"):
        groups = [[p] for p in parts]
        known: dict[tuple[int, int], tuple[float, int, int]] = {}  # places on the map don't change when cells move

        def between(a: Part, b: Part) -> tuple[float, int, int]:
            """Distance of two components and the sites (their numbers) between which their cells are placed."""
            if (id(a), id(b)) not in known:
                if method == "AgglomerativePartitionAssigned":
                    far, k, m = min((_ring_distance(r, s), k, m) for k, r in enumerate(a.rings) for m, s in enumerate(b.rings))
                    ia, ib = (o if len(o := np.flatnonzero(p.owners == n)) else np.arange(len(p.sites)) for p, n in ((a, k), (b, m)))
                    _, x, y = _nearest(a.sites[ia], b.sites[ib])
                    known[id(a), id(b)] = far, int(ia[x]), int(ib[y])
                else:
                    known[id(a), id(b)] = _nearest(a.sites, b.sites)
            return known[id(a), id(b)]

        while len(groups) > 1:
            best = None
            for i in range(len(groups)):
                for j in range(i + 1, len(groups)):
                    for a in groups[i]:
                        for b in groups[j]:
                            d, x, y = between(a, b)
                            found = (d, i, j, a, b, x, y)
                            if best is None or found[:3] < best[:3]:
                                best = found
            _, i, j, a, b, x, y = best
            if sum(p.weight for p in groups[j]) > sum(p.weight for p in groups[i]):
                i, j, a, b, x, y = j, i, b, a, y, x
            still = {c for p in groups[i] for c in p.cells}
            moving = {c for p in groups[j] for c in p.cells}
            dx, dy = free_offset(g, still, moving, tuple(map(int, a.site_cells[x])), tuple(map(int, b.site_cells[y])), b.sites[y] - a.sites[x])
            for p in groups[j]:
                p.shift(dx, dy)
            groups[i] += groups[j]
            groups.pop(j)
        return {p.key: p.offset for p in parts}
    order = sorted(range(len(parts)), key=lambda k: (-parts[k].weight, k))
    done: list[Part] = []
    for k in order:
        p = parts[k]
        if done:
            best = None
            for q in done:
                d, x, y = _nearest(q.centroids, p.centroids) if method == "Agnostic" else _nearest(q.sites, p.sites)
                if best is None or d < best[0]:
                    best = (d, q, x, y)
            _, q, x, y = best
            at, of = (q.middles[x], p.middles[y]) if method == "Agnostic" else (tuple(map(int, q.site_cells[x])), tuple(map(int, p.site_cells[y])))
            direction = p.centroids[y] - q.centroids[x] if method == "Agnostic" else p.sites[y] - q.sites[x]
            p.shift(*free_offset(g, {c for o in done for c in o.cells}, p.cells, at, of, direction))
        done.append(p)
    return {p.key: p.offset for p in parts}


OUT = "map_id string, comp_id struct<outline_id:int,partition_id:int>, dx int, dy int"


def combine(m: TileMap, g: Grid, method: str = "ClosestAssigned") -> TileMap:
    """The map with each component's cells, guides and site cells moved by one lattice offset.

    Every map is placed by a kernel of its own, which holds that map's cells and sites; the
    offsets are applied by joins. Agnostic needs stage DEFORMED, the others ASSIGNED. The
    stage doesn't change; placing a placed map moves it anew.
    """
    method = ALIASES.get(method, method)
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; known: {', '.join(METHODS)}")
    m.require(DEFORMED if method == "Agnostic" else ASSIGNED)
    comps = durable(dual.components(m.partitions, dual.dual_edges(m.partitions)))
    weighted = dual.weights(m.partitions, m.sites)
    pid = ["map_id", "outline_id", "partition_id"]
    own_cells = m.cells.groupBy(*pid).agg(F.collect_list(F.struct("x", "y")).alias("cells"))  # the cells of one region
    own_sites = m.sites.groupBy(*pid).agg(F.collect_list(F.struct("x", "y", "cell")).alias("sites"))
    centre = G.ring_centroid(F.col("ring"))
    packed = m.partitions.select(*pid, "ring", centre.alias("centre")).join(comps, pid).join(weighted, pid).join(own_cells, pid, "left").join(own_sites, pid, "left")
    name = g.name

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        own = grid(name)
        pdf = pdf.assign(k=[(c["outline_id"], c["partition_id"]) for c in pdf.comp_id]).sort_values(["k", "outline_id", "partition_id"])
        parts = []
        for key, rows in pdf.groupby("k", sort=True):
            cells, sites, at, owners, rings, middles = set(), [], [], [], [], []
            for i, r in enumerate(rows.itertuples()):
                region = {(int(c["x"]), int(c["y"])) for c in (r.cells if r.cells is not None else [])}
                cells |= region
                mid = np.mean([own.centroid(*c) for c in region], 0) if region else np.zeros(2)
                middles.append(own.containing(*mid) or min(region, default=(0, 0)))
                rings.append(np.array([[p["x"], p["y"]] for p in r.ring]))
                for s in r.sites if r.sites is not None else []:
                    if s["cell"] is not None or method == "Agnostic":
                        sites.append((s["x"], s["y"]))
                        at.append((s["cell"]["x"], s["cell"]["y"]) if s["cell"] is not None else (0, 0))
                        owners.append(i)
            centroids = np.array([(c["x"], c["y"]) if c is not None else ring.mean(0) for c, ring in zip(rows.centre, rings, strict=True)])
            if not sites:  # a region without sites stands by its polygon
                sites, at, owners = [tuple(c) for c in centroids], middles, list(range(len(rings)))
            parts.append(Part(key, int(rows.weight.sum()), cells, np.array(sites, float), np.array(at, int), rings, centroids, middles, np.array(owners)))
        offsets = place(parts, own, method)
        return pd.DataFrame([(pdf.map_id.iloc[0], {"outline_id": k[0], "partition_id": k[1]}, x, y) for k, (x, y) in offsets.items()], columns=["map_id", "comp_id", "dx", "dy"])

    moved = packed.groupBy("map_id").applyInPandas(kernel, OUT)
    by_part = durable(comps.join(moved, ["map_id", "comp_id"]).select(*PARTITION_KEY, "dx", "dy"))

    def shift(df: DataFrame) -> DataFrame:
        return df.join(by_part, PARTITION_KEY, "left").withColumn("x", F.col("x") + F.coalesce("dx", F.lit(0))).withColumn("y", F.col("y") + F.coalesce("dy", F.lit(0))).select(*df.columns)

    go = G.cell(F.col("dx"), F.col("dy"))
    right, up = F.floor(F.col("dx") / g.pc), F.col("dy")
    guides = m.guides.join(by_part, PARTITION_KEY, "left").na.fill(0, ["dx", "dy"]).withColumn("tx", F.col("tx") + right * g.right[0] + up * g.up[0]).withColumn("ty", F.col("ty") + right * g.right[1] + up * g.up[1]).select(*m.guides.columns)
    sites = m.sites.join(by_part, PARTITION_KEY, "left").withColumn("cell", F.when(F.col("cell").isNotNull() & F.col("dx").isNotNull(), G.plus(F.col("cell"), go)).otherwise(F.col("cell"))).select(*m.sites.columns)
    return m.with_(cells=shift(m.cells), guides=guides, guide_cells=shift(m.guide_cells), cell_quality=shift(m.cell_quality), sites=sites)
