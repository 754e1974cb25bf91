"""Guiding shapes: the cells that best imitate a partition's polygon at a given number of tiles."""

from __future__ import annotations

import heapq
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.grids import Grid, grid, ring_area
from ..schema import PARTITION_KEY

Cell = tuple[int, int]
SAMPLES = 5


def clip(ring: np.ndarray, convex: np.ndarray) -> np.ndarray:
    """A ring cut down to a convex counter-clockwise ring, half-plane by half-plane; any ring may be cut, area is right."""
    for i in range(len(convex)):
        if not len(ring):
            return ring
        a, d = convex[i], convex[(i + 1) % len(convex)] - convex[i]
        side = d[0] * (ring[:, 1] - a[1]) - d[1] * (ring[:, 0] - a[0])
        nxt, side_n = np.roll(ring, -1, 0), np.roll(side, -1)
        crossing = (side > 0) != (side_n > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            t = (side / (side - side_n))[:, None]
            hit = ring + t * (nxt - ring)
        keep = side > 0
        both = np.empty((2 * len(ring), 2))
        both[0::2], both[1::2] = ring, hit
        mask = np.empty(2 * len(ring), bool)
        mask[0::2], mask[1::2] = keep, crossing
        ring = both[mask]
    return ring


def triangles(ring: np.ndarray) -> list[np.ndarray]:
    """Convex parts of a tile: itself if convex, else its ears."""
    ring = ring if ring_area(ring) > 0 else ring[::-1]

    def turn(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> float:
        return float((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]))

    n = len(ring)
    if all(turn(ring[i - 1], ring[i], ring[(i + 1) % n]) >= -1e-9 for i in range(n)):
        return [ring]
    left, out = list(range(n)), []
    while len(left) > 3:
        for k in range(len(left)):
            i, j, m = left[k - 1], left[k], left[(k + 1) % len(left)]
            a, b, c = ring[i], ring[j], ring[m]
            if turn(a, b, c) > 1e-9 and not any(turn(a, b, ring[q]) >= 0 and turn(b, c, ring[q]) >= 0 and turn(c, a, ring[q]) >= 0 for q in left if q not in (i, j, m)):
                out.append(np.array([a, b, c]))
                left.pop(k)
                break
        else:
            break
    out.append(ring[left])
    return out


@lru_cache(maxsize=64)
def _parts(name: str) -> list[list[np.ndarray]]:
    return [triangles(t) for t in grid(name).tiles]


def quality_map(ring: np.ndarray, g: Grid) -> dict[Cell, float]:
    """Area of overlap with a polygon for every cell that it meets."""
    # lattice coordinates of the polygon's box bound the cells
    inv = np.linalg.inv(g.lattice)
    lat = (inv @ np.array([[a, b] for a in (ring[:, 0].min(), ring[:, 0].max()) for b in (ring[:, 1].min(), ring[:, 1].max())]).T).T
    (i0, j0), (i1, j1) = np.floor(lat.min(0)).astype(int) - 2, np.ceil(lat.max(0)).astype(int) + 2
    lo, hi = ring.min(0), ring.max(0)
    a, d = ring, np.roll(ring, -1, 0) - ring
    out: dict[Cell, float] = {}
    for v in range(g.pc):
        tile, parts = g.tiles[v], _parts(g.name)[v]
        reach = np.hypot(*(tile - g.centroids[v]).T).max()
        ii, jj = np.meshgrid(np.arange(i0, i1 + 1), np.arange(j0, j1 + 1), indexing="ij")
        ii, jj = ii.ravel(), jj.ravel()
        c = g.centroids[v] + ii[:, None] * np.array(g.right) + jj[:, None] * np.array(g.up)
        near = ((c >= lo - reach) & (c <= hi + reach)).all(1)
        ii, jj, c = ii[near], jj[near], c[near]
        for s in range(0, len(c), 512):
            cc = c[s : s + 512]
            t = np.clip(((cc[:, None] - a) * d).sum(2) / np.maximum((d * d).sum(1), 1e-300), 0, 1)
            away = np.hypot(*np.moveaxis(a + t[:, :, None] * d - cc[:, None], 2, 0)).min(1)
            cross = (a[:, 1] > cc[:, 1:]) != (np.roll(a, -1, 0)[:, 1] > cc[:, 1:])
            with np.errstate(divide="ignore", invalid="ignore"):
                x = a[:, 0] + (cc[:, 1:] - a[:, 1]) * d[:, 0] / d[:, 1]
            within = (cross & (cc[:, :1] < x)).sum(1) % 2 == 1
            for k in range(len(cc)):
                cell = (int(ii[s + k]) * g.pc + v, int(jj[s + k]))
                if away[k] > reach:
                    if within[k]:
                        out[cell] = float(g.areas[v])
                    continue
                off = g.offset(*cell)
                area = sum(abs(ring_area(p)) for part in parts if len(p := clip(ring, part + off)) > 2)
                if area > 1e-9:
                    out[cell] = area
    return out


def runs(cell: Cell, members: set[Cell], g: Grid, rook: bool = True) -> int:
    """Runs of member cells around a cell (with ``rook`` those that hold a rook neighbour)."""
    x, y = cell
    near = g.neighbours[x % g.pc]
    flags = [((x + dx, y + dy) in members, k == "rook") for dx, dy, k in near]
    if all(f for f, _ in flags):
        return 1
    first = next(i for i, (f, _) in enumerate(flags) if not f)
    n, open_, has = 0, False, False
    for i in range(len(flags)):
        f, r = flags[(first + i) % len(flags)]
        if f:
            if not open_:
                open_, has = True, False
            if (r or not rook) and not has:
                has = True
                n += 1
        else:
            open_ = False
    return n


@lru_cache(maxsize=64)
def _local(name: str) -> bool:
    """Whether neighbours that follow each other around a cell are rook neighbours themselves, so that a look around tells of connectivity."""
    g = grid(name)
    for v in range(g.pc):
        around = [(v + dx, dy) for dx, dy, _ in g.neighbours[v]]
        if any(b not in g.adjacent(*a) for a, b in zip(around, around[1:] + around[:1], strict=True)):
            return False
    return True


def safe(cell: Cell, members: set[Cell], g: Grid) -> bool:
    """Whether a set stays in one piece without a member (or its neighbours are in one piece around a cell outside)."""
    if runs(cell, members, g) != 1:
        return False
    return _local(g.name) or cell not in members or len(parts_of(members - {cell}, g)) == 1


def parts_of(members: set[Cell], g: Grid) -> list[set[Cell]]:
    """Rook-connected parts, in the order of their smallest cells."""
    left, out = set(members), []
    for c in sorted(members):
        if c not in left:
            continue
        part, todo = {c}, [c]
        left.discard(c)
        while todo:
            for n in g.adjacent(*todo.pop()):
                if n in left:
                    left.discard(n)
                    part.add(n)
                    todo.append(n)
        out.append(part)
    return out


def holes(members: set[Cell], g: Grid) -> set[Cell]:
    """Cells that the set encloses (the outside spreads over all touching cells)."""
    xs, ys = [x for x, _ in members], [y for _, y in members]
    x0, x1, y0, y1 = min(xs) - 2 * g.pc, max(xs) + 2 * g.pc, min(ys) - 2, max(ys) + 2
    seen, todo = {(x0, y0)}, [(x0, y0)]
    while todo:
        for n in g.adjacent(*todo.pop(), "rook"):
            if n not in seen and n not in members and x0 <= n[0] <= x1 and y0 <= n[1] <= y1:
                seen.add(n)
                todo.append(n)
    return {(x, y) for x in range(x0, x1 + 1) for y in range(y0, y1 + 1) if (x, y) not in seen and (x, y) not in members}


def connect(members: set[Cell], quality: dict[Cell, float], g: Grid) -> set[Cell]:
    """Members joined into one part by paths of fewest added cells, most quality among equals."""
    members = set(members)
    while len(parts := parts_of(members, g)) > 1:
        home = parts[0]
        best = {c: (0, 0.0) for c in home}
        back: dict[Cell, Cell] = {}
        todo = [(0, 0.0, c) for c in sorted(home)]
        heapq.heapify(todo)
        goal = None
        while todo:
            n, q, c = heapq.heappop(todo)
            if (n, q) > best[c]:
                continue
            if c in members and c not in home:
                goal = c
                break
            for m in g.adjacent(*c):
                if m not in members and m not in quality:
                    continue
                step = (n, q) if m in members else (n + 1, q - quality[m])
                if step < best.get(m, (1 << 60, 0.0)):
                    best[m], back[m] = step, c
                    heapq.heappush(todo, (*step, m))
        if goal is None:  # the polygon's cells don't join the parts: straight over any cells
            quality = dict(quality)
            fringe = {n for c in quality.keys() | members for n in g.adjacent(*c)} - quality.keys()
            quality.update((c, 0.0) for c in fringe)
            continue
        while goal in back:
            members.add(goal)
            goal = back[goal]
    return members


def trim(members: set[Cell], quality: dict[Cell, float], n: int, g: Grid) -> set[Cell]:
    """Members less their poorest cells, down to n, each taken only where the rest stays in one piece."""
    members = set(members)
    todo = [(quality.get(c, 0.0), c) for c in members]
    heapq.heapify(todo)
    put_off: set[Cell] = set()
    while len(members) > n and todo:
        _, c = heapq.heappop(todo)
        if c not in members:
            continue
        if not safe(c, members, g):
            put_off.add(c)
            continue
        members.discard(c)
        for m in g.adjacent(*c, "queen"):
            if m in put_off:
                put_off.discard(m)
                heapq.heappush(todo, (quality.get(m, 0.0), m))
    return members


def shape(ring: np.ndarray, tiles: int, g: Grid, i: int, j: int, samples: int = SAMPLES) -> tuple[set[Cell], dict[Cell, float], float, np.ndarray]:
    """Cells, overlap areas, factor and translation of the guide at sub-cell offset (i, j)."""
    factor = float(np.sqrt(tiles * g.average_area / abs(ring_area(ring))))
    move = np.array(g.up) * i / samples + np.array(g.right) * j / samples
    q = quality_map(ring * factor + move, g)
    if len(q) < tiles:
        raise ValueError(f"the polygon meets {len(q)} cells, {tiles} are needed")
    top = sorted(q, key=lambda c: (-q[c], c))[:tiles]
    cells = connect(set(top), q, g)
    cells |= holes(cells, g)
    return trim(cells, q, tiles, g), q, factor, move


def best_shape(ring: np.ndarray, tiles: int, g: Grid, samples: int = SAMPLES) -> tuple[set[Cell], dict[Cell, float], float, np.ndarray]:
    """The offset whose cells overlap the polygon most, the first among equals."""
    best = None
    for i in range(samples):
        for j in range(samples):
            got = shape(ring, tiles, g, i, j, samples)
            score = sum(got[1].get(c, 0.0) for c in got[0])
            if best is None or score > best[0] + 1e-9:
                best = (score, got)
    return best[1]


OUT = "map_id string, outline_id int, partition_id int, i int, j int, factor double, tx double, ty double, quality double, cells array<struct<x:int,y:int>>, areas array<struct<x:int,y:int,area:double>>"


def guides(partitions: DataFrame, g: Grid, samples: int = SAMPLES) -> DataFrame:
    """The best guide of each partition (map_id, outline_id, partition_id, ring, tiles): factor, tx, ty, quality, cells, areas.

    Every sub-cell offset of every partition is a task of its own; the best one is an
    aggregate whose rows are combined before the shuffle.
    """
    name = g.name
    offsets = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(samples) for j in range(samples)))
    work = partitions.select(*PARTITION_KEY, "ring", "tiles", F.explode(offsets).alias("o")).select(*PARTITION_KEY, "ring", "tiles", "o.i", "o.j")

    def run(batches):
        own = grid(name)
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                ring = np.array([[p["x"], p["y"]] for p in r.ring])
                cells, q, factor, move = shape(ring, int(r.tiles), own, r.i, r.j, samples)
                score = sum(q.get(c, 0.0) for c in cells)
                rows.append((r.map_id, r.outline_id, r.partition_id, r.i, r.j, factor, float(move[0]), float(move[1]), score, [{"x": x, "y": y} for x, y in sorted(cells)], [{"x": x, "y": y, "area": a} for (x, y), a in sorted(q.items())]))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")])

    made = work.repartition(*PARTITION_KEY, "i", "j").mapInPandas(run, OUT)
    row = F.struct("factor", "tx", "ty", "quality", "cells", "areas")
    return made.groupBy(*PARTITION_KEY).agg(F.max_by(row, F.struct(F.round("quality", 9), -F.col("i"), -F.col("j"))).alias("g")).select(*PARTITION_KEY, "g.*")


def polygon_cells(partitions: DataFrame, g: Grid) -> DataFrame:
    """Overlap area (x, y, area) of every cell that each ring meets, at the ring's own scale."""
    name = g.name

    def run(batches):
        own = grid(name)
        for pdf in batches:
            rows = [(r.map_id, r.outline_id, r.partition_id, x, y, a) for r in pdf.itertuples() for (x, y), a in sorted(quality_map(np.array([[p["x"], p["y"]] for p in r.ring]), own).items())]
            yield pd.DataFrame(rows, columns=[*PARTITION_KEY, "x", "y", "area"])

    return partitions.select(*PARTITION_KEY, "ring").mapInPandas(run, "map_id string, outline_id int, partition_id int, x int, y int, area double")


__all__ = ["best_shape", "clip", "connect", "guides", "holes", "parts_of", "polygon_cells", "quality_map", "runs", "safe", "shape", "trim"]
