"""Sites to cells: a bijection of least total squared displacement in every partition."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..durable import durable
from ..functions import geometry as G
from ..functions.grids import Grid
from ..schema import ASSIGNED, DEFORMED, PARTITION_KEY, TileMap
from . import align


def solve(cost: np.ndarray) -> np.ndarray:
    """Column of each row in a least-cost assignment of n rows to m >= n columns (shortest augmenting paths, dual potentials)."""
    n, m = cost.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    owner = np.zeros(m + 1, int)  # row (from 1) of each column
    for i in range(1, n + 1):
        owner[0] = i
        j = 0
        least = np.full(m + 1, np.inf)
        back = np.zeros(m + 1, int)
        used = np.zeros(m + 1, bool)
        while owner[j]:
            used[j] = True
            row = owner[j]
            reduced = cost[row - 1] - u[row] - v[1:]
            better = ~used[1:] & (reduced < least[1:])
            least[1:][better] = reduced[better]
            back[1:][better] = j
            step = np.where(used[1:], np.inf, least[1:])
            k = int(step.argmin()) + 1
            delta = step[k - 1]
            u[owner[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j = k
        while j:
            owner[j] = owner[back[j]]
            j = back[j]
    out = np.zeros(n, int)
    for j in range(1, m + 1):
        if owner[j]:
            out[owner[j] - 1] = j - 1
    return out


def _nearest(a: np.ndarray, c: np.ndarray, w: np.ndarray, block: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """For each point of ``a`` the number of the point of ``c`` with the least w - 2 a·c, and that value; at most ``block`` values are held."""
    at, least = np.empty(len(a), np.int64), np.empty(len(a))
    step = max(1, block // len(c))
    for k in range(0, len(a), step):
        x = w - 2 * (a[k : k + step] @ c.T)
        at[k : k + step] = x.argmin(1)
        least[k : k + step] = x.min(1)
    return at, least


def _spread(p: np.ndarray) -> np.ndarray:
    """Every second point along a curve that keeps near points together (bits of x and y in turn)."""
    q = ((p - p.min(0)) / max(float(np.ptp(p, 0).max()), 1e-300) * 65535).astype(np.uint64)
    z = np.zeros(len(p), np.uint64)
    for b in range(16):
        for k in (0, 1):
            z |= (q[:, k] >> np.uint64(b) & np.uint64(1)) << np.uint64(2 * b + k)
    return np.argsort(z, kind="stable")[1::2]


def _priced(a: np.ndarray, c: np.ndarray, leaf: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Cell of each site in an assignment of least total squared distance, and each cell's price (its squared length less its dual)."""
    sq = (c**2).sum(1)
    w = sq
    if len(a) == len(c) > leaf:  # else prices of cells that stay free would have to be equal
        i, j = _spread(a), _spread(c)
        to, price = _priced(a[i], c[j])
        w = -_nearest(c, a[i], 2 * (a[i] * c[j][to]).sum(1) - price[to])[1]
    w = w.copy()
    at, _ = _nearest(a, c, w)
    owner, cell = np.full(len(c), -1), np.full(len(a), -1)
    taken, by = np.unique(at, return_index=True)
    owner[taken], cell[by] = by, taken
    ax, ay, cx, cy = a[:, 0], a[:, 1], -2 * c[:, 0], -2 * c[:, 1]
    free, left = np.flatnonzero(cell < 0).tolist(), []
    n = len(free)
    for k, i in enumerate(free):  # a free site takes its best cell at a price that leaves it the second best as good; who loses a cell may try once
        x = ax[i] * cx + ay[i] * cy + w
        j = int(x.argmin())
        least, x[j] = x[j], np.inf
        rise = x.min() - least
        if rise <= 0 and owner[j] >= 0:
            left.append(i)
            continue
        if np.isfinite(rise):
            w[j] += rise
        r, owner[j], cell[i] = owner[j], i, j
        if r >= 0:
            cell[r] = -1
            (free if k < n and len(free) < 2 * n else left).append(int(r))
    one, two = np.empty(len(c)), np.empty(len(c))
    for i in left:  # shortest augmenting paths
        open_ = w.copy()
        far = ax[i] * cx + ay[i] * cy + open_
        back, seen, at_ = np.full(len(c), i), [], []
        while owner[j := int(far.argmin())] >= 0:
            reached, r = far[j], owner[j]
            seen.append(j)
            at_.append(reached)
            np.multiply(cx, ax[r], out=one)
            np.multiply(cy, ay[r], out=two)
            one += two
            off = one[j] + w[j] - reached
            open_[j] = far[j] = np.inf
            one += open_
            one -= off
            better = one < far
            np.copyto(far, one, where=better)
            back[better] = r
        if seen:
            w[seen] += far[j] - np.array(at_)
        while True:
            r = back[j]
            owner[j], j, cell[r] = r, cell[r], j
            if r == i:
                break
    return cell, w


def solve_points(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Number of the point of ``c`` for each of ``a`` (no more than of ``c``) in an assignment of least total squared distance.

    No matrix is held: costs are computed a row at a time. Prices for the cells are taken from the solution
    for every second site and cell, so most sites find their cells at once and shortest paths to others are short; the result is exact.
    """
    if len(c) == 1:
        return np.zeros(len(a), int)
    middle = c.mean(0)
    return _priced(a - middle, c - middle)[0]


SCHEMA = "map_id string, outline_id int, partition_id int, site_id int, x int, y int, cost double"


def _kernel(sites: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
    """One partition: sites with their aligned place (ax, ay), cells with their centroid."""
    if sites.empty:
        return pd.DataFrame({"map_id": [], "outline_id": [], "partition_id": [], "site_id": [], "x": [], "y": [], "cost": []})
    sites, cells = sites.sort_values("site_id"), cells.sort_values(["ord", "x", "y"])
    if len(cells) < len(sites):
        raise ValueError(f"partition {sites.iloc[0][['outline_id', 'partition_id']].tolist()} has {len(sites)} sites and {len(cells)} cells")
    a, c = sites[["ax", "ay"]].to_numpy(float), cells[["cx", "cy"]].to_numpy(float)
    to = solve_points(a, c)
    out = sites[["map_id", "outline_id", "partition_id", "site_id"]].copy()
    out["x"], out["y"], out["cost"] = cells.x.to_numpy()[to], cells.y.to_numpy()[to], ((a - c[to]) ** 2).sum(1)
    return out


def assign_sites(sites: DataFrame, cells: DataFrame, transforms: DataFrame, g: Grid) -> DataFrame:
    """Rows (…, site_id, x, y, cost) of the best assignment under given transforms.

    Partitions of one site take their first cell at no cost, natively; the others are
    solved by one kernel each, all partitions of all maps in parallel. A kernel holds one
    partition's sites and cells, but not the matrix of their costs.
    """
    size = sites.groupBy(*PARTITION_KEY).agg(F.count("*").alias("_n"))
    one = sites.join(size.where("_n = 1"), PARTITION_KEY).join(cells.groupBy(*PARTITION_KEY).agg(F.min(F.struct("ord", "x", "y")).alias("_c")), PARTITION_KEY)
    single = one.select("map_id", "outline_id", "partition_id", "site_id", F.col("_c.x").alias("x"), F.col("_c.y").alias("y"), F.lit(0.0).alias("cost"))
    moved = sites.join(size.where("_n > 1"), PARTITION_KEY).join(transforms, PARTITION_KEY).withColumn("_p", G.apply(F.col("t"), F.col("x"), F.col("y")))
    a = moved.select(*PARTITION_KEY, "site_id", F.col("_p.x").alias("ax"), F.col("_p.y").alias("ay")).toDF(*PARTITION_KEY, "site_id", "ax", "ay")
    b = align.centroids(cells, g).join(size.where("_n > 1"), PARTITION_KEY, "left_semi").select(*PARTITION_KEY, "x", "y", "ord", "cx", "cy").toDF(*PARTITION_KEY, "x", "y", "ord", "cx", "cy")
    tasks = int(sites.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # not fewer: a kernel's work is far more than its rows' size would tell
    a, b = a.repartition(tasks, *PARTITION_KEY), b.repartition(tasks, *PARTITION_KEY)
    solved = a.groupBy(*PARTITION_KEY).cogroup(b.groupBy(*PARTITION_KEY)).applyInPandas(_kernel, SCHEMA)
    return single.unionByName(solved)


def assign(m: TileMap, g: Grid, alignment: str = "Uniform-Agnostic", refine: str | None = None) -> tuple[TileMap, DataFrame]:
    """The map at stage ASSIGNED, and per map total cost, number of sites and rms.

    ``refine`` (an aware alignment) fits the transforms anew to the first result and solves
    once more; the second cost counts.
    """
    m.require(DEFORMED)
    m = m.at(DEFORMED)
    cells = m.cells
    t = align.align(alignment, m.sites, align.centroids(cells, g), m.guides, PARTITION_KEY)
    found = assign_sites(m.sites, cells, t, g)
    if refine:
        own = found.select(*PARTITION_KEY, "site_id", F.col("x").alias("_cx"), F.col("y").alias("_cy"))
        fitted = m.sites.join(own, [*PARTITION_KEY, "site_id"]).withColumn("_c", G.cell_centroid(F.col("_cx"), F.col("_cy"), g)).withColumn("cx", F.col("_c.x")).withColumn("cy", F.col("_c.y"))
        found = assign_sites(m.sites, cells, align.AWARE[refine](fitted, PARTITION_KEY), g)
    found = durable(found)
    put = found.select(*PARTITION_KEY, "site_id", F.struct("x", "y").alias("_cell"))
    sites = m.sites.join(put, [*PARTITION_KEY, "site_id"], "left").withColumn("cell", F.col("_cell")).select(*m.sites.columns)
    cost = found.groupBy("map_id").agg(F.sum("cost").alias("cost"), F.count("*").alias("sites"), F.sqrt(F.avg("cost")).alias("rms"))
    return m.with_(sites=sites).staged(ASSIGNED), cost

