"""Quality of a finished map: measures per site or partition, and their summaries.

Measures are rows (map_id, analyzer, outline_id, id, value); id is a site_id, or a
partition_id for the guide fits. Sites have x, y and their cell.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..durable import durable
from ..functions import geometry as G
from ..functions.grids import Grid
from ..schema import ASSIGNED, DEFORMED, PARTITION_KEY, TileMap
from . import align
from .spatial import nearest_sites


def _rows(df: DataFrame, name: str, key: str, value: Column) -> DataFrame:
    return df.select("map_id", F.lit(name).alias("analyzer"), "outline_id", F.col(key).alias("id"), value.cast("double").alias("value"))


def placed(sites: DataFrame, g: Grid) -> DataFrame:
    """Sites with an assigned cell, its coordinates and centroid (cx, cy)."""
    out = sites.where("cell is not null").withColumn("_c", G.cell_centroid(F.col("cell.x"), F.col("cell.y"), g))
    return out.withColumn("cx", F.col("_c.x")).withColumn("cy", F.col("_c.y")).drop("_c")


def guide_fit_count(cells: DataFrame, guide_cells: DataFrame) -> DataFrame:
    """Share of a partition's guide that its cells cover; partitions without a guide are left out."""
    size = guide_cells.groupBy(*PARTITION_KEY).agg(F.count("*").alias("_g"))
    hits = guide_cells.join(cells.select(*PARTITION_KEY, "x", "y"), [*PARTITION_KEY, "x", "y"], "left_semi").groupBy(*PARTITION_KEY).agg(F.count("*").alias("_h"))
    return _rows(size.join(hits, PARTITION_KEY, "left"), "GuidingShapeFit-countpct", "partition_id", F.coalesce("_h", F.lit(0)) / F.col("_g"))


def guide_fit_quality(cells: DataFrame, guides: DataFrame, cell_quality: DataFrame) -> DataFrame:
    """Overlap area under a partition's cells over that of its guide."""
    got = cells.join(cell_quality, [*PARTITION_KEY, "x", "y"], "left").groupBy(*PARTITION_KEY).agg(F.sum(F.coalesce("area", F.lit(0.0))).alias("_q"))
    return _rows(guides.join(got, PARTITION_KEY, "left"), "GuidingShapeFit-quality", "partition_id", F.try_divide(F.coalesce("_q", F.lit(0.0)), F.col("quality")))


def _with_guide(sites: DataFrame, guides: DataFrame) -> DataFrame:
    return sites.where("cell is not null").join(guides.select(*PARTITION_KEY, F.lit(1).alias("_has")), PARTITION_KEY, "left").withColumn("_x", F.col("cell.x")).withColumn("_y", F.col("cell.y"))


def site_guide_miss(sites: DataFrame, guides: DataFrame, guide_cells: DataFrame) -> DataFrame:
    """1 where a site's cell is outside its partition's guide, else 0; 0 without a guide."""
    inside = guide_cells.select(*PARTITION_KEY, F.col("x").alias("_x"), F.col("y").alias("_y"), F.lit(1).alias("_in"))
    s = _with_guide(sites, guides).join(inside, [*PARTITION_KEY, "_x", "_y"], "left")
    return _rows(s, "SiteGuideFit-miss", "site_id", F.when(F.col("_has").isNotNull() & F.col("_in").isNull(), 1).otherwise(0))


def site_guide_deviation(sites: DataFrame, guides: DataFrame, cell_quality: DataFrame, g: Grid) -> DataFrame:
    """Share of a site's cell that the moved polygon leaves free; 0 without a guide."""
    q = cell_quality.select(*PARTITION_KEY, F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("area").alias("_a"))
    s = _with_guide(sites, guides).join(q, [*PARTITION_KEY, "_x", "_y"], "left")
    return _rows(s, "SiteGuideFit-deviation", "site_id", F.when(F.col("_has").isNotNull(), 1 - F.coalesce("_a", F.lit(0.0)) / G.cell_area(F.col("_x"), g)).otherwise(0))


def _label(base: str, k: int) -> str:
    return f"{base}-{k if k > 0 else 'ALL'}"


def _keyed(sites: DataFrame) -> DataFrame:
    """Sites of a map under one key, as neighbours may be in any outline."""
    return sites.withColumn("_key", F.struct("outline_id", "site_id"))


def discordant(x: np.ndarray, r: np.ndarray, eps: float) -> np.ndarray:
    """For each point the number of others that lie on different sides of it in x and in r, by more than ``eps`` in both.

    Points stand in order of x; blocks of 1, 2, 4 … of them are sorted by r, so those before a
    place in x that are above a value of r are counted block by block: n log² n in all.
    """
    n = len(x)
    order = np.argsort(x, kind="stable")
    xs, rs = x[order], r[order]
    levels = np.sort(rs)
    rank = np.searchsorted(levels, rs)  # equal values share a rank

    def below(upto: np.ndarray, value: np.ndarray) -> np.ndarray:
        """How many of the first ``upto`` points in x have a rank under ``value``."""
        total = np.zeros(len(upto), np.int64)
        for k in range(n.bit_length()):
            block = np.arange(n) >> k
            keys = np.sort(block * (n + 1) + rank)
            with_block = np.flatnonzero(upto >> k & 1)
            own = (upto[with_block] >> (k + 1)) << 1
            total[with_block] += np.searchsorted(keys, own * (n + 1) + value[with_block]) - (own << k)
        return total

    left, right = np.searchsorted(xs, x - eps, "left"), np.searchsorted(xs, x + eps, "right")
    low, high = np.searchsorted(levels, r - eps, "left"), np.searchsorted(levels, r + eps, "right")
    above_left = left - below(left, high)
    under_right = below(np.full(n, n), low) - below(right, low)
    return above_left + under_right


def _strips(points: DataFrame, axis: str, n: int, eps: float) -> DataFrame:
    """map_id and bounds of maps: places on an axis that cut it into about ``n`` strips of as many points, none with a point within ``eps`` on both sides.

    Approximate percentiles make first strips; each later one's bound is its first gap of more than ``eps``, if it has one.
    """
    q = points.groupBy("map_id").agg(F.percentile_approx(axis, [k / n for k in range(1, n)], max(10_000, 10 * n)).alias("q"))
    rough = points.join(q, "map_id").select("map_id", axis, F.size(F.filter("q", lambda v: v <= F.col(axis))).alias("b")).where("b > 0")
    gap = F.col(axis) - F.lag(axis).over(Window.partitionBy("map_id", "b").orderBy(axis))
    first = rough.withColumn("gap", gap).where(F.col("gap") > eps).groupBy("map_id", "b").agg(F.min(F.col(axis) - F.col("gap") / 2).alias("at"))
    return first.groupBy("map_id").agg(F.sort_array(F.collect_set("at")).alias("bounds"))  # one number a strip


def discordances(points: DataFrame, key: list[str], eps: float, rows: int = 20_000) -> DataFrame:
    """``key`` and d of ``points`` (``key``, with map_id, x and r): on how many others' different sides each lies in x and in r, by more than ``eps`` in both.

    A map of over ``rows`` points is cut into strips of about as many by x and by r. Pairs of one strip of x meet in
    its group; pairs of one strip of r, but of different ones of x, in that one's; of all other pairs only the numbers of points in
    the strips' crossings matter, which running sums over the crossings add up. No group holds more than a few strips.
    """
    size = durable(points.groupBy("map_id").agg(F.count("*").alias("_n")))
    most = size.agg(F.max("_n")).first()[0] or 0
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for n in key for f in [points.schema[n]])

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf[key].assign(d=discordant(pdf.x.to_numpy(float), pdf.r.to_numpy(float), eps))

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        d = discordant(pdf.x.to_numpy(float), pdf.r.to_numpy(float), eps)
        for at in pdf.groupby("bx").indices.values():  # counted in the strip of x
            d[at] -= discordant(pdf.x.to_numpy(float)[at], pdf.r.to_numpy(float)[at], eps)
        return pdf[key].assign(d=d)

    if most <= rows:
        return points.select(*key, "x", "r").groupBy("map_id").applyInPandas(within, f"{kind}, d long")
    n = -(-most // rows)
    large = points.join(size.where(F.col("_n") > rows).select("map_id"), "map_id", "left_semi")
    placed_ = points.select(*key, "x", "r")
    for axis, name in (("x", "bx"), ("r", "br")):
        placed_ = placed_.join(durable(_strips(large, axis, n, eps)), "map_id", "left")
        place = F.coalesce(F.size(F.filter("bounds", lambda v: v <= F.col(axis))), F.lit(0))
        placed_ = placed_.withColumn(name, F.when(F.col("bounds").isNull(), 0).otherwise(place)).drop("bounds")
    placed_ = durable(placed_)
    cut = durable(placed_.groupBy("map_id").agg(F.max("bx").alias("nx"), F.max("br").alias("nr")).where("nx > 0"))
    own = placed_.groupBy("map_id", "bx").applyInPandas(within, f"{kind}, d long")
    more = placed_.join(cut.select("map_id"), "map_id", "left_semi")
    side = more.groupBy("map_id", "br").applyInPandas(across, f"{kind}, d long")
    cells = more.groupBy("map_id", "bx", "br").agg(F.count("*").alias("c"))
    grid_ = cut.select("map_id", F.explode(F.sequence(F.lit(0), "nx")).alias("bx"), "nr").select("map_id", "bx", F.explode(F.sequence(F.lit(0), "nr")).alias("br"))
    full = grid_.join(cells, ["map_id", "bx", "br"], "left").na.fill(0, ["c"])
    row, column = Window.partitionBy("map_id", "br").orderBy("bx"), Window.partitionBy("map_id", "bx").orderBy("br")
    before, after = Window.unboundedPreceding, Window.unboundedFollowing
    full = full.withColumn("left", F.sum("c").over(row.rowsBetween(before, -1))).withColumn("right", F.sum("c").over(row.rowsBetween(1, after))).na.fill(0, ["left", "right"])
    far = F.coalesce(F.sum("left").over(column.rowsBetween(1, after)), F.lit(0)) + F.coalesce(F.sum("right").over(column.rowsBetween(before, -1)), F.lit(0))
    crossed = full.withColumn("d", far).select("map_id", "bx", "br", "d")
    rest = more.join(crossed, ["map_id", "bx", "br"]).select(*key, "d")
    return own.unionByName(side).unionByName(rest).groupBy(*key).agg(F.sum("d").alias("d"))


def orthogonal_order(assigned: DataFrame, k: int, eps: float = 1e-6) -> DataFrame:
    """Flips of order in x plus flips in y among each site's k nearest (0: all) neighbours; equal coordinates are no flip.

    Among all neighbours flips are counted without pairs, and large maps in strips (see ``discordances``).
    """
    if k == 0:
        key = ["map_id", "outline_id", "site_id"]
        own = assigned.where("x is not null and y is not null")
        both = [discordances(own.select(*key, F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("r")), key, eps) for a, b in (("x", "cx"), ("y", "cy"))]
        flips = both[0].unionByName(both[1]).groupBy(*key).agg(F.sum("d").alias("_f"))
        flips = flips.join(own.groupBy("map_id").agg(F.count("*").alias("_n")), "map_id").where("_n > 1")
        return _rows(flips, _label("OrthogonalOrder", k), "site_id", F.col("_f"))
    n = nearest_sites(_keyed(assigned), k, ["map_id"], "_key", ["cx", "cy"])

    def flip(a: str, b: str) -> Column:
        d, r = F.col(f"nbr_{a}") - F.col(a), F.col(f"nbr_{b}") - F.col(b)
        return ((F.abs(d) > eps) & (F.abs(r) > eps) & (F.signum(d) != F.signum(r))).cast("int")

    flips = n.groupBy("map_id", "_key").agg(F.sum(flip("x", "cx") + flip("y", "cy")).alias("_f"))
    return _rows(flips.select("map_id", "_key.*", "_f"), _label("OrthogonalOrder", k), "site_id", F.col("_f"))


def deformation(assigned: DataFrame, k: int) -> DataFrame:
    """Mean squared residual of the neighbours' offsets in the grid against those on the map at the best scale.

    For all neighbours (k = 0) the sums follow from the map's totals, so no pairs are made.
    """
    d2, r2, dr = (F.col(c) for c in ("_d2", "_r2", "_dr"))
    if k == 0:
        t = assigned.groupBy("map_id").agg(F.count("*").alias("_n"), *(F.sum(F.col(a) * F.col(b)).alias(f"_{a}{b}") for a, b in (("x", "x"), ("y", "y"), ("cx", "cx"), ("cy", "cy"), ("x", "cx"), ("y", "cy"))), *(F.sum(a).alias(f"_{a}") for a in ("x", "y", "cx", "cy")))
        s = assigned.join(t, "map_id")

        def cross(a: str, b: str) -> Column:
            return F.col(f"_{a}{b}") - F.col(a) * F.col(f"_{b}") - F.col(b) * F.col(f"_{a}") + F.col("_n") * F.col(a) * F.col(b)

        s = s.select("map_id", "outline_id", "site_id", (F.col("_n") - 1).alias("_k"), (cross("x", "x") + cross("y", "y")).alias("_d2"), (cross("cx", "cx") + cross("cy", "cy")).alias("_r2"), (cross("x", "cx") + cross("y", "cy")).alias("_dr"))
    else:
        n = nearest_sites(_keyed(assigned), k, ["map_id"], "_key", ["cx", "cy"])
        dx, dy, rx, ry = (F.col(f"nbr_{c}") - F.col(c) for c in ("x", "y", "cx", "cy"))
        s = n.groupBy("map_id", "_key").agg(F.count("*").alias("_k"), F.sum(dx * dx + dy * dy).alias("_d2"), F.sum(rx * rx + ry * ry).alias("_r2"), F.sum(dx * rx + dy * ry).alias("_dr")).select("map_id", "_key.*", "_k", "_d2", "_r2", "_dr")
    return _rows(s.where("_k > 0"), _label("Deformation", k), "site_id", F.greatest(F.lit(0.0), F.try_divide(r2 - F.try_divide(dr * dr, d2), F.col("_k"))))


def displacement(assigned: DataFrame, mode: str = "Uni", guides: DataFrame | None = None) -> DataFrame:
    """Distance between a site, moved by its partition's fitted transform, and its cell; 0 in partitions of one site."""
    size = assigned.groupBy(*PARTITION_KEY).agg(F.count("*").alias("_n"))
    if mode == "Guide":
        t = align.uniform_aware(assigned, PARTITION_KEY).withColumnRenamed("t", "_d").join(align.guide_align(guides, PARTITION_KEY), PARTITION_KEY, "left").select(*PARTITION_KEY, F.coalesce("t", "_d").alias("t"))
    else:
        t = {"Uni": align.uniform_aware, "NonUni": align.nonuniform_aware}[mode](assigned, PARTITION_KEY)
    s = assigned.join(t, PARTITION_KEY).join(size, PARTITION_KEY).withColumn("_p", G.apply(F.col("t"), F.col("x"), F.col("y")))
    return _rows(s, f"Displacement-{mode}", "site_id", F.when(F.col("_n") > 1, F.hypot(F.col("_p.x") - F.col("cx"), F.col("_p.y") - F.col("cy"))).otherwise(0.0))


HIGH_IS_GOOD = ("GuidingShapeFit",)
#: bins of values looked at in a round, and rounds
BINS, ROUNDS = 1024, 4
NEIGHBOURS = (5, 15, 50, 100, 0)


def analyze(m: TileMap, g: Grid, names: list[str] | None = None, neighbours: tuple[int, ...] = NEIGHBOURS) -> DataFrame:
    """The measures of a map, by name prefix or all. Guide fits need stage DEFORMED, the others ASSIGNED."""
    wanted = lambda n: names is None or any(n.startswith(p) for p in names)
    out = []
    m.require(DEFORMED)
    if wanted("GuidingShapeFit"):
        out += [guide_fit_count(m.cells, m.guide_cells), guide_fit_quality(m.cells, m.guides, m.cell_quality)]
    if names is None or any(not n.startswith("GuidingShapeFit") for n in names):
        m.require(ASSIGNED)
        s = placed(m.sites, g)
        if wanted("SiteGuideFit"):
            out += [site_guide_miss(m.sites, m.guides, m.guide_cells), site_guide_deviation(m.sites, m.guides, m.cell_quality, g)]
        for k in neighbours:
            if wanted("OrthogonalOrder"):
                out.append(orthogonal_order(s, k))
            if wanted("Deformation"):
                out.append(deformation(s, k))
        if wanted("Displacement"):
            out += [displacement(s, "Uni"), displacement(s, "NonUni"), displacement(s, "Guide", m.guides)]
    all_ = out[0]
    for df in out[1:]:
        all_ = all_.unionByName(df)
    return all_


def summarize(measures: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per analyzer: total, avg, count, min, max and the values a tenth and a quarter from the bad end.

    ``max`` is the worst value and ``min`` the best; pct90 is the value at position
    ceil(n / 10) from the worst (positions from 0), pct75 at ceil(n / 4), the best one
    where that is beyond the end. The two are found by counting values in bins and looking
    again into the bin that holds the place, so no task ranks all values of a group.
    """
    by = by or ["map_id", "analyzer"]
    good = F.col("analyzer").startswith(HIGH_IS_GOOD[0])
    own = measures.where("value is not null").select(*by, "value", F.when(good, F.col("value")).otherwise(-F.col("value")).alias("_v"))
    totals = own.groupBy(*by).agg(F.sum("value").alias("total"), F.avg("value").alias("avg"), F.count("*").alias("count"), F.max("_v").alias("_hi"), F.min("_v").alias("_lo"))
    last = F.col("count") - 1
    wanted = F.array(*(F.struct(F.lit(name).alias("what"), F.least(p, last).alias("_at")) for name, p in (("pct90", F.ceil(F.col("count") / 10)), ("pct75", F.ceil(F.col("count") / 4)))))
    asked = totals.select(*by, F.explode(wanted).alias("w"), F.col("_lo").alias("_a"), F.col("_hi").alias("_b")).select(*by, "w.*", "_a", "_b")
    for _ in range(ROUNDS):
        step = (F.col("_b") - F.col("_a")) / BINS
        bin_ = F.when(step > 0, F.least(F.lit(BINS - 1), F.floor((F.col("_v") - F.col("_a")) / step))).otherwise(0)
        spread = own.join(asked, by).where("_v >= _a and _v <= _b").withColumn("_bin", bin_)
        counted = spread.groupBy(*by, "what", "_at", "_bin").agg(F.count("*").alias("_c"), F.min("_v").alias("_a"), F.max("_v").alias("_b"))
        w = Window.partitionBy(*by, "what").orderBy("_bin")  # at most BINS rows
        upto = F.sum("_c").over(w)
        asked = counted.withColumn("_u", upto).where("_at < _u and _at >= _u - _c").select(*by, "what", (F.col("_at") - F.col("_u") + F.col("_c")).alias("_at"), "_a", "_b")
        asked = durable(asked)
        if not asked.where("_a < _b").limit(1).count():
            break
    # what is left of a group lies in one bin of the last round: equal or very near values, counted before they are ranked
    near = own.join(asked, by).where("_v >= _a and _v <= _b").groupBy(*by, "what", "_at", "_v").agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*by, "what").orderBy("_v")
    at = near.withColumn("_u", F.sum("_c").over(w)).where("_at < _u and _at >= _u - _c").select(*by, "what", "_v")
    picked = at.groupBy(*by).agg(*(F.max(F.when(F.col("what") == n, F.col("_v"))).alias(n) for n in ("pct90", "pct75")))
    sign = F.when(good, 1).otherwise(-1)
    return totals.join(picked, by).select(*by, "total", "avg", "count", (F.col("_hi") * sign).alias("min"), (F.col("_lo") * sign).alias("max"), *((F.col(n) * sign).alias(n) for n in ("pct90", "pct75")))


def total_displacement(measures: DataFrame) -> DataFrame:
    """Sum and root mean square of the displacements of each map."""
    d = measures.where(F.col("analyzer").startswith("Displacement"))
    return d.groupBy("map_id", "analyzer").agg(F.sum("value").alias("total"), F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"))
