"""Transforms from map space to grid space, fitted per partition with plain aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.grids import Grid


def _ratio(a: Column, b: Column) -> Column:
    """a / b; 1 where b is zero (sites in one place or line)."""
    return F.coalesce(F.when(b != 0, F.try_divide(a, b)), F.lit(1.0))


def _joined(sites: DataFrame, cells: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    def stats(df: DataFrame, x: str, y: str, p: str) -> DataFrame:
        return df.groupBy(*keys).agg(*(f.alias(f"{p}{n}{c}") for c, v in (("x", x), ("y", y)) for n, f in (("m", F.avg(v)), ("s", F.var_pop(v) * F.count(v)), ("lo", F.min(v)), ("hi", F.max(v)))))

    return stats(sites, "x", "y", "s"), stats(cells, "cx", "cy", "c")


def centroids(cells: DataFrame, g: Grid) -> DataFrame:
    """``cells`` with cx and cy, their centroids."""
    return cells.withColumn("_c", G.cell_centroid(F.col("x"), F.col("y"), g)).withColumn("cx", F.col("_c.x")).withColumn("cy", F.col("_c.y")).drop("_c")


def _transform(sx: Column, sy: Column) -> Column:
    """Scale, then bring the mean site onto the mean cell."""
    return G.transform(sx, sy, F.col("cmx") - sx * F.col("smx"), F.col("cmy") - sy * F.col("smy"))


def bbox_agnostic(sites: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys and t: the sites' box onto the box of the cells' centroids, corner on corner."""
    s, c = _joined(sites, cells, keys)
    sx, sy = (_ratio(F.col(f"chi{a}") - F.col(f"clo{a}"), F.col(f"shi{a}") - F.col(f"slo{a}")) for a in "xy")
    return s.join(c, keys).select(*keys, G.transform(sx, sy, F.col("clox") - sx * F.col("slox"), F.col("cloy") - sy * F.col("sloy")).alias("t"))


def nonuniform_agnostic(sites: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """Per axis the root of the cells' over the sites' squared spread (sums, not means)."""
    s, c = _joined(sites, cells, keys)
    return s.join(c, keys).select(*keys, _transform(F.sqrt(_ratio(F.col("csx"), F.col("ssx"))), F.sqrt(_ratio(F.col("csy"), F.col("ssy")))).alias("t"))


def uniform_agnostic(sites: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """One scale: the root of the cells' over the sites' squared spread in both axes."""
    s, c = _joined(sites, cells, keys)
    scale = F.sqrt(_ratio(F.col("csx") + F.col("csy"), F.col("ssx") + F.col("ssy")))
    return s.join(c, keys).select(*keys, _transform(scale, scale).alias("t"))


def _aware(assigned: DataFrame, keys: list[str], uniform: bool) -> DataFrame:
    m = assigned.groupBy(*keys).agg(F.avg("x").alias("smx"), F.avg("y").alias("smy"), F.avg("cx").alias("cmx"), F.avg("cy").alias("cmy"), F.covar_pop("x", "cx").alias("xc"), F.covar_pop("y", "cy").alias("yc"), F.var_pop("x").alias("xx"), F.var_pop("y").alias("yy"))
    if uniform:
        s = _ratio(F.col("xc") + F.col("yc"), F.col("xx") + F.col("yy"))
        return m.select(*keys, _transform(s, s).alias("t"))
    return m.select(*keys, _transform(_ratio(F.col("xc"), F.col("xx")), _ratio(F.col("yc"), F.col("yy"))).alias("t"))


def nonuniform_aware(assigned: DataFrame, keys: list[str]) -> DataFrame:
    """Least squares per axis of sites (x, y) onto their own cells (cx, cy)."""
    return _aware(assigned, keys, False)


def uniform_aware(assigned: DataFrame, keys: list[str]) -> DataFrame:
    """Least squares with one scale."""
    return _aware(assigned, keys, True)


def guide_align(guides: DataFrame, keys: list[str]) -> DataFrame:
    """The transform that made each guide."""
    return guides.select(*keys, G.transform(F.col("factor"), F.col("factor"), F.col("tx"), F.col("ty")).alias("t"))


AGNOSTIC = {"BBox-Agnostic": bbox_agnostic, "Nonuniform-Agnostic": nonuniform_agnostic, "Uniform-Agnostic": uniform_agnostic}
AWARE = {"Nonuniform-Aware": nonuniform_aware, "Uniform-Aware": uniform_aware}
# other spellings that users may have in scripts
ALIASES = {"OPTIMAL": "Uniform-Agnostic", "CENTROID_VAR": "Nonuniform-Agnostic", "CV": "Nonuniform-Agnostic", "BBOX": "BBox-Agnostic", "Guide": "GuideAlign"}


def align(name: str, sites: DataFrame, cells: DataFrame, guides: DataFrame | None, keys: list[str]) -> DataFrame:
    """A transform per partition by name: one of AGNOSTIC or GuideAlign (partitions without a guide fall back to the default)."""
    name = ALIASES.get(name, name)
    if name == "GuideAlign":
        if guides is None:
            raise ValueError("GuideAlign needs guides")
        default = uniform_agnostic(sites, cells, keys).withColumnRenamed("t", "_d")
        return default.join(guide_align(guides, keys), keys, "left").select(*keys, F.coalesce("t", "_d").alias("t"))
    if name not in AGNOSTIC:
        raise ValueError(f"unknown alignment {name!r}; known: {', '.join([*AGNOSTIC, 'GuideAlign'])}")
    return AGNOSTIC[name](sites, cells, keys)
