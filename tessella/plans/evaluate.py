"""Experiments: suites of plans over maps, with statistics of their inputs and results."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import analyze, arrange, partition
from ..schema import PARTITION_KEY, TileMap
from .pipeline import Plan, Result, run

# The parameters of each suite.
SUITES: dict[str, list[Plan]] = {
    "partition": [Plan(cut_type=k, dilation=float(d), productivity=p, alignment=None, combination=None) for p, d, k in itertools.product((1, 5, 10, 20, 30), (1, 3, 5), partition.CUT_TYPES)],
    "deform": [Plan(grid=g, alignment=None, combination=None) for g in ("SQUARE", "HEXAGON")],
    "grids": [Plan(grid=g, alignment=None, combination=None) for g in ("SQUARE", "HEXAGON", "STAGSQUARE", "TRIANGLE", "EQUILATERAL", "NS2", "MIXED")],
    "assign": [Plan(grid=g, alignment=a) for g in ("SQUARE", "HEXAGON") for a in ("BBox-Agnostic", "Nonuniform-Agnostic", "Uniform-Agnostic", "GuideAlign")] + [Plan(grid=g, refine="Uniform-Aware") for g in ("SQUARE", "HEXAGON")],
    "compose": [Plan(grid=g, combination=c) for g in ("SQUARE", "HEXAGON") for c in ("Agnostic", "ClosestAssigned", "AgglomerativeAssigned", "AgglomerativePartitionAssigned")],
    "pipeline": [Plan(grid=g, productivity=p, combination=c, measures=[]) for g in ("SQUARE", "HEXAGON") for p, c in ((10, "AgglomerativePartitionAssigned"), (15, "ClosestAssigned"))],
    "bases": [Plan(grid=g, dilation=None, alignment=None, combination=None) for g in ("SQUARE", "HEXAGON", "STAGSQUARE", "TRIANGLE", "EQUILATERAL", "GEESE", "NS2", "NS3", "MIXED")],
    "data": [Plan(dilation=None, alignment=None, combination=None)],
    "teaser": [Plan(grid=g, productivity=p) for g, p in (("SQUARE", 10), ("HEXAGON", 10))],
    "other": [Plan(grid="HEXAGON", productivity=p, cut_type=k, measures=[]) for p in (5, 20) for k in partition.CUT_TYPES],
    "cartogram": [Plan(grid=g, dilation=None, config=arrange.CARTOGRAM, alignment=None, combination="Agnostic") for g in ("SQUARE", "HEXAGON")],
}


def run_suite(m: TileMap, name: str, repetitions: int = 1) -> list[tuple[Plan, Result]]:
    """Every plan of a suite over the same maps."""
    if name not in SUITES:
        raise ValueError(f"unknown suite {name!r}; known: {', '.join(SUITES)}")
    return [(plan, run(m, plan, repetitions)) for plan in SUITES[name]]


def map_statistics(m: TileMap) -> DataFrame:
    """Outlines, vertices, sites and partitions of each map."""
    o = m.outlines.groupBy("map_id").agg(F.count("*").alias("outlines"), F.sum(F.size("ring")).alias("vertices"))
    s, p = (df.groupBy("map_id").agg(F.count("*").alias(n)) for df, n in ((m.sites, "sites"), (m.partitions, "partitions")))
    return o.join(s, "map_id", "left").join(p, "map_id", "left").na.fill(0)


def shape_measures(m: TileMap) -> DataFrame:
    """fatness, length and dilation of each partition.

    Length is that of its edges inside the outline (whose midpoint isn't on the outline's
    boundary); dilation is the sum over these of (perimeter - length of the edge) / it.
    """
    p = m.partitions.join(m.outlines.select("map_id", "outline_id", F.col("ring").alias("_o")), ["map_id", "outline_id"])
    e = p.select(*PARTITION_KEY, "_o", G.fatness(F.col("ring")).alias("fatness"), G.perimeter(F.col("ring")).alias("_p"), F.explode(G.edges(F.col("ring"))).alias("e"))
    mx, my = (F.col("e.a.x") + F.col("e.b.x")) / 2, (F.col("e.a.y") + F.col("e.b.y")) / 2
    border = F.exists(G.edges(F.col("_o")), lambda s: G.on_segment(s["a"], s["b"], mx, my, 1e-6))
    long = F.hypot(F.col("e.b.x") - F.col("e.a.x"), F.col("e.b.y") - F.col("e.a.y"))
    inner = ~border
    return e.withColumn("_l", long).groupBy(*PARTITION_KEY).agg(F.first("fatness").alias("fatness"), F.sum(F.when(inner, F.col("_l")).otherwise(0.0)).alias("length"), F.sum(F.when(inner, F.try_divide(F.col("_p") - F.col("_l"), F.col("_l"))).otherwise(0.0)).alias("dilation"))


def compare_cut_types(shapes: DataFrame) -> DataFrame:
    """Per map and cut type (columns map_id, cut_type, and shape measures): means and, per metric, how often the type is best.

    A cut's length and dilation are seen from both sides, hence halved.
    """
    s = shapes.groupBy("map_id", "cut_type").agg(F.avg("fatness").alias("fatness"), (F.sum("dilation") / (2 * F.count("*"))).alias("dilation"), (F.sum("length") / (2 * F.count("*"))).alias("length"), (F.count("*") - 1).alias("cuts"))
    for name, order in (("fatness", F.desc("fatness")), ("dilation", F.desc("dilation")), ("length", F.asc("length"))):
        s = s.withColumn(f"best_{name}", (F.rank().over(Window.partitionBy("map_id").orderBy(order)) == 1).cast("int"))
    return s


def cut_counts(stats: DataFrame) -> DataFrame:
    """Found, remaining and applied cuts of each map, from the partition operator's statistics."""
    return stats.groupBy("map_id").agg(*(F.sum(c).alias(c) for c in ("found", "remaining", "applied")))


def assignment_table(measures: DataFrame) -> DataFrame:
    """avg, max and percentiles of the displacements with their rms."""
    return analyze.summarize(measures.where(F.col("analyzer").startswith("Displacement"))).join(analyze.total_displacement(measures).select("map_id", "analyzer", "rms"), ["map_id", "analyzer"])


def timing_ratio(old: DataFrame, new: DataFrame) -> DataFrame:
    """stage, old and new mean milliseconds and their quotient."""
    return old.select("stage", F.col("avg_ms").alias("old_ms")).join(new.select("stage", F.col("avg_ms").alias("new_ms")), "stage").withColumn("ratio", F.try_divide(F.col("old_ms"), F.col("new_ms")))


def parse_timing(line: Column) -> Column:
    """Milliseconds from a log line: the third field from its end."""
    return F.regexp_extract(line, r"(\d+)\s+\S+\s+\S+\s*$", 1).try_cast("long")


def row_layout(m: TileMap, gap: float = 1.0) -> DataFrame:
    """Where each outline goes if outlines stand in a row, most sites first: map_id, outline_id, left."""
    n = m.sites.groupBy("map_id", "outline_id").agg(F.count("*").alias("_n"))
    b = m.outlines.withColumn("_b", G.box(F.col("ring"))).join(n, ["map_id", "outline_id"], "left").withColumn("_w", F.col("_b.right") - F.col("_b.left") + gap)
    w = Window.partitionBy("map_id").orderBy(F.desc_nulls_last("_n"), "outline_id").rowsBetween(Window.unboundedPreceding, -1)
    return b.select("map_id", "outline_id", F.coalesce(F.sum("_w").over(w), F.lit(0.0)).alias("left"))


def bars(measures: DataFrame) -> DataFrame:
    """Share of the worst value for each summary, as bars are drawn."""
    s = analyze.summarize(measures)
    return s.select("map_id", "analyzer", *(F.try_divide(F.col(c), F.col("max")).alias(c) for c in ("avg", "pct90", "pct75")))


def timing_lines(results: list[tuple[Plan, Result]], name: str) -> list[str]:
    """One log line per step of every result, as ``parse_timing`` reads it."""
    return [f"{name} {plan.grid} {plan.cut_type} {plan.productivity} {plan.combination} {step} {1000 * s:.0f} ms total" for plan, r in results for step, s in r.timings]


def outcomes(lines: DataFrame) -> DataFrame:
    """suite, settings and step with mean and number of the times that log lines (line) give; other lines are passed over."""
    f = F.split(F.trim("line"), " +")
    n = F.size(f)
    rows = lines.select(F.get(f, F.lit(0)).alias("suite"), F.concat_ws(" ", F.slice(f, F.lit(2), F.greatest(n - 5, F.lit(0)))).alias("settings"), F.get(f, n - 4).alias("step"), parse_timing(F.col("line")).alias("ms"))
    return rows.where("ms is not null and step is not null").groupBy("suite", "settings", "step").agg(F.avg("ms").alias("avg_ms"), F.count("*").alias("count"))


def file_settings(files: DataFrame, names: list[str]) -> DataFrame:
    """``files`` (path) with the settings that a result's file name gives, joined by hyphens, by ``names``; null where a name has fewer.

    A name with more parts than names isn't a result and is left out.
    """
    stem = F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1)
    parts = F.split(stem, "-")
    return files.where(F.size(parts) <= len(names)).select("*", *(F.get(parts, F.lit(k)).alias(n) for k, n in enumerate(names)))


#: shares of the other value from which on a value is marked as better, and as much better
BETTER, MUCH_BETTER = 0.95, 0.8


def marks(values: DataFrame, by: list[str], variant: str, value: str = "value", high_is_good: bool = False) -> DataFrame:
    """``values`` with the best of the other variants of each group (other) and a mark: ``**`` for a value much better than it, ``*`` for a better one."""
    w = Window.partitionBy(*by)
    good = F.col(value) if not high_is_good else -F.col(value)
    first, second = F.min(F.struct(good.alias("v"), F.col(variant).alias("k"))).over(w), F.sort_array(F.collect_list(F.struct(good.alias("v"), F.col(variant).alias("k"))).over(w))  # the variants of one group
    other = F.when(F.col(variant) == F.col("_f.k"), F.get(F.col("_s"), F.lit(1))["v"]).otherwise(F.col("_f.v"))
    out = values.withColumn("_f", first).withColumn("_s", second).withColumn("other", other if not high_is_good else -other)
    share = F.try_divide(F.col("other"), F.col(value)) if high_is_good else F.try_divide(F.col(value), F.col("other"))
    return out.withColumn("mark", F.when(share <= MUCH_BETTER, "**").when(share <= BETTER, "*").otherwise("")).drop("_f", "_s")


__all__ = ["BETTER", "MUCH_BETTER", "file_settings", "marks", "outcomes", "timing_lines", "SUITES", "assignment_table", "bars", "compare_cut_types", "cut_counts", "map_statistics", "parse_timing", "row_layout", "run_suite", "shape_measures", "timing_ratio"]
