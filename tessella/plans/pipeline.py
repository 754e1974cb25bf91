"""From outlines and sites to a finished tile map, and mosaic cartograms with other weights."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..durable import durable
from ..functions import geometry as G
from ..functions.grids import grid
from ..operators import analyze as analyzers
from ..operators import arrange as arranging
from ..operators import assign as assigning
from ..operators import combine as combining
from ..operators import partition as partitioning
from ..schema import TileMap
from ..sources import drawings, ipe, tsv, wkt


def read_map(spark: SparkSession, path: str, stages: int = 15) -> TileMap:
    """Maps from files by extension: ``.wkt`` (whole) or ``.ipe`` (the stages asked for)."""
    low = path.lower().rstrip("/*")
    if low.endswith(".ipe"):
        return ipe.read(spark, path, stages)
    if low.endswith((".wkt", ".txt")) or "." not in low.rsplit("/", 1)[-1]:
        return wkt.read(spark, path)
    raise ValueError(f"can't tell the format of {path!r}: .wkt and .ipe are known")


def write_map(m: TileMap, path: str, kind: str = "wkt") -> None:
    """One text per map in a folder: wkt or ipe."""
    {"wkt": wkt.write, "ipe": ipe.write}[kind](m, path)


def extended(path: Column, extension: str) -> Column:
    """``path`` ending in the extension (with or without its dot given), whatever its case; another extension stays and gets this one after it."""
    dotted = f".{extension.lstrip('.')}"
    return F.when(F.lower(path).endswith(dotted.lower()), path).otherwise(F.concat(path, F.lit(dotted)))


def with_extension(path: str, extension: str) -> str:
    """The same for the path of one export."""
    dotted = f".{extension.lstrip('.')}"
    return path if path.lower().endswith(dotted.lower()) else path + dotted


def export(m: TileMap, path: str) -> None:
    """GeoJSON, SVG and TSV of the assigned cells, each in a folder of its own; maps may be on different grids."""
    names = sorted(r.grid for r in m.maps.where("grid is not null").select("grid").distinct().collect())  # some dozens of grids
    for draw, kind in ((drawings.geojson, "geojson"), (drawings.svg, "svg")):
        texts = None
        for name in names:
            own = m.with_(sites=m.sites.join(m.maps.where(F.col("grid") == name).select("map_id"), "map_id", "left_semi"))
            drawn = draw(own, grid(name))
            texts = drawn if texts is None else texts.unionByName(drawn)
        if texts is not None:
            drawings.write(texts, with_extension(path, kind))
    tsv.write_result(m, with_extension(path, "tsv"))


@dataclass
class Plan:
    """What to do with a map; None leaves a step out. Several spellings of methods are known."""

    grid: str = "SQUARE"
    cut_type: str = "COMBINED"
    dilation: float | None = 3.0
    productivity: int = 10
    alignment: str | None = "Uniform-Agnostic"
    refine: str | None = None
    combination: str | None = "ClosestAssigned"
    config: arranging.Config = arranging.GRID_MAP
    measures: list[str] | None = None


@dataclass
class Result:
    map: TileMap
    timings: list[tuple[str, float]] = field(default_factory=list)
    measures: DataFrame | None = None
    cost: DataFrame | None = None

    def timing_table(self, spark: SparkSession) -> DataFrame:
        """stage, total and mean milliseconds, and count."""
        rows = spark.createDataFrame([(n, 1000 * s) for n, s in self.timings], "stage string, ms double")
        return rows.groupBy("stage").agg(F.sum("ms").alias("total_ms"), F.avg("ms").alias("avg_ms"), F.count("*").alias("count"))


def run(m: TileMap, plan: Plan | None = None, repetitions: int = 1) -> Result:
    """All steps of a plan; with repetitions the timings of each, and the last result."""
    plan = plan or Plan()
    g = grid(plan.grid)
    out = Result(m)
    for _ in range(repetitions):
        now = m

        def step(name: str, f, *tables: str):
            t = time.time()
            got = f()
            result = got[0] if isinstance(got, tuple) else got
            kept = result.with_(**{n: durable(getattr(result, n)) for n in tables})
            out.timings.append((name, time.time() - t))
            return kept, got[1] if isinstance(got, tuple) else None

        if plan.dilation is None:
            now, _ = step("partition", lambda: partitioning.trivial(now), "maps", "partitions", "sites")
        else:
            now, _ = step("partition", lambda: partitioning.partition(now, plan.cut_type, plan.dilation, plan.productivity), "maps", "partitions", "sites")
        now, _ = step("arrange", lambda: arranging.arrange(now, g, plan.config), "maps", "cells", "guides", "guide_cells", "cell_quality")
        if plan.alignment:
            now, out.cost = step("assign", lambda: assigning.assign(now, g, plan.alignment, plan.refine), "maps", "sites")
        if plan.combination:
            now, _ = step("combine", lambda: combining.combine(now, g, plan.combination), "cells", "sites", "guides", "guide_cells", "cell_quality")
        out.map = now
    if plan.measures is not None:
        t = time.time()
        out.measures = durable(analyzers.analyze(now, g, plan.measures or None))
        out.timings.append(("analyze", time.time() - t))
    return out


# cartogram weights


def area_weights(outlines: DataFrame, low: float, high: float) -> DataFrame:
    """Weights from low to high in line with outline area; for low under 1 the scale starts at no area and weight 1."""
    sized = outlines.withColumn("_a", G.area(F.col("ring")))
    ends = sized.groupBy("map_id").agg((F.lit(0.0) if low < 1 else F.min("_a")).alias("_lo"), F.max("_a").alias("_hi"))
    least = 1.0 if low < 1 else float(low)
    share = F.coalesce(F.try_divide(F.col("_a") - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0))
    return sized.join(ends, "map_id").withColumn("custom_weight", G.half_up(least + share * (high - least))).drop("_a", "_lo", "_hi")


def random_weights(outlines: DataFrame, low: int, high: int, seed: int = 1) -> DataFrame:
    """Whole weights between low and high (both included) that depend on the seed and the outline alone."""
    h = F.pmod(F.xxhash64(F.lit(seed), F.col("map_id"), F.col("outline_id")), F.lit(high - low + 1))
    return outlines.withColumn("custom_weight", (h + low).cast("int"))


def table_weights(outlines: DataFrame, weights: DataFrame, factor: float = 1.0, key: Column | None = None) -> DataFrame:
    """Weights from a table (key, value) by label, times factor, at least 1; an outline without a row is an error."""
    named = weights.select(F.col("key").alias("_k"), F.col("value").alias("_v"))
    joined = outlines.join(named, (key if key is not None else F.col("label")) == F.col("_k"), "left")
    missing = F.raise_error(F.concat(F.lit("no weight for outline "), F.coalesce("label", F.lit("<NULL>")))).cast("int")
    return joined.withColumn("custom_weight", F.when(F.col("_v").isNotNull(), G.half_up(F.greatest(F.lit(1.0), F.col("_v") * factor))).otherwise(missing)).drop("_k", "_v")


def cartogram(m: TileMap, grid_name: str = "SQUARE", exact: bool = False, config: arranging.Config | None = None) -> TileMap:
    """A mosaic cartogram: one region per outline of its weight's size, components side by side; no assignment."""
    g = grid(grid_name)
    made, _ = arranging.arrange(partitioning.trivial(m), g, config or arranging.cartogram_config(exact))
    return combining.combine(made, g, "Agnostic")
