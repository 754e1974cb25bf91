"""Tab-separated tables: sites, weights, adjacencies, and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.spatial import locate
from ..schema import TileMap


def _fields(spark: SparkSession, path: str) -> DataFrame:
    """ln (ordered within a file) and f, the fields of each line."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("ln", "line"))
    return lines.where("line <> ''").select("ln", F.split("line", "\t").alias("f"))


def read_sites(spark: SparkSession, path: str, outlines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sites of a file (see ``put_sites``) in the outlines of one map, and those in none."""
    maps = [r.map_id for r in outlines.select("map_id").distinct().limit(2).collect()]
    if len(maps) != 1:
        raise ValueError("a table of sites belongs to one map: give the outlines of that map")
    return put_sites(_fields(spark, path).select(F.lit(maps[0]).alias("map_id"), "ln", "f"), outlines)


def put_sites(lines: DataFrame, outlines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sites from lines (map_id, ln, f: label, x, y and optional r, g, b; black without) put into the first outline of their map that holds them, and those in none."""
    get = lambda i, kind: F.get("f", F.lit(i)).try_cast(kind)
    color = F.struct(*(F.coalesce(get(i, "int"), F.lit(0)).alias(n) for i, n in ((3, "r"), (4, "g"), (5, "b"))))
    rows = lines.select("map_id", "ln", get(0, "string").alias("label"), get(1, "double").alias("x"), get(2, "double").alias("y"), color.alias("color")).where("x is not null and y is not null")
    put = locate(rows, outlines, ["map_id", "ln"], "outline_id", ["map_id"])
    w = Window.partitionBy("map_id", "outline_id").orderBy("ln")
    inside = put.where("outline_id is not null").withColumn("site_id", (F.row_number().over(w) - 1).cast("int"))
    return inside.select("map_id", "outline_id", "site_id", "label", "x", "y", "color"), put.where("outline_id is null").select("map_id", "label", "x", "y")


def weight_map(lines: DataFrame) -> DataFrame:
    """key and value from (ln, line): lines with exactly two fields that don't begin with #, the last of equal keys."""
    f = lines.where(~F.col("line").startswith("#")).select("ln", F.split("line", "\t").alias("f")).where(F.size("f") == 2)
    rows = f.select("ln", F.col("f")[0].alias("key"), F.col("f")[1].try_cast("double").alias("value")).where("value is not null")
    return rows.groupBy("key").agg(F.max_by("value", "ln").alias("value"))


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("ln", "line"))
    return weight_map(lines)


def read_adjacency(spark: SparkSession, path: str) -> DataFrame:
    """Undirected pairs a < b."""
    f = _fields(spark, path).where(F.size("f") == 2).select(F.col("f")[0].alias("p"), F.col("f")[1].alias("q"))
    return f.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()


def read_result(spark: SparkSession, path: str) -> DataFrame:
    """label, x, y of a table with or without a header (label or region first)."""
    f = _fields(spark, path)
    return f.select(F.col("f")[0].alias("label"), F.get("f", F.lit(1)).try_cast("double").alias("x"), F.get("f", F.lit(2)).try_cast("double").alias("y")).where("x is not null")


def result_lines(m: TileMap) -> DataFrame:
    """map_id and cell x, cell y, label of each assigned site."""
    return m.sites.where("cell is not null").select("map_id", F.concat_ws("\t", "cell.x", "cell.y", F.coalesce("label", F.lit(""))).alias("value"))


def write_result(m: TileMap, path: str) -> None:
    result_lines(m).write.partitionBy("map_id").mode("overwrite").text(path)


def site_lines(sites: DataFrame, partitions: DataFrame | None = None) -> DataFrame:
    """label, x, y, r, g, b of each site, with its partition's label first if partitions are given."""
    own = [F.coalesce("label", F.lit("")), F.col("x").cast("string"), F.col("y").cast("string"), F.concat_ws("\t", "color.r", "color.g", "color.b")]
    if partitions is None:
        return sites.select("map_id", F.concat_ws("\t", *own).alias("value"))
    named = sites.join(partitions.select("map_id", "outline_id", "partition_id", F.col("label").alias("_p")), ["map_id", "outline_id", "partition_id"], "left")
    return named.select("map_id", F.concat_ws("\t", F.coalesce("_p", F.lit("")), *own).alias("value"))
