"""GeoJSON and SVG of finished maps, as one text per map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.grids import Grid
from ..schema import TileMap


def _tiles(m: TileMap, g: Grid) -> DataFrame:
    return m.sites.where("cell is not null").withColumn("tile", G.cell_boundary(F.col("cell.x"), F.col("cell.y"), g))


def geojson(m: TileMap, g: Grid) -> DataFrame:
    """map_id and a feature collection: a polygon per site with property label (escaped)."""
    closed = F.concat(F.col("tile"), F.slice("tile", 1, 1))
    ring = F.transform(closed, lambda p: F.array(p["x"], p["y"]))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.coalesce("label", F.lit("")).alias("label")).alias("properties"), geometry.alias("geometry"))
    rows = _tiles(m, g).select("map_id", F.struct("outline_id", "site_id", F.to_json(feature).alias("f")).alias("e"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["f"]), ",")
    return rows.groupBy("map_id").agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), body, F.lit("]}")).alias("value"))


def _escaped(s: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def svg(m: TileMap, g: Grid, scale: float = 8.0) -> DataFrame:
    """map_id and a drawing: a polygon per site with attribute label; the cells' box times ``scale``, y upwards."""
    t = _tiles(m, g).withColumn("b", G.box(F.col("tile")))
    view = t.groupBy("map_id").agg(F.min("b.left").alias("l"), F.min("b.bottom").alias("o"), F.max("b.right").alias("r"), F.max("b.top").alias("t"))
    at = F.transform("tile", lambda p: F.concat_ws(",", F.round((p["x"] - F.col("l")) * scale, 4).cast("string"), F.round((F.col("t") - p["y"]) * scale, 4).cast("string")))
    fill = F.when(F.col("color").isNull(), "none").otherwise(F.concat(F.lit("rgb("), F.concat_ws(",", "color.r", "color.g", "color.b"), F.lit(")")))
    shape = F.concat(F.lit('<polygon label="'), _escaped(F.coalesce("label", F.lit(""))), F.lit('" fill="'), fill, F.lit('" stroke="black" stroke-width="0.25" points="'), F.array_join(at, " "), F.lit('"/>'))
    rows = t.join(view, "map_id").select("map_id", "l", "o", "r", "t", F.struct("outline_id", "site_id", shape.alias("s")).alias("e"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["s"]), "\n")
    head = F.format_string('<svg xmlns="http://www.w3.org/2000/svg" width="%.4f" height="%.4f">\n', (F.first("r") - F.first("l")) * scale, (F.first("t") - F.first("o")) * scale)
    return rows.groupBy("map_id").agg(F.concat(head, body, F.lit("\n</svg>")).alias("value"))


def write(texts: DataFrame, path: str) -> None:
    texts.write.partitionBy("map_id").mode("overwrite").text(path)
