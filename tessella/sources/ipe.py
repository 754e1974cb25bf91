"""IPE drawings: maps read from layers by name prefix, and written as pages per stage.

Layers mean what their names begin with: ``outline``, ``sites``, ``partition_<outline>``,
``cells_<grid>_<partition>``, ``gridmap``. The XML is taken apart by one Arrow-fed parser
per file; everything after that is joins.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..durable import durable
from ..functions import geometry as G
from ..functions.grids import grid
from ..operators.spatial import locate
from ..schema import ASSIGNED, CELL, DEFORMED, INPUT, PARTITIONED, RING, TileMap

OBJECTS = f"map_id string, page int, ord int, layer string, kind string, ring {RING}, x double, y double, label string, r int, g int, b int, grp int"


def _matrix(text: str | None) -> list[float]:
    return [float(v) for v in text.split()] if text else [1, 0, 0, 1, 0, 0]


def _times(m: list[float], n: list[float]) -> list[float]:
    a, b, c, d, e, f = m
    return [a * n[0] + c * n[1], b * n[0] + d * n[1], a * n[2] + c * n[3], b * n[2] + d * n[3], a * n[4] + c * n[5] + e, b * n[4] + d * n[5] + f]


def _at(m: list[float], x: float, y: float) -> dict[str, float]:
    return {"x": m[0] * x + m[2] * y + m[4], "y": m[1] * x + m[3] * y + m[5]}


def _ring(text: str, m: list[float]) -> list[dict[str, float]]:
    out, held = [], []
    for t in (text or "").split():
        if t in ("m", "l") and len(held) >= 2:
            out.append(_at(m, held[-2], held[-1]))
            held = []
        elif t not in ("h", "c", "q", "a", "s", "u", "e", "m", "l"):
            held.append(float(t))
    if len(out) > 1 and out[0] == out[-1]:
        out.pop()
    return out


def _color(el: ET.Element) -> tuple[int | None, int | None, int | None]:
    for key in ("fill", "stroke"):
        parts = (el.get(key) or "").split()
        if len(parts) == 3:
            return tuple(int(float(p) * 255 + 0.5) for p in parts)
    return None, None, None


def drawn(text: str) -> list[tuple]:
    """(page, ord, layer, kind, ring, x, y, label, r, g, b, group) of each path and text; members of a group share its number."""
    rows: list[tuple] = []
    group = 0

    def visit(el: ET.Element, page: int, layer: str, m: list[float], grp: int | None) -> None:
        nonlocal group
        here = _times(m, _matrix(el.get("matrix")))
        if el.tag == "path":
            ring = _ring(el.text, here)
            if ring:
                rows.append((page, len(rows), layer, "path", ring, None, None, None, *_color(el), grp))
        elif el.tag == "text":
            x, y = (float(v) for v in (el.get("pos") or "0 0").split())
            p = _at(here, x, y)
            rows.append((page, len(rows), layer, "text", None, p["x"], p["y"], (el.text or "").strip(), *_color(el), grp))
        elif el.tag == "group":
            group += 1
            own = group
            for child in el:
                visit(child, page, layer, here, own)

    for page, node in enumerate(ET.fromstring(text).iter("page")):
        layer = next((x.get("name") for x in node.iter("layer")), "")
        for el in node:
            layer = el.get("layer", layer)
            if el.tag in ("path", "text", "group"):
                visit(el, page, layer, [1, 0, 0, 1, 0, 0], None)
    return rows


def files(spark: SparkSession, path: str) -> DataFrame:
    """map_id (the file's name without its extension) and value (its text); a file is one map."""
    return spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(\.[^./]*)?$", 1).alias("map_id"), "value")


def objects(texts: DataFrame) -> DataFrame:
    """All drawn objects of documents (map_id, value)."""

    def run(batches):
        names = [c.split()[0] for c in OBJECTS.replace(RING, "ring").split(", ")]
        for pdf in batches:
            rows = [(r.map_id, *o) for r in pdf.itertuples() for o in drawn(r.value)]
            yield pd.DataFrame(rows, columns=names).astype({"r": "Int32", "g": "Int32", "b": "Int32", "grp": "Int32"})

    return texts.mapInPandas(run, OBJECTS)


def find_page(items: DataFrame, prefixes: list[str]) -> DataFrame:
    """Each map's objects on its first page that has a layer for every prefix."""
    hit = [F.max(F.col("layer").startswith(p).cast("int")).alias(f"_p{i}") for i, p in enumerate(prefixes)]
    pages = items.groupBy("map_id", "page").agg(*hit).where(" and ".join(f"_p{i} = 1" for i in range(len(prefixes)))).groupBy("map_id").agg(F.min("page").alias("page"))
    return items.join(pages, ["map_id", "page"])


def _color_of(d: str = "") -> Column:
    return F.when(F.col(f"{d}r").isNotNull(), F.struct(F.col(f"{d}r").alias("r"), F.col(f"{d}g").alias("g"), F.col(f"{d}b").alias("b"))).cast("struct<r:int,g:int,b:int>")


def read(spark: SparkSession, path: str, stages: int = INPUT) -> TileMap:
    """Maps at the latest of the asked stages that each file has pages for."""
    return parse(files(spark, path), stages)


def parse(texts: DataFrame, stages: int = INPUT) -> TileMap:
    """Maps from documents (map_id, value)."""
    items = durable(objects(texts))
    m = _input(texts.sparkSession, find_page(items, ["outline", "sites"]))
    if stages & PARTITIONED:
        m = _partitions(m, find_page(items, ["partition_"]))
        if stages & DEFORMED:
            m = _cells(m, find_page(items, ["cells_"]))
            if stages & ASSIGNED:
                m = _assigned(m, find_page(items, ["gridmap"]))
    return m


def _input(spark: SparkSession, items: DataFrame) -> TileMap:
    """Closed paths of outline layers, labelled by a text of their group, else a text inside, else o0, o1, …; paths and texts of site layers."""
    outs = items.where("layer like 'outline%' and kind = 'path'")
    by_ord = Window.partitionBy("map_id").orderBy("ord")
    outs = outs.withColumn("outline_id", (F.row_number().over(by_ord) - 1).cast("int")).withColumn("ring", G.counter_clockwise(F.col("ring")))
    texts = items.where("layer like 'outline%' and kind = 'text'")
    grouped = texts.where("grp is not null").groupBy("map_id", "grp").agg(F.min_by("label", "ord").alias("_l"), F.min_by(F.struct("x", "y"), "ord").alias("_t"))
    loose = locate(texts.where("grp is null").select("map_id", "ord", "x", "y", "label"), outs.select("map_id", "outline_id", "ring"), ["map_id", "ord"], "outline_id", ["map_id"]).where("outline_id is not null").groupBy("map_id", "outline_id").agg(F.min_by("label", "ord").alias("_m"), F.min_by(F.struct("x", "y"), "ord").alias("_u"))
    named = outs.join(grouped, ["map_id", "grp"], "left").join(loose, ["map_id", "outline_id"], "left")
    outlines = named.select("map_id", "outline_id", F.coalesce("_l", "_m", F.concat(F.lit("o"), "outline_id")).alias("label"), F.coalesce("_t", "_u").alias("label_pt"), _color_of().alias("color"), "ring", F.lit(-1).alias("custom_weight"))
    outlines = durable(outlines)  # each later step reads outlines, partitions and sites several times
    centre = G.ring_centroid(F.col("ring"))
    marks = items.where("layer like 'sites%'").withColumn("_c", centre).select("map_id", "ord", F.coalesce("_c.x", "x").alias("x"), F.coalesce("_c.y", "y").alias("y"), F.when(F.col("kind") == "text", F.col("label")).alias("label"), _color_of().alias("color"), "layer").where("x is not null")
    put = locate(marks, outlines, ["map_id", "ord"], "outline_id", ["map_id"]).where("outline_id is not null")
    w = Window.partitionBy("map_id", "outline_id").orderBy("ord")
    sites = put.withColumn("site_id", (F.row_number().over(w) - 1).cast("int")).withColumn("_n", F.row_number().over(by_ord) - 1)
    sites = sites.select("map_id", "outline_id", "site_id", F.coalesce("label", F.concat(F.lit("s"), F.col("_n").cast("string"))).alias("label"), "x", "y", "color", "layer", F.lit(None).cast("int").alias("partition_id"), F.lit(None).cast(CELL).alias("cell"))
    maps = outlines.select("map_id").distinct().select("map_id", F.lit(INPUT).alias("stage"), F.lit(None).cast("string").alias("grid"))
    return TileMap.of(spark, maps=maps, outlines=outlines, sites=durable(sites))


def _raise(m: TileMap, reached: DataFrame, stage: int, grid_of: DataFrame | None = None) -> TileMap:
    maps = m.maps.join(reached.select("map_id").distinct().withColumn("_s", F.lit(stage)), "map_id", "left").withColumn("stage", F.coalesce("_s", "stage")).drop("_s")
    if grid_of is not None:
        maps = maps.drop("grid").join(grid_of, "map_id", "left").select("map_id", "stage", "grid")
    return m.with_(maps=maps)


def _partitions(m: TileMap, items: DataFrame) -> TileMap:
    """Paths of layer partition_<outline label>, numbered in drawing order; sites go to the first that holds them."""
    p = items.where("layer like 'partition\\_%' and kind = 'path'").withColumn("_o", F.substring("layer", 11, 1000))
    p = p.join(m.outlines.select("map_id", "outline_id", F.col("label").alias("_o")), ["map_id", "_o"])
    w = Window.partitionBy("map_id", "outline_id").orderBy("ord")
    p = p.withColumn("partition_id", (F.row_number().over(w) - 1).cast("int"))
    texts = items.where("layer like 'partition\\_%' and kind = 'text'").select("map_id", "layer", "ord", "x", "y", "label")
    rings = p.select("map_id", "layer", "outline_id", "partition_id", "ring", "ord")
    held = locate(texts, rings, ["map_id", "ord"], "partition_id", ["map_id", "layer"]).where("partition_id is not null").groupBy("map_id", "layer", "partition_id").agg(F.min_by("label", "ord").alias("_l"), F.min_by(F.struct("x", "y"), "ord").alias("_t"))
    p = p.join(held, ["map_id", "layer", "partition_id"], "left")
    partitions = p.select("map_id", "outline_id", "partition_id", F.coalesce("_l", F.concat_ws(":", "_o", "partition_id")).alias("label"), F.col("_t").alias("label_pt"), _color_of().alias("color"), G.counter_clockwise(F.col("ring")).alias("ring"), F.lit(-1).alias("custom_weight"))
    partitions = durable(partitions)
    sites = locate(m.sites.drop("partition_id"), partitions, ["map_id", "outline_id", "site_id"], "partition_id", ["map_id", "outline_id"]).select(*m.sites.columns)
    return _raise(m.with_(partitions=partitions, sites=durable(sites)), partitions, PARTITIONED)


def _cells(m: TileMap, items: DataFrame) -> TileMap:
    """Paths of layer cells_<grid>_<partition label>: the cells that hold their centroids."""
    c = items.where("layer like 'cells\\_%' and kind = 'path'").withColumn("_g", F.regexp_extract("layer", r"^cells_([^_]*)_(.*)$", 1)).withColumn("_p", F.regexp_extract("layer", r"^cells_([^_]*)_(.*)$", 2)).withColumn("_c", G.ring_centroid(F.col("ring")))
    names = [r[0] for r in c.select("_g").distinct().collect()]  # a few grid names
    at = F.lit(None).cast(CELL)
    for n in names:
        at = F.when(F.col("_g") == n, G.containing_cell(F.col("_c.x"), F.col("_c.y"), grid(n))).otherwise(at)
    c = c.withColumn("_cell", at).join(m.partitions.select("map_id", "outline_id", "partition_id", F.col("label").alias("_p")), ["map_id", "_p"])
    cells = c.select("map_id", "outline_id", "partition_id", F.col("_cell.x").alias("x"), F.col("_cell.y").alias("y"), "ord")
    return _raise(m.with_(cells=cells), cells, DEFORMED, c.groupBy("map_id").agg(F.first("_g").alias("grid")))


def _assigned(m: TileMap, items: DataFrame) -> TileMap:
    """Texts of gridmap layers: the cell around a text goes to the first site of that label."""
    t = items.where("layer like 'gridmap%' and kind = 'text'").join(m.maps.select("map_id", "grid"), "map_id")
    at = F.lit(None).cast(CELL)
    for n in [r[0] for r in m.maps.where("grid is not null").select("grid").distinct().collect()]:
        at = F.when(F.col("grid") == n, G.containing_cell(F.col("x"), F.col("y"), grid(n))).otherwise(at)
    first = m.sites.groupBy("map_id", "label").agg(F.min(F.struct("outline_id", "site_id")).alias("_s"))
    got = t.withColumn("_cell", at).join(first, ["map_id", "label"]).groupBy("map_id", "_s").agg(F.min_by("_cell", "ord").alias("_cell")).select("map_id", "_s.*", "_cell")
    sites = m.sites.join(got, ["map_id", "outline_id", "site_id"], "left").withColumn("cell", F.col("_cell")).select(*m.sites.columns)
    return _raise(m.with_(sites=sites), got, ASSIGNED)


# writing


def _escaped(s: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def _path(ring: Column, layer: Column, color: Column | None = None) -> Column:
    points = F.transform(ring, lambda p, i: F.concat(p["x"].cast("string"), F.lit(" "), p["y"].cast("string"), F.when(i == 0, " m").otherwise(" l")))
    fill = F.lit("") if color is None else F.when(color.isNull(), "").otherwise(F.concat(F.lit(' fill="'), F.concat_ws(" ", *((color[n] / 255).cast("string") for n in "rgb")), F.lit('"')))
    return F.concat(F.lit('<path layer="'), _escaped(layer), F.lit('" stroke="black"'), fill, F.lit(">\n"), F.array_join(points, "\n"), F.lit("\nh\n</path>"))


def _text(x: Column, y: Column, label: Column, layer: Column) -> Column:
    return F.concat(F.lit('<text layer="'), _escaped(layer), F.lit('" type="label" pos="'), F.concat_ws(" ", x.cast("string"), y.cast("string")), F.lit('">'), _escaped(F.coalesce(label, F.lit(""))), F.lit("</text>"))


def documents(m: TileMap, stages: int = 15) -> DataFrame:
    """map_id and an IPE text with a page for each asked stage that a map has reached; the partition page holds the input too."""
    out: list[DataFrame] = []

    def add(df: DataFrame, page: int, kind: int, shape: Column, layer: Column) -> None:
        out.append(df.select("map_id", F.struct(F.lit(page).alias("page"), F.lit(kind).alias("kind"), "outline_id", F.coalesce(F.col("k"), F.lit(0)).cast("int").alias("k"), layer.alias("layer"), shape.alias("s")).alias("e")))

    def reached(df: DataFrame, stage: int) -> DataFrame:
        return df.join(m.maps.where(F.col("stage") >= stage).select("map_id"), "map_id")

    for page, bit in ((0, INPUT), (1, PARTITIONED)):
        if stages & bit:
            o, s = reached(m.outlines, bit).withColumn("k", F.lit(0)), reached(m.sites, bit).withColumn("k", F.col("site_id"))
            lay = F.lit("outline")
            add(o, page, 0, _path(F.col("ring"), lay, F.col("color")), lay)
            add(o.withColumn("_c", F.coalesce("label_pt", G.ring_centroid(F.col("ring")))), page, 1, _text(F.col("_c.x"), F.col("_c.y"), F.col("label"), lay), lay)
            lay = F.lit("sites")
            add(s, page, 2, _text(F.col("x"), F.col("y"), F.col("label"), lay), lay)
    if stages & PARTITIONED:
        p = reached(m.partitions, PARTITIONED).join(m.outlines.select("map_id", "outline_id", F.col("label").alias("_o")), ["map_id", "outline_id"]).withColumn("k", F.col("partition_id"))
        lay = F.concat(F.lit("partition_"), "_o")
        add(p, 1, 3, _path(F.col("ring"), lay, F.col("color")), lay)
        add(p.withColumn("_c", F.coalesce("label_pt", G.ring_centroid(F.col("ring")))), 1, 4, _text(F.col("_c.x"), F.col("_c.y"), F.col("label"), lay), lay)
    if stages & (DEFORMED | ASSIGNED):
        for n in [r[0] for r in m.maps.where("grid is not null").select("grid").distinct().collect()]:
            g = grid(n)
            own = m.maps.where(F.col("grid") == n).select("map_id")
            if stages & DEFORMED:
                c = m.cells.join(own, "map_id").join(m.partitions.select("map_id", "outline_id", "partition_id", "label", "color"), ["map_id", "outline_id", "partition_id"]).withColumn("k", F.col("ord"))
                lay = F.concat(F.lit(f"cells_{n}_"), "label")
                add(c, 2, 5, _path(G.cell_boundary(F.col("x"), F.col("y"), g), lay, F.col("color")), lay)
            if stages & ASSIGNED:
                s = reached(m.sites, ASSIGNED).join(own, "map_id").where("cell is not null").withColumn("k", F.col("site_id")).withColumn("_c", G.cell_centroid(F.col("cell.x"), F.col("cell.y"), g))
                lay = F.concat(F.lit("gridmap_"), F.coalesce("layer", F.lit("sites")))
                add(s, 3, 6, _path(G.cell_boundary(F.col("cell.x"), F.col("cell.y"), g), lay, F.col("color")), lay)
                lay = F.concat(lay, F.lit("_labels"))
                add(s, 3, 7, _text(F.col("_c.x"), F.col("_c.y"), F.col("label"), lay), lay)
    both = out[0]
    for df in out[1:]:
        both = both.unionByName(df)
    pages = both.groupBy("map_id", "e.page").agg(F.array_sort(F.collect_list("e")).alias("es"))
    names = F.array_sort(F.array_distinct(F.transform("es", lambda e: e["layer"])))
    page = F.concat(F.lit("<page>\n"), F.array_join(F.transform(names, lambda n: F.concat(F.lit('<layer name="'), _escaped(n), F.lit('"/>'))), "\n"), F.lit("\n"), F.array_join(F.transform("es", lambda e: e["s"]), "\n"), F.lit("\n</page>"))
    texts = pages.select("map_id", F.struct(F.col("page"), page.alias("t")).alias("p")).groupBy("map_id").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    return texts.select("map_id", F.concat(F.lit('<?xml version="1.0"?>\n<ipe version="70206">\n'), F.array_join(F.transform("ps", lambda p: p["t"]), "\n"), F.lit("\n</ipe>")).alias("value"))


def write(m: TileMap, path: str, stages: int = 15) -> None:
    documents(m, stages).write.partitionBy("map_id").mode("overwrite").text(path)


__all__ = ["documents", "drawn", "files", "find_page", "objects", "parse", "read", "write"]
