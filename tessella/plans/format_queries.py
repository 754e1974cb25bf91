"""Registered queries of text formats and of placing components, over an atlas: a map for every sixty ids, so maps grow in number and not in size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..durable import dealt, durable
from ..functions import colors as C
from ..functions import geometry as G
from ..functions.grids import grid
from ..operators import combine
from ..schema import INPUT, TileMap
from ..sources import drawings, ipe, tsv, wkt
from . import pipeline
from .queries import LAID, _table, laid, q6, query, r6

SQUARE = grid("SQUARE")
EACH, APART = 60, 200
ATLAS = (
    LAID
    + f", lm AS (SELECT *, 'm' || CAST(CAST(floor(site_id / {EACH}) AS BIGINT) AS VARCHAR) AS map_id FROM laid), o AS (SELECT map_id, partition_id, CAST(dense_rank() OVER (PARTITION BY map_id ORDER BY partition_id) - 1 AS INT) AS outline_id, min(x) - 1 AS l, max(x) + 1 AS r, min(y) - 1 AS b, max(y) + 1 AS t FROM lm GROUP BY 1, 2),"
    " w AS (SELECT lm.map_id, outline_id, CAST(row_number() OVER (PARTITION BY lm.map_id, outline_id ORDER BY lm.site_id) - 1 AS INT) AS site_id, CAST(lm.site_id AS VARCHAR) AS label, 'part ' || lm.partition_id AS part, x, y, cx, cy FROM lm JOIN o ON lm.map_id = o.map_id AND lm.partition_id = o.partition_id)"
)


def atlas(spark: SparkSession, sf_dir: str, apart: int = 0) -> TileMap:
    """Maps of the partitions' boxes and sites, boxes ``apart`` from one another, cut into themselves, each site on its cell by row number."""
    s = laid(spark, sf_dir).withColumn("map_id", F.concat(F.lit("m"), F.floor(F.col("site_id") / EACH).cast("string")))
    none = F.lit(None)
    o = s.groupBy("map_id", F.col("partition_id").alias("_p")).agg((F.min("x") - 1).alias("l"), (F.min("y") - 1).alias("b"), (F.max("x") + 1).alias("r"), (F.max("y") + 1).alias("t"))
    o = o.withColumn("outline_id", (F.dense_rank().over(Window.partitionBy("map_id").orderBy("_p")) - 1).cast("int"))
    go = F.col("outline_id") * apart
    ring = F.array(*(G.point(F.col(x) + go, F.col(y)) for x, y in (("l", "b"), ("r", "b"), ("r", "t"), ("l", "t"))))
    shown = [F.concat(F.lit("part "), F.col("_p")).alias("label"), none.cast("struct<x:double,y:double>").alias("label_pt"), C.fixed((1, 2, 3)).alias("color"), ring.alias("ring"), F.lit(-1).alias("custom_weight")]
    w = Window.partitionBy("map_id", "outline_id").orderBy("_s")
    own = s.drop("outline_id").withColumnRenamed("partition_id", "_p").withColumnRenamed("site_id", "_s").join(o.select("map_id", "_p", "outline_id"), ["map_id", "_p"])
    # partitions beside one another have cells of their own
    cell = G.cell(F.col("cell.x") + F.col("outline_id") * 10, F.col("cell.y"))
    put = own.select("map_id", "outline_id", (F.row_number().over(w) - 1).cast("int").alias("site_id"), F.col("_s").cast("string").alias("label"), (F.col("x") + go).alias("x"), "y", C.fixed((0, 0, 0)).alias("color"), F.lit("sites").alias("layer"), F.lit(0).alias("partition_id"), cell.alias("cell"))
    taken = put.select("map_id", "outline_id", "partition_id", "cell.x", "cell.y", F.col("site_id").alias("ord"))
    maps = o.select("map_id").distinct().select("map_id", F.lit(8).alias("stage"), F.lit("SQUARE").alias("grid"))
    return TileMap.of(spark, maps=maps, outlines=o.select("map_id", "outline_id", *shown), sites=put, partitions=o.select("map_id", "outline_id", F.lit(0).alias("partition_id"), *shown), cells=taken)


def _by_map(lines: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of maps dealt by map, a task for about 50,000 sites: lines compress so well that merged tasks would hold far more."""
    return dealt(lines, ["map_id"], _table(spark, sf_dir, "embeddings").count(), 50_000)


def _read_back(spark: SparkSession, sf_dir: str) -> TileMap:
    m = atlas(spark, sf_dir)
    text = _by_map(wkt.lines(m), spark, sf_dir)
    return wkt.parse(text.withColumn("ln", F.row_number().over(Window.partitionBy("map_id").orderBy("key"))).select("map_id", "ln", "line"))


@query(f"WITH {ATLAS} SELECT map_id, outline_id, 'part ' || partition_id AS label, {q6('l')} AS l, {q6('t')} AS t, {q6('(r - l) * (t - b)')} AS area, 1 AS red FROM o")
def wkt_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, b = _read_back(spark, sf_dir).outlines, G.box(F.col("ring"))
    return o.select("map_id", "outline_id", "label", r6(b["left"]).alias("l"), r6(b["top"]).alias("t"), r6(G.area(F.col("ring"))).alias("area"), F.col("color.r").alias("red"))


@query(f"WITH {ATLAS} SELECT map_id, outline_id, site_id, label, {q6('x')} AS x, {q6('y')} AS y, 0 AS partition_id, CAST(cx + outline_id * 10 AS INT) AS cx, cy FROM w")
def wkt_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _read_back(spark, sf_dir).sites
    return s.select("map_id", "outline_id", "site_id", "label", r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"), "partition_id", F.col("cell.x").alias("cx"), F.col("cell.y").alias("cy"))


@query(f"WITH {ATLAS} SELECT map_id, outline_id, 0 AS partition_id, 'part ' || partition_id AS label, {q6('(r - l) * (t - b)')} AS area FROM o")
def wkt_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read_back(spark, sf_dir).partitions
    return p.select("map_id", "outline_id", "partition_id", "label", r6(G.area(F.col("ring"))).alias("area"))


@query(f"WITH {ATLAS} SELECT map_id, outline_id, CAST(cx + outline_id * 10 AS INT) AS x, cy AS y, site_id AS ord FROM w")
def wkt_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read_back(spark, sf_dir).cells.select("map_id", "outline_id", "x", "y", "ord")


@query(f"WITH {ATLAS} SELECT map_id, outline_id, site_id % 3 + 0.5 AS factor, {q6('x')} AS tx, {q6('y')} AS ty, CAST(sum(0.25 * (1 + k)) AS DOUBLE) AS quality, count(*) AS cells, sum(x0) AS xs, CAST(max(0.25 * (1 + k)) AS DOUBLE) AS best FROM (SELECT *, cx + k AS x0 FROM w, range(3) AS g(k) WHERE site_id < 1) GROUP BY ALL")
def wkt_guides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guides of cartograms, their cells and the cells' shares, written and read again; a guide is three cells beside its region's first."""
    m = atlas(spark, sf_dir)
    first = m.sites.where("site_id < 1")
    key = ["map_id", "outline_id", "partition_id"]
    k = first.select(*key, F.explode(F.sequence(F.lit(0), F.lit(2))).alias("ord"), F.col("outline_id").alias("_o"), "cell")
    near = k.select(*key, (F.col("cell.x") - F.col("_o") * 10 + F.col("ord")).cast("int").alias("x"), F.col("cell.y").alias("y"), "ord")
    guides = first.select(*key, (F.col("site_id") % 3 + 0.5).cast("double").alias("factor"), F.col("x").alias("tx"), F.col("y").alias("ty"), F.lit(0.0).alias("quality"))
    shares = near.select(*key, "x", "y", (0.25 * (1 + F.col("ord"))).cast("double").alias("area"))
    text = _by_map(wkt.lines(m.with_(guides=guides, guide_cells=near, cell_quality=shares)), spark, sf_dir)
    back = wkt.parse(text.withColumn("ln", F.row_number().over(Window.partitionBy("map_id").orderBy("key"))).select("map_id", "ln", "line"))
    cells = back.guide_cells.groupBy("map_id", "outline_id").agg(F.count("*").alias("cells"), F.sum("x").alias("xs"))
    best = back.cell_quality.groupBy("map_id", "outline_id").agg(F.max("area").alias("best"))
    return back.guides.join(cells, ["map_id", "outline_id"]).join(best, ["map_id", "outline_id"]).select("map_id", "outline_id", "factor", r6(F.col("tx")).alias("tx"), r6(F.col("ty")).alias("ty"), "quality", "cells", "xs", "best")


@query(f"WITH {ATLAS} SELECT map_id, (cx + outline_id * 10) || chr(9) || cy || chr(9) || label AS value FROM w")
def tsv_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tsv.result_lines(atlas(spark, sf_dir)).select("map_id", "value")


@query(f"WITH {ATLAS} SELECT map_id, part || chr(9) || label || chr(9) || CAST(cx AS VARCHAR) || '.0' || chr(9) || CAST(cy AS VARCHAR) || '.0' || chr(9) || '0' || chr(9) || '0' || chr(9) || '0' AS value FROM w")
def tsv_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = atlas(spark, sf_dir)
    whole = m.sites.withColumn("x", (F.col("cell.x") - F.col("outline_id") * 10).cast("double")).withColumn("y", F.col("cell.y").cast("double"))
    return tsv.site_lines(whole, m.partitions).select("map_id", "value")


_CORNER = "'[' || CAST({x} AS DOUBLE) || ',' || CAST({y} AS DOUBLE) || ']'"
_SIDES = (("+", "-"), ("+", "+"), ("-", "+"), ("-", "-"))
_CORNERS = " || ',' || ".join(_CORNER.format(x=f"(cx + outline_id * 10) {i} 0.5", y=f"cy {j} 0.5") for i, j in (*_SIDES, _SIDES[0]))


@query(f"""WITH {ATLAS}, f AS (SELECT map_id, outline_id, site_id, '{{"type":"Feature","properties":{{"label":"' || label || '"}},"geometry":{{"type":"Polygon","coordinates":[[' || {_CORNERS} || ']]}}}}' AS f FROM w) SELECT map_id, '{{"type":"FeatureCollection","features":[' || string_agg(f, ',' ORDER BY outline_id, site_id) || ']}}' AS value FROM f GROUP BY map_id""")
def geojson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drawings.geojson(atlas(spark, sf_dir), SQUARE).select("map_id", "value")


_POINTS = " || ' ' || ".join(f"CAST(((cx + outline_id * 10 {i} 0.5) - l) * 8 AS DOUBLE) || ',' || CAST((t - (cy {j} 0.5)) * 8 AS DOUBLE)" for i, j in _SIDES)


@query(f"WITH {ATLAS}, v AS (SELECT map_id, min(cx + outline_id * 10) - 0.5 AS l, max(cy) + 0.5 AS t FROM w GROUP BY 1) SELECT w.map_id, label, {_POINTS} AS points, true AS closed FROM w JOIN v ON w.map_id = v.map_id")
def svg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The polygons of every drawing, their labels and corners, taken from its text."""
    d = drawings.svg(atlas(spark, sf_dir), SQUARE).withColumn("closed", F.col("value").endswith("</svg>"))
    shape = F.explode(F.regexp_extract_all("value", F.lit("<polygon [^>]*>"), F.lit(0))).alias("s")
    return d.select("map_id", shape, "closed").select("map_id", F.regexp_extract("s", ' label="([^"]*)"', 1).alias("label"), F.regexp_extract("s", ' points="([^"]*)"', 1).alias("points"), "closed")


@query(f"WITH {ATLAS} SELECT map_id, label, {q6('x')} AS x, {q6('y')} AS y, true AS readable FROM w")
def ipe_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels of every drawing's sites and where they stand, taken from its text."""
    d = ipe.documents(atlas(spark, sf_dir), INPUT).withColumn("readable", F.trim("value").endswith("</ipe>"))
    mark = F.explode(F.regexp_extract_all("value", F.lit('<text layer="sites"[^<]*</text>'), F.lit(0))).alias("s")
    s = d.select("map_id", mark, "readable").withColumn("at", F.split(F.regexp_extract("s", ' pos="([^"]*)"', 1), " "))
    return s.select("map_id", F.regexp_extract("s", ">([^<]*)<", 1).alias("label"), r6(F.col("at")[0].cast("double")).alias("x"), r6(F.col("at")[1].cast("double")).alias("y"), "readable")


def _drawn_back(spark: SparkSession, sf_dir: str, stages: int) -> TileMap:
    return ipe.parse(ipe.documents(atlas(spark, sf_dir, APART), stages), stages)


@query(f"WITH {ATLAS} SELECT map_id, outline_id, 'part ' || partition_id AS label, {q6(f'l + outline_id * {APART}')} AS l, {q6('t')} AS t, {q6('(r - l) * (t - b)')} AS area, 1 AS red, 1 AS stage FROM o")
def ipe_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines of drawings: closed paths, named by the text inside."""
    m = _drawn_back(spark, sf_dir, INPUT)
    b = G.box(F.col("ring"))
    return m.outlines.join(m.maps, "map_id").select("map_id", "outline_id", "label", r6(b["left"]).alias("l"), r6(b["top"]).alias("t"), r6(G.area(F.col("ring"))).alias("area"), F.col("color.r").alias("red"), "stage")


@query(f"WITH {ATLAS} SELECT map_id, outline_id, site_id, label, {q6(f'x + outline_id * {APART}')} AS x, {q6('y')} AS y, 0 AS partition_id, CAST(cx + outline_id * 10 AS INT) AS cx, cy FROM w")
def ipe_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites of drawings, the partitions that hold them and the cells around their labels."""
    s = _drawn_back(spark, sf_dir, 15).sites
    return s.select("map_id", "outline_id", "site_id", "label", r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"), "partition_id", F.col("cell.x").alias("cx"), F.col("cell.y").alias("cy"))


@query(f"WITH {ATLAS} SELECT map_id, outline_id, 0 AS partition_id, 'part ' || partition_id AS label, {q6('(r - l) * (t - b)')} AS area FROM o")
def ipe_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _drawn_back(spark, sf_dir, 3).partitions
    return p.select("map_id", "outline_id", "partition_id", "label", r6(G.area(F.col("ring"))).alias("area"))


@query(f"WITH {ATLAS} SELECT map_id, outline_id, 0 AS partition_id, CAST(cx + outline_id * 10 AS INT) AS x, cy AS y FROM w")
def ipe_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drawn_back(spark, sf_dir, 7).cells.select("map_id", "outline_id", "partition_id", "x", "y")


_METHODS = ("Agnostic", "ClosestAssigned", "AgglomerativeAssigned", "AgglomerativePartitionAssigned")


@query(f"WITH {ATLAS}, n AS (SELECT map_id, outline_id, count(*) AS n, max(cx) - min(cx) AS width, max(cy) - min(cy) AS height FROM w GROUP BY 1, 2), k(method) AS (VALUES {', '.join(f'({m!r})' for m in _METHODS)}) SELECT method, map_id, outline_id, n AS cells, CAST(width AS INT) AS width, CAST(height AS INT) AS height, true AS free FROM n, k")
def combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions that lie over one another are placed side by side by every method: shapes stay, cells don't meet, sites go along."""
    m = atlas(spark, sf_dir)
    back = lambda x: F.col(x) - F.col("outline_id") * 10  # noqa: E731  all over the origin again
    m = m.with_(sites=durable(m.sites.withColumn("cell", G.cell(F.col("cell.x") - F.col("outline_id") * 10, F.col("cell.y")))), cells=durable(m.cells.withColumn("x", back("x").cast("int"))), partitions=durable(m.partitions))
    out, key = None, ["map_id", "outline_id"]
    for method in _METHODS:
        done = combine.combine(m, SQUARE, method)
        c = durable(done.cells)
        shared = c.groupBy("map_id", "x", "y").agg(F.count("*").alias("n"), F.first("outline_id").alias("outline_id"))
        alone = shared.groupBy(*key).agg((F.max("n") == 1).alias("alone"))
        kept = done.sites.select(*key, "cell.x", "cell.y").join(c.select(*key, "x", "y"), [*key, "x", "y"], "left_semi").groupBy(*key).agg(F.count("*").alias("_k"))
        shape = c.groupBy(*key).agg(F.count("*").alias("cells"), (F.max("x") - F.min("x")).alias("width"), (F.max("y") - F.min("y")).alias("height"))
        rows = shape.join(alone, key).join(kept, key).select(F.lit(method).alias("method"), *key, "cells", "width", "height", (F.col("alone") & (F.col("_k") == F.col("cells"))).alias("free"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("SELECT DISTINCT CASE WHEN c_custkey % 3 = 0 THEN c_name || '.tsv' WHEN c_custkey % 3 = 1 THEN c_name || '.TSV' ELSE c_name || '.csv' END AS path, CASE WHEN c_custkey % 3 = 0 THEN c_name || '.tsv' WHEN c_custkey % 3 = 1 THEN c_name || '.TSV' ELSE c_name || '.csv.tsv' END AS once, CASE WHEN c_custkey % 3 = 0 THEN c_name || '.tsv' WHEN c_custkey % 3 = 1 THEN c_name || '.TSV' ELSE c_name || '.csv.tsv' END AS twice FROM customer")
def extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An output's extension is put where it is missing, once, whatever the case."""
    kinds = F.element_at(F.array(*(F.lit(k) for k in (".tsv", ".TSV", ".csv"))), (F.col("c_custkey") % 3 + 1).cast("int"))
    names = _table(spark, sf_dir, "customer").select(F.concat("c_name", kinds).alias("path")).distinct()
    once = pipeline.extended(F.col("path"), "tsv")
    return names.select("path", once.alias("once"), pipeline.extended(once, ".TSV").alias("twice"))
