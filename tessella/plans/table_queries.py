"""Registered queries of steps over many small maps and graphs: trivial partitions, located sites, nearest components, moves, bridges, flows, comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.grids import grid
from ..operators import cells, flow, partition, spatial
from ..sources import tsv
from . import evaluate
from .format_queries import APART, ATLAS, SQUARE, atlas
from .planar_queries import LINES, _fans
from .queries import SITES, _table, q6, query, r6, sites


@query(f"WITH {ATLAS}, n AS (SELECT map_id, outline_id, count(*) AS n FROM w GROUP BY 1, 2) SELECT map_id, outline_id, 0 AS partition_id, 'part ' || partition_id AS label, {q6('(r - l) * (t - b)')} AS area, n AS sites FROM o JOIN n USING (map_id, outline_id)")
def trivial_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every outline as its own partition, which all its sites are in."""
    m = partition.trivial(atlas(spark, sf_dir))
    n = m.sites.groupBy("map_id", "outline_id", "partition_id").agg(F.count("*").alias("sites"))
    return m.partitions.join(n, ["map_id", "outline_id", "partition_id"]).select("map_id", "outline_id", "partition_id", "label", r6(G.area(F.col("ring"))).alias("area"), "sites")


@query(f"WITH {ATLAS} SELECT map_id, outline_id, site_id, label, {q6(f'x + outline_id * {APART}')} AS x, {q6('y')} AS y, CASE WHEN site_id % 2 = 0 THEN 7 ELSE 0 END AS red FROM w")
def tsv_located(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of site tables, with and without a colour, put into the outlines that hold them."""
    m = atlas(spark, sf_dir, APART)
    named = F.concat_ws("\t", "label", F.col("x").cast("string"), F.col("y").cast("string"))
    line = F.when(F.col("site_id") % 2 == 0, F.concat(named, F.lit("\t7\t8\t9"))).otherwise(named)
    lines = m.sites.select("map_id", F.col("label").cast("long").alias("ln"), F.split(line, "\t").alias("f"))
    put, _ = tsv.put_sites(lines, m.outlines)
    return put.select("map_id", "outline_id", "site_id", "label", r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"), F.col("color.r").alias("red"))


_WIDE = f"greatest(0, q.l + q.outline_id * {APART} - p.r - p.outline_id * {APART})"
_HIGH = "greatest(0, greatest(p.b, q.b) - least(p.t, q.t))"


@query(f"WITH {ATLAS} SELECT p.map_id, p.outline_id AS a, q.outline_id AS b, {q6(f'sqrt({_WIDE} * {_WIDE} + {_HIGH} * {_HIGH})')} AS distance FROM o p JOIN o q ON p.map_id = q.map_id AND p.outline_id < q.outline_id")
def nearest_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distance of every two components of a map, from the partitions nearest to each other."""
    p = atlas(spark, sf_dir, APART).partitions.withColumn("c", F.col("outline_id"))
    return spatial.nearest_partitions(p, "c", ["map_id"]).select("map_id", "a", "b", r6(F.col("distance")).alias("distance"))


# a rotated and stretched grid

_ROTATED = "SQUARE!r!30!s!2!3"


@query(f"WITH {SITES}, u AS (SELECT site_id, x / 2 AS x, y / 3 AS y FROM s) SELECT site_id, CAST(floor(x * cos(pi() / 6) + y * sin(pi() / 6) + 0.5) AS INT) AS cx, CAST(floor(y * cos(pi() / 6) - x * sin(pi() / 6) + 0.5) AS INT) AS cy FROM u")
def cell_affine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of a square grid that was turned by 30 degrees, then stretched."""
    c = G.containing_cell(F.col("x"), F.col("y"), grid(_ROTATED))
    return sites(spark, sf_dir).select("site_id", c["x"].alias("cx"), c["y"].alias("cy"))


@query(f"WITH {SITES}, n AS (SELECT partition_id, count(*) AS n FROM s GROUP BY 1), k(g, area) AS (VALUES ('SQUARE', 1.0), ('HEXAGON', 1.5 * sqrt(3.0)), ('{_ROTATED}', 6.0)) SELECT partition_id, g AS tiling, {q6('n * area')} AS area FROM n, k")
def cells_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The area that as many cells as a partition has sites take on average, by tiling."""
    areas = F.explode(F.array(*(F.struct(F.lit(n).alias("tiling"), F.lit(grid(n).average_area).alias("a")) for n in ("SQUARE", "HEXAGON", _ROTATED)))).alias("k")
    n = sites(spark, sf_dir).groupBy("partition_id").agg(F.count("*").alias("n"))
    return n.select("partition_id", "n", areas).select("partition_id", "k.tiling", r6(F.col("n") * F.col("k.a")).alias("area"))


@query(f"WITH {SITES}, c AS (SELECT DISTINCT CAST(floor(x + 0.5) AS INT) AS x, CAST(floor(y + 0.5) AS INT) AS y FROM s), k(g, i, j) AS (SELECT 'SQUARE', a.i, b.i FROM range(-1, 2) AS a(i), range(-1, 2) AS b(i) WHERE a.i <> 0 OR b.i <> 0) SELECT g AS tiling, CAST(x + i AS INT) AS x, CAST(y + j AS INT) AS y, count(*) AS n FROM c, k GROUP BY ALL")
def unit_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the lattice steps of the square grid lead from the cells that hold sites, and from how many."""
    c = sites(spark, sf_dir).select(G.half_up(F.col("x")).alias("x"), G.half_up(F.col("y")).alias("y")).distinct()
    steps = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in SQUARE.unit_vectors))).alias("d")
    return c.select(F.lit("SQUARE").alias("tiling"), "x", "y", steps).groupBy("tiling", (F.col("x") + F.col("d.i")).alias("x"), (F.col("y") + F.col("d.j")).alias("y")).agg(F.count("*").alias("n"))


@query(f"WITH {SITES} SELECT site_id, {q6('(x - partition_id) / (0.5 + partition_id)')} AS px, {q6('(y + 2) / (0.5 + partition_id)')} AS py FROM s")
def guide_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in guides back on the map: each partition has a factor and a translation of its own."""
    k = F.col("partition_id")
    p = G.guide_point(F.col("x"), F.col("y"), 0.5 + k, k, F.lit(-2.0))
    return sites(spark, sf_dir).select("site_id", r6(p["x"]).alias("px"), r6(p["y"]).alias("py"))


# moves: regions are the cells of a label's even sites, guides those of its sites divisible by three

MOVES = SITES + ", c AS (SELECT DISTINCT partition_id, CAST(floor(x + 0.5) AS INT) AS x, CAST(floor(y + 0.5) AS INT) AS y FROM s WHERE site_id % 2 = 0), g AS (SELECT DISTINCT partition_id, CAST(floor(x + 0.5) AS INT) AS x, CAST(floor(y + 0.5) AS INT) AS y FROM s WHERE site_id % 3 = 0)"


def _moves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    at = [F.col("partition_id"), G.half_up(F.col("x")).alias("x"), G.half_up(F.col("y")).alias("y")]
    s = sites(spark, sf_dir)
    return s.where("site_id % 2 = 0").select(*at).distinct(), s.where("site_id % 3 = 0").select(*at).distinct()


@query(f"WITH {MOVES} SELECT DISTINCT g.partition_id, g.x, g.y FROM g JOIN c ON c.partition_id = g.partition_id AND abs(c.x - g.x) + abs(c.y - g.y) = 1 WHERE NOT EXISTS (SELECT 1 FROM c d WHERE d.partition_id = g.partition_id AND d.x = g.x AND d.y = g.y)")
def cells_to_take(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, guide = _moves(spark, sf_dir)
    return cells.take_candidates(own, guide, SQUARE, ["partition_id"]).select("partition_id", "x", "y")


@query(f"WITH {MOVES} SELECT partition_id, x, y FROM c EXCEPT SELECT partition_id, x, y FROM g")
def cells_to_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, guide = _moves(spark, sf_dir)
    return cells.release_candidates(own, guide, ["partition_id"])


@query(f"WITH {SITES}, c AS (SELECT x, y, min(partition_id) AS o FROM (SELECT partition_id, CAST(floor(x + 0.5) AS INT) AS x, CAST(floor(y + 0.5) AS INT) AS y FROM s) GROUP BY 1, 2), e AS (SELECT DISTINCT a.o, a.x, a.y, b.o AS other FROM c a JOIN c b ON abs(a.x - b.x) + abs(a.y - b.y) = 1 AND a.o <> b.o), k AS (SELECT o, other, count(*) AS n FROM e GROUP BY 1, 2) SELECT c.o AS region, c.x, c.y, count(k.n) AS lost FROM c LEFT JOIN e ON e.o = c.o AND e.x = c.x AND e.y = c.y LEFT JOIN k ON k.o = e.o AND k.other = e.other AND k.n = 1 GROUP BY 1, 2, 3")
def contacts_lost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many contacts of its region each cell alone keeps up; a square belongs to its smallest label."""
    c = sites(spark, sf_dir).groupBy(G.half_up(F.col("x")).alias("x"), G.half_up(F.col("y")).alias("y")).agg(F.min("partition_id").alias("region")).withColumn("map_id", F.lit("m"))
    return cells.lost_contacts(c, SQUARE, ["map_id"], "region").select("region", "x", "y", "lost")


# graphs of orders


@query(f"WITH {LINES}, k AS (SELECT o, max(v) AS k FROM v GROUP BY 1 HAVING max(v) > 1), e AS (SELECT o, k, unnest(CASE WHEN k <= 3 THEN range(1, k) ELSE [k - 1] END) AS a FROM k) SELECT o, CAST(count(*) AS BIGINT) AS bridges, CAST(count(*) AS BIGINT) AS beyond FROM e GROUP BY o")
def order_bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bridges of orders whose lines but the last stand in a circle, the last beside the one before it, and the vertices beyond them."""
    _, v = _fans(spark, sf_dir)
    k = v.groupBy("o").agg(F.max("v").cast("long").alias("k")).where("k > 1")
    path = k.select("o", F.explode(F.sequence(F.lit(1).cast("long"), F.col("k") - 1)).alias("u")).withColumn("v", F.col("u") + 1)
    closed = k.where("k > 3").select("o", F.lit(1).cast("long").alias("u"), (F.col("k") - 1).alias("v"))
    return flow.bridge_table(path.unionByName(closed), ["o"]).groupBy("o").agg(F.count("*").alias("bridges"), F.sum("side").alias("beyond"))


PAIRS = "l AS (SELECT l_orderkey AS o, l_linenumber AS n, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY 1, 2), r AS (SELECT o, n % 2 AS side, q, row_number() OVER (PARTITION BY o, n % 2 ORDER BY q, n) AS k, count(*) OVER (PARTITION BY o, n % 2) AS m FROM l), b AS (SELECT o FROM r GROUP BY o HAVING count(*) FILTER (side = 0) = count(*) FILTER (side = 1))"


@query(f"WITH {PAIRS} SELECT a.o, CAST(count(*) AS BIGINT) AS moved, CAST(sum(abs(a.q - c.q)) AS DOUBLE) AS cost FROM r a JOIN r c ON a.o = c.o AND a.side = 0 AND c.side = 1 AND a.k = c.k SEMI JOIN b ON a.o = b.o GROUP BY a.o")
def order_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest flow from an order's even lines to its odd ones, as many, at the difference of their quantities: that of both in order."""
    l = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o"), F.col("l_linenumber").cast("long").alias("n")).agg(F.sum("l_quantity").alias("q"))
    even = F.sum(F.when(F.col("n") % 2 == 0, 1).otherwise(-1))
    l = l.join(l.groupBy("o").agg(even.alias("d")).where("d = 0").select("o"), "o", "left_semi")
    a = l.where("n % 2 = 0").select("o", F.col("n").alias("a"), F.col("q").alias("p"))
    b = l.where("n % 2 = 1").select("o", F.col("n").alias("b"), "q")
    arcs = a.join(b, "o").select("o", "a", "b", F.lit(1).cast("long").alias("capacity"), F.abs(F.col("p") - F.col("q")).alias("cost"))
    supplies = l.select("o", F.col("n").alias("v"), F.when(F.col("n") % 2 == 0, 1).otherwise(-1).cast("long").alias("supply"))
    got = flow.cheapest_flow(arcs, supplies, ["o"]).join(arcs, ["o", "a", "b"])
    return got.groupBy("o").agg(F.sum("flow").alias("moved"), F.sum(F.col("flow") * F.col("cost")).alias("cost"))


# comparisons

_SHAPES = "h AS (SELECT l_suppkey AS map_id, l_linenumber % 3 AS cut_type, l_discount AS fatness, l_tax AS dilation, l_quantity AS length FROM lineitem), s AS (SELECT map_id, cut_type, avg(fatness) AS fatness, sum(dilation) / (2 * count(*)) AS dilation, sum(length) / (2 * count(*)) AS length, count(*) - 1 AS cuts FROM h GROUP BY 1, 2)"


@query(f"WITH {_SHAPES} SELECT map_id, cut_type, {q6('fatness')} AS fatness, {q6('dilation')} AS dilation, {q6('length')} AS length, cuts FROM s")
def cut_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of the shapes that each kind of cut leaves, by map."""
    h = _table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("map_id"), (F.col("l_linenumber") % 3).alias("cut_type"), F.col("l_discount").alias("fatness"), F.col("l_tax").alias("dilation"), F.col("l_quantity").alias("length"))
    s = evaluate.compare_cut_types(h)
    return s.select("map_id", "cut_type", *(r6(F.col(c)).alias(c) for c in ("fatness", "dilation", "length")), "cuts")


@query("WITH h AS (SELECT l_suppkey AS map_id, l_linenumber % 3 AS cut_type, sum(l_quantity) / count(*) AS v FROM lineitem GROUP BY 1, 2), m AS (SELECT *, min(v) OVER (PARTITION BY map_id) AS least FROM h) SELECT cut_type, CAST(sum(CASE WHEN v = least THEN 1 ELSE 0 END) AS BIGINT) AS wins FROM m GROUP BY 1")
def cut_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On how many maps each kind of cut has the shortest ones."""
    h = _table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("map_id"), (F.col("l_linenumber") % 3).alias("cut_type"), F.lit(0.0).alias("fatness"), F.lit(0.0).alias("dilation"), F.col("l_quantity").alias("length"))
    return evaluate.compare_cut_types(h).groupBy("cut_type").agg(F.sum("best_length").alias("wins"))


@query("SELECT o_custkey AS map_id, CAST(sum(o_orderkey % 7) AS BIGINT) AS found, CAST(sum(o_orderkey % 5) AS BIGINT) AS remaining, CAST(sum(o_orderkey % 3) AS BIGINT) AS applied FROM orders GROUP BY 1")
def cut_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Found, remaining and applied cuts of each map from those of its outlines."""
    o = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("map_id"), *((F.col("o_orderkey") % k).alias(n) for k, n in ((7, "found"), (5, "remaining"), (3, "applied"))))
    return evaluate.cut_counts(o)
