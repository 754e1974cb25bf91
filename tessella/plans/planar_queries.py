"""Registered queries of planar graphs and cuts: faces, convex parts, Schnyder woods, duals on cells, trees of cuts, over many graphs and rings."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..durable import dealt, durable
from ..functions import geometry as G
from ..functions.grids import grid
from ..operators import dual, partition, planar
from .queries import SITES, _table, q6, query, r6, sites

# every order as a fan: its lines on a parabola, joined to their neighbours and to the first

LINES = "l AS (SELECT l_orderkey AS o, l_linenumber, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY 1, 2), v AS (SELECT o, CAST(row_number() OVER w AS INT) AS v, CAST(sum(q) OVER w AS BIGINT) AS x FROM l WINDOW w AS (PARTITION BY o ORDER BY l_linenumber))"


def _fans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    w = Window.partitionBy("o").orderBy("l_linenumber")
    items = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), "l_linenumber", "l_quantity")
    lines = dealt(items, ["o"], items.count()).groupBy("o", "l_linenumber").agg(F.sum("l_quantity").cast("long").alias("q"))
    v = lines.select("o", F.row_number().over(w).alias("v"), F.sum("q").over(w).cast("double").alias("x")).withColumn("y", F.col("x") * F.col("x"))
    v = durable(v)
    ends = F.array_distinct(F.array(F.col("v") - 1, F.lit(1)))
    return v.select("o", "v", F.explode(ends).alias("u")).where("u >= 1 AND u < v"), v


@query(f"""WITH {LINES}, f AS (SELECT a.o, 1 AS fu, b.v AS fv, 3 AS n_edges, ((b.x - a.x) * (c.x * c.x - a.x * a.x) - (c.x - a.x) * (b.x * b.x - a.x * a.x)) / 2.0 AS area FROM v a JOIN v b ON a.o = b.o AND a.v = 1 AND b.v > 1 JOIN v c ON a.o = c.o AND c.v = b.v + 1),
k AS (SELECT o, max(v) AS k FROM v GROUP BY 1 HAVING max(v) > 1) SELECT o, fu, fv, CAST(n_edges AS BIGINT) AS n_edges, CAST(area AS DOUBLE) AS area, false AS outer_face FROM f UNION ALL SELECT k.o, 1, k, CAST(k AS BIGINT), CAST(-coalesce(sum(area), 0) AS DOUBLE), true FROM k LEFT JOIN f USING (o) GROUP BY k.o, k""")
def planar_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faces of every order's fan: triangles from its first line, and the outer one around all."""
    edges, v = _fans(spark, sf_dir)
    labelled = planar.faces(planar.half_edges(edges, v, ["o"]), ["o"])
    return planar.face_table(labelled, v, ["o"]).select("o", F.col("face.u").alias("fu"), F.col("face.v").alias("fv"), "n_edges", F.col("area") + F.lit(0.0), "outer").toDF("o", "fu", "fv", "n_edges", "area", "outer_face")


@query(f"WITH {LINES}, e AS (SELECT o, max(v) AS n, CASE WHEN max(v) = 1 THEN 0 ELSE 2 * max(v) - 3 END AS m FROM v GROUP BY 1) SELECT o, CAST(n AS BIGINT) AS vertices, CAST(m AS BIGINT) AS edges, CAST(2 - n + m AS BIGINT) AS faces FROM e WHERE n > 1")
def planar_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices, edges and faces of every order's fan, as Euler's formula has them."""
    edges, v = _fans(spark, sf_dir)
    labelled = planar.faces(planar.half_edges(edges, v, ["o"]), ["o"])
    first = F.col("face") == F.struct("u", "v")  # one half-edge of each face
    return dealt(labelled, ["o"], labelled.count()).groupBy("o").agg(F.countDistinct("u").alias("vertices"), F.floor(F.count("*") / 2).alias("edges"), F.count_if(first).alias("faces"))


# every customer as a star: its orders at even angles, as far out as they cost

STARS = "p AS (SELECT o_custkey AS c, row_number() OVER w AS i, count(*) OVER (PARTITION BY o_custkey) AS n, 1 + o_totalprice % 997 / 500.0 AS r FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)), s AS (SELECT c, i, n, r * cos(6 * i / CAST(n AS DOUBLE)) AS x, r * sin(6 * i / CAST(n AS DOUBLE)) AS y FROM p WHERE n >= 3)"


@query(f"WITH {STARS}, t AS (SELECT c, n, x * lead(y, 1, first_y) OVER w - lead(x, 1, first_x) OVER w * y AS twice FROM (SELECT *, first(x) OVER z AS first_x, first(y) OVER z AS first_y FROM s WINDOW z AS (PARTITION BY c ORDER BY i)) WINDOW w AS (PARTITION BY c ORDER BY i)) SELECT c, {q6('sum(twice) / 2')} AS area, true AS convex, true AS inside FROM t GROUP BY c")
def convex_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Convex parts of every customer's star: they make up its area, all of them are convex and their corners are the star's."""
    w, whole = Window.partitionBy("o_custkey").orderBy("o_orderkey"), Window.partitionBy("o_custkey")
    p = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c"), F.row_number().over(w).alias("i"), F.count("*").over(whole).alias("n"), (1 + F.col("o_totalprice") % 997 / 500).alias("r")).where("n >= 3")
    turn = 6 * F.col("i") / F.col("n")
    p = p.select("c", "i", G.point(F.col("r") * F.cos(turn), F.col("r") * F.sin(turn)).alias("p"))
    rings = p.groupBy("c").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "p"))), lambda e: e["p"]).alias("ring"))
    parts = planar.convex_decomposition(rings, ["c"]).join(rings.withColumnRenamed("ring", "whole"), "c")
    turns = F.transform(F.sequence(F.lit(0), F.size("ring") - 1), lambda k: _turn(F.get("ring", k), F.get("ring", (k + 1) % F.size("ring")), F.get("ring", (k + 2) % F.size("ring"))))
    parts = parts.select("c", G.area(F.col("ring")).alias("area"), F.forall(turns, lambda t: t >= -1e-9).alias("convex"), (F.size(F.array_except("ring", "whole")) == 0).alias("inside"))
    return parts.groupBy("c").agg(r6(F.sum("area")).alias("area"), F.bool_and("convex").alias("convex"), F.bool_and("inside").alias("inside"))


def _turn(a, b, c):
    return (b["x"] - a["x"]) * (c["y"] - b["y"]) - (b["y"] - a["y"]) * (c["x"] - b["x"])


@query(f"WITH {LINES}, e AS (SELECT o, max(v) AS k FROM v GROUP BY 1 HAVING max(v) >= 3), n AS (SELECT o, k, CASE WHEN k = 3 THEN 3 ELSE 2 * k + 1 END AS n FROM e) SELECT o, CAST(n AS BIGINT) AS vertices, CAST(3 * n - 6 AS BIGINT) AS edges, CAST(n - 3 AS BIGINT) AS coloured, CAST(0 AS BIGINT) AS crossings, true AS on_grid, CAST(k AS BIGINT) AS own FROM n")
def schnyder_wood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wood of every order's fan made a triangulation: each inner vertex has one parent of each colour, and in its coordinates no two edges cross."""
    edges, v = _fans(spark, sf_dir)
    w = planar.woods(edges, v, ["o"])
    last, at = F.size("a") - 1, F.sequence(F.lit(0), F.size("a") - 1)
    parents = lambda i: F.array(*(F.get(c, i) for c in ("left", "right", "top")))
    coloured = F.size(F.filter(at, lambda i: F.get("left", i).isNotNull() & (F.size(F.array_distinct(parents(i))) == 3)))
    inside = F.forall(at, lambda i: (F.get("a", i) + F.get("b", i) + F.get("c", i) > 0) & (F.least(F.get("a", i), F.get("b", i), F.get("c", i)) >= 0))
    places = F.size(F.array_distinct(F.transform(at, lambda i: F.get("a", i) * F.lit(1 << 32) + F.get("b", i))))
    tree = F.flatten(F.transform(at, lambda i: F.transform(F.filter(parents(i), lambda t: t.isNotNull()), lambda t: F.struct(i.alias("s"), t.alias("t")))))
    rim = F.array(*(F.struct(F.lit(s).alias("s"), t.alias("t")) for s, t in ((0, F.lit(1)), (0, last), (1, last))))
    ends = lambda e: F.struct(e["s"].alias("s"), e["t"].alias("t"), *(F.get(c, e[k]).cast("long").alias(k + c) for k in ("s", "t") for c in ("a", "b")))
    n = w.select("o", F.size("a").cast("long").alias("vertices"), coloured.cast("long").alias("coloured"), (inside & (places == F.size("a"))).alias("on_grid"), F.size(F.filter("v", lambda v: v.isNotNull())).cast("long").alias("own"), F.transform(F.concat(tree, rim), ends).alias("e"))
    # pairs of a graph's edges, made and judged where its wood is: only those that cross go on, and one row of each graph
    # (outer, as the optimizer would else find the edges twice more, to drop graphs that have none)
    pairs = n.select("*", F.posexplode_outer("e").alias("i", "p")).select("*", F.posexplode_outer("e").alias("j", "q"))
    side = lambda p, q, r: F.signum((q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0]))
    s, t, s2, t2 = ((F.col(f"{e}.{k}a"), F.col(f"{e}.{k}b")) for e in ("p", "q") for k in ("s", "t"))
    one, two, three, four = side(s, t, s2), side(s, t, t2), side(s2, t2, s), side(s2, t2, t)
    apart = F.expr("i < j AND p.s <> q.s AND p.s <> q.t AND p.t <> q.s AND p.t <> q.t")
    crossing = apart & (one * two <= 0) & (three * four <= 0) & ((F.abs(one) + F.abs(two) + F.abs(three) + F.abs(four)) > 0)
    kept = pairs.where(F.expr("i = 0 AND j = 0") | crossing).withColumn("edges", F.size("e").cast("long"))
    return kept.groupBy("o", "vertices", "edges", "coloured", "on_grid", "own").agg(F.count_if(F.col("j") > 0).alias("crossings")).select("o", "vertices", "edges", "coloured", "crossings", "on_grid", "own")


# the unit squares that hold a label's sites, a map of each label

SQUARES = SITES + ", c AS (SELECT DISTINCT partition_id AS label, CAST(floor(x + 0.5) AS INT) AS x, CAST(floor(y + 0.5) AS INT) AS y FROM s)"


@query(f"WITH {SQUARES} SELECT a.label, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by FROM c a JOIN c b ON a.label = b.label AND abs(a.x - b.x) + abs(a.y - b.y) = 1 WHERE (a.x, a.y) < (b.x, b.y)")
def dual_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions in contact, corners included, right after every label's dual is put on cells: those that adjoin on the map, no more and no fewer."""
    c = sites(spark, sf_dir).select("partition_id", G.half_up(F.col("x")).alias("x"), G.half_up(F.col("y")).alias("y")).distinct()
    p = c.select(F.col("partition_id").cast("string").alias("map_id"), F.col("x").alias("outline_id"), F.col("y").alias("partition_id"), G.cell_boundary(F.col("x"), F.col("y"), grid("SQUARE")).alias("ring"))
    at = planar.embedding(p, dual.components(p, dual.dual_edges(p)))
    around = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((1, -1), (1, 0), (1, 1), (0, 1)))))
    near = at.select("map_id", "comp_id", F.struct("outline_id", "partition_id").alias("p"), "x", "y", around.alias("d")).select("map_id", "comp_id", "p", (F.col("x") + F.col("d.i")).alias("x"), (F.col("y") + F.col("d.j")).alias("y"))
    met = near.join(at.select("map_id", "comp_id", F.struct("outline_id", "partition_id").alias("q"), "x", "y"), ["map_id", "comp_id", "x", "y"]).where("p <> q")
    pairs = met.select("map_id", F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q")).distinct()
    return pairs.select(F.col("map_id").cast("int").alias("label"), F.col("p.outline_id").alias("ax"), F.col("p.partition_id").alias("ay"), F.col("q.outline_id").alias("bx"), F.col("q.partition_id").alias("by"))


# cuts of every supplier's ring: from its lineitems, halves of halves of a ring of length 4096

DYADIC = "z AS (SELECT DISTINCT l_suppkey AS k, l_linenumber % 5 AS h, l_partkey % 1024 AS p FROM lineitem), c AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY a, b DESC) AS cut, CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b, 1 + 7.0 * (a * 31 + b) % 900 AS long FROM (SELECT DISTINCT k, (p >> h << h) * 4 AS a, ((p >> h << h) + (1 << h)) * 4 AS b FROM z))"


@query(f"""WITH {DYADIC}, n AS (SELECT *, least(b - a, 4096 - b + a) >= 1.5 * long AS kept FROM c), o AS (SELECT n.k, n.cut, n.kept, e.cut AS p, e.kept AS pk, row_number() OVER (PARTITION BY n.k, n.cut ORDER BY e.b - e.a, e.cut DESC) AS r FROM n LEFT JOIN n e ON n.k = e.k AND e.a <= n.a AND n.b <= e.b AND n.cut <> e.cut)
SELECT k, cut, max(p) FILTER (r = 1) AS parent, kept, CASE WHEN kept THEN arg_min(p, r) FILTER (pk) END AS kept_parent FROM o GROUP BY k, cut, kept""")
def cut_nesting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The innermost cut around each cut, before and after short-sided ones are taken out."""
    z = _table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), (F.col("l_linenumber") % 5).cast("int").alias("h"), (F.col("l_partkey") % 1024).cast("long").alias("p"))
    a = F.expr("shiftleft(shiftright(p, h), h)")
    c = partition.distinct_cuts(z.select("k", (a * 4).cast("double").alias("start"), ((a + F.expr("shiftleft(1L, h)")) * 4).cast("double").alias("end")), ["k"])
    w = Window.partitionBy("k").orderBy("start", F.desc("end"))
    c = c.select("k", F.row_number().over(w).cast("long").alias("cut"), "start", "end", (1 + 7.0 * (F.col("start") * 31 + F.col("end")) % 900).alias("length"))
    rings = c.select("k").distinct().withColumn("total", F.lit(4096.0))
    return partition.nested_cuts(c, rings, ["k"], 1.5)
