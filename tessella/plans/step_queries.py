"""More registered queries: single steps of the tile maps, text formats and whole maps, each with SQL for the same rows.

Sites are those of ``queries``. Where a step is free in its choices (cuts, regions,
assignment), the query returns what must hold of any right result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..durable import durable
from ..functions import colors as C
from ..functions import geometry as G
from ..functions.grids import grid
from ..functions.shapes import label_point, remove_degeneracies
from ..operators import align, analyze, assign, cells, dual, guide, partition, regions
from ..schema import ASSIGNED, INPUT, PARTITIONED, TileMap
from . import evaluate, pipeline
from .queries import CELLS, GUIDED, HALVES, HEX, KEY, LAID, NEXT, ROOKS, SITES, STATS, TILES, UNI, _displaced, _guided, _halves, _measure, _norm, _rings, _square_cells, _table, laid, placed, q6, query, r6, sites

S3 = repr(math.sqrt(3))
SQUARE = grid("SQUARE")

# norms and offsets

query(f"WITH {SITES}, {HEX}, {NEXT} SELECT site_id, CAST(CASE WHEN dx * dy >= 0 THEN greatest(abs(dx), abs(dy)) ELSE abs(dx) + abs(dy) END AS INT) AS steps FROM n WHERE dx IS NOT NULL")(_norm("HEXAGON"))
query(f"""WITH {SITES}, a AS (SELECT *, floor(x + 0.5) AS q, floor(y + 0.5) AS r FROM s), c AS (SELECT *, CAST(2 * q + CASE WHEN x - q >= y - r THEN 0 ELSE 1 END AS INT) AS cx, CAST(r AS INT) AS cy FROM a),
m AS (SELECT site_id, cx, lead(cx) OVER w AS nx, lead(cy) OVER w - cy AS dy FROM c WINDOW w AS (PARTITION BY partition_id ORDER BY site_id)), k AS (SELECT *, CASE WHEN nx >= cx THEN floor((nx - cx) / 2) ELSE -floor((cx - nx) / 2) END AS p FROM m WHERE nx IS NOT NULL)
SELECT site_id, CAST(2 * CASE WHEN p * dy >= 0 THEN greatest(abs(p), abs(dy)) ELSE abs(p) + abs(dy) END + CASE WHEN abs(cx % 2) <> abs(nx % 2) THEN 1 ELSE 0 END AS INT) AS steps FROM k""")(_norm("TRIANGLE"))


@query(f"WITH {CELLS}, u AS (SELECT DISTINCT x, y FROM c) SELECT x, y, CAST(((x % 9) + 9) % 9 AS INT) AS variant, CAST(floor(x / 9.0) * 9 AS INT) AS root, CAST(floor(x * 0.5 + 0.5) AS INT) AS hx, CAST(floor(y * 0.5 + 0.5) AS INT) AS hy, x + 9 AS px, y - 2 AS py, -x AS ix, -y AS iy, ((x % 9) + 9) % 9 = 0 AS whole, CAST(floor(x / 9.0) * 9 + 4 AS INT) AS shifted FROM u")
def cell_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums, inverses, multiples, variants and patterns of cells of a nine-tile grid."""
    g = grid("NS3")
    c = _square_cells(spark, sf_dir).select("x", "y").distinct().withColumn("c", G.cell(F.col("x"), F.col("y")))
    half, moved, inv = G.times(F.col("c"), 0.5), G.plus(F.col("c"), G.cell(F.lit(9), F.lit(-2))), G.inverse(F.col("c"))
    root, there = G.local_root(F.col("c"), g), G.minus(moved, G.cell(F.lit(0), F.lit(0)))
    return c.select("x", "y", G.variant(F.col("x"), g).alias("variant"), root["x"].alias("root"), half["x"].alias("hx"), half["y"].alias("hy"), there["x"].alias("px"), there["y"].alias("py"), inv["x"].alias("ix"), inv["y"].alias("iy"), G.is_lattice_offset(F.col("c"), g).alias("whole"), G.shift_variant(F.col("c"), 4, g)["x"].alias("shifted"))


@query(f"WITH {SITES} SELECT site_id, CAST(floor((x * 1.5 + y * ({S3} / 2)) / ({S3} * 1.5) + 0.5) AS INT) AS sx, CAST(floor(y * {S3} / ({S3} * 1.5) + 0.5) AS INT) AS sy FROM s")
def lattice_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lattice translation of hexagons nearest to each site as a vector."""
    c = G.lattice_steps(F.col("x"), F.col("y"), grid("HEXAGON"))
    return sites(spark, sf_dir).select("site_id", c["x"].alias("sx"), c["y"].alias("sy"))


@query(f"WITH {CELLS}, u AS (SELECT DISTINCT x, y FROM c), k(i, j) AS (VALUES (0, 0), (0, 1), (1, 1), (1, 2)) SELECT x, y, 2 * x + i AS fx, 2 * y + j AS fy FROM u, k")
def refined_hexagons(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _square_cells(spark, sf_dir).select("x", "y").distinct()
    return c.select("x", "y", F.explode(G.refine(F.col("x"), F.col("y"), grid("HEXAGON"))).alias("f")).select("x", "y", F.col("f.x").alias("fx"), F.col("f.y").alias("fy"))


@query(f"WITH {TILES} SELECT x, y, 1.0::DOUBLE AS area, x - 0.5 AS \"left\", y + 0.5 AS top FROM c")
def cell_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area and box of the tile of each cell."""
    c = _square_cells(spark, sf_dir).select("x", "y").distinct()
    b = G.box(G.cell_boundary(F.col("x"), F.col("y"), SQUARE))
    return c.select("x", "y", G.cell_area(F.col("x"), SQUARE).cast("double").alias("area"), b["left"].alias("left"), b["top"].alias("top"))


# points and rings

FOLLOWING = SITES + ", p AS (SELECT site_id, x AS ax, y AS ay, lead(x) OVER w AS bx, lead(y) OVER w AS b_y, lead(x, 2) OVER w AS cx, lead(y, 2) OVER w AS cy, lead(x, 3) OVER w AS dx, lead(y, 3) OVER w AS dy FROM s WINDOW w AS (PARTITION BY partition_id ORDER BY site_id)), f AS (SELECT * FROM p WHERE dx IS NOT NULL)"


def _following(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each site with the three that follow it in its partition, as points a to d."""
    w = Window.partitionBy("partition_id").orderBy("site_id")
    p = G.point(F.col("x"), F.col("y"))
    s = sites(spark, sf_dir)
    return s.select("site_id", p.alias("a"), *(F.lead(p, k).over(w).alias(n) for k, n in ((1, "b"), (2, "c"), (3, "d")))).where("d is not null")


def _turn(a: str, b: str, c: str) -> str:
    x, y = (lambda n: f"{n}x"), (lambda n: "b_y" if n == "b" else f"{n}y")
    return f"(({x(b)} - {x(a)}) * ({y(c)} - {y(a)}) - ({y(b)} - {y(a)}) * ({x(c)} - {x(a)}))"


def _side(e: str) -> str:
    return f"CASE WHEN {e} > 1e-6 THEN 1 WHEN {e} < -1e-6 THEN -1 ELSE 0 END"


@query(f"WITH {FOLLOWING} SELECT site_id, {_side(_turn('a', 'b', 'c'))} AS side, ({_side(_turn('a', 'b', 'c'))}) * ({_side(_turn('a', 'b', 'd'))}) < 0 AND ({_side(_turn('c', 'd', 'a'))}) * ({_side(_turn('c', 'd', 'b'))}) < 0 AS crosses FROM f")
def segments_crossing(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, c, d = (F.col(n) for n in "abcd")
    return _following(spark, sf_dir).select("site_id", G.orientation(a, b, c).alias("side"), G.segments_cross(a, b, c, d).alias("crosses"))


@query(f"WITH {FOLLOWING}, v AS (SELECT site_id, bx - ax AS x, b_y - ay AS y, atan2(b_y - ay, bx - ax) AS u, atan2(dy - cy, dx - cx) AS w FROM f), m AS (SELECT *, (u - w) - floor((u - w) / (2 * pi())) * 2 * pi() AS t FROM v) SELECT site_id, CASE WHEN x > 0 AND y >= 0 THEN 1 WHEN x <= 0 AND y > 0 THEN 2 WHEN x < 0 AND y <= 0 THEN 3 WHEN x >= 0 AND y < 0 THEN 4 ELSE 0 END AS quadrant, {q6('least(t, 2 * pi() - t)')} AS angle FROM m")
def directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quadrant of the step to the next site, and the angle between that step and the one after the next."""
    x, y = F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y")
    t = G.angle_difference(F.atan2(y, x), F.atan2(F.col("d.y") - F.col("c.y"), F.col("d.x") - F.col("c.x")))
    return _following(spark, sf_dir).select("site_id", G.quadrant(x, y).alias("quadrant"), r6(t).alias("angle"))


TRIANGLE = FOLLOWING + f", t AS (SELECT *, {_turn('a', 'b', 'c')} / 2 AS area, sqrt((bx - ax) ** 2 + (b_y - ay) ** 2) + sqrt((cx - bx) ** 2 + (cy - b_y) ** 2) + sqrt((ax - cx) ** 2 + (ay - cy) ** 2) AS perimeter FROM f)"


def _triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _following(spark, sf_dir).withColumn("ring", F.array("a", "b", "c"))


@query(f"WITH {TRIANGLE} SELECT site_id, {q6('area')} AS signed, {q6('abs(area)')} AS area, {q6('perimeter')} AS perimeter, {q6('2 * sqrt(pi() * abs(area)) / perimeter')} AS fatness, {q6('(ax + bx + cx) / 3')} AS mx, {q6('(ay + b_y + cy) / 3')} AS my, area < 0 AS turned, {q6('least(ax, bx, cx)')} AS \"left\", {q6('greatest(ay, b_y, cy)')} AS top FROM t")
def ring_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area, length, fatness, centroid, direction and box of triangles of sites."""
    r = F.col("ring")
    c, b = G.ring_centroid(r), G.box(r)
    turned = G.counter_clockwise(r) != r
    return _triangles(spark, sf_dir).select("site_id", r6(G.signed_area(r)).alias("signed"), r6(G.area(r)).alias("area"), r6(G.perimeter(r)).alias("perimeter"), r6(G.fatness(r)).alias("fatness"), r6(c["x"]).alias("mx"), r6(c["y"]).alias("my"), turned.alias("turned"), r6(b["left"]).alias("left"), r6(b["top"]).alias("top"))


@query(f"WITH {TRIANGLE} SELECT site_id, 3 AS corners, true AS inside FROM t WHERE abs(area) > 0.01")
def labels_and_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triangles with the middle of every edge put in: those go again, and the label stands inside."""
    mid = F.transform(G.edges(F.col("ring")), lambda e: F.array(e["a"], G.point((e["a"]["x"] + e["b"]["x"]) / 2, (e["a"]["y"] + e["b"]["y"]) / 2)))
    t = _triangles(spark, sf_dir).where(G.area(F.col("ring")) > 0.01).withColumn("p", label_point(F.col("ring")))
    return t.select("site_id", F.size(remove_degeneracies(F.flatten(mid))).alias("corners"), G.contains(F.col("ring"), F.col("p.x"), F.col("p.y")).alias("inside"))


@query(f"WITH {FOLLOWING}, k AS (SELECT *, greatest(0, least(1, ((dx - ax) * (bx - ax) + (dy - ay) * (b_y - ay)) / ((bx - ax) ** 2 + (b_y - ay) ** 2))) AS t FROM f) SELECT site_id, {q6('sqrt((ax + t * (bx - ax) - dx) ** 2 + (ay + t * (b_y - ay) - dy) ** 2)')} AS distance FROM k")
def segment_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _following(spark, sf_dir).select("site_id", r6(G.segment_distance(F.col("d.x"), F.col("d.y"), F.col("a"), F.col("b"))).alias("distance"))


@query(f"WITH {SITES}, b AS (SELECT min(x) AS l, max(x) AS r, min(y) AS o, max(y) AS t FROM s), c AS (SELECT site_id, (x - l) / (r - l) - 0.5 AS x, (y - o) / (t - o) - 0.5 AS y FROM s, b), a AS (SELECT site_id, degrees(atan2(y, x)) AS d, sqrt(x * x + y * y) / sqrt(0.5) AS far FROM c), h AS (SELECT site_id, (d - floor(d / 360) * 360) / 360 * 6 AS six, 1 - far * 0.8 AS b FROM a), f AS (SELECT site_id, floor(six) % 6 AS k, six - floor(six) AS f, b FROM h), q AS (SELECT *, b * 0.3 AS p, b * (1 - f * 0.7) AS q, b * (1 - (1 - f) * 0.7) AS t FROM f) SELECT site_id, CAST(floor((CASE k WHEN 0 THEN b WHEN 1 THEN q WHEN 2 THEN p WHEN 3 THEN p WHEN 4 THEN t ELSE b END) * 255 + 0.5) AS INT) AS r, CAST(floor((CASE k WHEN 0 THEN t WHEN 1 THEN b WHEN 2 THEN b WHEN 3 THEN q ELSE p END) * 255 + 0.5) AS INT) AS g, CAST(floor((CASE k WHEN 0 THEN p WHEN 1 THEN p WHEN 2 THEN t WHEN 3 THEN b WHEN 4 THEN b ELSE q END) * 255 + 0.5) AS INT) AS b FROM q")
def color_radial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.color_sites(sites(spark, sf_dir), "radial").select("site_id", "color.r", "color.g", "color.b")


@query(f"WITH {SITES}, n AS (SELECT site_id, (row_number() OVER (PARTITION BY partition_id ORDER BY site_id) - 1) % {len(C.PALETTE)} AS k FROM s), c(k, r, g, b) AS (VALUES {', '.join(str((k, *c)) for k, c in enumerate(C.PALETTE))}) SELECT site_id, r, g, b FROM n JOIN c USING (k)")
def color_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.number_colors(sites(spark, sf_dir), ["partition_id"], ["site_id"]).select("site_id", "color.r", "color.g", "color.b")


def _mix(a: int, b: int, f: str) -> str:
    return f"floor({a} + {b - a} * ({f}) + 0.5)"


def _between(k: int) -> str:
    first, second = _mix(C.LIGHT[k], C.DARK[k], "(v - 1000) / 500"), _mix(C.DARK[k], 0, "(v - 1500) / 300")
    return f"CAST(CASE WHEN v < 1000 THEN {C.LIGHT[k]} WHEN v > 1800 THEN 0 WHEN v <= 1500 THEN {first} ELSE {second} END AS INT)"


@query(f"WITH p AS (SELECT p_partkey, p_retailprice AS v FROM part) SELECT p_partkey, {_between(0)} AS r, {_between(1)} AS g, {_between(2)} AS b FROM p")
def color_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "part")
    return p.select("p_partkey", C.comparison_color(F.col("p_retailprice"), 1000, 1500, 1800).alias("c")).select("p_partkey", "c.r", "c.g", "c.b")


# sets of cells


@query(f"WITH {CELLS}, d(dx, dy) AS (VALUES (1, 1), (1, -1), (-1, 1), (-1, -1)) SELECT DISTINCT partition_id, x + dx AS x, y + dy AS y FROM c, d WHERE NOT EXISTS (SELECT 1 FROM c o WHERE o.partition_id = c.partition_id AND abs(o.x - c.x - dx) + abs(o.y - c.y - dy) <= 1)")
def nbrs_bishop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.neighbours(_square_cells(spark, sf_dir), SQUARE, KEY, "bishop")


_AROUND = [(1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1)]
_BITS = ", ".join(f"max(CASE WHEN o.x - c.x = {i} AND o.y - c.y = {j} THEN 1 ELSE 0 END) AS b{k}" for k, (i, j) in enumerate(_AROUND))
_RUNS = " + ".join(f"b{k} * (1 - b{(k - 1) % 8} * b{(k - 2) % 8})" for k in (0, 2, 4, 6))


@query(f"WITH {CELLS}, n AS (SELECT c.partition_id, c.x, c.y, {_BITS} FROM c LEFT JOIN c o ON o.partition_id = c.partition_id AND greatest(abs(o.x - c.x), abs(o.y - c.y)) = 1 GROUP BY 1, 2, 3), r AS (SELECT *, CASE WHEN {' + '.join(f'b{k}' for k in range(8))} = 8 THEN 1 ELSE {_RUNS} END AS runs FROM n) SELECT partition_id, x, y, CAST(runs AS INT) AS runs, runs = 1 AS safe FROM r")
def contiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a set's cells around each of them, and whether it can leave."""
    c = _square_cells(spark, sf_dir)
    return cells.contiguous(c, c, SQUARE, KEY)


@query(f"WITH {CELLS}, {ROOKS}, o AS (SELECT x + dx AS x, y + dy AS y, partition_id FROM c, d) SELECT x, y FROM o WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.x = o.x AND c.y = o.y) GROUP BY x, y HAVING count(*) = 3 AND count(DISTINCT partition_id) >= 2")
def alleys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.alleys(_square_cells(spark, sf_dir).withColumn("m", F.lit(0)), SQUARE, ["m"], "partition_id").select("x", "y")


@query(f"WITH {HALVES}, p AS (SELECT DISTINCT partition_id, x, y FROM h WHERE k = 1), i AS (SELECT DISTINCT partition_id, x, y, 1 AS hit FROM h WHERE k = 0) SELECT partition_id, count(*) AS asked, count(hit) AS found, count(hit) > 0 AS some, count(hit) = count(*) AS all_, count(hit) = 0 AS none_ FROM p LEFT JOIN i USING (partition_id, x, y) GROUP BY 1")
def set_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _halves(spark, sf_dir)
    return cells.membership(a, b, KEY)


@query(f"WITH {CELLS}, t AS (SELECT partition_id, max(y) AS y FROM c GROUP BY 1) SELECT c.partition_id, y, min(c.x) AS \"left\", max(c.x) AS \"right\" FROM c JOIN t USING (partition_id, y) GROUP BY 1, 2")
def set_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = cells.extremes(_square_cells(spark, sf_dir), KEY)
    return e.select("partition_id", F.col("top_left.y").alias("y"), F.col("top_left.x").alias("left"), F.col("top_right.x").alias("right"))


@query(f"WITH {CELLS} SELECT partition_id, x + 3 AS x, y - 2 AS y FROM c")
def set_translate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.translate(_square_cells(spark, sf_dir), 3, -2, SQUARE)


EXPOSED = f"{CELLS}, {ROOKS}, e AS (SELECT partition_id, count(*) AS n FROM c, d WHERE NOT EXISTS (SELECT 1 FROM c o WHERE o.partition_id = c.partition_id AND o.x = c.x + dx AND o.y = c.y + dy) GROUP BY 1)"


@query(f"WITH {EXPOSED} SELECT partition_id, n AS edges FROM e")
def outline_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.outline_edges(_square_cells(spark, sf_dir), SQUARE, KEY).groupBy("partition_id").agg(F.count("*").alias("edges"))


@query(f"WITH {EXPOSED}, k AS (SELECT partition_id, count(*) AS cells FROM c GROUP BY 1) SELECT partition_id, CAST(cells AS DOUBLE) AS area, CAST(n AS DOUBLE) AS length FROM k JOIN e USING (partition_id)")
def boundary_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rings of each set enclose its cells (holes counting against) and are as long as its open edges."""
    rings = regions.boundary_rings(_square_cells(spark, sf_dir), SQUARE, KEY)
    return rings.groupBy("partition_id").agg(r6(F.sum(G.signed_area(F.col("ring")))).alias("area"), r6(F.sum(G.perimeter(F.col("ring")))).alias("length"))


WALK = f"{CELLS}, walk AS (SELECT partition_id, x, y, x AS rx, y AS ry FROM c UNION SELECT w.partition_id, c.x, c.y, w.rx, w.ry FROM walk w JOIN c ON c.partition_id = w.partition_id AND abs(c.x - w.x) + abs(c.y - w.y) = 1), root AS (SELECT partition_id, x, y, min((rx, ry)) AS r FROM walk GROUP BY 1, 2, 3)"


@query(f"WITH RECURSIVE {WALK} SELECT partition_id, x, y, CAST(dense_rank() OVER (PARTITION BY partition_id ORDER BY r) - 1 AS INT) AS part FROM root")
def set_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.parts(_square_cells(spark, sf_dir), SQUARE, KEY)


@query(f"WITH RECURSIVE {WALK} SELECT partition_id, CAST(count(DISTINCT r) AS INT) AS parts, count(DISTINCT r) = 1 AS connected FROM root GROUP BY 1")
def set_connected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.connected(_square_cells(spark, sf_dir), SQUARE, KEY)


FLOOD = f"""{CELLS}, box AS (SELECT partition_id, min(x) - 1 AS l, max(x) + 1 AS r, min(y) - 1 AS o, max(y) + 1 AS t FROM c GROUP BY 1),
col AS (SELECT partition_id, l, o, t, unnest(generate_series(l, r)) AS x FROM box), spot AS (SELECT partition_id, l, o, x, unnest(generate_series(o, t)) AS y FROM col),
free AS (SELECT * FROM spot ANTI JOIN c k ON k.partition_id = spot.partition_id AND k.x = spot.x AND k.y = spot.y),
sea AS (SELECT partition_id, x, y FROM free WHERE x = l AND y = o UNION SELECT f.partition_id, f.x, f.y FROM sea s JOIN free f ON f.partition_id = s.partition_id AND abs(f.x - s.x) + abs(f.y - s.y) = 1),
hole AS (SELECT DISTINCT partition_id, x, y FROM free EXCEPT SELECT partition_id, x, y FROM sea)"""
# a grid's cells that meet at corners let the sea through only along edges


@query(f"WITH RECURSIVE {FLOOD} SELECT partition_id, CAST(x AS INT) AS x, CAST(y AS INT) AS y FROM hole")
def set_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.holes(_square_cells(spark, sf_dir), SQUARE, KEY).drop("hole")


@query(f"WITH RECURSIVE {FLOOD} SELECT partition_id, CAST(x AS INT) AS x, CAST(y AS INT) AS y FROM hole UNION SELECT partition_id, x, y FROM c")
def set_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.filled(_square_cells(spark, sf_dir), SQUARE, KEY)


@query(f"WITH RECURSIVE {FLOOD} SELECT DISTINCT partition_id, c.x, c.y FROM c JOIN hole h USING (partition_id) WHERE abs(c.x - h.x) + abs(c.y - h.y) = 1")
def hole_borders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.hole_borders(_square_cells(spark, sf_dir), SQUARE, KEY)


@query(f"WITH {HALVES} SELECT a.partition_id, CAST(min(abs(a.x - b.x) + abs(a.y - b.y)) AS INT) AS steps FROM h a JOIN h b USING (partition_id) WHERE a.k = 0 AND b.k = 1 GROUP BY 1")
def set_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _halves(spark, sf_dir)
    return regions.distance(a.distinct(), b.distinct(), SQUARE, KEY)


# components, guides, measures


@query(f"WITH RECURSIVE {TILES}, walk AS (SELECT x, y, x AS rx, y AS ry FROM c UNION SELECT c.x, c.y, w.rx, w.ry FROM walk w JOIN c ON abs(c.x - w.x) + abs(c.y - w.y) = 1), r AS (SELECT x, y, min((rx, ry)) AS r FROM walk GROUP BY 1, 2), k AS (SELECT r, count(*) AS n FROM s JOIN r ON r.x = CAST(floor(s.x + 0.5) AS INT) AND r.y = CAST(floor(s.y + 0.5) AS INT) GROUP BY 1), p AS (SELECT r, count(*) AS partitions FROM r GROUP BY 1) SELECT r[1] AS rx, r[2] AS ry, n AS weight, partitions FROM k JOIN p USING (r)")
def component_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites and squares of every component of adjoining squares."""
    p = _rings(spark, sf_dir)
    s = sites(spark, sf_dir).select("map_id", G.half_up(F.col("x")).alias("outline_id"), G.half_up(F.col("y")).alias("partition_id"))
    w = dual.weights(p.withColumn("custom_weight", F.lit(-1)), s)
    c = dual.component_weights(dual.components(p, dual.dual_edges(p)), w)
    return c.select(F.col("comp_id.outline_id").alias("rx"), F.col("comp_id.partition_id").alias("ry"), "weight", "partitions")


QUALITY = GUIDED + ", cq AS (SELECT partition_id, cx, cy, least(1.0, count(*) / 3.0) AS area FROM c WHERE site_id % 2 = 0 GROUP BY 1, 2, 3)"


def _quality(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    s, _, own = _guided(spark, sf_dir)
    key = ["map_id", "outline_id", "partition_id"]
    q = s.where("site_id % 2 = 0").groupBy(*key, "cell.x", "cell.y").agg(F.least(F.lit(1.0), F.count("*") / 3.0).cast("double").alias("area"))
    return s, own, q, q.groupBy(*key).agg(F.sum("area").alias("quality"))


@query(f"WITH {QUALITY}, g AS (SELECT partition_id, sum(area) AS q FROM cq GROUP BY 1), h AS (SELECT partition_id, sum(area) AS a FROM own JOIN cq USING (partition_id, cx, cy) GROUP BY 1) SELECT partition_id, {q6('coalesce(a, 0) / q')} AS value FROM g LEFT JOIN h USING (partition_id)")
def guide_fit_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, own, q, guides = _quality(spark, sf_dir)
    return analyze.guide_fit_quality(own, guides, q).select(F.col("id").alias("partition_id"), r6(F.col("value")).alias("value"))


@query(f"WITH {QUALITY} SELECT site_id, {q6('CASE WHEN EXISTS (SELECT 1 FROM cq k WHERE k.partition_id = c.partition_id) THEN 1 - coalesce(area, 0) ELSE 0 END')} AS value FROM c LEFT JOIN cq USING (partition_id, cx, cy)")
def site_guide_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, _, q, guides = _quality(spark, sf_dir)
    return _measure(analyze.site_guide_deviation(s, guides, q, SQUARE))


@query(_displaced(*UNI).replace("f AS (SELECT *, (kx + ky) / (vx + vy) AS sx, (kx + ky) / (vx + vy) AS sy FROM m)", "f AS (SELECT *, CASE WHEN partition_id % 2 = 0 THEN 1.5 ELSE (kx + ky) / (vx + vy) END AS sx FROM m), j AS (SELECT *, sx AS sy, CASE WHEN partition_id % 2 = 0 THEN 2.0 ELSE mcx - sx * mx END AS tx, CASE WHEN partition_id % 2 = 0 THEN -1.0 ELSE mcy - sx * my END AS ty FROM f)").replace("x * sx + mcx - sx * mx - cx", "x * sx + tx - cx").replace("y * sy + mcy - sy * my - cy", "y * sy + ty - cy").replace("JOIN f USING", "JOIN j USING") + f" SELECT site_id, {q6('v')} AS value FROM v")
def displacement_guide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Displacement after the guides' transforms; partitions without a guide after the best fit."""
    p = placed(spark, sf_dir)
    key = ["map_id", "outline_id", "partition_id"]
    guides = p.where("partition_id % 2 = 0").select(*key).distinct().withColumns({"factor": F.lit(1.5), "tx": F.lit(2.0), "ty": F.lit(-1.0)})
    return _measure(analyze.displacement(p, "Guide", guides))


@query(f"WITH {LAID}, {STATS} SELECT partition_id, {q6('CASE WHEN partition_id % 2 = 0 THEN 1.5 ELSE sqrt((vcx + vcy) / (vx + vy)) END')} AS sx, {q6('CASE WHEN partition_id % 2 = 0 THEN 2.0 ELSE mcx - sqrt((vcx + vcy) / (vx + vy)) * mx END')} AS tx FROM m")
def align_guide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment by guide, or by the default where there is none."""
    p = placed(spark, sf_dir)
    guides = p.where("partition_id % 2 = 0").select("partition_id").distinct().withColumns({"factor": F.lit(1.5), "tx": F.lit(2.0), "ty": F.lit(-1.0)})
    t = align.align("Guide", p, p.select("partition_id", "cx", "cy"), guides, KEY)
    return t.select("partition_id", r6(F.col("t.sx")).alias("sx"), r6(F.col("t.tx")).alias("tx"))


@query(f"WITH {LAID} SELECT partition_id, count(*) AS sites, count(*) AS cells, true AS no_worse FROM laid GROUP BY 1")
def assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites of each partition on the cells of a square block: each has a cell of its own, and the cost is no more than by row number; tests hold the kernel against brute force."""
    s = laid(spark, sf_dir)
    c = s.select("map_id", "outline_id", "partition_id", "cell.x", "cell.y").withColumn("ord", F.col("y") * 8 + F.col("x"))
    key = ["map_id", "outline_id", "partition_id"]
    t = align.align("Uniform-Agnostic", s, align.centroids(c, SQUARE), None, key)
    got = assign.assign_sites(s, c, t, SQUARE).select(*key, "site_id", F.col("x").alias("gx"), F.col("y").alias("gy"))
    at = s.join(t, key).withColumn("p", G.apply(F.col("t"), F.col("x"), F.col("y"))).join(got, [*key, "site_id"])
    cost = lambda x, y: (F.col("p.x") - x) ** 2 + (F.col("p.y") - y) ** 2
    total = at.groupBy("partition_id").agg(F.count("*").alias("sites"), F.countDistinct("gx", "gy").alias("cells"), F.sum(cost(F.col("gx"), F.col("gy"))).alias("a"), F.sum(cost(F.col("cell.x"), F.col("cell.y"))).alias("b"))
    return total.select("partition_id", "sites", "cells", (F.col("a") <= F.col("b") + 1e-6).alias("no_worse"))


# a map of the partitions' boxes and their sites

MAP = LAID + ", o AS (SELECT partition_id, CAST(dense_rank() OVER (ORDER BY partition_id) - 1 AS INT) AS outline_id, min(x) - 1 AS l, max(x) + 1 AS r, min(y) - 1 AS b, max(y) + 1 AS t FROM s GROUP BY 1), w AS (SELECT outline_id, CAST(row_number() OVER (PARTITION BY outline_id ORDER BY laid.site_id) - 1 AS INT) AS site_id, CAST(laid.site_id AS VARCHAR) AS label, x, y, cx, cy FROM laid JOIN o USING (partition_id))"


def drawn(spark: SparkSession, sf_dir: str) -> TileMap:
    """The partitions as outlines (boxes) of one map with their sites, cut into themselves, each site on its cell by row number."""
    s = laid(spark, sf_dir)
    none = F.lit(None)
    o = s.groupBy("map_id", F.col("partition_id").alias("_p")).agg((F.min("x") - 1).alias("l"), (F.min("y") - 1).alias("b"), (F.max("x") + 1).alias("r"), (F.max("y") + 1).alias("t"))
    o = o.withColumn("outline_id", (F.dense_rank().over(Window.partitionBy("map_id").orderBy("_p")) - 1).cast("int"))
    ring = F.array(*(G.point(F.col(x), F.col(y)) for x, y in (("l", "b"), ("r", "b"), ("r", "t"), ("l", "t"))))
    shown = [F.concat(F.lit("part "), F.col("_p")).alias("label"), none.cast("struct<x:double,y:double>").alias("label_pt"), C.fixed((1, 2, 3)).alias("color"), ring.alias("ring"), F.lit(-1).alias("custom_weight")]
    outlines = o.select("map_id", "outline_id", *shown)
    own = s.drop("outline_id").withColumnRenamed("partition_id", "_p").join(o.select("map_id", "_p", "outline_id"), ["map_id", "_p"])
    w = Window.partitionBy("map_id", "outline_id").orderBy("site_id")
    put = own.select("map_id", "outline_id", (F.row_number().over(w) - 1).cast("int").alias("n"), F.col("site_id").cast("string").alias("label"), "x", "y", C.fixed((0, 0, 0)).alias("color"), F.lit("sites").alias("layer"), F.lit(0).alias("partition_id"), "cell")
    placed_ = put.withColumnRenamed("n", "site_id")
    # partitions beside one another have cells of their own
    moved = placed_.withColumn("cell", G.cell(F.col("cell.x") + F.col("outline_id") * 10, F.col("cell.y")))
    parts = o.select("map_id", "outline_id", F.lit(0).alias("partition_id"), *shown)
    taken = moved.select("map_id", "outline_id", "partition_id", "cell.x", "cell.y", F.col("site_id").alias("ord"))
    maps = spark.createDataFrame([("m", 8, "SQUARE")], "map_id string, stage int, grid string")
    return TileMap.of(spark, maps=maps, outlines=outlines, sites=moved, partitions=parts, cells=taken)


# whole maps: regions as dumbbells, their nations' customers as sites

NATIONS = "n AS (SELECT n_regionkey AS outline_id, n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k FROM nation)"
DUMBBELL = [(0, 0), (10, 0), (10, 4), (14, 4), (14, 0), (24, 0), (24, 10), (14, 10), (14, 6), (10, 6), (10, 10), (0, 10)]


def continents(spark: SparkSession, sf_dir: str, each: int = 4) -> TileMap:
    """Every region as a dumbbell far from the others, with ``each`` sites to a nation spread over its two lobes."""
    r = _table(spark, sf_dir, "region")
    none = F.lit(None)
    ring = F.array(*(G.point(F.lit(float(x)) + F.col("r_regionkey") * 40, F.lit(float(y))) for x, y in DUMBBELL))
    outlines = r.select(F.lit("m").alias("map_id"), F.col("r_regionkey").cast("int").alias("outline_id"), F.col("r_name").alias("label"), none.cast("struct<x:double,y:double>").alias("label_pt"), C.fixed((9, 9, 9)).alias("color"), ring.alias("ring"), F.lit(-1).alias("custom_weight"))
    n = _table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("int").alias("outline_id"), "n_nationkey", "n_name", F.explode(F.sequence(F.lit(0), F.lit(each - 1))).alias("i"))
    w = Window.partitionBy("outline_id").orderBy("n_nationkey", "i")
    n = n.withColumn("k", F.row_number().over(w) - 1)
    lobe, at = F.col("k") % 2, F.floor(F.col("k") / 2)
    x = F.col("outline_id") * 40 + lobe * 14 + 1.1 + (at % 4) * 2.4 + at * 0.013
    y = 1.2 + F.floor(at / 4) * 2.7 + lobe * 0.31
    s = n.select(F.lit("m").alias("map_id"), "outline_id", F.col("k").cast("int").alias("site_id"), F.concat_ws("-", "n_name", "i").alias("label"), x.cast("double").alias("x"), y.cast("double").alias("y"), C.fixed((0, 0, 0)).alias("color"), F.lit("sites").alias("layer"), none.cast("int").alias("partition_id"), none.cast("struct<x:int,y:int>").alias("cell"))
    maps = spark.createDataFrame([("m", INPUT, None)], "map_id string, stage int, grid string")
    return TileMap.of(spark, maps=maps, outlines=outlines, sites=s)


@query(f"WITH {NATIONS} SELECT outline_id, CAST(count(*) * 4 AS BIGINT) AS sites, 208.0::DOUBLE AS area, true AS cut, true AS kept FROM n GROUP BY 1")
def partition_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each dumbbell is cut, its parts make up its area, and every site is in the part that holds it."""
    m, _ = partition.partition(continents(spark, sf_dir), "COMBINED", 3.0, 5)
    sized = m.partitions.groupBy("outline_id").agg(r6(F.sum(G.area(F.col("ring")))).alias("area"), (F.count("*") > 1).alias("cut"))
    key = ["map_id", "outline_id", "partition_id"]
    inside = m.sites.join(m.partitions.select(*key, "ring"), key).groupBy("outline_id").agg(F.count("*").alias("sites"), F.bool_and(G.contains(F.col("ring"), F.col("x"), F.col("y"))).alias("kept"))
    return inside.join(sized, "outline_id").select("outline_id", "sites", "area", "cut", "kept")


@query(f"WITH {NATIONS} SELECT outline_id, CAST(count(*) * 4 AS BIGINT) AS sites, CAST(count(*) * 4 AS BIGINT) AS cells, CAST(count(*) * 4 AS BIGINT) AS placed, true AS whole FROM n GROUP BY 1")
def tile_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From outlines to a finished map: as many cells as sites, each site on a cell of its own, every partition in one piece."""
    m = pipeline.run(continents(spark, sf_dir), pipeline.Plan(grid="HEXAGON", productivity=5, dilation=3.0)).map
    key = ["outline_id", "partition_id"]
    whole = regions.connected(m.cells, grid("HEXAGON"), key).groupBy("outline_id").agg(F.bool_and("connected").alias("whole"))
    own = m.cells.groupBy("outline_id").agg(F.count("*").alias("cells"))
    at = m.sites.join(m.cells.select(*key, "x", "y"), (m.sites.outline_id == m.cells.outline_id) & (m.sites.partition_id == m.cells.partition_id) & (m.sites.cell.x == m.cells.x) & (m.sites.cell.y == m.cells.y), "left_semi")
    got = at.groupBy("outline_id").agg(F.count("*").alias("sites"), F.countDistinct("cell").alias("placed"))
    return got.join(own, "outline_id").join(whole, "outline_id").select("outline_id", "sites", "cells", "placed", "whole")


@query("WITH c AS (SELECT n_regionkey AS outline_id, count(*) AS n FROM nation GROUP BY 1) SELECT outline_id, CAST(3 + n % 4 + outline_id AS BIGINT) AS cells, true AS whole FROM c")
def cartogram_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mosaic cartogram gives every region as many cells as it weighs, in one piece."""
    m = continents(spark, sf_dir)
    n = _table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").cast("int").alias("outline_id")).agg(F.count("*").alias("n"))
    weight = (3 + F.col("n") % 4 + F.col("outline_id")).cast("int")
    weighed = m.outlines.drop("custom_weight").join(n, "outline_id").withColumn("custom_weight", weight).select(*m.outlines.columns)
    made = pipeline.cartogram(m.with_(outlines=weighed), "SQUARE")
    whole = regions.connected(made.cells, SQUARE, ["outline_id"]).select("outline_id", F.col("connected").alias("whole"))
    return made.cells.groupBy("outline_id").agg(F.count("*").alias("cells")).join(whole, "outline_id")


@query("WITH r AS (SELECT CAST(r_regionkey AS INT) AS outline_id FROM region) SELECT outline_id, true AS within, true AS again FROM r")
def weights_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random weights stay within their ends and depend on the seed alone."""
    o = continents(spark, sf_dir).outlines.drop("custom_weight")
    a, b = (pipeline.random_weights(o, 3, 9).select("outline_id", F.col("custom_weight").alias(n)) for n in "ab")
    return a.join(b, "outline_id").select("outline_id", F.col("a").between(3, 9).alias("within"), (F.col("a") == F.col("b")).alias("again"))


# evaluation


@query(f"WITH {MAP}, n AS (SELECT count(*) AS k FROM o) SELECT 'm' AS map_id, k AS outlines, 4 * k AS vertices, (SELECT count(*) FROM w) AS sites, k AS partitions FROM n")
def map_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.map_statistics(drawn(spark, sf_dir))


@query(f"WITH {MAP}, n AS (SELECT outline_id, count(*) AS n FROM w GROUP BY 1), k AS (SELECT o.outline_id, n, r - l + 1 AS width FROM o JOIN n USING (outline_id)) SELECT outline_id, {q6('coalesce(sum(width) OVER (ORDER BY n DESC, outline_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)')} AS \"left\" FROM k")
def row_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.row_layout(drawn(spark, sf_dir)).select("outline_id", r6(F.col("left")).alias("left"))


_LOG = "l AS (SELECT event_type AS suite, 'S' || (event_id % 3) AS settings, 'step' || (event_id % 2) AS step, CAST(floor(abs(value)) AS BIGINT) AS ms FROM events WHERE value IS NOT NULL)"


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events").where("value is not null")
    return e.select(F.concat_ws(" ", "event_type", F.concat(F.lit("S"), F.col("event_id") % 3), F.concat(F.lit("step"), F.col("event_id") % 2), F.floor(F.abs("value")).cast("long").cast("string"), F.lit("ms total")).alias("line"))


@query(f"WITH {_LOG} SELECT suite, settings, step, {q6('avg(ms)')} AS avg_ms, count(*) AS count FROM l GROUP BY 1, 2, 3")
def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.outcomes(_log(spark, sf_dir)).withColumn("avg_ms", r6(F.col("avg_ms")))


@query(f"WITH {_LOG}, a AS (SELECT step AS stage, avg(ms) AS o FROM l WHERE settings = 'S0' GROUP BY 1), b AS (SELECT step AS stage, avg(ms) AS n FROM l WHERE settings = 'S1' GROUP BY 1) SELECT stage, {q6('o')} AS old_ms, {q6('n')} AS new_ms, {q6('o / n')} AS ratio FROM a JOIN b USING (stage)")
def timing_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _log(spark, sf_dir).select(F.split("line", " ").alias("f"), evaluate.parse_timing(F.col("line")).alias("ms"))
    old, new = (t.where(F.col("f")[1] == k).groupBy(F.col("f")[2].alias("stage")).agg(F.avg("ms").alias("avg_ms")) for k in ("S0", "S1"))
    r = evaluate.timing_ratio(old, new)
    return r.select("stage", *(r6(F.col(c)).alias(c) for c in ("old_ms", "new_ms", "ratio")))


@query("WITH n AS (SELECT n_nationkey AS k, lower(n_name) AS m, n_regionkey AS r FROM nation) SELECT '/out/' || m || '-SQUARE-' || r || '.wkt' AS path, m AS map, 'SQUARE' AS grid, CAST(r AS VARCHAR) AS alignment, CAST(NULL AS VARCHAR) AS combination FROM n")
def file_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _table(spark, sf_dir, "nation")
    files = n.select(F.concat(F.lit("/out/"), F.lower("n_name"), F.lit("-SQUARE-"), F.col("n_regionkey"), F.lit(".wkt")).alias("path"))
    files = files.unionByName(n.select(F.concat(F.lit("/out/a-b-c-d-e-"), F.col("n_name"), F.lit(".txt")).alias("path")))
    return evaluate.file_settings(files, ["map", "grid", "alignment", "combination"])


@query(f"WITH v AS (SELECT n_regionkey AS region, n_name AS nation, avg(c_acctbal) AS v FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2), o AS (SELECT a.region, a.nation, a.v, min(b.v) AS o FROM v a LEFT JOIN v b ON a.region = b.region AND a.nation <> b.nation GROUP BY 1, 2, 3) SELECT region, nation, {q6('v')} AS value, {q6('o')} AS other, CASE WHEN v / o <= 0.8 THEN '**' WHEN v / o <= 0.95 THEN '*' ELSE '' END AS mark FROM o")
def value_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations whose customers' mean balance is lower than any other's in their region, marked like better results."""
    n = _table(spark, sf_dir, "nation").join(_table(spark, sf_dir, "customer"), F.col("n_nationkey") == F.col("c_nationkey"))
    v = n.groupBy(F.col("n_regionkey").alias("region"), F.col("n_name").alias("nation")).agg(F.avg("c_acctbal").alias("value"))
    return evaluate.marks(v, ["region"], "nation").select("region", "nation", r6(F.col("value")).alias("value"), r6(F.col("other")).alias("other"), "mark")


@query(_displaced(*UNI) + f", o AS (SELECT v, row_number() OVER (ORDER BY v DESC) - 1 AS r, count(*) OVER () AS n FROM v), t AS (SELECT avg(v) AS a, max(v) AS m, max(CASE WHEN r = least(ceil(n / 10.0), n - 1) THEN v END) AS p, max(CASE WHEN r = least(ceil(n / 4.0), n - 1) THEN v END) AS q, sqrt(avg(v * v)) AS rms FROM o) SELECT {q6('a / m')} AS avg, {q6('p / m')} AS pct90, {q6('q / m')} AS pct75, {q6('rms')} AS rms FROM t")
def quality_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries as shares of the worst value, and the table of displacements with its root mean square."""
    d = analyze.displacement(placed(spark, sf_dir), "Uni")
    b = evaluate.bars(d).join(evaluate.assignment_table(d).select("map_id", "analyzer", "rms"), ["map_id", "analyzer"])
    return b.select(*(r6(F.col(c)).alias(c) for c in ("avg", "pct90", "pct75", "rms")))


@query(f"WITH {NATIONS} SELECT outline_id, 2 AS parts, 4.0::DOUBLE AS cut, true AS fat FROM n GROUP BY 1")
def partition_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two lobes of every dumbbell: the cut is seen from both sides and as long as the neck is wide."""
    m, _ = partition.partition(continents(spark, sf_dir), "COMBINED", 3.0, 5)
    s = evaluate.shape_measures(m)
    return s.groupBy("outline_id").agg(F.count("*").cast("int").alias("parts"), r6(F.sum("length")).alias("cut"), F.bool_and(F.col("fatness").between(0.7, 1.0)).alias("fat"))


# guides, placement, files


@query(f"WITH {MAP}, n AS (SELECT outline_id, count(*) AS n FROM w GROUP BY 1) SELECT outline_id, n AS tiles, true AS whole, true AS covered, true AS scaled FROM n")
def guide_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The guide of every box: as many cells as it has sites, in one piece and without holes, mostly under it, at the scale at which its area is theirs."""
    m = drawn(spark, sf_dir)
    n = m.sites.groupBy("map_id", "outline_id", "partition_id").agg(F.count("*").cast("int").alias("tiles"))
    p = m.partitions.join(n, ["map_id", "outline_id", "partition_id"])
    made = durable(guide.guides(p.select("map_id", "outline_id", "partition_id", "ring", "tiles"), SQUARE, 3))
    own = made.select("outline_id", F.explode("cells").alias("c")).select("outline_id", "c.x", "c.y")
    whole = regions.connected(own, SQUARE, ["outline_id"]).select("outline_id", "connected")
    holed = regions.holes(own, SQUARE, ["outline_id"]).select("outline_id").distinct().withColumn("holed", F.lit(True))
    scaled = F.abs(F.col("factor") * F.col("factor") * G.area(F.col("ring")) - F.col("tiles")) < 1e-6 * F.col("tiles")
    joined = made.join(p.select("outline_id", "ring", "tiles"), "outline_id").join(whole, "outline_id").join(holed, "outline_id", "left")
    return joined.select("outline_id", F.size("cells").cast("long").alias("tiles"), (F.col("connected") & F.col("holed").isNull()).alias("whole"), (F.col("quality") > 0.6 * F.col("tiles")).alias("covered"), scaled.alias("scaled"))


@query(f"WITH {MAP}, b AS (SELECT outline_id, l, r, b, t, unnest(generate_series(CAST(floor(l + 0.5) AS BIGINT), CAST(floor(r + 0.5) AS BIGINT))) AS x FROM o), c AS (SELECT *, unnest(generate_series(CAST(floor(b + 0.5) AS BIGINT), CAST(floor(t + 0.5) AS BIGINT))) AS y FROM b), a AS (SELECT outline_id, x, y, greatest(0, least(r, x + 0.5) - greatest(l, x - 0.5)) * greatest(0, least(t, y + 0.5) - greatest(b, y - 0.5)) AS area FROM c) SELECT outline_id, CAST(x AS INT) AS x, CAST(y AS INT) AS y, {q6('area')} AS area FROM a WHERE area > 1e-4")
def polygon_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of every square with every box."""
    p = guide.polygon_cells(drawn(spark, sf_dir).partitions, SQUARE)
    return p.where("area > 1e-4").select("outline_id", "x", "y", r6(F.col("area")).alias("area"))


@query(f"WITH {MAP} SELECT stage, (SELECT count(*) FROM w) AS sites, CASE WHEN stage >= 2 THEN (SELECT count(*) FROM o) ELSE 0 END AS partitions, CASE WHEN stage >= 4 THEN (SELECT count(*) FROM w) ELSE 0 END AS cells, CASE WHEN stage >= 8 THEN (SELECT count(*) FROM w) ELSE 0 END AS placed FROM (VALUES (1), (2), (4), (8)) AS k(stage)")
def stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of a finished map at each earlier stage."""
    m, out = drawn(spark, sf_dir), None
    for stage in (INPUT, PARTITIONED, 4, ASSIGNED):
        now = m.at(stage)
        now.require(stage)
        one = [now.sites.agg(F.count("*").alias("sites"), F.count("cell").alias("placed")), now.partitions.agg(F.count("*").alias("partitions")), now.cells.agg(F.count("*").alias("cells"))]
        row = one[0].join(one[1]).join(one[2]).select(F.lit(stage).alias("stage"), "sites", "partitions", "cells", "placed")  # one row each
        out = row if out is None else out.unionByName(row)
    return out
