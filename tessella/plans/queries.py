"""Registered queries of the tile-map operators over whole tables, each with SQL for the same rows.

The tables hold no maps, so ``embeddings`` gives the sites: site = vec_id, x = 20 e1,
y = 20 e2 (doubles), partition = label. The cell of a site is the one that holds it, or,
where each site needs a cell of its own, one of a layout by row number. Doubles are
rounded to six places on both sides, ties are ordered by ids.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import colors as C
from ..functions import geometry as G
from ..functions.grids import grid
from ..operators import align, analyze, cells, dual, partition, spatial
from ..sources import tsv
from . import pipeline

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column) -> Column:
    """Rounded to six places by floor, with no negative zero."""
    return F.floor(c * 1e6 + 0.5) / 1e6


def q6(e: str) -> str:
    return f"floor(({e}) * 1e6 + 0.5) / 1e6"


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "embeddings")
    x, y = (F.get("embedding", F.lit(i)).cast("double") * 20 for i in (0, 1))
    return e.where("vec_id is not null and label is not null").select(F.lit("m").alias("map_id"), F.lit(0).alias("outline_id"), F.col("label").cast("int").alias("partition_id"), F.col("vec_id").alias("site_id"), x.alias("x"), y.alias("y")).where("x is not null and y is not null")


SITES = "s AS (SELECT CAST(label AS INT) AS partition_id, vec_id AS site_id, CAST(embedding[1] AS DOUBLE) * 20 AS x, CAST(embedding[2] AS DOUBLE) * 20 AS y FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding[1] IS NOT NULL AND embedding[2] IS NOT NULL)"
# cell of a site by row number inside its partition, eight to a row
LAID = SITES + ", laid AS (SELECT *, CAST((rn - 1) % 8 AS INT) AS cx, CAST(floor((rn - 1) / 8) AS INT) AS cy FROM (SELECT *, row_number() OVER (PARTITION BY partition_id ORDER BY site_id) AS rn FROM s))"


def laid(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("partition_id").orderBy("site_id")
    s = sites(spark, sf_dir).withColumn("_n", F.row_number().over(w) - 1)
    return s.withColumn("cell", G.cell(F.col("_n") % 8, F.floor(F.col("_n") / 8))).drop("_n")


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyze.placed(laid(spark, sf_dir), grid("SQUARE"))


def _cells_of(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = G.containing_cell(F.col("x"), F.col("y"), grid(name))
        return sites(spark, sf_dir).select("site_id", c.alias("c")).select("site_id", F.col("c.x").alias("cx"), F.col("c.y").alias("cy"))

    f.__name__ = f"cell_{name.lower()}"
    return f


S3 = repr(math.sqrt(3))
# three coordinates of sum zero, rounded; the one that changed most follows from the others
HEX = f"h AS (SELECT *, x / {S3} + y / 1.5 / 2 AS u, y / 1.5 AS v FROM s), k AS (SELECT *, floor(u - v + 0.5) AS i, floor(v + 0.5) AS j, floor(-u + 0.5) AS l FROM h), e AS (SELECT *, abs(i - (u - v)) AS di, abs(j - v) AS dj, abs(l + u) AS dl FROM k), c AS (SELECT *, CAST(CASE WHEN dl > di AND dl > dj THEN i + j ELSE -l END AS INT) AS cx, CAST(CASE WHEN NOT (dl > di AND dl > dj) AND dj > di THEN -i - l ELSE j END AS INT) AS cy FROM e)"
HEX_SQL = f"WITH {SITES}, {HEX} SELECT site_id, cx, cy FROM c"


def _tiles_sql(name: str) -> str:
    """The cell whose tile holds each site, by crossing parity over the tiles of the patterns around it."""
    g = grid(name)
    rows = ", ".join(f"({v}, {a[0]!r}::DOUBLE, {a[1]!r}::DOUBLE, {b[0]!r}::DOUBLE, {b[1]!r}::DOUBLE)" for v, ring in enumerate(g.tiles) for a, b in zip(ring.tolist(), [*ring.tolist()[1:], ring.tolist()[0]], strict=True))
    det = g.right[0] * g.up[1] - g.right[1] * g.up[0]
    return f"""WITH {SITES}, t(v, x1, y1, x2, y2) AS (VALUES {rows}), o AS (SELECT *, floor((x * {g.up[1]!r} - y * {g.up[0]!r}) / {det!r} + 0.5) AS p, floor((y * {g.right[0]!r} - x * {g.right[1]!r}) / {det!r} + 0.5) AS q FROM s),
n AS (SELECT site_id, p + i AS p, q + j AS q, x - (p + i) * {g.right[0]!r} - (q + j) * {g.up[0]!r} AS x, y - (p + i) * {g.right[1]!r} - (q + j) * {g.up[1]!r} AS y FROM o, unnest([-2, -1, 0, 1, 2]) AS a(i), unnest([-2, -1, 0, 1, 2]) AS b(j))
SELECT site_id, CAST(p * {g.pc} + v AS INT) AS cx, CAST(q AS INT) AS cy FROM n, t WHERE (y1 > y) <> (y2 > y) AND x < x1 + (y - y1) * (x2 - x1) / (y2 - y1) GROUP BY site_id, p, q, v HAVING count(*) % 2 = 1"""


def _equilateral_sql() -> str:
    a, b, c, d, e, f = grid("EQUILATERAL").inverse
    return f"WITH {SITES}, i AS (SELECT site_id, x * {a!r} + y * {c!r} + {e!r} AS x, x * {b!r} + y * {d!r} + {f!r} AS y FROM s), a AS (SELECT *, floor(x + 0.5) AS q, floor(y + 0.5) AS r FROM i) SELECT site_id, CAST(2 * q + CASE WHEN x - q >= y - r THEN 0 ELSE 1 END AS INT) AS cx, CAST(r AS INT) AS cy FROM a"


query(f"WITH {SITES} SELECT site_id, CAST(floor(x + 0.5) AS INT) AS cx, CAST(floor(y + 0.5) AS INT) AS cy FROM s")(_cells_of("SQUARE"))
query(HEX_SQL)(_cells_of("HEXAGON"))
query(f"WITH {SITES}, a AS (SELECT *, floor(y + 0.5) AS r FROM s) SELECT site_id, CAST(floor(x + r * 0.5 + 0.5) AS INT) AS cx, CAST(r AS INT) AS cy FROM a")(_cells_of("STAGSQUARE"))
query(f"WITH {SITES}, a AS (SELECT *, floor(x + 0.5) AS q, floor(y + 0.5) AS r FROM s) SELECT site_id, CAST(2 * q + CASE WHEN x - q >= y - r THEN 0 ELSE 1 END AS INT) AS cx, CAST(r AS INT) AS cy FROM a")(_cells_of("TRIANGLE"))
for _name in ("GEESE", "MIXED", "NS2", "NS3"):
    query(_tiles_sql(_name))(_cells_of(_name))
query(_equilateral_sql())(_cells_of("EQUILATERAL"))


def _norm(name: str) -> Callable[[SparkSession, str], DataFrame]:
    """Steps between the cells of consecutive sites of a partition."""

    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        g = grid(name)
        w = Window.partitionBy("partition_id").orderBy("site_id")
        s = sites(spark, sf_dir).withColumn("c", G.containing_cell(F.col("x"), F.col("y"), g)).withColumn("n", F.lead("c").over(w)).where("n is not null")
        return s.select("site_id", G.norm(F.col("c.x"), F.col("c.y"), F.col("n.x"), F.col("n.y"), g).alias("steps"))

    f.__name__ = f"norm_{name.lower()}"
    return f


NEXT = "n AS (SELECT site_id, lead(cx) OVER w - cx AS dx, lead(cy) OVER w - cy AS dy FROM c WINDOW w AS (PARTITION BY partition_id ORDER BY site_id))"
query(f"WITH {SITES}, c AS (SELECT *, CAST(floor(x + 0.5) AS INT) AS cx, CAST(floor(y + 0.5) AS INT) AS cy FROM s), {NEXT} SELECT site_id, CAST(abs(dx) + abs(dy) AS INT) AS steps FROM n WHERE dx IS NOT NULL")(_norm("SQUARE"))
query(f"WITH {SITES}, a AS (SELECT *, floor(y + 0.5) AS r FROM s), c AS (SELECT *, CAST(floor(x + r * 0.5 + 0.5) AS INT) AS cx, CAST(r AS INT) AS cy FROM a), {NEXT} SELECT site_id, CAST(CASE WHEN dx * dy >= 0 THEN greatest(abs(dx), abs(dy)) ELSE abs(dx) + abs(dy) END AS INT) AS steps FROM n WHERE dx IS NOT NULL")(_norm("STAGSQUARE"))


@query(f"WITH {SITES} SELECT site_id, {q6(f'floor(x + 0.5) * {S3} - floor(y + 0.5) * ({S3} / 2)')} AS px, {q6('floor(y + 0.5) * 1.5')} AS py FROM s")
def cell_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid("HEXAGON")
    c = G.cell_centroid(G.half_up(F.col("x")), G.half_up(F.col("y")), g)
    return sites(spark, sf_dir).select("site_id", r6(c["x"]).alias("px"), r6(c["y"]).alias("py"))


@query(f"WITH {SITES}, b AS (SELECT partition_id, min(x) AS l, max(x) AS r, min(y) AS o, max(y) AS t FROM s GROUP BY 1), k AS (SELECT *, least(100 / nullif(r - l, 0), 50 / nullif(t - o, 0)) AS k FROM b) SELECT site_id, {q6('(x - (l + r) / 2) * k + 50')} AS px, {q6('(y - (o + t) / 2) * k + 25')} AS py FROM s JOIN k USING (partition_id)")
def fit_to_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each partition's sites fitted into a box of 100 by 50."""
    s = sites(spark, sf_dir)
    box = s.groupBy("partition_id").agg(F.min("x").alias("left"), F.min("y").alias("bottom"), F.max("x").alias("right"), F.max("y").alias("top"))
    target = F.struct(F.lit(0.0).alias("left"), F.lit(0.0).alias("bottom"), F.lit(100.0).alias("right"), F.lit(50.0).alias("top"))
    t = box.select("partition_id", G.fit_box(F.struct("left", "bottom", "right", "top"), target).alias("t"))
    p = s.join(t, "partition_id").select("site_id", G.apply(F.col("t"), F.col("x"), F.col("y")).alias("p"))
    return p.select("site_id", r6(F.col("p.x")).alias("px"), r6(F.col("p.y")).alias("py"))


@query(f"WITH {SITES} SELECT site_id, {q6('(x * 3 + 7 - 7) / 3')} AS px, {q6('y * -2 - 1')} AS py FROM s")
def transform_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = G.transform(F.lit(3.0), F.lit(-2.0), F.lit(7.0), F.lit(-1.0))
    there = G.apply(t, F.col("x"), F.col("y"))
    back = G.unapply(t, there["x"], there["y"])
    return sites(spark, sf_dir).select("site_id", r6(back["x"]).alias("px"), r6(there["y"]).alias("py"))


def _square_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sites(spark, sf_dir).select("partition_id", G.half_up(F.col("x")).alias("x"), G.half_up(F.col("y")).alias("y")).distinct()


CELLS = SITES + ", c AS (SELECT DISTINCT partition_id, CAST(floor(x + 0.5) AS INT) AS x, CAST(floor(y + 0.5) AS INT) AS y FROM s)"
ROOKS = "d(dx, dy) AS (VALUES (1, 0), (-1, 0), (0, 1), (0, -1))"
QUEENS = "d(dx, dy) AS (VALUES (1, 0), (-1, 0), (0, 1), (0, -1), (1, 1), (1, -1), (-1, 1), (-1, -1))"


def _outside(offsets: str) -> str:
    return f"WITH {CELLS}, {offsets} SELECT DISTINCT partition_id, x + dx AS x, y + dy AS y FROM c, d WHERE NOT EXISTS (SELECT 1 FROM c o WHERE o.partition_id = c.partition_id AND o.x = c.x + dx AND o.y = c.y + dy)"


@query(_outside(ROOKS))
def nbrs_rook(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.neighbours(_square_cells(spark, sf_dir), grid("SQUARE"), ["partition_id"], "rook")


@query(_outside(QUEENS))
def nbrs_queen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.neighbours(_square_cells(spark, sf_dir), grid("SQUARE"), ["partition_id"], "queen")


@query(f"WITH {CELLS}, a AS (SELECT DISTINCT p.partition_id AS a, q.partition_id AS b FROM c p JOIN c q ON p.x = q.x AND p.y = q.y AND p.partition_id < q.partition_id) SELECT a, b FROM a")
def set_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of partitions whose cell sets meet."""
    return cells.overlaps(_square_cells(spark, sf_dir), []).drop("shared")


@query(f"WITH {SITES}, c AS (SELECT DISTINCT site_id % 40 AS map_id, partition_id, CAST(floor(x + 0.5) AS INT) + dx AS x, CAST(floor(y + 0.5) AS INT) + dy AS y FROM s, (VALUES (0, 0), (1, 0), (0, 1), (1, 1)) d(dx, dy)) SELECT p.map_id, p.partition_id AS a, q.partition_id AS b, CAST(count(*) AS BIGINT) AS shared FROM c p JOIN c q ON p.map_id = q.map_id AND p.x = q.x AND p.y = q.y AND p.partition_id < q.partition_id GROUP BY 1, 2, 3")
def guide_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that the guides of two partitions share, in forty maps; a guide is the squares of two by two cells at its sites."""
    s = sites(spark, sf_dir).select((F.col("site_id") % 40).alias("map_id"), "partition_id", G.half_up(F.col("x")).alias("cx"), G.half_up(F.col("y")).alias("cy"))
    at = F.explode(F.array(*(G.cell(F.col("cx") + i, F.col("cy") + j) for i in (0, 1) for j in (0, 1))))
    return cells.overlaps(s.select("map_id", "partition_id", at.alias("c")).select("map_id", "partition_id", "c.x", "c.y"), ["map_id"])


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s = sites(spark, sf_dir).select("partition_id", "site_id", G.half_up(F.col("x")).alias("x"), G.half_up(F.col("y")).alias("y"))
    return s.where("site_id % 2 = 0").drop("site_id"), s.where("site_id % 2 = 1").drop("site_id")


HALVES = SITES + ", h AS (SELECT DISTINCT partition_id, site_id % 2 AS k, CAST(floor(x + 0.5) AS INT) AS x, CAST(floor(y + 0.5) AS INT) AS y FROM s)"


@query(f"WITH {HALVES} SELECT partition_id, x, y FROM h WHERE k = 0 INTERSECT SELECT partition_id, x, y FROM h WHERE k = 1")
def set_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.intersection(*_halves(spark, sf_dir), ["partition_id"])


@query(f"WITH {HALVES} SELECT partition_id, x, y FROM h WHERE k = 0 EXCEPT SELECT partition_id, x, y FROM h WHERE k = 1")
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.difference(*_halves(spark, sf_dir), ["partition_id"])


@query(f"WITH {HALVES} SELECT DISTINCT partition_id, x, y FROM h")
def set_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.union(*_halves(spark, sf_dir), ["partition_id"])


@query(f"WITH {HALVES}, {ROOKS} SELECT DISTINCT a.partition_id FROM h a JOIN h b USING (partition_id) WHERE a.k = 0 AND b.k = 1 AND abs(a.x - b.x) + abs(a.y - b.y) <= 1")
def set_touch(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _halves(spark, sf_dir)
    return cells.touching(a, b, grid("SQUARE"), ["partition_id"], "rook")


@query(f"WITH {CELLS}, {ROOKS} SELECT DISTINCT partition_id, x, y FROM c, d WHERE NOT EXISTS (SELECT 1 FROM c o WHERE o.partition_id = c.partition_id AND o.x = c.x + dx AND o.y = c.y + dy)")
def edge_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.edge_cells(_square_cells(spark, sf_dir), grid("SQUARE"), ["partition_id"])


@query(f"WITH {CELLS} SELECT p.partition_id AS a, q.partition_id AS b, count(*) AS pairs FROM c p JOIN c q ON abs(p.x - q.x) + abs(p.y - q.y) = 1 AND p.partition_id < q.partition_id GROUP BY 1, 2")
def adjacency_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _square_cells(spark, sf_dir).withColumn("m", F.lit(0))
    return cells.adjacency_counts(c, grid("SQUARE"), ["m"], "partition_id").drop("m")


@query(f"WITH {HALVES}, t AS (SELECT partition_id, x, y, max(CASE WHEN k = 0 THEN 1 ELSE 0 END) AS a, max(CASE WHEN k = 1 THEN 1 ELSE 0 END) AS b FROM h GROUP BY 1, 2, 3) SELECT partition_id, CAST(sum(a) AS BIGINT) AS cells, CAST(sum(b) AS BIGINT) AS guide, CAST(sum(a * b) AS BIGINT) AS hits, CAST(sum(a) + sum(b) - 2 * sum(a * b) AS BIGINT) AS difference, {q6('(sum(a) + sum(b) - 2 * sum(a * b)) / nullif(CAST(sum(b) AS DOUBLE), 0)')} AS relative FROM t GROUP BY 1")
def tile_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (h.distinct() for h in _halves(spark, sf_dir))
    return cells.tile_error(a, b, ["partition_id"]).select("partition_id", "cells", "guide", "hits", "difference", r6(F.col("relative")).alias("relative"))


@query(f"WITH {CELLS} SELECT partition_id, min(x) AS \"left\", min(y) AS bottom, max(x) AS \"right\", max(y) AS top FROM c GROUP BY 1")
def cell_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.boxes(_square_cells(spark, sf_dir), ["partition_id"])


@query(f"WITH {CELLS}, m AS (SELECT partition_id, avg(x) AS mx, avg(y) AS my FROM c GROUP BY 1) SELECT partition_id, {q6('mx')} AS mx, {q6('my')} AS my FROM m")
def barycenter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.barycenters(_square_cells(spark, sf_dir), grid("SQUARE"), ["partition_id"]).select("partition_id", r6(F.col("bx")).alias("mx"), r6(F.col("by")).alias("my"))


@query(f"WITH {SITES}, o AS (SELECT partition_id, count(*) AS n, min(x) AS l, max(x) AS r, min(y) AS b, max(y) AS t, avg(x) AS mx, avg(y) AS my FROM s GROUP BY 1) SELECT partition_id, n AS sites, {q6('l')} AS l, {q6('b')} AS b, {q6('r')} AS r, {q6('t')} AS t, {q6('mx')} AS mx, {q6('my')} AS my, {q6('(r - l) * (t - b)')} AS area, {q6('2 * (r - l + t - b)')} AS perimeter FROM o")
def outline_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, box and centroid of each partition's sites, and area and perimeter of the box as a ring."""
    o = sites(spark, sf_dir).groupBy("partition_id").agg(F.count("*").alias("sites"), F.min("x").alias("l"), F.min("y").alias("b"), F.max("x").alias("r"), F.max("y").alias("t"), F.avg("x").alias("mx"), F.avg("y").alias("my"))
    ring = _box_ring()
    return o.select("partition_id", "sites", *(r6(F.col(c)).alias(c) for c in ("l", "b", "r", "t", "mx", "my")), r6(G.area(ring)).alias("area"), r6(G.perimeter(ring)).alias("perimeter"))


def _box_ring() -> Column:
    return F.array(*(G.point(F.col(x), F.col(y)) for x, y in (("l", "b"), ("r", "b"), ("r", "t"), ("l", "t"))))


@query(f"WITH {SITES}, o AS (SELECT partition_id AS o, min(x) AS l, max(x) AS r, min(y) AS b, max(y) AS t FROM s GROUP BY 1) SELECT site_id, min(o) AS outline FROM s LEFT JOIN o ON x >= l - 1e-6 AND x <= r + 1e-6 AND y >= b - 1e-6 AND y <= t + 1e-6 GROUP BY 1")
def point_in_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first outline (box of a partition) that holds each site."""
    s = sites(spark, sf_dir)
    o = s.groupBy("partition_id").agg(F.min("x").alias("l"), F.min("y").alias("b"), F.max("x").alias("r"), F.max("y").alias("t")).select(F.lit("m").alias("map_id"), F.col("partition_id").alias("outline"), _box_ring().alias("ring"))
    return spatial.locate(s.select("map_id", "site_id", "x", "y"), o, ["map_id", "site_id"], "outline", ["map_id"]).select("site_id", "outline")


def _knn(k: int, ties: str = "") -> str:
    limit = f"WHERE rank <= {k}" if k else ""
    return f"knn AS (SELECT * FROM (SELECT a.site_id, b.site_id AS nbr, a.x, a.y, b.x AS nx, b.y AS ny, a.cx, a.cy, b.cx AS ncx, b.cy AS ncy, row_number() OVER (PARTITION BY a.site_id ORDER BY (b.x - a.x) ** 2 + (b.y - a.y) ** 2, b.site_id) AS rank FROM laid a JOIN laid b ON a.site_id <> b.site_id) {limit})"


@query(f"WITH {LAID}, {_knn(10)} SELECT site_id, nbr, CAST(rank AS INT) AS rank, {q6('(nx - x) ** 2 + (ny - y) ** 2')} AS d2 FROM knn")
def knn_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.nearest_sites(sites(spark, sf_dir), 10, ["map_id"]).select("site_id", "nbr", "rank", r6(F.col("d2")).alias("d2"))


FLIP = "sum(CASE WHEN abs(nx - x) > 1e-6 AND abs(ncx - cx) > 1e-6 AND sign(nx - x) <> sign(ncx - cx) THEN 1 ELSE 0 END + CASE WHEN abs(ny - y) > 1e-6 AND abs(ncy - cy) > 1e-6 AND sign(ny - y) <> sign(ncy - cy) THEN 1 ELSE 0 END)"


def _measure(df: DataFrame) -> DataFrame:
    return df.select(F.col("id").alias("site_id"), r6(F.col("value")).alias("value"))


@query(f"WITH {LAID}, {_knn(10)} SELECT site_id, CAST({FLIP} AS DOUBLE) AS value FROM knn GROUP BY 1")
def ortho_order_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _measure(analyze.orthogonal_order(placed(spark, sf_dir), 10))


@query(f"WITH {LAID}, {_knn(0)} SELECT site_id, CAST({FLIP} AS DOUBLE) AS value FROM knn GROUP BY 1")
def ortho_order_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _measure(analyze.orthogonal_order(placed(spark, sf_dir), 0))


DEFORM = "greatest(0.0, (sum((ncx - cx) ** 2 + (ncy - cy) ** 2) - sum((nx - x) * (ncx - cx) + (ny - y) * (ncy - cy)) ** 2 / sum((nx - x) ** 2 + (ny - y) ** 2)) / count(*))"


@query(f"WITH {LAID}, {_knn(10)} SELECT site_id, {q6(DEFORM)} AS value FROM knn GROUP BY 1")
def deformation_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _measure(analyze.deformation(placed(spark, sf_dir), 10))


@query(f"WITH {LAID}, {_knn(0)} SELECT site_id, {q6(DEFORM)} AS value FROM knn GROUP BY 1")
def deformation_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _measure(analyze.deformation(placed(spark, sf_dir), 0))


KEY = ["partition_id"]
STATS = "m AS (SELECT partition_id, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(cx) AS mcx, avg(cy) AS mcy, var_pop(x) AS vx, var_pop(y) AS vy, var_pop(cx) AS vcx, var_pop(cy) AS vcy, covar_pop(x, cx) AS kx, covar_pop(y, cy) AS ky, min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy, min(cx) AS lcx, max(cx) AS hcx, min(cy) AS lcy, max(cy) AS hcy FROM laid GROUP BY 1)"


def _fit_sql(sx: str, sy: str, tx: str = "mcx - sx * mx", ty: str = "mcy - sy * my") -> str:
    return f"WITH {LAID}, {STATS}, f AS (SELECT *, {sx} AS sx, {sy} AS sy FROM m) SELECT partition_id, {q6('sx')} AS sx, {q6('sy')} AS sy, {q6(tx)} AS tx, {q6(ty)} AS ty FROM f"


def _fit(t: DataFrame) -> DataFrame:
    return t.select("partition_id", *(r6(F.col(f"t.{c}")).alias(c) for c in ("sx", "sy", "tx", "ty")))


def _both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = placed(spark, sf_dir)
    return p, p.select("partition_id", "cx", "cy")


@query(_fit_sql("(hcx - lcx) / (hx - lx)", "(hcy - lcy) / (hy - ly)", "lcx - sx * lx", "lcy - sy * ly"))
def align_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fit(align.bbox_agnostic(*_both(spark, sf_dir), KEY))


@query(_fit_sql("sqrt(vcx / vx)", "sqrt(vcy / vy)"))
def align_nonuni_agn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fit(align.nonuniform_agnostic(*_both(spark, sf_dir), KEY))


@query(_fit_sql("sqrt((vcx + vcy) / (vx + vy))", "sqrt((vcx + vcy) / (vx + vy))"))
def align_uni_agn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fit(align.uniform_agnostic(*_both(spark, sf_dir), KEY))


@query(_fit_sql("kx / vx", "ky / vy"))
def align_nonuni_aware(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fit(align.nonuniform_aware(placed(spark, sf_dir), KEY))


@query(_fit_sql("(kx + ky) / (vx + vy)", "(kx + ky) / (vx + vy)"))
def align_uni_aware(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fit(align.uniform_aware(placed(spark, sf_dir), KEY))


def _displaced(sx: str, sy: str) -> str:
    return f"WITH {LAID}, {STATS}, f AS (SELECT *, {sx} AS sx, {sy} AS sy FROM m), v AS (SELECT site_id, CASE WHEN n > 1 THEN sqrt((x * sx + mcx - sx * mx - cx) ** 2 + (y * sy + mcy - sy * my - cy) ** 2) ELSE 0 END AS v FROM laid JOIN f USING (partition_id))"


UNI, NONUNI = ("(kx + ky) / (vx + vy)",) * 2, ("kx / vx", "ky / vy")


@query(_displaced(*UNI) + f" SELECT site_id, {q6('v')} AS value FROM v")
def displacement_uni(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _measure(analyze.displacement(placed(spark, sf_dir), "Uni"))


@query(_displaced(*NONUNI) + f" SELECT site_id, {q6('v')} AS value FROM v")
def displacement_nonuni(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _measure(analyze.displacement(placed(spark, sf_dir), "NonUni"))


@query(_displaced(*UNI) + f" SELECT {q6('sum(v)')} AS total, {q6('sqrt(avg(v * v))')} AS rms FROM v")
def displacement_rms(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = analyze.total_displacement(analyze.displacement(placed(spark, sf_dir), "Uni"))
    return t.select(r6(F.col("total")).alias("total"), r6(F.col("rms")).alias("rms"))


RANKED = ", o AS (SELECT v, row_number() OVER (ORDER BY v DESC) - 1 AS r, count(*) OVER () AS n FROM v)"


@query(_displaced(*UNI) + RANKED + f" SELECT {q6('sum(v)')} AS total, {q6('avg(v)')} AS avg, count(*) AS count, {q6('max(CASE WHEN r = n - 1 THEN v END)')} AS min, {q6('max(CASE WHEN r = 0 THEN v END)')} AS max, {q6('max(CASE WHEN r = least(ceil(n / 10.0), n - 1) THEN v END)')} AS pct90, {q6('max(CASE WHEN r = least(ceil(n / 4.0), n - 1) THEN v END)')} AS pct75 FROM o")
def quality_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = analyze.summarize(analyze.displacement(placed(spark, sf_dir), "Uni"))
    return s.select(r6(F.col("total")).alias("total"), r6(F.col("avg")).alias("avg"), "count", *(r6(F.col(c)).alias(c) for c in ("min", "max", "pct90", "pct75")))


# guides: the cells that hold the even sites of a partition; a site's own cell is the one that holds it
GUIDED = SITES + ", c AS (SELECT *, CAST(floor(x + 0.5) AS INT) AS cx, CAST(floor(y + 0.5) AS INT) AS cy FROM s), gd AS (SELECT DISTINCT partition_id, cx, cy FROM c WHERE site_id % 2 = 0), own AS (SELECT DISTINCT partition_id, cx, cy FROM c WHERE site_id % 3 <> 0)"


def _guided(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    s = sites(spark, sf_dir).withColumn("cell", G.containing_cell(F.col("x"), F.col("y"), grid("SQUARE")))
    key = ["map_id", "outline_id", "partition_id"]
    guide = s.where("site_id % 2 = 0").select(*key, "cell.x", "cell.y").distinct()
    own = s.where("site_id % 3 <> 0").select(*key, "cell.x", "cell.y").distinct()
    return s, guide, own


@query(f"WITH {GUIDED} SELECT partition_id, {q6('count(own.cx) / CAST(count(*) AS DOUBLE)')} AS value FROM gd LEFT JOIN own USING (partition_id, cx, cy) GROUP BY 1")
def guide_fit_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, guide, own = _guided(spark, sf_dir)
    return analyze.guide_fit_count(own, guide).select(F.col("id").alias("partition_id"), r6(F.col("value")).alias("value"))


@query(f"WITH {GUIDED} SELECT site_id, CAST(CASE WHEN EXISTS (SELECT 1 FROM gd h WHERE h.partition_id = c.partition_id) AND NOT EXISTS (SELECT 1 FROM gd WHERE gd.partition_id = c.partition_id AND gd.cx = c.cx AND gd.cy = c.cy) THEN 1 ELSE 0 END AS DOUBLE) AS value FROM c")
def site_guide_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, guide, _ = _guided(spark, sf_dir)
    return _measure(analyze.site_guide_miss(s, guide.select("map_id", "outline_id", "partition_id").distinct(), guide))


@query(f"WITH {SITES}, p AS (SELECT a.partition_id AS a, b.partition_id AS b, a.site_id AS sa, b.site_id AS sb, (a.x - b.x) ** 2 + (a.y - b.y) ** 2 AS d2 FROM s a JOIN s b ON a.partition_id < b.partition_id) SELECT a, b, sa, sb, {q6('d2')} AS d2 FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY d2, sa, sb) AS r FROM p) WHERE r = 1")
def nearest_site_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest sites of every two partitions."""
    s = sites(spark, sf_dir)
    parts = s.select("partition_id").distinct()
    pairs = parts.select(F.col("partition_id").alias("a")).join(parts.select(F.col("partition_id").alias("b")), F.col("a") < F.col("b"))
    left = pairs.join(s.select(F.col("partition_id").alias("a"), F.col("site_id").alias("sa"), "x", "y"), "a")
    right = pairs.join(s.select(F.col("partition_id").alias("b"), F.col("site_id").alias("sb"), F.col("x").alias("rx"), F.col("y").alias("ry")), "b")
    return spatial.nearest_pair(left, right, ["a", "b"], ["sa", "sb"]).select("a", "b", "sa", "sb", r6(F.col("d2")).alias("d2"))


@query(f"WITH {SITES}, m AS (SELECT partition_id, avg(x) AS x, avg(y) AS y FROM s GROUP BY 1), p AS (SELECT a.partition_id AS a, b.partition_id AS b, (a.x - b.x) ** 2 + (a.y - b.y) ** 2 AS d2 FROM m a JOIN m b ON a.partition_id <> b.partition_id) SELECT a, b, {q6('d2')} AS d2 FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d2, b) AS r FROM p) WHERE r = 1")
def nearest_centroid_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest other centroid of every partition's."""
    c = sites(spark, sf_dir).groupBy("map_id", F.col("partition_id").alias("a")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    return spatial.nearest_sites(c, 1, ["map_id"], "a").select("a", F.col("nbr").alias("b"), r6(F.col("d2")).alias("d2"))


@query(f"WITH {SITES}, b AS (SELECT min(x) AS l, max(x) AS r, min(y) AS o, max(y) AS t FROM s), f AS (SELECT site_id, (x - l) / (r - l) AS xf, (y - o) / (t - o) AS yf FROM s, b), h AS (SELECT site_id, floor((xf - floor(xf)) * 6) AS k, (xf - floor(xf)) * 6 - floor((xf - floor(xf)) * 6) AS f, 1 - yf * 0.8 AS b FROM f), q AS (SELECT *, b * 0.3 AS p, b * (1 - f * 0.7) AS q, b * (1 - (1 - f) * 0.7) AS t FROM h) SELECT site_id, CAST(floor(CASE k WHEN 0 THEN b WHEN 1 THEN q WHEN 2 THEN p WHEN 3 THEN p WHEN 4 THEN t ELSE b END * 255 + 0.5) AS INT) AS r, CAST(floor(CASE k WHEN 0 THEN t WHEN 1 THEN b WHEN 2 THEN b WHEN 3 THEN q ELSE p END * 255 + 0.5) AS INT) AS g, CAST(floor(CASE k WHEN 0 THEN p WHEN 1 THEN p WHEN 2 THEN t WHEN 3 THEN b WHEN 4 THEN b ELSE q END * 255 + 0.5) AS INT) AS b FROM q")
def color_ortho(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.color_sites(sites(spark, sf_dir)).select("site_id", "color.r", "color.g", "color.b")


@query(f"WITH p AS (SELECT p_partkey, (p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()) AS f FROM part) SELECT p_partkey, CAST(floor(140 + 114 * (1 - f) + 0.5) AS INT) AS r, CAST(floor(45 + 192 * (1 - f) + 0.5) AS INT) AS g, CAST(floor(4 + 218 * (1 - f) + 0.5) AS INT) AS b FROM p")
def quality_color(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices on the quality ramp, low is good."""
    p = _table(spark, sf_dir, "part")
    ends = p.agg(F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi"))  # one row
    c = C.quality_color(F.col("p_retailprice"), F.col("lo"), F.col("hi"), False)
    return p.crossJoin(ends).select("p_partkey", c.alias("c")).select("p_partkey", "c.r", "c.g", "c.b")


@query(f"WITH {SITES}, o AS (SELECT partition_id, (max(x) - min(x)) * (max(y) - min(y)) AS a FROM s GROUP BY 1) SELECT partition_id, CAST(floor(5 + coalesce((a - min(a) OVER ()) / nullif(max(a) OVER () - min(a) OVER (), 0), 0) * 95 + 0.5) AS INT) AS weight FROM o")
def weights_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = sites(spark, sf_dir).groupBy("partition_id").agg(F.min("x").alias("l"), F.min("y").alias("b"), F.max("x").alias("r"), F.max("y").alias("t")).select(F.lit("m").alias("map_id"), "partition_id", _box_ring().alias("ring"))
    return pipeline.area_weights(o, 5, 100).select("partition_id", F.col("custom_weight").alias("weight"))


@query("WITH w AS (SELECT c_nationkey AS k, sum(c_acctbal) AS v FROM customer GROUP BY 1) SELECT n_name AS label, CAST(floor(greatest(1.0, v * 0.001) + 0.5) AS INT) AS weight FROM nation JOIN w ON k = n_nationkey")
def weights_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.sum("c_acctbal").alias("value"))
    n = _table(spark, sf_dir, "nation").join(w, F.col("n_nationkey") == F.col("c_nationkey"), "left_semi").select(F.col("n_name").alias("label"), "n_nationkey")
    keyed = pipeline.table_weights(n, w.withColumnRenamed("c_nationkey", "key"), 0.001, F.col("n_nationkey"))
    return keyed.select("label", F.col("custom_weight").alias("weight"))


@query("WITH c AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) SELECT n_regionkey AS region, n_nationkey AS nation, CAST(CASE WHEN n_nationkey % 5 = 0 THEN 7 ELSE coalesce(n, 0) END AS INT) AS weight FROM nation LEFT JOIN c ON c_nationkey = n_nationkey")
def partition_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as partitions of regions with their customers as sites; every fifth has a weight of its own."""
    n = _table(spark, sf_dir, "nation")
    p = n.select(F.lit("m").alias("map_id"), F.col("n_regionkey").alias("outline_id"), F.col("n_nationkey").alias("partition_id"), F.when(F.col("n_nationkey") % 5 == 0, 7).otherwise(-1).alias("custom_weight"))
    c = _table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.lit("m").alias("map_id"), F.col("n_regionkey").alias("outline_id"), F.col("n_nationkey").alias("partition_id"))
    return dual.weights(p, c).select(F.col("outline_id").alias("region"), F.col("partition_id").alias("nation"), "weight")


@query("WITH e AS (SELECT DISTINCT l_partkey % 50 AS a, l_suppkey % 50 AS b FROM lineitem) SELECT least(a, b) AS a, greatest(a, b) AS b FROM e WHERE a <> b GROUP BY 1, 2")
def dedup_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of boundary positions without repeats or order."""
    e = _table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 50).cast("double").alias("start"), (F.col("l_suppkey") % 50).cast("double").alias("end"))
    return partition.distinct_cuts(e, []).select(F.col("start").cast("long").alias("a"), F.col("end").cast("long").alias("b"))


@query(f"WITH {SITES}, c AS (SELECT partition_id, CAST(floor(x + 0.5) AS INT) AS x, CAST(floor(y + 0.5) AS INT) AS y, count(*) AS n FROM s GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY partition_id ORDER BY n DESC, x, y) AS k FROM c) SELECT partition_id, x, y, CAST(n AS DOUBLE) AS area FROM r WHERE k <= 5")
def top_n_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five fullest cells of each partition, as a guide takes its best."""
    s = sites(spark, sf_dir)
    c = s.groupBy("partition_id", G.half_up(F.col("x")).alias("x"), G.half_up(F.col("y")).alias("y")).agg(F.count("*").cast("double").alias("area"))
    return cells.top_cells(c, ["partition_id"], s.select("partition_id").distinct().withColumn("n", F.lit(5)))


def _rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A unit square ring for every cell that holds a site, as partitions of one map."""
    c = sites(spark, sf_dir).select(G.half_up(F.col("x")).alias("x"), G.half_up(F.col("y")).alias("y")).distinct()
    tile = G.cell_boundary(F.col("x"), F.col("y"), grid("SQUARE"))
    return c.select(F.lit("m").alias("map_id"), F.col("x").alias("outline_id"), F.col("y").alias("partition_id"), tile.alias("ring"))


TILES = SITES + ", c AS (SELECT DISTINCT CAST(floor(x + 0.5) AS INT) AS x, CAST(floor(y + 0.5) AS INT) AS y FROM s)"


@query(f"WITH {TILES} SELECT a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by FROM c a JOIN c b ON abs(a.x - b.x) + abs(a.y - b.y) = 1 WHERE (a.x, a.y) < (b.x, b.y)")
def dual_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjoining unit squares: those that share an edge, not those that share a corner."""
    e = dual.dual_edges(_rings(spark, sf_dir))
    return e.select(F.col("p1.outline_id").alias("ax"), F.col("p1.partition_id").alias("ay"), F.col("p2.outline_id").alias("bx"), F.col("p2.partition_id").alias("by"))


@query(f"WITH RECURSIVE {TILES}, walk AS (SELECT x, y, x AS rx, y AS ry FROM c UNION SELECT c.x, c.y, w.rx, w.ry FROM walk w JOIN c ON abs(c.x - w.x) + abs(c.y - w.y) = 1) SELECT x, y, min((rx, ry))[1] AS rx, min((rx, ry))[2] AS ry FROM walk GROUP BY 1, 2")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest unit square reachable from each."""
    p = _rings(spark, sf_dir)
    c = dual.components(p, dual.dual_edges(p))
    return c.select(F.col("outline_id").alias("x"), F.col("partition_id").alias("y"), F.col("comp_id.outline_id").alias("rx"), F.col("comp_id.partition_id").alias("ry"))


@query("WITH l AS (SELECT event_id AS ln, event_type || chr(9) || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS line FROM events WHERE value IS NOT NULL) SELECT split_part(line, chr(9), 1) AS key, CAST(arg_max(split_part(line, chr(9), 2), ln) AS DOUBLE) AS value FROM l WHERE line NOT LIKE '#%' GROUP BY 1")
def weight_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A weight table from lines of text: the last line of each key counts."""
    e = _table(spark, sf_dir, "events").where("value is not null")
    return tsv.weight_map(e.select(F.col("event_id").alias("ln"), F.concat_ws("\t", "event_type", F.floor("value").cast("long").cast("string")).alias("line")))
