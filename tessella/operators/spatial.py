"""Points in polygons, nearest neighbours and nearest pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..durable import dealt, durable
from ..functions import geometry as G


def locate(points: DataFrame, rings: DataFrame, point_keys: list[str], ring_key: str, by: list[str], order: str | None = None, tiles: int = 64) -> DataFrame:
    """Each point with the first ring (by ``order``) that holds it: columns of ``points`` and ``ring_key``, null where none does.

    The extent of each map is cut into at most ``tiles`` x ``tiles`` squares, about one for each ring or
    for each thousand points, whichever are more; a ring is sent to the squares its box meets, so points and rings meet in an equi-join, and
    the exact test runs on those pairs alone. Null coordinates are in no ring.
    """
    order = order or ring_key
    shapes = rings.select(*by, F.col(ring_key).alias("_id"), F.col(order).alias("_ord"), "ring").withColumn("_b", G.box(F.col("ring")))
    box = shapes.groupBy(*by).agg(F.min("_b.left").alias("_l"), F.min("_b.bottom").alias("_o"), F.max("_b.right").alias("_r"), F.max("_b.top").alias("_t"), F.count("*").alias("_n"))
    held = points.groupBy(*by).agg((F.count("*") / 1000).alias("_m"))
    side = F.least(F.lit(tiles), F.ceil(F.sqrt(F.greatest("_n", "_m")))).cast("int")
    extent = box.join(held, by).withColumn("_k", side).select(*by, "_l", "_o", "_k", ((F.col("_r") - F.col("_l")) / F.col("_k")).alias("_w"), ((F.col("_t") - F.col("_o")) / F.col("_k")).alias("_h"))

    def square(v: Column, low: str, size: str) -> Column:
        return F.greatest(F.lit(-1), F.least(F.col("_k"), F.coalesce(F.floor(F.try_divide(v - F.col(low), F.col(size))), F.lit(0)))).cast("int")

    placed = shapes.join(extent, by)
    cover = placed.withColumn("_x", F.explode(F.sequence(square(F.col("_b.left") - 1e-6, "_l", "_w"), square(F.col("_b.right") + 1e-6, "_l", "_w")))).withColumn("_y", F.explode(F.sequence(square(F.col("_b.bottom") - 1e-6, "_o", "_h"), square(F.col("_b.top") + 1e-6, "_o", "_h"))))
    cover = cover.select(*by, "_x", "_y", "_id", "_ord", "ring", "_b")
    asked = points.select(*dict.fromkeys([*point_keys, *by]), "x", "y").join(extent, by).withColumn("_x", square(F.col("x"), "_l", "_w")).withColumn("_y", square(F.col("y"), "_o", "_h"))
    pairs = asked.join(cover, [*by, "_x", "_y"]).where("x >= _b.left - 1e-6 and x <= _b.right + 1e-6 and y >= _b.bottom - 1e-6 and y <= _b.top + 1e-6")
    hits = pairs.where(G.contains(F.col("ring"), F.col("x"), F.col("y")))
    first = hits.groupBy(*point_keys).agg(F.min_by("_id", F.struct("_ord", "_id")).alias(ring_key))
    return points.drop(ring_key).join(first, point_keys, "left")


def nearest_sites(sites: DataFrame, k: int, by: list[str], key: str = "site_id", keep: list[str] | None = None) -> DataFrame:
    """The k nearest other sites of each site (ties to the smaller key): by, key, nbr, rank and d2, and ``keep`` columns of both (nbr_…).

    ``k = 0`` means all others, below zero none. Sites are put into squares of about k
    sites each and meet those of the squares around them; a site whose k-th distance
    reaches beyond these meets wider rings of squares, and all of its map if even nine
    squares each way are too few. The result is exact.
    """
    keep = keep or []
    own = sites.select(*by, key, "x", "y", *keep).where("x is not null and y is not null")
    other = own.select(*by, F.col(key).alias("nbr"), F.col("x").alias("nbr_x"), F.col("y").alias("nbr_y"), *(F.col(c).alias(f"nbr_{c}") for c in keep))
    d2 = (F.col("nbr_x") - F.col("x")) ** 2 + (F.col("nbr_y") - F.col("y")) ** 2
    w = Window.partitionBy(*by, key).orderBy("d2", "nbr")
    if k < 0:
        return own.join(other, by).where("false").withColumn("d2", d2).withColumn("rank", F.lit(0))
    if k == 0:
        return own.join(other, by).where(F.col(key) != F.col("nbr")).withColumn("d2", d2).withColumn("rank", F.row_number().over(w))
    own = durable(own)  # read several times
    n = own.count()
    other = own.select(*by, F.col(key).alias("nbr"), F.col("x").alias("nbr_x"), F.col("y").alias("nbr_y"), *(F.col(c).alias(f"nbr_{c}") for c in keep))
    stats = own.groupBy(*by).agg(F.count("*").alias("_n"), F.min("x").alias("_l"), F.min("y").alias("_o"), F.max("x").alias("_r"), F.max("y").alias("_t"))
    side = F.sqrt(F.greatest((F.col("_r") - F.col("_l")) * (F.col("_t") - F.col("_o")), F.lit(1e-12)) * float(k) / F.col("_n"))
    span = F.greatest(F.col("_r") - F.col("_l"), F.col("_t") - F.col("_o"), F.lit(1e-9))
    stats = stats.select(*by, "_n", "_l", "_o", F.greatest(side, span / 4096).alias("_s"))

    def put(df: DataFrame, x: str, y: str) -> DataFrame:
        return df.join(stats, by).withColumn("_bx", F.floor((F.col(x) - F.col("_l")) / F.col("_s")).cast("int")).withColumn("_by", F.floor((F.col(y) - F.col("_o")) / F.col("_s")).cast("int"))

    def ring(asked: DataFrame, reach: int) -> DataFrame:
        """``asked`` and the k nearest within ``reach`` squares (near), or null where a site further off can change them.

        At first the others go to the squares around them, so an asked site finds all in its own square and their pairs
        stay in its task. Later few sites are asked, and these go around instead.
        """
        low, high = (lambda c, b, o: F.col(c) - F.col(o) - (F.col(b) - reach) * F.col("_s")), (lambda c, b, o: F.col(o) + (F.col(b) + reach + 1) * F.col("_s") - F.col(c))
        gap = F.least(low("x", "_bx", "_l"), high("x", "_bx", "_l"), low("y", "_by", "_o"), high("y", "_by", "_o"))
        mine = put(asked, "x", "y").withColumn("_gap", gap).drop("_l", "_o", "_s")
        step = F.sequence(F.lit(-reach), F.lit(reach))
        square, first = [*by, "_bx", "_by"], reach == 1

        def around(df: DataFrame) -> DataFrame:
            return df.withColumn("_i", F.explode(step)).withColumn("_j", F.explode(step)).withColumn("_bx", F.col("_bx") + F.col("_i")).withColumn("_by", F.col("_by") + F.col("_j")).drop("_i", "_j")

        theirs = put(other, "nbr_x", "nbr_y").drop("_n", "_l", "_o", "_s")
        a, b = (mine, around(theirs)) if first else (around(mine), theirs)
        sent = 9 * n if first else n + asked.count() * (2 * reach + 1) ** 2
        pairs = dealt(a, square, sent, 50_000).hint("shuffle_merge").join(dealt(b, square, sent, 50_000), square).where(F.col(key) != F.col("nbr")).withColumn("d2", d2)
        place = [*square, key] if first else [*by, key]
        ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy(*place).orderBy("d2", "nbr"))).where(F.col("rank") <= k)
        found = ranked.groupBy(*place).agg(F.collect_list(F.struct("nbr", "rank", "d2", "nbr_x", "nbr_y", *(f"nbr_{c}" for c in keep))).alias("_near"), F.max("d2").alias("_far"), F.first("_gap").alias("_gap"), F.first("_n").alias("_n"), *(F.first(c).alias(c) for c in ("x", "y", *keep)))
        enough = (F.size("_near") == F.least(F.lit(k), F.col("_n") - 1)) & (F.sqrt("_far") <= F.col("_gap"))
        return found.select(*by, key, "x", "y", *keep, F.when(enough, F.col("_near")).alias("_near"))

    def rows(found: DataFrame) -> DataFrame:
        return found.where("_near is not null").withColumn("_e", F.explode("_near")).select(*by, key, "x", "y", *keep, *(F.col(f"_e.{c}").alias(c) for c in ("nbr", "nbr_x", "nbr_y", *(f"nbr_{c}" for c in keep), "d2", "rank")))

    found = durable(ring(own, 1))
    done = rows(found)
    rest = durable(own.join(found.where("_near is not null").select(*by, key), [*by, key], "left_anti"))
    for reach in (3, 9):  # each ring of squares is three times as wide
        if rest.isEmpty():
            return done
        found = durable(ring(rest, reach))
        done = done.unionByName(rows(found))
        rest = durable(rest.join(found.where("_near is not null").select(*by, key), [*by, key], "left_anti"))
    if rest.isEmpty():
        return done
    far = rest.join(other, by).where(F.col(key) != F.col("nbr")).withColumn("d2", d2)
    far = far.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return done.unionByName(far.select(*done.columns))


def nearest_pair(left: DataFrame, right: DataFrame, by: list[str], order: list[str], sample: int = 64) -> DataFrame:
    """Per key the nearest pair of a left point (x, y) and a right point (rx, ry), first by ``order`` among ties: all columns and d2.

    The ``sample`` left points and right points next to the middle between the two sides give
    a distance that the nearest pair can't exceed. Squares of that side then hold all pairs
    that matter, so points only meet those of the squares around them. Exact.
    """
    names = [c for c in dict.fromkeys([*left.columns, *right.columns]) if c not in by]
    d2 = (F.col("rx") - F.col("x")) ** 2 + (F.col("ry") - F.col("y")) ** 2
    ends = left.groupBy(*by).agg(F.avg("x").alias("_lx"), F.avg("y").alias("_ly")).join(right.groupBy(*by).agg(F.avg("rx").alias("_rx"), F.avg("ry").alias("_ry")), by)
    middle = ends.select(*by, ((F.col("_lx") + F.col("_rx")) / 2).alias("_mx"), ((F.col("_ly") + F.col("_ry")) / 2).alias("_my"))

    def close(df: DataFrame, x: str, y: str) -> DataFrame:
        off = (F.col(x) - F.col("_mx")) ** 2 + (F.col(y) - F.col("_my")) ** 2
        w = Window.partitionBy(*by).orderBy(off, x, y)
        return df.join(middle, by).withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= sample).select(*by, x, y)

    bound = close(left, "x", "y").join(close(right, "rx", "ry"), by).groupBy(*by).agg((F.sqrt(F.min(d2)) * (1 + 1e-9)).alias("_d"))
    extent = left.groupBy(*by).agg(F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("_e"))
    side = bound.join(extent, by).select(*by, F.greatest("_d", F.col("_e") / 1e6, F.lit(1e-9)).alias("_s"))
    near = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    a = left.join(side, by).withColumn("_q", F.explode(near)).withColumn("_bx", F.floor(F.col("x") / F.col("_s")) + F.col("_q.i")).withColumn("_by", F.floor(F.col("y") / F.col("_s")) + F.col("_q.j")).drop("_q", "_s")
    b = right.join(side, by).withColumn("_bx", F.floor(F.col("rx") / F.col("_s"))).withColumn("_by", F.floor(F.col("ry") / F.col("_s"))).drop("_s")
    pairs = a.join(b, [*by, "_bx", "_by"]).withColumn("d2", d2)
    return pairs.groupBy(*by).agg(F.min_by(F.struct(*names, "d2"), F.struct("d2", *order)).alias("_m")).select(*by, "_m.*")


def nearest_partitions(partitions: DataFrame, component: str, by: list[str]) -> DataFrame:
    """For every two components (a < b) of a map the partitions nearest by polygon distance: a, b, pa, pb, distance."""
    own = partitions.select(*by, F.col(component).alias("a"), F.struct("outline_id", "partition_id").alias("pa"), F.col("ring").alias("_ra"))
    other = partitions.select(*by, F.col(component).alias("b"), F.struct("outline_id", "partition_id").alias("pb"), F.col("ring").alias("_rb"))
    pairs = own.join(other, by).where("a < b").withColumn("distance", G.ring_distance(F.col("_ra"), F.col("_rb")))
    return pairs.groupBy(*by, "a", "b").agg(F.min_by(F.struct("pa", "pb", "distance"), F.struct("distance", "pa", "pb")).alias("_m")).select(*by, "a", "b", "_m.*")
