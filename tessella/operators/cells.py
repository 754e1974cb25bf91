"""Sets of cells as rows (keys…, x, y): neighbours, set algebra, contact, local tests.

Neighbourhoods come from the grid's lookup table, which the grid's definition bounds
(some dozens of rows), so joining it is a broadcast of proven size; everything else is an
equi-join on keys and coordinates. Empty sets give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.grids import Grid, neighbour_table

KINDS = {"rook": ["rook"], "bishop": ["bishop"], "queen": ["rook", "bishop"]}


def contacts(cells: DataFrame, g: Grid, kind: str = "queen") -> DataFrame:
    """Each cell with each of its neighbours: columns of ``cells``, nx, ny, kind and ord (counter-clockwise)."""
    near = neighbour_table(cells.sparkSession, g).where(F.col("kind").isin(KINDS[kind])).withColumnRenamed("variant", "_v")
    return cells.withColumn("_v", G.variant(F.col("x"), g)).join(F.broadcast(near), "_v").withColumn("nx", F.col("x") + F.col("dx")).withColumn("ny", F.col("y") + F.col("dy")).drop("_v", "dx", "dy")


def _moved(cells: DataFrame, keys: list[str]) -> DataFrame:
    return cells.select(*keys, F.col("x").alias("nx"), F.col("y").alias("ny"))


def neighbours(cells: DataFrame, g: Grid, keys: list[str], kind: str = "rook") -> DataFrame:
    """Cells outside each set that touch it. A bishop neighbour touches by points only."""
    around = contacts(cells.select(*keys, "x", "y"), g, "queen").join(_moved(cells, keys), [*keys, "nx", "ny"], "left_anti")
    rook = F.max((F.col("kind") == "rook").cast("int")).alias("r")
    found = around.groupBy(*keys, F.col("nx").alias("x"), F.col("ny").alias("y")).agg(rook)
    return (found if kind == "queen" else found.where(F.col("r") == (1 if kind == "rook" else 0))).drop("r")


def union(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.select(*keys, "x", "y").unionByName(b.select(*keys, "x", "y")).distinct()


def intersection(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.select(*keys, "x", "y").distinct().join(b.select(*keys, "x", "y"), [*keys, "x", "y"], "left_semi")


def difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.select(*keys, "x", "y").distinct().join(b.select(*keys, "x", "y"), [*keys, "x", "y"], "left_anti")


def overlapping(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose two sets share a cell, with the number shared."""
    return intersection(a, b, keys).groupBy(*keys).agg(F.count("*").alias("shared"))


def overlaps(c: DataFrame, keys: list[str], part: str = "partition_id") -> DataFrame:
    """Pairs a < b of cell sets (guides, regions) of the same ``keys`` that share cells, with their number.

    Sets meet in a join on their cells, so only pairs that do share one are looked at.
    """
    own = c.select(*keys, part, "x", "y").distinct()
    a, b = (own.withColumnRenamed(part, n) for n in "ab")
    return a.join(b, [*keys, "x", "y"]).where("a < b").groupBy(*keys, "a", "b").agg(F.count("*").alias("shared"))


def touching(a: DataFrame, b: DataFrame, g: Grid, keys: list[str], kind: str = "rook") -> DataFrame:
    """Keys whose two sets share a cell or have neighbouring cells."""
    own = a.select(*keys, "x", "y")
    reach = own.unionByName(contacts(own, g, kind).select(*keys, F.col("nx").alias("x"), F.col("ny").alias("y")))
    return reach.join(b.select(*keys, "x", "y"), [*keys, "x", "y"], "left_semi").select(*keys).distinct()


def translate(cells: DataFrame, dx: Column | int, dy: Column | int, g: Grid) -> DataFrame:
    """Cells moved by a lattice offset; an offset that would change variants is an error."""
    if isinstance(dx, int):
        if dx % g.pc:
            raise ValueError(f"offset ({dx}, {dy}) changes the cells' variants")
        return cells.withColumn("x", F.col("x") + dx).withColumn("y", F.col("y") + dy)
    return cells.withColumn("x", F.when(F.pmod(dx, F.lit(g.pc)) == 0, F.col("x") + dx).otherwise(F.raise_error(F.lit("offset changes the cells' variants")).cast("int"))).withColumn("y", F.col("y") + dy)


def membership(cells: DataFrame, probe: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: how many probe cells there are, how many are in the set, and whether some, all or none are."""
    inside = cells.select(*keys, "x", "y").distinct().withColumn("_in", F.lit(1))
    counted = probe.select(*keys, "x", "y").distinct().join(inside, [*keys, "x", "y"], "left").groupBy(*keys).agg(F.count("*").alias("asked"), F.count("_in").alias("found"))
    return counted.withColumn("some", F.col("found") > 0).withColumn("all_", F.col("found") == F.col("asked")).withColumn("none_", F.col("found") == 0)


def edge_cells(cells: DataFrame, g: Grid, keys: list[str], kind: str = "rook") -> DataFrame:
    """Cells with a neighbour outside their set."""
    out = contacts(cells.select(*keys, "x", "y"), g, kind).join(_moved(cells, keys), [*keys, "nx", "ny"], "left_anti")
    return out.select(*keys, "x", "y").distinct()


def contiguous(cells: DataFrame, probe: DataFrame, g: Grid, keys: list[str], rook: bool = True) -> DataFrame:
    """Probe cells with ``runs``, the number of runs of set cells around them, and ``safe`` (exactly one run).

    Around means the counter-clockwise queen neighbours, cyclically; with ``rook`` a run
    counts only if it holds a rook neighbour. A cell is safe to take or leave when one run
    remains, as the set then neither falls apart nor closes around a hole there.
    """
    inside = _moved(cells, keys).distinct().withColumn("_in", F.lit(1))
    ringed = contacts(probe.select(*keys, "x", "y").distinct(), g, "queen").join(inside, [*keys, "nx", "ny"], "left")
    item = F.struct("ord", F.col("_in").isNotNull().alias("in"), (F.col("kind") == "rook").alias("rook"))
    listed = ringed.groupBy(*keys, "x", "y").agg(F.array_sort(F.collect_list(item)).alias("n"))  # one row per neighbour kind of a tile: bounded
    around = F.col("n")
    # start after an outside neighbour, so that no run wraps around
    gap = F.array_position(F.transform(around, lambda e: e["in"]), False).cast("int")
    turned = F.when(gap > 0, F.concat(F.slice(around, gap, F.size(around) - gap + 1), F.slice(around, F.lit(1), gap - 1))).otherwise(around)
    zero = F.struct(F.lit(0).alias("runs"), F.lit(False).alias("open"), F.lit(False).alias("rook"))

    def step(s: Column, e: Column) -> Column:
        # a run counts once: when it begins, or with ``rook`` at its first rook neighbour
        fresh = ~s["open"]
        counted = F.when(fresh, F.lit(False)).otherwise(s["rook"])
        adds = e["in"] & ~counted & (e["rook"] if rook else fresh)
        return F.struct((s["runs"] + adds.cast("int")).alias("runs"), e["in"].alias("open"), (e["in"] & (counted | adds)).alias("rook"))

    runs = F.aggregate(turned, zero, step, lambda s: s["runs"])
    return listed.select(*keys, "x", "y", runs.alias("runs")).withColumn("safe", F.col("runs") == 1)


def alleys(cells: DataFrame, g: Grid, keys: list[str], owner: str) -> DataFrame:
    """Free cells all but one of whose rook neighbours are taken, by at least two owners."""
    own = cells.select(*keys, owner, "x", "y")
    out = contacts(own, g, "rook").select(*keys, F.col("nx").alias("x"), F.col("ny").alias("y"), owner)
    free = out.join(own.select(*keys, "x", "y"), [*keys, "x", "y"], "left_anti")
    need = neighbour_table(cells.sparkSession, g).where("kind = 'rook'").groupBy(F.col("variant").alias("_v")).agg((F.count("*") - 1).alias("need"))
    taken = free.groupBy(*keys, "x", "y").agg(F.count("*").alias("taken"), F.countDistinct(owner).alias("owners"))
    return taken.withColumn("_v", G.variant(F.col("x"), g)).join(F.broadcast(need), "_v").where("taken = need and owners >= 2").select(*keys, "x", "y")


def adjacency_counts(cells: DataFrame, g: Grid, keys: list[str], owner: str, kind: str = "rook") -> DataFrame:
    """Number of touching cell pairs between every two owners: a < b, pairs."""
    own = cells.select(*keys, F.col(owner).alias("a"), "x", "y")
    other = cells.select(*keys, F.col(owner).alias("b"), F.col("x").alias("nx"), F.col("y").alias("ny"))
    return contacts(own, g, kind).join(other, [*keys, "nx", "ny"]).where("a < b").groupBy(*keys, "a", "b").agg(F.count("*").alias("pairs"))


def barycenters(cells: DataFrame, g: Grid, keys: list[str]) -> DataFrame:
    """Mean cell centroid (bx, by) of each set and the cell that holds it."""
    c = G.cell_centroid(F.col("x"), F.col("y"), g)
    mean = cells.select(*keys, c.alias("_c")).groupBy(*keys).agg(F.avg("_c.x").alias("bx"), F.avg("_c.y").alias("by"))
    return mean.withColumn("cell", G.containing_cell(F.col("bx"), F.col("by"), g))


def tile_error(cells: DataFrame, guide: DataFrame, keys: list[str]) -> DataFrame:
    """Per set: cells, guide cells, hits, size difference and symmetric difference, and the last over the guide's size (as a true quotient)."""
    a = cells.select(*keys, "x", "y", F.lit(1).alias("_a"))
    b = guide.select(*keys, "x", "y", F.lit(1).alias("_b"))
    both = a.join(b, [*keys, "x", "y"], "full").groupBy(*keys).agg(F.count("_a").alias("cells"), F.count("_b").alias("guide"), F.count(F.col("_a") + F.col("_b")).alias("hits"))
    sd = F.col("cells") + F.col("guide") - 2 * F.col("hits")
    return both.withColumn("size_error", F.abs(F.col("cells") - F.col("guide"))).withColumn("difference", sd).withColumn("relative", F.try_divide(sd.cast("double"), F.col("guide")))


def boxes(cells: DataFrame, keys: list[str]) -> DataFrame:
    return cells.groupBy(*keys).agg(F.min("x").alias("left"), F.min("y").alias("bottom"), F.max("x").alias("right"), F.max("y").alias("top"))


def extremes(cells: DataFrame, keys: list[str]) -> DataFrame:
    """The topmost cells of each set: leftmost and rightmost of the top row."""
    c = F.struct("x", "y")
    return cells.groupBy(*keys).agg(F.max_by(c, F.struct(F.col("y"), -F.col("x"))).alias("top_left"), F.max_by(c, F.struct("y", "x")).alias("top_right"))


def outline_edges(cells: DataFrame, g: Grid, keys: list[str]) -> DataFrame:
    """The boundary edges (ax, ay, bx, by) of each set: tile edges that occur once. Tiles must meet edge to edge."""
    tile = G.cell_boundary(F.col("x"), F.col("y"), g)
    e = cells.select(*keys, F.explode(G.edges(tile)).alias("e")).select(*keys, *(F.round(F.col(f"e.{p}.{c}"), 6).alias(f"{p}{c}") for p in "ab" for c in "xy"))
    swap = (F.col("ax") > F.col("bx")) | ((F.col("ax") == F.col("bx")) & (F.col("ay") > F.col("by")))
    line = [F.when(swap, F.col(o)).otherwise(F.col(n)).alias(f"_{n}") for n, o in (("ax", "bx"), ("ay", "by"), ("bx", "ax"), ("by", "ay"))]
    once = e.select("*", *line).groupBy(*keys, "_ax", "_ay", "_bx", "_by").agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("ax", "ay", "bx", "by"))).where("n = 1")
    return once.select(*keys, "ax", "ay", "bx", "by")


def top_cells(qualities: DataFrame, keys: list[str], counts: DataFrame) -> DataFrame:
    """The ``n`` cells of largest area of each key (ties by x, y); ``counts`` has n per key."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(F.desc("area"), "x", "y")
    return qualities.withColumn("_k", F.row_number().over(w)).join(counts, keys).where(F.col("_k") <= F.col("n")).drop("_k", "n")


def take_candidates(cells: DataFrame, guide: DataFrame, g: Grid, keys: list[str]) -> DataFrame:
    """Cells outside each set that rook-touch it and lie in its guide."""
    return neighbours(cells, g, keys).join(guide.select(*keys, "x", "y"), [*keys, "x", "y"], "left_semi")


def release_candidates(cells: DataFrame, guide: DataFrame, keys: list[str]) -> DataFrame:
    """Cells of each set that lie outside its guide."""
    return cells.select(*keys, "x", "y").join(guide.select(*keys, "x", "y"), [*keys, "x", "y"], "left_anti")


def lost_contacts(cells: DataFrame, g: Grid, keys: list[str], region: str) -> DataFrame:
    """Each cell of regions (``keys``, ``region``) with the number of regions with which its own would be in no contact without it."""
    near = contacts(cells.select(*keys, region, "x", "y"), g, "rook")
    other = cells.select(*keys, F.col(region).alias("_o"), F.col("x").alias("nx"), F.col("y").alias("ny"))
    met = near.join(other, [*keys, "nx", "ny"]).where(F.col("_o") != F.col(region)).select(*keys, region, "_o", "x", "y").distinct()
    alone = met.groupBy(*keys, region, "_o").agg(F.count("*").alias("_n"), F.min(F.struct("x", "y")).alias("_c")).where("_n = 1")
    lost = alone.groupBy(*keys, region, F.col("_c.x").alias("x"), F.col("_c.y").alias("y")).agg(F.count("*").alias("lost"))
    return cells.select(*keys, region, "x", "y").join(lost, [*keys, region, "x", "y"], "left").na.fill(0, ["lost"])
