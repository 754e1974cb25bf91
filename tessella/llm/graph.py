"""Connected components by contraction, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def connected_components(edges: DataFrame) -> DataFrame:
    """The smallest node reachable from every node of undirected ``edges`` (src, dst): columns node, component.

    Each round maps a node to its smallest neighbour (or itself), follows these
    pointers twice, and replaces the edges by edges between the pointed-at nodes, so
    chains shrink at least fourfold and stars vanish at once. The smallest node of a
    component always keeps itself, hence the last node left is the component's id.
    Minima are combined before the shuffle; hub nodes are split by adaptive skew joins.

    Null ends are ignored; loops and repeated edges count once; nodes that only have
    loops aren't returned; no edges give an empty result.
    """
    e = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"), F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("src") != F.col("dst")))
    e = checkpointed(e.where(e[2]).select("u", "v").distinct())
    steps: list[DataFrame] = []
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        to = both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("p"))
        for _ in range(2):
            up = to.select(F.col("u").alias("p"), F.col("p").alias("pp"))
            to = to.join(up, "p").select("u", F.col("pp").alias("p"))
            to = checkpointed(to)
        steps.append(to)
        e = e.join(to, "u").select("v", F.col("p").alias("a")).join(to.withColumnRenamed("u", "v"), "v").select(F.greatest("a", "p").alias("u"), F.least("a", "p").alias("v"))
        e = checkpointed(e.where("u <> v").distinct())
    if not steps:
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    found = steps[0].select(F.col("u").alias("node"), F.col("p").alias("component"))
    for to in steps[1:]:
        found = found.join(to, found.component == to.u, "left").select("node", F.coalesce("p", "component").alias("component"))
    return found
