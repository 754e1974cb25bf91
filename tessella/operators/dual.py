"""Which partitions adjoin, and the components they form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..durable import durable
from ..functions import geometry as G


def dual_edges(partitions: DataFrame, digits: int = 6) -> DataFrame:
    """Pairs of adjoining partitions of a map: map_id, p1 < p2 (structs of outline_id, partition_id).

    Two partitions adjoin when both consecutive vertices of some edge are vertices of both
    (to ``digits`` places); one common vertex isn't enough. Edges meet edges as undirected
    pairs of points in one equi-join.
    """
    p = F.struct("outline_id", "partition_id").alias("p")

    def at(end: str):
        return F.struct(F.round(F.col(f"e.{end}.x"), digits).alias("x"), F.round(F.col(f"e.{end}.y"), digits).alias("y"))

    e = partitions.select("map_id", p, F.explode(G.edges(F.col("ring"))).alias("e")).select("map_id", "p", F.least(at("a"), at("b")).alias("u"), F.greatest(at("a"), at("b")).alias("v")).where("u <> v").distinct()
    other = e.withColumnRenamed("p", "p2")
    return e.withColumnRenamed("p", "p1").join(other, ["map_id", "u", "v"]).where("p1 < p2").select("map_id", "p1", "p2").distinct()


def components(partitions: DataFrame, edges: DataFrame) -> DataFrame:
    """map_id, outline_id, partition_id and comp_id (the smallest (outline_id, partition_id) reachable) of every partition.

    Labels are replaced by the smallest neighbour's and then by that label's own label, so
    the rounds grow with the logarithm of a component's diameter; lineage is cut each round.
    """
    own = partitions.select("map_id", F.struct("outline_id", "partition_id").alias("p"))
    both = durable(edges.select("map_id", F.col("p1").alias("p"), F.col("p2").alias("q")).unionByName(edges.select("map_id", F.col("p2").alias("p"), F.col("p1").alias("q"))))
    label = durable(own.withColumn("c", F.col("p")))
    while True:
        near = both.join(label.select("map_id", F.col("p").alias("q"), F.col("c").alias("n")), ["map_id", "q"]).groupBy("map_id", "p").agg(F.min("n").alias("n"))
        low = label.join(near, ["map_id", "p"], "left").select("map_id", "p", "c", F.least("c", F.coalesce("n", "c")).alias("d"))
        hop = label.select("map_id", F.col("p").alias("d"), F.col("c").alias("dd"))
        new = durable(low.join(hop, ["map_id", "d"]).select("map_id", "p", F.least("d", "dd").alias("n"), (F.least("d", "dd") != F.col("c")).alias("changed")))
        changed = new.where("changed").limit(1).count()
        label = new.select("map_id", "p", F.col("n").alias("c"))
        if not changed:
            return label.select("map_id", F.col("p.outline_id").alias("outline_id"), F.col("p.partition_id").alias("partition_id"), F.col("c").alias("comp_id"))


def weights(partitions: DataFrame, sites: DataFrame) -> DataFrame:
    """weight of every partition: the custom one if above zero, else its number of sites."""
    n = sites.groupBy("map_id", "outline_id", "partition_id").agg(F.count("*").alias("_n"))
    return partitions.join(n, ["map_id", "outline_id", "partition_id"], "left").select("map_id", "outline_id", "partition_id", F.when(F.col("custom_weight") > 0, F.col("custom_weight")).otherwise(F.coalesce("_n", F.lit(0))).cast("int").alias("weight"))


def component_weights(comps: DataFrame, weighted: DataFrame) -> DataFrame:
    return comps.join(weighted, ["map_id", "outline_id", "partition_id"]).groupBy("map_id", "comp_id").agg(F.sum("weight").alias("weight"), F.count("*").alias("partitions"))
