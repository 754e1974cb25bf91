"""Tables of a map and the stages it goes through.

Every object is keyed by (map_id, outline_id, partition_id or site_id); ``ord`` columns
keep an order where it matters. A stage is a new frame bundle: reverting to a stage means
using the earlier bundle or ``TileMap.at``.
"""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession

INPUT, PARTITIONED, DEFORMED, ASSIGNED = 1, 2, 4, 8
ALL_STAGES = INPUT | PARTITIONED | DEFORMED | ASSIGNED

POINT = "struct<x:double,y:double>"
COLOR = "struct<r:int,g:int,b:int>"
CELL = "struct<x:int,y:int>"
RING = f"array<{POINT}>"
SCHEMAS = {
    "maps": "map_id string, stage int, grid string",
    "outlines": f"map_id string, outline_id int, label string, label_pt {POINT}, color {COLOR}, ring {RING}, custom_weight int",
    "sites": f"map_id string, outline_id int, site_id int, label string, x double, y double, color {COLOR}, layer string, partition_id int, cell {CELL}",
    "partitions": f"map_id string, outline_id int, partition_id int, label string, label_pt {POINT}, color {COLOR}, ring {RING}, custom_weight int",
    "cells": "map_id string, outline_id int, partition_id int, x int, y int, ord int",
    "guides": "map_id string, outline_id int, partition_id int, factor double, tx double, ty double, quality double",
    "guide_cells": "map_id string, outline_id int, partition_id int, x int, y int, ord int",
    "cell_quality": "map_id string, outline_id int, partition_id int, x int, y int, area double",
}
PARTITION_KEY = ["map_id", "outline_id", "partition_id"]


@dataclass
class TileMap:
    """One or more maps as DataFrames; tables of stages not reached are empty."""

    maps: DataFrame
    outlines: DataFrame
    sites: DataFrame
    partitions: DataFrame
    cells: DataFrame
    guides: DataFrame
    guide_cells: DataFrame
    cell_quality: DataFrame

    @classmethod
    def empty(cls, spark: SparkSession) -> TileMap:
        return cls(**{name: spark.createDataFrame([], schema) for name, schema in SCHEMAS.items()})

    @classmethod
    def of(cls, spark: SparkSession, **tables: DataFrame) -> TileMap:
        return replace(cls.empty(spark), **tables)

    def with_(self, **tables: DataFrame) -> TileMap:
        return replace(self, **tables)

    def staged(self, stage: int, grid: str | None = None) -> TileMap:
        """This map with its stage (and grid) set."""
        from pyspark.sql import functions as F

        maps = self.maps.withColumn("stage", F.lit(stage))
        return self.with_(maps=maps.withColumn("grid", F.lit(grid)) if grid else maps)

    def at(self, stage: int) -> TileMap:
        """This map without what stages after ``stage`` have added."""
        from pyspark.sql import functions as F

        none = TileMap.empty(self.sites.sparkSession)
        out = self
        if stage < ASSIGNED:
            out = out.with_(sites=out.sites.withColumn("cell", F.lit(None).cast(CELL)))
        if stage < DEFORMED:
            out = out.with_(cells=none.cells, guides=none.guides, guide_cells=none.guide_cells, cell_quality=none.cell_quality, maps=out.maps.withColumn("grid", F.lit(None).cast("string")))
        if stage < PARTITIONED:
            out = out.with_(partitions=none.partitions, sites=out.sites.withColumn("partition_id", F.lit(None).cast("int")))
        return out.with_(maps=out.maps.withColumn("stage", F.least("stage", F.lit(stage))))

    def require(self, stage: int) -> None:
        """Raise unless every map has reached ``stage``."""
        low = self.maps.where(self.maps["stage"] < stage).limit(1).collect()
        if low:
            raise ValueError(f"map {low[0].map_id!r} is at stage {low[0].stage}; stage {stage} is needed")

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}
