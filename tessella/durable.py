"""Cutting lineage in a way that survives lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def dealt(df: DataFrame, keys: list[str], rows: int, each: int = 500_000) -> DataFrame:
    """``df`` hashed by ``keys`` into tasks of about ``each`` of its ``rows`` rows, no fewer than the session's shuffle partitions.

    Adaptive execution merges partitions by their compressed bytes. Small keys in order compress to a
    few bytes a row, so a merged task may have to sort many times what its bytes tell.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(tasks, -(-rows // each)), *keys)


def durable(df: DataFrame) -> DataFrame:
    """``df`` kept in the folder named by spark.checkpoint.dir, which the cluster shares.

    A plan that has passed many joins is cut here; a lost executor costs nothing, as any
    other can read the files. It is a written table rather than ``checkpoint()``, which keeps
    the plan's estimated size: in loops that estimate multiplies until planning itself fails.
    A local session without the setting gets a temporary folder.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tessella-")
        spark.sparkContext.setCheckpointDir(folder)
    path = f"{folder.rstrip('/')}/tessella/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)
