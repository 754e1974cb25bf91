"""Shared helpers: table access, the shared scratch folder, Arrow column access."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Only a local-mode session may lack the setting (tests, notebooks); it then gets
    a temporary folder, since driver and executors are one process there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tessella-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut, kept in the shared folder.

    A written table rather than ``checkpoint()``: the latter keeps the plan's estimated
    size, which multiplies with every join of a loop until planning itself fails.
    """
    return stored(df, "step")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and reread (columnar, so later reads prune columns)."""
    path = f"{shared_dir(df.sparkSession)}/tessella/{name}-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", 16 << 20).parquet(path)  # small row groups: writers hold one in memory
    out = df.sparkSession.read.parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing will read again."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, size: str = "4m") -> None:
    """Hand texts to Python by ``size`` bytes, unless the session has a bound of its own.

    By default a batch has up to 64 MB: the JVM holds it outside its heap, its vectors doubled as they grow, and the worker once more, for each task.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in spark.conf.getAll:
        spark.conf.set(key, size)


def found_in(df: DataFrame, small: DataFrame, keys: list[str], limit: int = 1_000_000) -> DataFrame:
    """The rows of ``df`` whose keys are in ``small`` (a stored table): where they lie if it has at most ``limit`` rows, which bounds the broadcast, else by a shuffle."""
    return df.join(F.broadcast(small) if small.count() <= limit else small, keys, "left_semi")


def utf8(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column's cells, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def kept_rows(docs: DataFrame, text_col: str, flag: Column, keep: Callable[[list[bytes], list[bool]], list[bool]]) -> DataFrame:
    """The rows of ``docs``, all columns, that ``keep`` (texts, flags) retains; rows stay where they are, so nothing is shuffled."""
    schema = StructType([StructField("row", docs.schema)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1000, "row", 4 << 20):
            row = batch.column(0)
            good = keep(utf8(pc.struct_field(row, [text_col])), batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([row.filter(pa.array(good, pa.bool_()))], ["row"])

    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), flag.alias("flag"))
    return whole.mapInArrow(run, schema).select("row.*")


def slices(batches: Iterator[pa.RecordBatch], rows: int, column: str | None = None, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into slices of at most ``rows`` rows and, given a binary or string column, about ``size`` bytes."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            n = min(rows, batch.num_rows - at)
            if column is not None:
                while n > 1 and batch.column(column).slice(at, n).nbytes > size:
                    n = (n + 1) // 2
            yield batch.slice(at, n)
            at += n


def by_group(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 100_000) -> Iterator[pa.Table]:
    """Regroup the batches of a partition sorted by ``keys`` so that no group is cut; tables hold about ``rows`` rows or one group."""
    def same(t: pa.Table, i: int, j: int) -> bool:
        return all(t.column(k)[i].as_py() == t.column(k)[j].as_py() for k in keys)

    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        last = t.num_rows - 1
        lo, hi = 0, last  # the first row of the last group, by bisection: rows are sorted
        while lo < hi:
            mid = (lo + hi) // 2
            if same(t, mid, last):
                hi = mid
            else:
                lo = mid + 1
        if lo:
            yield t.slice(0, lo)
        held = t.slice(lo).to_batches()
        n = sum(b.num_rows for b in held)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
