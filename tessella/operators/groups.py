"""Kernels over many small groups: a group's rows are collected, and a batch of groups goes to Python at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..durable import dealt


def each_group(df: DataFrame, key: list[str], columns: list[str], run: Callable[..., list[tuple]], out: str, n: int = 0) -> DataFrame:
    """``key`` and the columns ``out`` (a schema) of the rows that ``run`` makes of each group's ``columns``, given as lists in one order.

    A call of a group costs little beside the call's work, where a batch for each group costs
    more than most small graphs do. One group is held whole, as in any grouped kernel. Groups are dealt to
    all shuffle partitions, as a kernel's work is far more than its rows' size would tell, and to more
    where the number ``n`` of rows is given and calls for it (see ``dealt``).
    """
    rows = dealt(df.select(*key, *columns), key, n).groupBy(*key).agg(F.collect_list(F.struct(*columns)).alias("_rows"))
    rows = rows.select(*key, *(F.col("_rows")[c].alias(f"_{i}") for i, c in enumerate(columns)))
    made = StructType.fromDDL(out)
    kinds = [to_arrow_type(f.dataType) for f in made]
    whole = StructType([*(df.schema[c] for c in key), *made])

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            lists = [b.column(len(key) + i) for i in range(len(columns))]
            flat = [c.flatten().to_pylist() for c in lists]
            sizes, at = pc.list_value_length(lists[0]).to_pylist(), 0
            owner, found = [], []
            for g, n in enumerate(sizes):
                got = run(*(c[at : at + n] for c in flat))
                owner += [g] * len(got)
                found += got
                at += n
            own = pa.array(owner, pa.int32())
            values = list(zip(*found, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(own) for i in range(len(key))), *(pa.array(v, k) for v, k in zip(values, kinds, strict=True))], names=whole.names)

    return rows.mapInArrow(batches, whole)
