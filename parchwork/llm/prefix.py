"""Running totals over a whole table in a given order, without a single-task window."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parchwork.llm.scratch import stash


def running_total(df: DataFrame, order: list[Column], value: str, out: str) -> DataFrame:
    """df with ``out``: the sum of ``value`` (long, not null) over all rows before a row in ``order``.

    Rows are range-partitioned and sorted; each partition sums on its own, is
    written to a table, and then gets the total of the partitions before it.
    Only one row for each partition meets in one task. ``order`` should end in
    columns that tell rows apart where it matters which comes first. df is
    computed twice (Spark samples it for the ranges), so pass a stored table.
    """
    names = df.columns
    schema = T.StructType([*df.schema, T.StructField("_part", T.IntegerType()), T.StructField(out, T.LongType())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            if batch.num_rows:
                values = batch.column(value).to_numpy(zero_copy_only=False).astype(np.int64)
                sums = np.cumsum(values) + before
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(np.full(len(values), part, np.int32)), pa.array(sums - values)],
                    [*names, "_part", out],
                )
                before = int(sums[-1])

    local = stash(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(add, schema), out.strip("_"))
    totals = local.groupBy("_part").agg(F.sum(value).alias("_own"))
    earlier = totals.select(
        F.col("_part"),
        F.coalesce(F.sum("_own").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_earlier"),
    )
    joined = local.join(F.broadcast(earlier), "_part")  # one row for each partition
    return joined.select(*names, (F.col(out) + F.col("_earlier")).alias(out))
