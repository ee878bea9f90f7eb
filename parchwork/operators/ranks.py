"""Places in an order over a whole table, without a task that sees all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchwork.plans import shared_folder

#: monotonically_increasing_id puts the partition's number above so many bits and the row's number below.
_ROW_BITS = 33


def with_place(rows: DataFrame, order: list[Column], out: str) -> DataFrame:
    """rows with ``out``: the place in the order, from 1.

    Rows are range-partitioned and sorted, numbered within their partition and
    written to a table once; then each gets the number of rows in the
    partitions before its own. One row for each partition meets in one task.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    ranged = ranged.withColumn("_part", F.shiftright("_at", _ROW_BITS)).withColumn("_at", F.col("_at").bitwiseAND((1 << _ROW_BITS) - 1))
    numbered = shared_folder.stored(ranged, "places")
    sizes = numbered.groupBy("_part").agg(F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = numbered.join(F.broadcast(sizes.select("_part", before.alias("_before"))), "_part")  # one row for each partition
    return placed.select(*rows.columns, (F.col("_before") + F.col("_at") + 1).alias(out))
