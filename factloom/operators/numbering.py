"""Numbers in a total order, without sending all rows through one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.storage import stored


def number_rows(df: DataFrame, order: list[Column | str], name: str = "n") -> DataFrame:
    """Consecutive numbers from 0 in the given order: rows are range-sorted, counted by partition, and numbered from the counts before.

    The rows are stored between the two passes, so that both see the same partitions and rows that tie keep their places even if an executor
    is lost; the table of counts has a row per partition.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at"))
    placed = stored(placed, "numbered")
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_k"))
    before = counts.select("_part", (F.sum("_k").over(W.orderBy("_part")) - F.col("_k")).alias("_before"))
    # the upper bits of _at are the partition, the lower 33 the place in it
    out = placed.join(before, "_part").withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    return out.drop("_part", "_at", "_before")


def running_sum(df: DataFrame, order: list[Column | str], value: str, name: str = "sum") -> DataFrame:
    """The sum of a long column up to each row in the given order, without sending all rows through one task: rows are range-sorted and stored
    with the sums within their partition; a partition adds what those before it come to, one row each."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        so_far = 0
        for b in batches:
            sums = so_far + np.cumsum(b.column(value).to_numpy(zero_copy_only=False))
            so_far = int(sums[-1]) if len(sums) else so_far
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sums, pa.int64())], names=[*b.schema.names, name])

    from pyspark.sql.types import LongType, StructType

    summed = placed.mapInArrow(add, StructType([*df.schema.fields]).add(name, LongType()))
    summed = stored(summed.withColumn("_part", F.spark_partition_id()), "sums")
    totals = summed.groupBy("_part").agg(F.sum(value).alias("_total"))
    before = totals.select("_part", (F.sum("_total").over(W.orderBy("_part")) - F.col("_total")).alias("_before"))
    return summed.join(before, "_part").withColumn(name, F.col(name) + F.col("_before")).drop("_part", "_before")
