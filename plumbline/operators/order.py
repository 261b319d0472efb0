"""A global order with row numbers, without a one-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import cut_lineage

_ROW_BITS = 33  # monotonically_increasing_id holds the row of a partition in its lower 33 bits


def numbered(df: DataFrame, order: list[str | Column], column: str = "position") -> DataFrame:
    """Add the place of each row in the order of ``order``, from 1; rows come back sorted, nulls first.

    Range partitions are sorted one by one and checkpointed, so that their borders stay as they are. They are counted, and a
    row's place is its place in its partition behind the rows of those before. One small row per partition reaches the
    driver. ``order`` should be unique; otherwise the places among equal rows are any.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    kept = cut_lineage(ranged)
    placed = kept.withColumn("_id", F.monotonically_increasing_id())
    part = F.shiftright("_id", _ROW_BITS)
    counts = dict(placed.groupBy(part).count().collect())
    before, upto = [], 0
    for k in range(max(counts, default=-1) + 1):
        before.append(upto)
        upto += counts.get(k, 0)
    offsets = F.array(*[F.lit(n).cast("bigint") for n in before]) if before else F.array(F.lit(0).cast("bigint"))
    row = F.col("_id").bitwiseAND((1 << _ROW_BITS) - 1)
    return placed.withColumn(column, F.get(offsets, part.cast("int")) + row + 1).drop("_id")
