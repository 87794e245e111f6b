"""Dense row numbers, running totals and size-checked broadcasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placelab.session import materialize

BROADCAST_ROWS = 100_000
_PART_BITS = 33


def _ranged(df: DataFrame, order: tuple[str | Column, ...]) -> DataFrame:
    """Sorted range partitions with their number ``_part`` and the 0-based place ``_pos`` inside.

    Written out at once: a task that is run again cannot land on other numbers.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    marked = ranged.withColumn("_mid", F.monotonically_increasing_id())
    return materialize(
        marked.withColumn("_part", F.shiftright("_mid", _PART_BITS))
        .withColumn("_pos", F.col("_mid").bitwiseAND((1 << _PART_BITS) - 1))
        .drop("_mid")
    )


def _shift_by_earlier_parts(ranged: DataFrame, amount: Column) -> DataFrame:
    """Add ``_before``: the sum of ``amount`` over all earlier partitions.

    The table of sums has one row per shuffle partition, whatever the data size.
    """
    sums = ranged.groupBy("_part").agg(F.sum(amount).alias("_sum"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    return ranged.join(F.broadcast(offsets), "_part")


def with_row_id(df: DataFrame, *order: str | Column, name: str = "row_id") -> DataFrame:
    """Add a dense 0-based number that follows ``order``, which has to be unique. One shuffle."""
    shifted = _shift_by_earlier_parts(_ranged(df, order), F.lit(1))
    return shifted.withColumn(name, F.col("_pos") + F.col("_before")).drop("_part", "_pos", "_before")


def with_running_total(df: DataFrame, value: str, *order: str | Column, name: str = "running_total") -> DataFrame:
    """Add the running sum of ``value`` along ``order`` without a single-task global window."""
    shifted = _shift_by_earlier_parts(_ranged(df, order), F.col(value))
    inside = Window.partitionBy("_part").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    return shifted.withColumn(name, F.sum(value).over(inside) + F.col("_before")).drop("_part", "_pos", "_before")


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint only when ``df`` is counted to hold at most ``limit`` rows."""
    if df.limit(limit + 1).count() <= limit:
        return F.broadcast(df)
    return df
