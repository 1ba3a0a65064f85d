"""Places of rows in a global order, counted without one task that sees them all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import settle, small


def numbered(df: DataFrame, group: str, order: Sequence[Column]) -> DataFrame:
    """All columns, with place (from 0) and size (long, rows of the group) added, settled.

    order sorts the table so that the rows of a group stand together; group is never null. Rows are dealt
    by ranges of the order, ties by the place they were read at, so a group or a value that most rows share
    is split. A row's place is its place in its range and the rows of the group in the ranges before, of
    which there are no more than tasks.
    """
    read = df.withColumn("_read", F.monotonically_increasing_id())
    ranged = read.repartitionByRange(*order, F.col("_read")).sortWithinPartitions(*order, F.col("_read")).drop("_read")
    stored = settle(ranged.select("*", F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().alias("_row")))
    pieces = stored.groupBy(group, "_range").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    whole = Window.partitionBy(group)
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts, _ = small(pieces.select(group, "_range", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(whole).alias("size")))
    placed = stored.join(starts, [group, "_range"]).withColumn("place", F.col("_row") + F.col("_shift"))
    return placed.drop("_range", "_row", "_shift")
