"""Dense positions along a global order, without sorting everything in one task.

A plain `row_number() over (order by ts)` moves every row to a single partition. Here the
order is cut into monotone buckets instead, for example day, then second of the day. Only
the bucket *counts* are summed up in order; rows are numbered inside their own bucket in
parallel. The counts that meet in one task are bounded by the calendar: at most 3.65
million days between the years 1 and 9999, 86,400 seconds in a day, and a million
distinct microseconds in a second.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def time_levels(ts: Column) -> list[Column]:
    """Day and second of day, read off the zone-free timestamp itself."""
    return [
        F.unix_date(ts.cast("date")),
        F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts),
    ]


def magnitude_levels(value: Column) -> list[Column]:
    """Monotone bucket of a non-negative score: 64 per doubling, so at most ~134,000 in all."""
    return [F.when(value > 0, F.floor(F.log2(value) * 64)).otherwise(F.lit(-1_000_000))]


def dense_position(
    df: DataFrame,
    order_by: Sequence[Column | str],
    levels: Sequence[Column],
    out: str,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Add `out` = 0, 1, 2, … in the order of `order_by`, separately for each key.

    `levels` must be monotone in the order, from coarse to fine.
    """
    keys = list(keys)
    names = [f"__level{i}" for i in range(len(levels))]
    # Never-NULL levels keep the branches below alike, so they share one exchange of `df`.
    tagged = df.withColumns({n: F.coalesce(level, F.lit(-1)) for n, level in zip(names, levels)})
    finest = tagged.groupBy(*keys, *names).agg(F.count(F.lit(1)).alias("__n"))

    offsets: DataFrame | None = None
    for depth, name in enumerate(names):
        outer = keys + names[:depth]
        counts = finest
        if depth + 1 < len(names):
            counts = finest.groupBy(*outer, name).agg(F.sum("__n").alias("__n"))
        before = Window.partitionBy(*outer).orderBy(name).rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.select(*outer, name, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
        if offsets is not None:
            base = offsets.withColumnRenamed("__start", "__base")
            counts = counts.join(base, outer).select(*outer, name, (F.col("__start") + F.col("__base")).alias("__start"))
        offsets = counts

    inside = Window.partitionBy(*keys, *names).orderBy(*order_by)
    numbered = tagged.withColumn("__rn", F.row_number().over(inside))
    return numbered.join(offsets, keys + names).select(
        *[f"`{c}`" for c in df.columns], (F.col("__start") + F.col("__rn") - 1).alias(out)
    )


def time_position(df: DataFrame, ts: str, out: str, keys: Sequence[str] = ()) -> DataFrame:
    """Position of each row on its time axis; `ts` must be unique per key and not NULL."""
    return dense_position(df, [F.col(ts)], time_levels(F.col(ts)), out, keys)
