"""Exact interpolated quantiles without gathering or sorting a column in one task.

Equal values are counted once, and the counts are stored. A wanted rank is then closed in on: the
range it lies in is cut into equal parts, the parts are counted, and the part with the rank is the
next range, until it holds few values. Only those are put in order. Every step is an aggregation,
so one key may hold all rows; the result is the exact linear-interpolation quantile.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from stationweave.functions.names import clean_double, q
from stationweave.session import materialise, release

PARTS = 1024  # parts that a range is cut into
LAST = 10_000  # values of a range that are put in order together; any number gives the same result


def value_counts(rows: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """(keys, __v, __c): every present value with the rows that have it, stored. Quantiles, distinct values and moments all come from it."""
    present = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("__v"))
    return materialise(present.groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__c")))


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], keys: Sequence[str], last: int = LAST) -> DataFrame:
    """One row per key with `n` and `quantiles ARRAY<DOUBLE>` in the order of `probs`.

    Counting and closing in run at once, as jobs of their own; only the pick is left to the caller.
    """
    return quantiles_of(value_counts(df.withColumn(value, F.col(value).cast("double")), value, keys), probs, keys, last)


def quantiles_of(counts: DataFrame, probs: Sequence[float], keys: Sequence[str], last: int = LAST) -> DataFrame:
    """exact_quantiles from value_counts."""
    keys = list(keys)
    wanted = [float(p) for p in probs]
    sizes = counts.groupBy(*keys).agg(
        F.sum("__c").alias("n"), F.min("__v").alias("__low"), F.max("__v").alias("__high"), F.count(F.lit(1)).alias("__inside")
    )
    sides = F.array(*[F.expr(f"cast({side}({p!r}D * (n - 1)) as bigint)") for p in sorted(set(wanted)) for side in ("floor", "ceil")])
    # A range with all the ranks that lie in it: at first one for each key.
    ranges = materialise(sizes.select("*", F.lit(0).cast("long").alias("__before"), F.array_distinct(sides).alias("__ranks")))
    wide = (F.col("__low") < F.col("__high")) & (F.col("__inside") > last)
    while not ranges.where(wide).isEmpty():
        closer = _closer(counts, ranges.where(wide).withColumn("__rank", F.explode("__ranks")).drop("__ranks"), keys)
        together = [*keys, "n", "__low", "__high", "__inside", "__before"]
        narrowed = closer.groupBy(*together).agg(F.collect_set("__rank").alias("__ranks"))
        found = materialise(ranges.where(~wide).unionByName(narrowed))
        release(ranges)
        ranges = found
    near = _inside(counts, ranges, keys)
    upto = F.col("__before") + F.sum("__c").over(Window.partitionBy(*keys, "__low").orderBy("__v"))
    placed = near.withColumn("__upto", upto)
    held = F.filter("__ranks", lambda k: (k < F.col("__upto")) & (k >= F.col("__upto") - F.col("__c")))
    picked = placed.select(*keys, "n", "__v", F.explode(held).alias("__rank"))
    found = picked.groupBy(*keys, "n").agg(F.map_from_entries(F.collect_list(F.struct("__rank", "__v"))).alias("__at"))
    at = lambda side, p: f"element_at(__at, cast({side}({p!r}D * (n - 1)) as bigint))"
    exact = [f"{at('floor', p)} + ({at('ceil', p)} - {at('floor', p)}) * ({p!r}D * (n - 1) - floor({p!r}D * (n - 1)))" for p in wanted]
    return found.select(*keys, "n", F.expr(f"array({', '.join(exact)})").alias("quantiles"))


def _inside(counts: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """The counted values of each range."""
    if not keys:
        counts, ranges, keys = counts.withColumn("__one", F.lit(1)), ranges.withColumn("__one", F.lit(1)), ["__one"]
    return counts.join(ranges, keys).where(F.col("__v").between(F.col("__low"), F.col("__high")))


def _closer(counts: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Every range cut down to the part that holds its rank."""
    # Halved, so that a range from the least to the greatest double doesn't overflow.
    share = (F.col("__v") / 2 - F.col("__low") / 2) / (F.col("__high") / 2 - F.col("__low") / 2)
    part = F.least(F.floor(share * PARTS), F.lit(PARTS - 1)).alias("__part")
    parts = _inside(counts, ranges, keys).groupBy(*keys, "n", "__rank", "__before", part).agg(
        F.sum("__c").alias("__rows"), F.min("__v").alias("__low"), F.max("__v").alias("__high"), F.count(F.lit(1)).alias("__inside")
    )
    upto = F.sum("__rows").over(Window.partitionBy(*keys, "__rank").orderBy("__part"))  # at most PARTS rows
    ended = parts.withColumn("__upto", F.col("__before") + upto)
    held = ended.where("__upto > __rank and __upto - __rows <= __rank")
    return held.withColumn("__before", F.col("__upto") - F.col("__rows")).drop("__upto", "__rows", "__part")


def quantile_columns(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], keys: Sequence[str] = ()
) -> DataFrame:
    """Exact quantiles of several columns: one row per (key, column)."""
    return exact_quantiles(to_long(df, columns, keys), "value", probs, [*keys, "column"])


def to_long(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, column, value) with one row per present numeric cell."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), clean_double(q(c)).alias("value")) for c in columns])
    return (
        df.select(*[q(k) for k in keys], F.explode(cells).alias("__cell"))
        .select(*keys, "__cell.column", "__cell.value")
        .where(F.col("value").isNotNull())
    )

