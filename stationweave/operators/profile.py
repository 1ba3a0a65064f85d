"""Column statistics and correlations of a readings frame."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from stationweave.functions.names import clean_double, q
from stationweave.functions.quantiles import quantiles_of, to_long, value_counts
from stationweave.session import config_table


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [
        f.name
        for f in df.schema
        if f.name not in exclude and isinstance(f.dataType, T.NumericType)
    ]


def column_profile(df: DataFrame, exclude: Sequence[str] = (), stage: str | None = None) -> DataFrame:
    """One row per column: type, counts, shares, exact distinct values, mean, median, min, max.

    Values are counted once per (column, value) across the cluster; presence, distinct values, moments and
    the exact median of all columns come from these counts, and the rows are read for nothing else.
    """
    columns = [c for c in df.columns if c not in exclude]
    if not columns:
        raise ValueError("there is no column to describe")
    numeric = [c for c in columns if c in numeric_columns(df, exclude)]
    texts = [c for c in columns if c not in numeric]
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    nothing = F.lit(None).cast("double")
    found = []
    if numeric:
        # Adding zero makes -0.0 and 0.0 one value.
        counts = value_counts(to_long(df, numeric).withColumn("value", F.col("value") + 0.0), "value", ["column"])
        sums = counts.groupBy("column").agg(
            F.sum("__c").alias("present_count"),
            F.count(F.lit(1)).alias("unique"),
            (F.sum(F.col("__v") * F.col("__c")) / F.sum("__c")).alias("mean"),
            F.min("__v").alias("min"),
            F.max("__v").alias("max"),
        )
        medians = quantiles_of(counts, [0.5], ["column"]).select("column", F.element_at("quantiles", 1).alias("median"))
        found.append(sums.join(medians, "column"))
    if texts:
        cells = F.array(*[F.struct(F.lit(c).alias("column"), q(c).cast("string").alias("value")) for c in texts])
        values = df.select(F.explode(cells).alias("__c")).select("__c.*").where(F.col("value").isNotNull())
        counted = values.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
        sums = counted.groupBy("column").agg(F.sum("n").alias("present_count"), F.count(F.lit(1)).alias("unique"))
        found.append(sums.select("*", *[nothing.alias(m) for m in ("mean", "min", "max", "median")]))
    described = config_table(df.sparkSession, [(c, kinds[c]) for c in columns], "column string, dtype string")
    rows = df.select(F.lit(1)).agg(F.count(F.lit(1)).alias("row_count"))
    # One row of the count beside one row a column.
    base = described.join(reduce(DataFrame.unionByName, found), "column", "left").withColumn("row_count", rows.scalar())
    present = F.coalesce("present_count", F.lit(0))
    share = lambda n: F.coalesce(F.try_divide(n * 100.0, F.col("row_count")), F.lit(0.0))
    missing = F.col("row_count") - present
    final = base.select(
        "column",
        "dtype",
        "row_count",
        present.alias("present_count"),
        missing.alias("missing_count"),
        share(present).alias("present_pct_of_all_rows"),
        share(missing).alias("missing_pct_of_all_rows"),
        F.coalesce("unique", F.lit(0)).alias("unique"),
        "mean",
        "median",
        "min",
        "max",
    )
    return final if stage is None else final.select(F.lit(stage).alias("stage"), "*")


def correlation(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), decimals: int | None = 6) -> DataFrame:
    """(by, col_a, col_b, corr): pairwise-complete Pearson, undefined as 0.

    Columns without any non-zero partner are left out. All pairs are algebraic aggregates
    of one pass, so nothing but the sums is shuffled.
    """
    values = {c: clean_double(q(c)) for c in columns}
    pairs = list(combinations(columns, 2))
    measures: list[Column] = []
    for a, b in pairs:
        x = F.when(values[b].isNotNull(), values[a])
        y = F.when(values[a].isNotNull(), values[b])
        spread = F.stddev_pop(x) * F.stddev_pop(y)
        measures.append(F.coalesce(F.try_divide(F.covar_pop(x, y), spread), F.lit(0.0)).alias(f"r:{a}|{b}"))
    measures += [
        F.when(F.stddev_pop(values[c]) > 0, 1.0).otherwise(0.0).alias(f"r:{c}|{c}") for c in columns
    ]
    grouped = df.groupBy(*[q(k) for k in by]).agg(*measures)

    def corr(a: str, b: str) -> Column:
        x, y = (a, b) if columns.index(a) <= columns.index(b) else (b, a)
        return q(f"r:{x}|{y}")

    linked = {
        c: F.greatest(F.lit(0.0), F.lit(0.0), *[F.abs(corr(c, o)) for o in columns if o != c]) > 0
        for c in columns
    }
    shown = lambda r: r if decimals is None else F.bround(r, decimals)
    entries = [
        F.when(
            linked[a] & linked[b],
            F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), shown(corr(a, b)).alias("corr")),
        )
        for a in columns
        for b in columns
    ]
    return grouped.select(*by, F.explode(F.array_compact(F.array(*entries))).alias("__e")).select(*by, "__e.*")


def top_correlated(corr: DataFrame, targets: Sequence[str], k: int = 3, by: Sequence[str] = ()) -> DataFrame:
    """The `k` (at least one) features most correlated with each target, by absolute value."""
    from pyspark.sql import Window

    # A group is one target's row of the correlation matrix: as many entries as columns.
    order = Window.partitionBy(*by, "col_a").orderBy(F.abs("corr").desc(), "col_b")
    picked = corr.where(F.col("col_a").isin(*targets) & (F.col("col_a") != F.col("col_b")))
    ranked = picked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(1, k))
    return ranked.select(*by, F.col("col_a").alias("target"), F.col("col_b").alias("feature"), "corr", "rank")
