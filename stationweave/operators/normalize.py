"""Fitting, applying and undoing feature normalisation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from stationweave.functions.names import clean_double, q
from stationweave.functions.quantiles import quantile_columns, to_long
from stationweave.operators.profile import numeric_columns
from stationweave.session import config_table
from stationweave.functions.choices import normalization_method

STATS_SCHEMA = "method string, column string, center double, scale double, raw_scale double"


@dataclass(frozen=True)
class NormStats:
    """Per column: the subtracted center, the divisor, and the divisor before the zero guard."""

    method: str
    columns: dict[str, tuple[float, float, float]] = field(default_factory=dict)

    def to_frame(self, spark) -> DataFrame:
        rows = [(self.method, c, *v) for c, v in self.columns.items()]
        return config_table(spark, rows, STATS_SCHEMA)

    @staticmethod
    def from_frame(df: DataFrame) -> "NormStats":
        """Read back a stats table: one row per feature column."""
        rows = df.collect()
        method = rows[0].method if rows else "none"
        return NormStats(method, {r["column"]: (r.center, r.scale, r.raw_scale) for r in rows})


def identity_stats(df: DataFrame, exclude: Sequence[str] = ()) -> NormStats:
    return NormStats("none", {c: (0.0, 1.0, 1.0) for c in numeric_columns(df, exclude)})


def fit_stats(
    df: DataFrame, columns: Sequence[str], method: str = "zscore", keys: Sequence[str] = ()
) -> DataFrame:
    """(keys, method, column, center, scale, raw_scale); a zero scale becomes 1."""
    method = normalization_method(method)
    if method == "robust":
        found = quantile_columns(df, columns, [0.25, 0.5, 0.75], keys)
        at = lambda i: F.element_at("quantiles", i)
        stats = found.select(*keys, "column", at(2).alias("center"), (at(3) - at(1)).alias("raw_scale"))
    else:
        measures, entries = [], []
        for c in columns:
            v = clean_double(q(c))
            center, scale = {
                "none": (F.lit(0.0), F.lit(1.0)),
                "zscore": (F.avg(v), F.stddev_pop(v)),
                "minmax": (F.min(v), F.max(v) - F.min(v)),
                "maxabs": (F.lit(0.0), F.max(F.abs(v))),
            }[method]
            measures += [F.max(center).alias(f"c:{c}") if method == "none" else center.alias(f"c:{c}")]
            measures += [F.max(scale).alias(f"s:{c}") if method == "none" else scale.alias(f"s:{c}")]
            entries.append(
                F.struct(F.lit(c).alias("column"), q(f"c:{c}").alias("center"), q(f"s:{c}").alias("raw_scale"))
            )
        one = df.groupBy(*[q(k) for k in keys]).agg(*measures)
        stats = one.select(*keys, F.explode(F.array(*entries)).alias("__s")).select(*keys, "__s.*")
    guarded = F.when(F.col("raw_scale") == 0, 1.0).otherwise(F.col("raw_scale"))
    return stats.select(*keys, F.lit(method).alias("method"), "column", "center", guarded.alias("scale"), "raw_scale")


def fit(df: DataFrame, columns: Sequence[str], method: str = "zscore") -> NormStats:
    """Fitted stats on the driver: a handful of numbers per feature column."""
    if normalization_method(method) == "none":
        return NormStats("none", {c: (0.0, 1.0, 1.0) for c in columns})
    return NormStats.from_frame(fit_stats(df, columns, method))


def apply_stats(df: DataFrame, stats: NormStats, exclude: Sequence[str] = ()) -> DataFrame:
    """Normalise the columns the stats know about; others pass through."""
    if stats.method == "none":
        return df
    changed = {
        c: (q(c) - F.lit(center)) / F.lit(scale)
        for c, (center, scale, _) in stats.columns.items()
        if c in df.columns and c not in exclude
    }
    return df.select(*[changed[c].alias(c) if c in changed else q(c) for c in df.columns])


def denormalize(value: Column, stats: NormStats, column: str) -> Column:
    """Back to the original scale."""
    if stats.method == "none":
        return value
    center, scale, raw = stats.columns[column]
    return value * F.lit(raw if stats.method == "minmax" else scale) + F.lit(center)


def fit_task_stats(rows: DataFrame, method: str = "zscore") -> DataFrame:
    """Stats arrays of every task at once, from the array form of the supervised rows."""
    cells = rows.select("task_id", F.posexplode("features").alias("slot", "value"))
    keyed = cells.select("task_id", F.col("slot").cast("string").alias("slot"), "value")
    stats = fit_stats(keyed, ["value"], method, ["task_id", "slot"])
    entry = F.struct(F.col("slot").cast("int").alias("slot"), "center", "scale")
    ordered = F.array_sort(F.collect_list(entry))
    return stats.groupBy("task_id").agg(
        F.transform(ordered, lambda e: e["center"]).alias("centers"),
        F.transform(ordered, lambda e: e["scale"]).alias("scales"),
    )


def apply_task_stats(rows: DataFrame, stats: DataFrame) -> DataFrame:
    shifted = F.zip_with("features", "centers", lambda v, c: v - c)
    scaled = F.zip_with(shifted, "scales", lambda v, s: v / s)
    return rows.join(stats, "task_id").withColumn("features", scaled).select(*rows.columns)


__all__ = [
    "NormStats",
    "apply_stats",
    "apply_task_stats",
    "denormalize",
    "fit",
    "fit_stats",
    "fit_task_stats",
    "identity_stats",
    "to_long",
]
