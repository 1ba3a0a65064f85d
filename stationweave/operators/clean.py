"""Missing readings: counting them, dropping their rows, filling them with medians."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from stationweave.functions.names import q
from stationweave.functions.quantiles import quantile_columns

ALL_STATIONS = "__all__"


def is_missing(df: DataFrame, column: str) -> Column:
    """NULL, or NaN in a floating column."""
    c = q(column)
    if isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def present_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    return [c for c in columns if c in df.columns]


def any_missing(df: DataFrame, columns: Sequence[str]) -> Column:
    checks = [is_missing(df, c) for c in present_columns(df, columns)]
    return reduce(Column.__or__, checks) if checks else F.lit(False)


def drop_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows whose listed columns are all present; columns that do not exist are ignored."""
    return df.where(~any_missing(df, columns))


def _counts_to_rows(counts: DataFrame, columns: Sequence[str], keys: Sequence[str], out: Sequence[str]) -> DataFrame:
    cells = F.array(
        *[F.struct(F.lit(c).alias("column"), *[q(f"{o}:{c}").cast("long").alias(o) for o in out]) for c in columns]
    )
    return counts.select(*keys, F.explode(cells).alias("__c")).select(*keys, "__c.*")


def missing_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, missing) in one pass over the readings, with a `__total__` row."""
    per = df.agg(*[F.count_if(is_missing(df, c)).alias(f"missing:{c}") for c in columns])
    total = sum((q(f"missing:{c}") for c in columns), F.lit(0))
    return _counts_to_rows(
        per.withColumn("missing:__total__", total), [*columns, "__total__"], [], ["missing"]
    )


def missing_by_station(
    df: DataFrame, columns: Sequence[str], station: str = "station_id", dropping: Sequence[str] = ()
) -> DataFrame:
    """(station_id, column, missing_before, missing_after) per station and over all stations.

    `after` counts what would be left once rows missing any `dropping` column are gone, so
    one pass gives both sides. Only the per-station counts are rolled up.
    """
    kept = ~any_missing(df, dropping)
    counts = []
    for c in columns:
        gone = is_missing(df, c)
        counts += [
            F.count_if(gone).alias(f"missing_before:{c}"),
            F.count_if(gone & kept).alias(f"missing_after:{c}"),
        ]
    per = df.groupBy(q(station).cast("string").alias("station_id")).agg(*counts)
    sums = [F.sum(q(n)).alias(n) for n in per.columns if n != "station_id"]
    rolled = per.rollup("station_id").agg(*sums, F.grouping("station_id").alias("__g"))
    named = rolled.withColumn("station_id", F.when(F.col("__g") == 1, ALL_STATIONS).otherwise(F.col("station_id")))
    return _counts_to_rows(named, columns, ["station_id"], ["missing_before", "missing_after"])


def drop_details(df: DataFrame, columns: Sequence[str], station: str = "station_id") -> DataFrame:
    """How many values each cleaned column lost, per station and in total."""
    cleaned = present_columns(df, columns)
    return missing_by_station(df, cleaned, station, cleaned).withColumns(
        {"method": F.lit("drop_rows"), "selected_features": F.array().cast("array<string>")}
    )


def dropped_rows(df: DataFrame, columns: Sequence[str], station: str = "station_id") -> DataFrame:
    """(station_id, row_count, dropped_rows), with a row over all stations."""
    per = df.groupBy(q(station).cast("string").alias("station_id")).agg(
        F.count(F.lit(1)).alias("row_count"), F.count_if(any_missing(df, columns)).alias("dropped_rows")
    )
    rolled = per.rollup("station_id").agg(
        F.sum("row_count").alias("row_count"), F.sum("dropped_rows").alias("dropped_rows"), F.grouping("station_id").alias("__g")
    )
    return rolled.select(
        F.when(F.col("__g") == 1, ALL_STATIONS).otherwise(F.col("station_id")).alias("station_id"),
        "row_count",
        "dropped_rows",
    )


def filling_stats(raw: DataFrame, filled: DataFrame, columns: Sequence[str], details: DataFrame, station: str = "station_id") -> DataFrame:
    """The merged table for the filling strategies, with gaps counted in both frames and in total."""
    counts = [missing_by_station(df, columns, station).withColumnRenamed("missing_before", "missing").drop("missing_after") for df in (raw, filled)]
    return imputation_stats(*counts, details)


def imputation_stats(before: DataFrame, after: DataFrame, details: DataFrame) -> DataFrame:
    """Full outer merge of (station_id, column) counts before and after with the method used."""
    keys = ["station_id", "column"]
    b = before.select(*keys, F.col("missing").alias("missing_before"))
    a = after.select(*keys, F.col("missing").alias("missing_after"))
    d = details.select(*keys, "method", F.concat_ws(",", "selected_features").alias("selected_features"))
    return b.join(a, keys, "full_outer").join(d, keys, "full_outer").select(
        *keys,
        F.coalesce("missing_before", F.lit(0)).alias("missing_before"),
        F.coalesce("missing_after", F.lit(0)).alias("missing_after"),
        "method",
        F.coalesce("selected_features", F.lit("")).alias("selected_features"),
    )


def cleaning_stats(
    df: DataFrame, columns: Sequence[str], dropping: Sequence[str], station: str = "station_id"
) -> DataFrame:
    """The same table for the drop strategy, from a single pass over the readings."""
    counts = missing_by_station(df, columns, station, dropping)
    cleaned = F.col("column").isin(*dropping) if dropping else F.lit(False)
    return counts.withColumns({"method": F.when(cleaned, "drop_rows"), "selected_features": F.lit("")})


def impute_median(
    df: DataFrame, columns: Sequence[str], station: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Fill missing numbers with the column's (or the station's column's) exact median.

    Returns the filled frame and (station_id?, column, method, fill_value, missing_before,
    missing_after) for the columns that had gaps.
    """
    names = present_columns(df, columns)
    keys = ["station_id"] if station else []
    base = df.withColumn("__station", q(station).cast("string")) if station else df
    source = base.withColumnRenamed("__station", "station_id") if station and station != "station_id" else base
    source = source.drop("__station")
    medians = quantile_columns(source, names, [0.5], keys).select(
        *keys, "column", F.element_at("quantiles", 1).alias("median")
    )
    # One small map per station (or one in all); joined by size, not by hint.
    if keys:
        fills = medians.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("column", "median"))).alias("__fill"))
        joined = source.join(fills, keys, "left")
        fill = lambda c: F.element_at("__fill", F.lit(c))
    else:
        known = {r["column"]: r["median"] for r in medians.collect()}
        joined = source
        fill = lambda c: F.lit(known.get(c)).cast("double")
    filled = joined.withColumns({c: F.when(is_missing(source, c), fill(c)).otherwise(q(c).cast("double")) for c in names})
    filled = filled.select(*[q(c) for c in source.columns])
    def counted(frame: DataFrame, out: str) -> DataFrame:
        if keys:
            found = missing_by_station(frame, names, "station_id").where(F.col("station_id") != ALL_STATIONS)
            return found.select(*keys, "column", F.col("missing_before").alias(out))
        return missing_counts(frame, names).where(F.col("column") != "__total__").withColumnRenamed("missing", out)

    details = (
        counted(source, "missing_before")
        .where(F.col("missing_before") > 0)
        .join(medians, [*keys, "column"], "left")
        .join(counted(filled, "missing_after"), [*keys, "column"], "left")
        .select(*keys, "column", F.lit("median").alias("method"), F.col("median").alias("fill_value"), "missing_before", "missing_after")
    )
    return filled, details
