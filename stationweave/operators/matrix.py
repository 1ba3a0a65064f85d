"""Readings to cells (long) and to the time x station matrix (wide)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from stationweave.functions.names import clean_double, q
from stationweave.functions.positions import time_position

# Above this many output columns a real pivot is cheaper than one expression per column.
_WIDE_AGG_COLUMNS = 32


def unpivot_readings(df: DataFrame, pollutants: Sequence[str], ts: str = "ts", station: str = "station_id") -> DataFrame:
    """(ts, station_id, pollutant, value): one row per pollutant column, NULL kept."""
    doubles = [clean_double(q(p)).alias(p) for p in pollutants]
    base = df.select(q(ts).alias("ts"), q(station).cast("string").alias("station_id"), *doubles)
    return base.unpivot(["ts", "station_id"], [q(p) for p in pollutants], "pollutant", "value")


def station_cells(df: DataFrame, pollutants: Sequence[str], ts: str = "ts", station: str = "station_id") -> DataFrame:
    """Mean reading per (ts, pollutant, station); missing readings and times leave no cell."""
    long = unpivot_readings(df, pollutants, ts, station)
    return (
        long.where(F.col("value").isNotNull() & F.col("ts").isNotNull() & F.col("station_id").isNotNull())
        .groupBy("ts", "pollutant", "station_id")
        .agg(F.avg("value").alias("value"))
    )


def time_axis(df: DataFrame, pollutants: Sequence[str], ts: str = "ts", station: str = "station_id") -> DataFrame:
    """(ts, ts_idx): dense positions of the times with a reading from any station."""
    present = reduce(Column.__or__, [clean_double(q(p)).isNotNull() for p in pollutants])
    times = (
        df.where(present & q(ts).isNotNull() & q(station).isNotNull()).select(q(ts).alias("ts")).distinct()
    )
    return time_position(times, "ts", "ts_idx")


def matrix_column(pollutant: str, station: str, multi: bool) -> str:
    return f"{pollutant}__{station}" if multi else station


def station_matrix(
    df: DataFrame,
    pollutants: Sequence[str],
    stations: Sequence[str],
    ts: str = "ts",
    station: str = "station_id",
) -> DataFrame:
    """Wide matrix: `ts` plus one mean column per (pollutant and) station, in one shuffle.

    A time stays when any station has a reading there, listed in `stations` or not.
    """
    multi = len(pollutants) > 1
    if len(pollutants) * len(stations) > _WIDE_AGG_COLUMNS:
        return _pivoted(df, pollutants, stations, ts, station)
    values = {p: clean_double(q(p)) for p in pollutants}
    present = reduce(Column.__or__, [v.isNotNull() for v in values.values()])
    name = q(station).cast("string")
    return (
        df.where(present & q(ts).isNotNull() & q(station).isNotNull())
        .groupBy(q(ts).alias("ts"))
        .agg(
            *[
                F.avg(F.when(name == s, v)).alias(matrix_column(p, s, multi))
                for p, v in values.items()
                for s in stations
            ]
        )
    )


def _pivoted(df: DataFrame, pollutants: Sequence[str], stations: Sequence[str], ts: str, station: str) -> DataFrame:
    multi = len(pollutants) > 1
    cells = station_cells(df, pollutants, ts, station)
    # The label keeps both parts apart, whatever they hold; columns get their names afterwards.
    label = F.concat("pollutant", F.lit("\0"), "station_id")
    names = {f"{p}\0{s}": matrix_column(p, s, multi) for p in pollutants for s in stations}
    wide = cells.withColumn("__label", label).groupBy("ts").pivot("__label", list(names)).agg(F.max("value"))
    return wide.toDF("ts", *names.values())
