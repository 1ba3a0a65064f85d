"""Which columns and stations a specification needs, and checks that they exist."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame

from stationweave.functions.names import q
from stationweave.session import config_table
from stationweave.specs import StationSpec


def required_columns(spec: StationSpec) -> list[str]:
    """Selected, structural, target and cleaning columns, each once, in that order."""
    wanted = [
        *spec.columns,
        spec.ts,
        spec.sort_col or spec.ts,
        spec.station,
        *spec.pollutants,
        *spec.model_targets,
        *spec.impute_columns,
    ]
    return list(dict.fromkeys(c for c in wanted if c))


def project_required(df: DataFrame, spec: StationSpec) -> DataFrame:
    """The required columns only; missing ones are an error that names them."""
    names = required_columns(spec)
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise KeyError("columns not found in the readings: " + ", ".join(missing))
    return df.select(*[q(c) for c in names])


def export_view(df: DataFrame, spec: StationSpec) -> DataFrame:
    """The required columns that exist; all columns when none does."""
    names = [c for c in required_columns(spec) if c in df.columns]
    return df.select(*[q(c) for c in names]) if names else df


def missing_stations(df: DataFrame, required: Iterable[str], station: str = "station_id") -> DataFrame:
    """Required station ids without any reading."""
    ids = config_table(df.sparkSession, [(str(s),) for s in required], "station_id string")
    # Distinct first: equal ids collapse before anything is shuffled.
    present = df.select(q(station).cast("string").alias("station_id")).distinct()
    return ids.join(present, "station_id", "left_anti")


def check_stations(df: DataFrame, spec: StationSpec) -> None:
    required: Sequence[str] = [spec.target_station, *spec.input_stations]
    absent = [r.station_id for r in missing_stations(df, required, spec.station).collect()]
    if absent:
        raise KeyError("configured stations not found in the readings: " + ", ".join(sorted(absent)))
