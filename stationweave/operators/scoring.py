"""Scoring feature vectors given as arrays, in batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stationweave.operators.models import StationModel
from stationweave.operators.normalize import NormStats, apply_stats
from stationweave.operators.supervised import feature_names
from stationweave.specs import Task


def vector_columns(df: DataFrame, task: Task, vector: str = "features", history: str | None = None, target_lags: int = 1) -> DataFrame:
    """Array entries to named feature columns, pollutant-major, then station, then lag.

    Entries beyond the expected count are ignored and flagged in `surplus`; a vector that
    is too short fails the job. With `history`, an array of past target values (one list, or
    one list per pollutant laid end to end) becomes `target_history_lag_<k>` columns.
    """
    names = feature_names(task)
    n = len(names)
    size = F.size(vector)
    short = F.concat(F.lit(f"expected {n} neighbour values, received "), size.cast("string"))
    checked = F.when(size < n, F.raise_error(short).cast("double"))
    out = df.withColumns(
        {name: F.coalesce(checked, F.get(vector, i).cast("double")) for i, name in enumerate(names)}
    ).withColumn("surplus", F.greatest(size - n, F.lit(0)))
    return _history_columns(out, task, history, target_lags) if history else out


def _history_columns(df: DataFrame, task: Task, history: str, lags: int) -> DataFrame:
    total = lags * len(task.pollutants)
    size = F.size(history)
    wrong = ~size.isin(lags, total) | size.isNull()
    checked = F.when(wrong, F.raise_error(F.lit(f"expected {lags} or {total} history values")).cast("double"))
    columns = {}
    for j, p in enumerate(task.pollutants):
        for k in range(1, lags + 1):
            name = f"target_history_lag_{k}" + (f"__{p}" if task.multi else "")
            at = F.when(size == total, F.lit(j * lags + k - 1)).otherwise(F.lit(k - 1))
            columns[name] = F.coalesce(checked, F.get(F.col(history), at).cast("double"))
    return df.withColumns(columns)


def score_vectors(df: DataFrame, task: Task, model: StationModel, stats: NormStats, vector: str = "features") -> DataFrame:
    """Predictions for each vector, normalised with the training statistics."""
    named = vector_columns(df, task, vector)
    return model.predict(apply_stats(named, stats))
