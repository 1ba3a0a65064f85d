"""Choosing training and test rows of a supervised frame."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, functions as F

from stationweave.functions.periods import in_periods, keep_periods, testing_windows
from stationweave.functions.positions import time_position
from stationweave.specs import StationSpec

LOG = logging.getLogger("stationweave")


def _cutoff(n: int, frac: float) -> int:
    return max(1, int(n * frac))


def _cut_time(rows: DataFrame, position: Column | int) -> Column:
    """Prediction time of the row at a position; only the time column is ordered."""
    placed = time_position(rows.select("prediction_time"), "prediction_time", "__pos")
    return placed.where(F.col("__pos") == position).select("prediction_time").scalar()


def positional_tail(rows: DataFrame, frac: float) -> DataFrame:
    """Rows from position `max(1, int(n * frac))` on, in time order."""
    n = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    return rows.where(F.col("prediction_time") >= _cut_time(rows, F.greatest(F.lit(1), F.floor(n * F.lit(float(frac))))))


def select_test_rows(rows: DataFrame, spec: StationSpec) -> DataFrame:
    """Rows predicted for a testing window; without windows the positional tail."""
    periods = testing_windows(spec)
    if periods:
        return keep_periods(rows, F.col("prediction_time"), periods)
    return positional_tail(rows, spec.train_frac)


def test_rows_or_all(rows: DataFrame, spec: StationSpec, strict: bool = False) -> DataFrame:
    """Test rows, or every row when the windows match none (an error when `strict`)."""
    test = select_test_rows(rows, spec)
    if not test.isEmpty():
        return test
    days = available_days(rows)
    message = f"no row falls into the testing periods; first days with rows: {', '.join(days)}"
    if strict:
        raise ValueError(message)
    LOG.warning("%s; scoring all rows instead", message)
    return rows


def available_days(rows: DataFrame, limit: int = 10) -> list[str]:
    day = F.date_format("prediction_time", "yyyy-MM-dd").alias("day")
    return [r.day for r in rows.select(day).distinct().orderBy("day").limit(limit).collect()]


def split_rows(rows: DataFrame, spec: StationSpec) -> tuple[DataFrame, DataFrame]:
    """(train, test): by training years, else outside the test windows, else by position."""
    periods = testing_windows(spec)
    when = F.col("prediction_time")
    if spec.train_years:
        test = select_test_rows(rows, spec)
        in_years = F.year(when).isin(*[int(y) for y in spec.train_years])
        if periods:
            train = rows.where(in_years & ~in_periods(when, periods))
        else:
            train = rows.where(in_years).join(test.select("prediction_time"), "prediction_time", "left_anti")
            train = train.select(*rows.columns)
        if train.isEmpty() or test.isEmpty():
            raise ValueError("the training years and test windows leave an empty train or test split")
        return train, test
    if periods:
        test = keep_periods(rows, when, periods)
        if not test.isEmpty():
            return rows.where(~in_periods(when, periods)), test
    n = rows.count()
    # With windows that match nothing both sides must stay non-empty; otherwise the tail decides.
    cutoff = _cutoff(n, spec.train_frac)
    if periods or cutoff >= n:
        cutoff = max(1, min(n - 1, cutoff))
    cut = _cut_time(rows, cutoff)
    return rows.where(when < cut), rows.where(when >= cut)
