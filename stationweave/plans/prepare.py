"""From readings to normalised supervised rows for training, tuning and evaluation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from stationweave.functions.choices import normalization_method
from stationweave.functions.names import q
from stationweave.functions.periods import (
    drop_periods,
    keep_periods,
    normalize_periods,
    period_years,
    testing_windows,
    validation_windows,
)
from stationweave.operators import normalize
from stationweave.operators.clean import drop_details, drop_missing, impute_median, present_columns
from stationweave.operators.matrix import station_matrix
from stationweave.operators.projection import check_stations, project_required
from stationweave.operators.splits import select_test_rows, test_rows_or_all
from stationweave.operators.supervised import feature_names, supervised_frame, target_names
from stationweave.session import materialise
from stationweave.specs import StationSpec


@dataclass(frozen=True)
class Prepared:
    """Raw supervised rows, the same rows normalised, and how they were made."""

    spec: StationSpec
    cleaned: DataFrame
    all_rows: DataFrame
    rows: DataFrame
    normalized: DataFrame
    stats: normalize.NormStats
    features: list[str]
    targets: list[str]
    normalization_source: str

    @property
    def matrix(self) -> DataFrame:
        stations = list(dict.fromkeys([*self.spec.input_stations, self.spec.target_station]))
        return station_matrix(self.cleaned, self.spec.pollutants, stations, self.spec.ts, self.spec.station)


def keep_years(df: DataFrame, spec: StationSpec, years: list[int]) -> DataFrame:
    """Whole calendar years as plain time bounds, which prune files and row groups."""
    return keep_periods(df, q(spec.ts), [str(y) for y in years]) if years else df


def clean_with_details(df: DataFrame, spec: StationSpec) -> tuple[DataFrame, DataFrame | None]:
    """Readings cleaned by the strategy of the specification, and what that did per station and column."""
    columns = present_columns(df, spec.impute_columns)
    if not columns:
        return df, None
    if spec.missing_values == "median":
        filled, details = impute_median(df, columns, spec.station)
        return filled, details.withColumn("selected_features", F.array().cast("array<string>"))
    if spec.missing_values == "random_forest":
        from stationweave.operators.impute import impute_forest

        return impute_forest(df, columns, (spec.ts,), station=spec.station)
    return drop_missing(df, columns), drop_details(df, columns, spec.station)


def clean_readings(df: DataFrame, spec: StationSpec) -> DataFrame:
    return clean_with_details(df, spec)[0]


def training_slice(df: DataFrame, spec: StationSpec) -> DataFrame:
    """Training windows when given; otherwise everything outside validation and testing."""
    train = normalize_periods(spec.train_periods)
    if train:
        return keep_periods(df, q(spec.ts), train)
    pruned = keep_years(df, spec, [int(y) for y in spec.train_years])
    return drop_periods(pruned, q(spec.ts), [*validation_windows(spec), *testing_windows(spec)])


def _frame(df: DataFrame, part: DataFrame, spec: StationSpec, store: bool = True) -> tuple[DataFrame, DataFrame]:
    """Cleaned readings of a part and their supervised rows; stored rows are built once for all later jobs.

    Columns and stations that the specification names must exist in all readings; the error names those that
    don't. Rows are complete only if every station reported, so stations are looked for where there are none.
    """
    project_required(df, spec)
    cleaned = clean_readings(part, spec)
    rows = supervised_frame(cleaned, spec.task(), spec.ts, spec.station)
    rows = materialise(rows) if store else rows
    if not store or rows.isEmpty():
        check_stations(df, spec)
    return cleaned, rows


def _normalised(
    rows: DataFrame, features: list[str], method: str, stats: normalize.NormStats | None
) -> tuple[DataFrame, normalize.NormStats]:
    used = stats if stats is not None else normalize.fit(rows, features, method)
    return normalize.apply_stats(rows, used), used


def prepare_training(df: DataFrame, spec: StationSpec, store: bool = True) -> Prepared:
    """Slice, clean, build rows and normalise with their own statistics.

    The slice comes before the time axis, so lags step over excluded windows.
    """
    cleaned, rows = _frame(df, training_slice(df, spec), spec, store)
    features, targets = feature_names(spec.task()), target_names(spec.task())
    scaled, stats = _normalised(rows, features, normalization_method(spec.normalization), None)
    return Prepared(spec, cleaned, rows, rows, scaled, stats, features, targets, "training_run")


def prepare_tuning(
    df: DataFrame, spec: StationSpec, stats: normalize.NormStats, store: bool = True
) -> Prepared | None:
    """Rows predicted for the validation windows, or None without such windows."""
    periods = validation_windows(spec)
    if not periods:
        return None
    cleaned, rows = _frame(df, keep_years(df, spec, period_years(periods)), spec, store)
    chosen = keep_periods(rows, F.col("prediction_time"), periods)
    features, targets = feature_names(spec.task()), target_names(spec.task())
    scaled, _ = _normalised(chosen, features, "none", stats)
    return Prepared(spec, cleaned, rows, chosen, scaled, stats, features, targets, "training_run")


def prepare_evaluation(
    df: DataFrame,
    spec: StationSpec,
    stats: normalize.NormStats | None = None,
    fallback: bool = True,
    strict: bool = False,
    store: bool = True,
) -> Prepared:
    """Rows predicted for the testing windows, built on their whole years.

    Without training statistics the rows are normalised with their own. With `fallback`,
    windows that match no row fall back to all rows.
    """
    cleaned, rows = _frame(df, keep_years(df, spec, period_years(testing_windows(spec))), spec, store)
    chosen = test_rows_or_all(rows, spec, strict) if fallback or strict else select_test_rows(rows, spec)
    features, targets = feature_names(spec.task()), target_names(spec.task())
    scaled, used = _normalised(chosen, features, normalization_method(spec.normalization), stats)
    source = "evaluation_data" if stats is None else "training_run"
    return Prepared(spec, cleaned, rows, chosen, scaled, used, features, targets, source)


def prepare_fold(df: DataFrame, spec: StationSpec, train_periods, validation_periods) -> tuple[DataFrame, DataFrame, list[str], list[str]]:
    """Normalised train and validation rows of one fold; the fold's own window is scored."""
    train = prepare_training(df, spec.with_(train_periods=train_periods))
    held_out = prepare_evaluation(
        df, spec.with_(testing_periods=validation_periods), train.stats, fallback=False
    )
    return train.normalized, held_out.normalized, train.features, train.targets
