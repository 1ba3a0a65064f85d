"""Plain descriptions of what to load, build, fit and score."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

@dataclass(frozen=True)
class Task:
    """One held-out station: which neighbours predict it, how far back and ahead."""

    task_id: str
    target_station: str
    input_stations: tuple[str, ...]
    pollutants: tuple[str, ...]
    lags: int = 1
    horizon: int = 0

    def __post_init__(self) -> None:
        if self.lags < 1:
            raise ValueError("station history lags must be >= 1")
        if self.horizon < 0:
            raise ValueError("horizon must be >= 0")
        if not self.pollutants:
            raise ValueError("at least one target pollutant is required")

    @property
    def multi(self) -> bool:
        return len(self.pollutants) > 1


@dataclass(frozen=True)
class StationSpec:
    """Roles of columns and stations, the time windows and the cleaning rules."""

    target_station: str
    input_stations: tuple[str, ...]
    pollutants: tuple[str, ...]
    ts: str = "ts"
    station: str = "station_id"
    sort_col: str | None = None
    columns: tuple[str, ...] = ()
    impute_columns: tuple[str, ...] = ()
    model_targets: tuple[str, ...] = ()
    missing_values: str = "drop"
    lags: int = 1
    horizon: int = 1
    train_periods: Any = None
    validation_periods: Any = None
    testing_periods: Any = None
    test_days: Any = None
    train_years: tuple[int, ...] = ()
    train_frac: float = 0.7
    normalization: Any = "zscore"

    def __post_init__(self) -> None:
        if self.missing_values not in ("drop", "median", "random_forest"):
            raise ValueError("missing_values must be drop, median or random_forest")

    def task(self, task_id: str = "task") -> Task:
        return Task(
            task_id,
            self.target_station,
            tuple(self.input_stations),
            tuple(self.pollutants),
            self.lags,
            self.horizon,
        )

    def with_(self, **changes: Any) -> "StationSpec":
        return replace(self, **changes)


@dataclass(frozen=True)
class ModelSpec:
    """Regressor alias or estimator class path, its parameters and the search over them.

    The built-in forests take the usual names: n_estimators (100), random_state (42), max_depth (as deep as
    rows allow), min_samples_split, min_samples_leaf, max_features, max_samples, bootstrap, and max_rows, the
    rows that one tree is fitted on at most (all of its group). A parameter without a counterpart is an error.
    """

    algorithm: str = "random_forest"
    params: dict[str, Any] = field(default_factory=dict)
    algorithm_name: str | None = None
    search: str | None = "none"
    metric: str = "RMSE"
    param_grid: dict[str, Any] = field(default_factory=dict)
    max_trials: int = 20
    search_seed: int = 42
