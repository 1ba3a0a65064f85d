"""Train a station model and score it next to the station-replacement baselines."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce
from typing import Any

from pyspark.sql import DataFrame, functions as F

from stationweave.functions.choices import search_name
from stationweave.functions.names import q
from stationweave.functions.periods import period_years, testing_windows
from stationweave.operators import baselines, normalize
from stationweave.operators.clean import cleaning_stats, filling_stats
from stationweave.operators.metrics import flatten_metrics, score, score_periods
from stationweave.operators.models import StationModel, fit_model
from stationweave.operators.profile import column_profile
from stationweave.operators.projection import export_view
from stationweave.operators.tuning import cross_validate, tune
from stationweave.plans.prepare import (
    Prepared,
    clean_with_details,
    keep_years,
    prepare_evaluation,
    prepare_fold,
    prepare_training,
    prepare_tuning,
)
from stationweave.sources.results import write_run_table
from stationweave.specs import ModelSpec, StationSpec

MODEL_METRICS = ("RMSE", "R2")


@dataclass(frozen=True)
class Trained:
    prepared: Prepared
    model: StationModel
    stats: normalize.NormStats
    best_params: dict[str, Any]
    trials: DataFrame | None


def train(df: DataFrame, spec: StationSpec, model_spec: ModelSpec, parallelism: int = 4) -> Trained:
    """Prepare, optionally tune on the validation windows, and fit on all training rows."""
    prepared = prepare_training(df, spec)
    normalized = prepared.normalized
    params, trials = dict(model_spec.params), None
    if search_name(model_spec.search) != "none":
        validation = prepare_tuning(df, spec, prepared.stats)
        if validation is None:
            raise ValueError("a search needs validation periods")
        found = tune(normalized, validation.normalized, prepared.features, prepared.targets, model_spec, parallelism)
        if found is not None:
            params, trials = found
    model = fit_model(normalized, prepared.features, prepared.targets, model_spec.algorithm, params)
    return Trained(prepared, model, prepared.stats, params, trials)


@dataclass
class Evaluation:
    """Result tables of one run, each planned when first asked for."""

    readings: DataFrame
    spec: StationSpec
    trained: Trained
    test: Prepared
    per_period: bool
    combined: bool

    @property
    def normalization_source(self) -> str:
        return self.test.normalization_source

    @cached_property
    def _rows(self) -> DataFrame:
        """Normalised test rows with the raw features aside, so one stored frame serves model and baselines."""
        aside = self.test.rows.withColumns({f"raw__{f}": q(f) for f in self.test.features})
        return normalize.apply_stats(aside, self.test.stats)

    @cached_property
    def _view(self) -> DataFrame:
        years = period_years(testing_windows(self.spec))
        return export_view(keep_years(self.readings, self.spec, years), self.spec)

    @property
    def _columns(self) -> list[str]:
        return [c for c in self._view.columns if c not in (self.spec.ts, self.spec.station)]

    @property
    def _cleaned(self) -> list[str]:
        return [c for c in self.spec.impute_columns if c in self._columns]

    @cached_property
    def predictions(self) -> DataFrame:
        return self.trained.model.predictions(self._rows)

    @cached_property
    def training_predictions(self) -> DataFrame:
        return self.trained.model.predictions(normalize.apply_stats(self.trained.prepared.rows, self.test.stats))

    def together(self, rows: DataFrame) -> DataFrame:
        """(source, algorithm, target, prediction_time, actual, prediction) of model and baselines, from one reading of the rows."""
        aside = rows.withColumns({f"raw__{f}": q(f) for f in self.test.features})
        predicted = self.trained.model.predict(normalize.apply_stats(aside, self.test.stats))
        made = {t: "prediction" if len(self.test.targets) == 1 else f"prediction__{t}" for t in self.test.targets}
        plain = predicted.select(
            "prediction_time", *[q(t) for t in made], *[q(c).alias(f"__made{i}") for i, c in enumerate(made.values())], *[q(f"raw__{f}").alias(f) for f in self.test.features]
        )
        empty = F.lit(None).cast("string").alias("baseline_id")
        own = [F.struct(empty, F.lit("model").alias("algorithm"), F.lit(t).alias("target"), q(t).alias("actual"), F.col(f"__made{i}").alias("prediction")) for i, t in enumerate(made)]
        every = F.explode(F.array(*own, *baselines.baseline_structs(plain.columns, self.spec.task()))).alias("__p")
        source = F.when(F.col("baseline_id").isNull(), "model").otherwise("baseline").alias("source")
        return plain.select("prediction_time", every).select("prediction_time", "__p.*").select(source, "algorithm", "target", "prediction_time", "actual", "prediction")

    @cached_property
    def details(self) -> DataFrame:
        return baselines.details(_named_predictions(self.trained.model.predict(self._rows), self.test), self.test.targets)

    @cached_property
    def metrics(self) -> DataFrame:
        return score(self.predictions, ["target"])

    @cached_property
    def baseline_predictions(self) -> DataFrame:
        return baselines.baseline_predictions(self.test.rows, self.spec.task())

    @cached_property
    def baseline_metrics(self) -> DataFrame:
        return score(self.baseline_predictions, ["baseline_id", "algorithm", "target"])

    @cached_property
    def period_metrics(self) -> DataFrame | None:
        """Cut from the whole frame, so periods do not depend on the overall selection."""
        if not self.per_period:
            return None
        rows = normalize.apply_stats(self.test.all_rows, self.test.stats)
        return score_periods(self.trained.model.predictions(rows), testing_windows(self.spec), ["target"])

    @cached_property
    def baseline_period_metrics(self) -> DataFrame | None:
        if not self.per_period:
            return None
        return baselines.baseline_period_metrics(self.test.all_rows, self.spec.task(), testing_windows(self.spec))

    @cached_property
    def _cleaning(self) -> tuple[DataFrame, DataFrame | None]:
        # The whole readings, as in preparation: filling may look at columns outside the view.
        return clean_with_details(keep_years(self.readings, self.spec, period_years(testing_windows(self.spec))), self.spec)

    @cached_property
    def imputation_stats(self) -> DataFrame:
        """By the strategy in effect: what was dropped, or what was filled and what is still missing."""
        filled, details = self._cleaning
        if self.spec.missing_values == "drop" or details is None:
            return cleaning_stats(self._view, self._columns, self._cleaned, self.spec.station)
        return filling_stats(self._view, filled, self._columns, details, self.spec.station)

    @property
    def imputation_details(self) -> DataFrame | None:
        return self._cleaning[1]

    @cached_property
    def column_statistics(self) -> DataFrame:
        structural = (self.spec.ts, self.spec.station)
        before = column_profile(self._view, structural, "before")
        return before.unionByName(column_profile(export_view(self.test.cleaned, self.spec), structural, "after"))


def evaluate(
    df: DataFrame,
    spec: StationSpec,
    trained: Trained,
    use_training_stats: bool = True,
    per_period: bool = False,
    only_per_period: bool = False,
) -> Evaluation:
    """Score the testing windows once; periods and baselines are groupings of the same rows."""
    if only_per_period and not testing_windows(spec):
        raise ValueError("per-period results alone need at least one testing period")
    test = prepare_evaluation(df, spec, trained.stats if use_training_stats else None)
    return Evaluation(df, spec, trained, test, per_period or only_per_period, not only_per_period)


def _named_predictions(predicted: DataFrame, test: Prepared) -> DataFrame:
    """actual / prediction columns, raw features under their own names."""
    multi = len(test.targets) > 1
    pairs = []
    for t in test.targets:
        pairs.append(F.col(f"`{t}`").alias(f"actual__{t}" if multi else "actual"))
        pairs.append(F.col(f"`prediction__{t}`" if multi else "prediction"))
    inputs = [F.col(f"`raw__{f}`").alias(f) for f in test.features]
    return predicted.select("prediction_time", *pairs, *inputs)


def run_metrics(evaluation: Evaluation, run_id: str) -> DataFrame:
    """All metric rows of a run in the long form the comparison reads.

    `source` tells model rows, named later by their run, from baseline rows that name
    themselves.
    """
    groups = ["source", "algorithm", "target"]
    iso = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(""))
    frames = []
    if evaluation.per_period:
        # Cut from the whole frame, so windows do not depend on the overall selection.
        frames.append(score_periods(evaluation.together(evaluation.test.all_rows), testing_windows(evaluation.spec), groups))
    if evaluation.combined:
        frames.append(score(evaluation.together(evaluation.test.rows), groups).withColumn("period_name", F.lit("overall")))
    scored = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames).where("row_count > 0")
    added = {
        "run_id": F.lit(run_id),
        "validation_period_name": F.col("period_name"),
        "validation_period_start": iso("period_start") if evaluation.per_period else F.lit(""),
        "validation_period_end": iso("period_end") if evaluation.per_period else F.lit(""),
    }
    return flatten_metrics(scored.withColumns(added), MODEL_METRICS, ["run_id", "source", "algorithm", *[c for c in added if c != "run_id"], "row_count"])


def write_evaluation(evaluation: Evaluation, root: str, run_id: str, store_details: bool = True) -> None:
    """Store the run's tables; combined ones only when the run keeps combined results."""
    write_run_table(run_metrics(evaluation, run_id).drop("run_id"), root, "metrics", run_id)
    write_run_table(evaluation.training_predictions, root, "training_predictions", run_id)
    write_run_table(evaluation.baseline_predictions, root, "baseline_predictions", run_id)
    if not evaluation.combined:
        return
    write_run_table(evaluation.predictions, root, "validation", run_id)
    if store_details:
        write_run_table(evaluation.details, root, "details", run_id)
    write_run_table(evaluation.imputation_stats, root, "imputation_stats", run_id)
    if evaluation.imputation_details is not None:
        write_run_table(evaluation.imputation_details, root, "imputation_details", run_id)
    write_run_table(evaluation.column_statistics, root, "column_statistics", run_id)


def cross_validation(
    df: DataFrame, spec: StationSpec, model_spec: ModelSpec, folds: list[dict[str, Any]], parallelism: int = 4
) -> tuple[DataFrame, DataFrame]:
    """(predictions, metrics) per fold."""
    prepare = lambda train_periods, validation_periods: prepare_fold(df, spec, train_periods, validation_periods)
    return cross_validate(folds, prepare, model_spec, df.sparkSession, parallelism)
