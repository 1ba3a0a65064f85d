"""Regressors by name, fitted on data that stays distributed: own forests, or any estimator of Spark ML."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from importlib import import_module
from typing import Any

from pyspark import StorageLevel
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, functions as F

from stationweave.functions.names import q
from stationweave.operators.forests import apply_forest, fit_forests, single_group
from stationweave.operators.metrics import score
from stationweave.operators.trees import KINDS, ForestSpec
from stationweave.session import materialise, release
from stationweave.specs import ModelSpec

def make_regressor(algorithm: str, params: dict[str, Any] | None = None) -> Estimator | ForestSpec:
    """A built-in forest by alias, or an estimator by the import path of any `pyspark.ml`-style class."""
    if algorithm.strip().lower() in KINDS:
        return ForestSpec.of(algorithm.strip().lower(), params)
    if "." not in algorithm:
        raise ValueError(f"unknown algorithm {algorithm!r}; use one of {sorted(KINDS)} or a class path")
    module, _, name = algorithm.rpartition(".")
    estimator = getattr(import_module(module), name)(**(params or {}))
    if not (hasattr(estimator, "fit") and estimator.hasParam("featuresCol") and estimator.hasParam("predictionCol")):
        raise TypeError(f"{algorithm} must be an estimator with features and prediction columns")
    return estimator


def scalar_params(params: dict[str, Any] | None) -> dict[str, Any]:
    """Parameters with a seed list reduced to its first seed."""
    out = dict(params or {})
    seeds = out.get("random_state")
    if isinstance(seeds, (list, tuple)):
        if not seeds:
            raise ValueError("random_state needs at least one seed")
        out["random_state"] = int(seeds[0])
    return out


@dataclass
class StationModel:
    """What was fitted, with feature and target order: one forest for all targets, or one estimator's model for each."""

    features: list[str]
    targets: list[str]
    models: dict[str, Model] = field(default_factory=dict)
    forest: DataFrame | None = None
    spec: ForestSpec | None = None

    def _prediction(self, target: str) -> str:
        return "prediction" if len(self.targets) == 1 else f"prediction__{target}"

    def predict(self, rows: DataFrame) -> DataFrame:
        """Rows plus `prediction`, or `prediction__<target>` for several targets."""
        if self.forest is not None:
            aside = rows.withColumn(VECTOR, F.array(*[q(f).cast("double") for f in self.features]))
            scored = apply_forest(aside, self.forest, [self.spec], len(self.targets), VECTOR, "__values")
            return scored.withColumns({self._prediction(t): F.get("__values", F.lit(i)) for i, t in enumerate(self.targets)}).drop(VECTOR, "__values")
        out = assemble(rows, self.features)
        for target in self.targets:
            out = self.models[target].copy().setPredictionCol(self._prediction(target)).transform(out)
        return out.drop(VECTOR)

    def predictions(self, rows: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """Long (keep, prediction_time, target, actual, prediction)."""
        structs = [
            F.struct(F.lit(t).alias("target"), q(t).cast("double").alias("actual"), q(self._prediction(t)).alias("prediction"))
            for t in self.targets
        ]
        scored = self.predict(rows)
        return scored.select(*keep, "prediction_time", F.explode(F.array(*structs)).alias("__p")).select(
            *keep, "prediction_time", "__p.*"
        )

    def evaluate(self, rows: DataFrame, extra: bool = False) -> DataFrame:
        """Metrics per target."""
        return score(self.predictions(rows), ["target"], extra)


VECTOR = "__features"


def assemble(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """Feature vector in training order; the columns get plain names for the assembler."""
    plain = [f"__f{i}" for i in range(len(features))]
    named = rows.withColumns({p: q(f).cast("double") for p, f in zip(plain, features)})
    return VectorAssembler(inputCols=plain, outputCol=VECTOR).transform(named).drop(*plain)


def vectors(rows: DataFrame, features: Sequence[str], targets: Sequence[str]) -> DataFrame:
    """What estimators are fitted on, persisted: several fits may share it, and its maker unpersists it."""
    made = assemble(rows, features).select(VECTOR, *[q(t).cast("double").alias(f"__y{i}") for i, t in enumerate(targets)])
    return made.persist(StorageLevel.MEMORY_AND_DISK)


def fit_vectors(made: DataFrame, features: Sequence[str], targets: Sequence[str], algorithm: str, params: dict[str, Any] | None = None) -> StationModel:
    """Fit one estimator per target on vectors."""
    fitted = StationModel(list(features), list(targets))
    for i, target in enumerate(targets):
        estimator = make_regressor(algorithm, scalar_params(params))
        fitted.models[target] = estimator.copy({estimator.featuresCol: VECTOR, estimator.labelCol: f"__y{i}"}).fit(made)
    return fitted


def forest_rows(rows: DataFrame, features: Sequence[str], targets: Sequence[str]) -> DataFrame:
    """What forests are fitted on, stored; rows with a gap are left out, as no tree can place them."""
    made = single_group(rows, [q(f) for f in features], [q(t) for t in targets])
    return materialise(made.where(F.forall(F.concat("x", "y"), lambda v: v.isNotNull() & ~F.isnan(v))))


def fit_model(
    rows: DataFrame, features: Sequence[str], targets: Sequence[str], algorithm: str, params: dict[str, Any] | None = None
) -> StationModel:
    """Fit on the rows: a forest's trees for all targets together, or one estimator per target."""
    made = make_regressor(algorithm, scalar_params(params))
    if isinstance(made, ForestSpec):
        source = forest_rows(rows, features, targets)
        forest = fit_forests(source, [made])
        release(source)
        if forest.isEmpty():
            raise ValueError("there are no complete rows to fit on")
        return StationModel(list(features), list(targets), forest=forest, spec=made)
    shared = vectors(rows, features, targets)
    try:
        return fit_vectors(shared, features, targets, algorithm, params)
    finally:
        shared.unpersist()


def fit_spec(rows: DataFrame, features: Sequence[str], targets: Sequence[str], spec: ModelSpec) -> StationModel:
    return fit_model(rows, features, targets, spec.algorithm, spec.params)
