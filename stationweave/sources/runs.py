"""Saved runs: fitted models, their normalisation, and the table that names them."""

from __future__ import annotations

import json
from dataclasses import asdict
from datetime import datetime
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from stationweave.functions.names import render_params
from stationweave.operators.models import StationModel
from stationweave.operators.normalize import NormStats
from stationweave.operators.trees import KINDS, ForestSpec
from stationweave.session import config_table
from stationweave.specs import ModelSpec, StationSpec

RUN_SCHEMA = (
    "run_id string, created_at timestamp_ntz, config string, target_station_id string, algorithm string, "
    "algorithm_name string, bidirectional boolean, pollutant string, params map<string,string>, "
    "best_params map<string,string>, feature_names array<string>, target_names array<string>, normalization string"
)


def save_run(
    spark: SparkSession,
    root: str,
    run_id: str,
    spec: StationSpec,
    model_spec: ModelSpec,
    model: StationModel,
    stats: NormStats | None,
    config: str | None = None,
    best_params: dict[str, Any] | None = None,
    created_at: datetime | None = None,
) -> None:
    """Store models and stats first and the run row last, so a listed run is complete."""
    if model.forest is not None:
        # One row a tree; the parameters stand beside them, so the forest is whole without its run row.
        spec_text = json.dumps(asdict(model.spec))
        model.forest.withColumn("spec", F.lit(spec_text)).write.mode("overwrite").parquet(f"{root}/models/{run_id}/forest")
    for i, target in enumerate(model.targets if model.models else ()):
        PipelineModel([model.models[target]]).write().overwrite().save(f"{root}/models/{run_id}/{i}")
    if stats is not None:
        stats.to_frame(spark).write.mode("overwrite").parquet(f"{root}/normalization/{run_id}")
    row = (
        run_id,
        created_at or datetime.now(),
        config or run_id,
        spec.target_station,
        model_spec.algorithm,
        model_spec.algorithm_name,
        False,
        spec.pollutants[0] if len(spec.pollutants) == 1 else None,
        list(render_params(model_spec.params).items()),
        list(render_params(best_params or model_spec.params).items()),
        model.features,
        model.targets,
        stats.method if stats else None,
    )
    config_table(spark, [row], RUN_SCHEMA).write.mode("append").parquet(f"{root}/runs")


def load_runs(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/runs")


def latest_runs(runs: DataFrame) -> DataFrame:
    """Newest run of every configuration; of two from the same moment, the larger id."""
    order = F.struct("created_at", "run_id")
    return runs.groupBy("config").agg(F.max_by("run_id", order).alias("run_id"), F.max("created_at").alias("created_at"))


def load_model(spark: SparkSession, root: str, run_id: str) -> StationModel:
    row = load_runs(spark, root).where(F.col("run_id") == run_id).first()
    if row is None:
        raise FileNotFoundError(f"no run {run_id!r} under {root}")
    model = StationModel(list(row.feature_names), list(row.target_names))
    if row.algorithm.strip().lower() in KINDS:
        stored = spark.read.parquet(f"{root}/models/{run_id}/forest")
        model.spec = ForestSpec(**json.loads(stored.select("spec").first()[0]))
        model.forest = stored.drop("spec")
        return model
    for i, target in enumerate(model.targets):
        model.models[target] = PipelineModel.load(f"{root}/models/{run_id}/{i}").stages[0]
    return model


def load_stats(spark: SparkSession, root: str, run_id: str, normalization: str = "zscore") -> NormStats:
    """Training statistics of a run; absent ones are fine only without normalisation."""
    from pyspark.errors import AnalysisException

    try:
        return NormStats.from_frame(spark.read.parquet(f"{root}/normalization/{run_id}"))
    except AnalysisException:
        if normalization == "none":
            return NormStats("none")
        raise FileNotFoundError(
            f"run {run_id!r} has no saved normalisation; train with it saved, or evaluate with self-fitted statistics"
        ) from None


def check_alignment(spark: SparkSession, root: str, run_id: str, spec: StationSpec, model_spec: ModelSpec) -> None:
    """The run must have the same target station, algorithm and parameters."""
    row = load_runs(spark, root).where(F.col("run_id") == run_id).first()
    if row is None:
        return
    wanted = {
        "target station": (row.target_station_id, spec.target_station),
        "algorithm": (row.algorithm, model_spec.algorithm),
        "parameters": (dict(row.params or {}), render_params(model_spec.params)),
    }
    for what, (saved, now) in wanted.items():
        if saved != now:
            raise ValueError(f"the {what} does not match the saved run: {now!r} instead of {saved!r}")
