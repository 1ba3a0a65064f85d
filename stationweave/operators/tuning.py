"""Hyper-parameter search on a validation window, and cross-validation over given folds."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from math import prod
from typing import Any

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, functions as F

from stationweave.functions.choices import search_metric, search_name
from stationweave.functions.names import q, render_params
from stationweave.operators.metrics import HIGHER_IS_BETTER, long_metrics, score, trial_score
from stationweave.operators.forests import apply_forest, fit_forests
from stationweave.operators.models import fit_model, fit_vectors, forest_rows, make_regressor, scalar_params, vectors
from stationweave.operators.trees import ForestSpec
from stationweave.session import config_table, release
from stationweave.specs import ModelSpec

def search_space(grid: dict[str, Any], params: dict[str, Any] | None = None) -> dict[str, list[Any]]:
    """Values of every axis. Seeds listed among the model parameters are an axis unless the grid has one."""
    space = {name: values if isinstance(values, list) else [values] for name, values in grid.items()}
    seeds = (params or {}).get("random_state")
    if isinstance(seeds, (list, tuple)):
        space.setdefault("random_state", [int(seed) for seed in seeds])
    if any(not values for values in space.values()):
        raise ValueError("no values for " + ", ".join(name for name, values in space.items() if not values))
    return space


def grid_point(space: dict[str, list[Any]], number: int) -> dict[str, Any]:
    """The point of this number; the last axis turns fastest, so points need no list of their own."""
    point = {}
    for name, values in reversed(space.items()):
        number, place = divmod(number, len(values))
        point[name] = values[place]
    return {name: point[name] for name in space}


def trial_points(space: dict[str, list[Any]], search: str, max_trials: int, seed: int) -> list[dict[str, Any]]:
    """All points of a grid search; for a random search a seeded draw of at most max_trials, in grid order."""
    size = prod(len(values) for values in space.values())
    numbers: Iterable[int] = range(size)
    if search == "random_search":
        draw = np.random.default_rng(int(seed)).choice(size, size=min(size, max(1, int(max_trials))), replace=False)
        numbers = np.sort(draw).tolist()
    return [grid_point(space, n) for n in numbers]


def in_threads(spark: SparkSession, work: Callable[[Any], Any], items: Iterable[Any], parallelism: int = 4) -> list[Any]:
    """Run independent Spark jobs side by side; order of results follows the items."""
    items = list(items)
    with ThreadPoolExecutor(max(1, min(parallelism, len(items)))) as pool:
        # Wrapped once per item, so each job carries a fresh copy of the caller's properties.
        inherit = inheritable_thread_target(spark)
        return [f.result() for f in [pool.submit(inherit(lambda i=i: work(i))) for i in items]]


def best_trial(trials: DataFrame, metric: str, by: Sequence[str] = ()) -> DataFrame:
    """Best-scoring trial per task; among equals the first one wins."""
    worth = -F.col("score") if metric in HIGHER_IS_BETTER else F.col("score")
    # A number that is none counts as the worst.
    rank = F.struct(F.isnan(worth) | worth.isNull(), worth, F.col("trial"))
    best = trials.groupBy(*by).agg(F.min_by(F.struct(*[q(c) for c in trials.columns]), rank).alias("__best"))
    return best.where("__best is not null").select("__best.*")


TRIAL_SCHEMA = "trial int, total_trials int, score double, params map<string,string>"


def tune(
    train: DataFrame,
    validation: DataFrame,
    features: Sequence[str],
    targets: Sequence[str],
    spec: ModelSpec,
    parallelism: int = 4,
) -> tuple[dict[str, Any], DataFrame] | None:
    """(best parameters, trial table), or None when no search is configured.

    The forests of all trials are grown together and scored in one pass over the validation rows. Trials of
    other estimators are Spark fits over the same vectors. Only scores come back to the driver.
    """
    search = search_name(spec.search)
    if search == "none":
        return None
    if not spec.param_grid:
        raise ValueError("a search needs a non-empty parameter grid")
    metric = search_metric(spec.metric)
    points = trial_points(search_space(spec.param_grid, spec.params), search, spec.max_trials, spec.search_seed)
    base = scalar_params(spec.params)
    if validation.isEmpty():
        raise ValueError("the validation periods hold no supervised rows")

    made = [make_regressor(spec.algorithm, scalar_params({**base, **point})) for point in points]
    if isinstance(made[0], ForestSpec):
        scores = _score_forests(train, validation, features, targets, made, metric)
    else:
        scores = _score_fits(train, validation, features, targets, spec.algorithm, [{**base, **point} for point in points], metric, parallelism)
    rows = [(i, len(points), float(s), render_params(p)) for i, (s, p) in enumerate(zip(scores, points), 1)]
    trials = config_table(train.sparkSession, [(i, n, s, list(p.items())) for i, n, s, p in rows], TRIAL_SCHEMA)
    best = best_trial(trials, metric).first().trial
    return {**base, **points[best - 1]}, trials


def _score_forests(train: DataFrame, validation: DataFrame, features: Sequence[str], targets: Sequence[str], specs: list[ForestSpec], metric: str) -> list[float]:
    """One score for each spec, from one fit and one scoring job."""
    source = forest_rows(train, features, targets)
    trees = fit_forests(source, specs)
    rows = validation.select(F.array(*[q(f).cast("double") for f in features]).alias("x"), F.array(*[q(t).cast("double") for t in targets]).alias("y"))
    scored = apply_forest(rows.where(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v))), trees, specs, len(targets))
    cells = [
        F.struct(F.lit(k).alias("trial"), F.lit(i).alias("target"), F.get("y", F.lit(i)).alias("actual"), F.get("predictions", F.lit(k * len(targets) + i)).alias("prediction"))
        for k in range(len(specs))
        for i in range(len(targets))
    ]
    long = scored.select(F.explode(F.array(*cells)).alias("c")).select("c.*")
    found = trial_score(long_metrics(score(long, ["trial", "target"]), [metric], ["trial", "target"]), metric, ["trial"]).collect()
    release(source)
    release(trees)
    by_trial = {r.trial: r.score for r in found}
    return [by_trial.get(k, float("nan")) for k in range(len(specs))]


def _score_fits(
    train: DataFrame, validation: DataFrame, features: Sequence[str], targets: Sequence[str], algorithm: str, points: list[dict[str, Any]], metric: str, parallelism: int
) -> list[float]:
    shared = vectors(train, features, targets)

    def run(point: dict[str, Any]) -> float:
        model = fit_vectors(shared, features, targets, algorithm, point)
        metrics = long_metrics(model.evaluate(validation), [metric], ["target"])
        return trial_score(metrics, metric, []).first().score

    try:
        return in_threads(train.sparkSession, run, points, parallelism)
    finally:
        shared.unpersist()


def cross_validate(
    folds: Sequence[dict[str, Any]],
    prepare: Callable[[Any, Any], tuple[DataFrame, DataFrame, list[str], list[str]]],
    spec: ModelSpec,
    spark: SparkSession,
    parallelism: int = 4,
) -> tuple[DataFrame, DataFrame]:
    """(predictions, metrics) over explicit folds, each with its own training and validation windows.

    `prepare(train_periods, validation_periods)` returns the normalised train and validation
    frames with their feature and target names.
    """
    if not folds:
        raise ValueError("cross-validation needs at least one fold")
    for fold in folds:
        if not fold.get("train_periods") or not fold.get("validation_periods"):
            raise ValueError("every fold needs train_periods and validation_periods")

    def run(numbered: tuple[int, dict[str, Any]]) -> DataFrame:
        index, fold = numbered
        train, held_out, features, targets = prepare(fold["train_periods"], fold["validation_periods"])
        model = fit_model(train, features, targets, spec.algorithm, spec.params)
        name = str(fold.get("name") or f"fold_{index}")
        return model.predictions(held_out).withColumn("fold", F.lit(name))

    frames = in_threads(spark, run, enumerate(folds, 1), parallelism)
    predictions = reduce(DataFrame.unionByName, frames)
    return predictions, score(predictions, ["fold", "target"])
