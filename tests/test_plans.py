from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from stationweave.operators import models, report, tuning
from stationweave.operators.trees import ForestSpec
from stationweave.plans import evaluate, prepare
from stationweave.sources import results, runs
from stationweave.specs import ModelSpec, StationSpec

LINEAR = ModelSpec("pyspark.ml.regression.LinearRegression", {"solver": "normal"})


@pytest.fixture(scope="module")
def hourly(spark):
    """Three stations over 2023 to 2025, the target a noisy mix of its neighbours, with gaps."""
    rng = np.random.default_rng(5)
    times = pd.date_range("2023-01-01", "2025-12-31", freq="36h")
    a, b = rng.normal(40, 9, len(times)), rng.normal(30, 7, len(times))
    t = 0.6 * a + 0.4 * b + rng.normal(0, 1, len(times))
    frame = pd.concat(
        [pd.DataFrame({"ts": times, "station_id": s, "PM2.5": v, "NO2": v * 2}) for s, v in (("a", a), ("b", b), ("t", t))]
    )
    frame.loc[rng.random(len(frame)) < 0.05, "PM2.5"] = np.nan
    df = spark.createDataFrame(frame).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return df.persist()


SPEC = StationSpec(
    "t", ("a", "b"), ("PM2.5",), impute_columns=("PM2.5",), lags=2, horizon=0,
    train_periods=["2023"], validation_periods=["2024"], testing_periods=["2025-01", "2025-06", {"start": "2025-01", "end": "2025-12"}],
)


def test_registry(spark):
    assert models.make_regressor("random_forest") == ForestSpec("random_forest", 100, 42)
    forest = models.make_regressor("Extra_Trees", {"n_estimators": 7, "max_depth": 50, "random_state": [5, 6], "n_jobs": -1, "min_samples_split": 10})
    assert forest == ForestSpec("extra_trees", 7, 5, 50, 10) and not forest.draws
    linear = models.make_regressor(LINEAR.algorithm, {"fitIntercept": False})
    assert isinstance(linear, LinearRegression) and not linear.getFitIntercept()
    for bad, error in (("unknown", ValueError), ("collections.OrderedDict", TypeError)):
        with pytest.raises((error, AttributeError)):
            models.make_regressor(bad)
    for bad in ({"depth": 3}, {"max_depth": 0}, {"min_samples_split": 1}, {"criterion": "absolute_error"}, {"max_features": "many"}, {"kind": "x"}):
        with pytest.raises(ValueError):
            models.make_regressor("random_forest", bad)


@pytest.mark.parametrize("change, name", [(dict(target_station="nowhere"), "nowhere"), (dict(input_stations=("a", "gone")), "gone"), (dict(pollutants=("SO2",)), "SO2")])
def test_unknown_roles_are_errors(hourly, change, name):
    spec = SPEC.with_(**change)
    for run in (lambda: prepare.prepare_training(hourly, spec), lambda: prepare.prepare_evaluation(hourly, spec), lambda: prepare.prepare_tuning(hourly, spec, None)):
        with pytest.raises(KeyError, match=name):
            run()


def test_training_slice_closes_up_excluded_windows(hourly):
    spec = SPEC.with_(train_periods=None, testing_periods=["2025"])
    prepared = prepare.prepare_training(hourly, spec)
    assert prepared.rows.select(F.year("prediction_time").alias("y")).distinct().collect()[0].y == 2023
    # The first row of the later stretch takes its lag from before the excluded year.
    gap = spec.with_(validation_periods=["2024"], testing_periods=["2023-06"])
    rows = prepare.prepare_training(hourly, gap).rows
    assert rows.where("year(feature_time) = 2025").count() > 0


def test_scaled_features_have_zero_mean(hourly):
    prepared = prepare.prepare_training(hourly, SPEC)
    means = prepared.normalized.agg(*[F.avg(f"`{f}`") for f in prepared.features]).first()
    assert np.allclose(list(means), 0, atol=1e-9)
    assert prepared.matrix.columns == ["ts", "a", "b", "t"]


def test_no_tuning_data_without_windows(hourly):
    spec = SPEC.with_(validation_periods=None)
    assert prepare.prepare_tuning(hourly, spec, prepare.prepare_training(hourly, spec).stats) is None


def test_run_from_training_to_report(spark, hourly, tmp_path):
    root = str(tmp_path)
    trained = evaluate.train(hourly, SPEC, LINEAR)
    result = evaluate.evaluate(hourly, SPEC, trained, per_period=True)
    model_rmse = result.metrics.first().RMSE
    best_baseline = result.baseline_metrics.agg(F.min("RMSE")).first()[0]
    assert model_rmse < best_baseline and model_rmse < 1.5
    evaluate.write_evaluation(result, root, "run_1")
    evaluate.write_evaluation(result, root, "run_1")
    runs.save_run(spark, root, "run_1", SPEC, LINEAR, trained.model, trained.stats, config="cfg.yaml")
    metrics = results.read_run_table(spark, root, "metrics", ["run_1"])
    # 3 periods and overall, one model and three baselines, two metrics; written twice, kept once.
    assert metrics.count() == 4 * 4 * 2
    named = results.comparable_metrics(metrics, runs.load_runs(spark, root))
    assert named.where("algorithm = 'LinearRegression'").count() == 4 * 2 * 2
    assert report.champions(report.select_metrics(report.report_periods(named))).first().champion == "LinearRegression"
    series = results.load_prediction_series(spark, root, runs.load_runs(spark, root))
    assert series.select("algorithm").distinct().count() == 4
    details = results.read_run_table(spark, root, "details")
    assert "input__neighbor__a__lag_1" in details.columns
    raw = result.test.rows.agg(F.sum("neighbor__a")).first()[0]
    assert details.agg(F.sum("input__neighbor__a")).first()[0] == pytest.approx(raw)
    assert results.read_run_table(spark, root, "column_statistics").select("stage").distinct().count() == 2
    results.write_training_dump(trained.prepared, root, "run_1")
    summary = results.read_run_table(spark, root, "dump_summary").first()
    assert summary.row_count == trained.prepared.rows.count() and summary.feature_count == 4

    loaded, stats = runs.load_model(spark, root, "run_1"), runs.load_stats(spark, root, "run_1")
    again = prepare.prepare_evaluation(hourly, SPEC, stats)
    assert loaded.evaluate(again.normalized).first().RMSE == pytest.approx(model_rmse)
    runs.check_alignment(spark, root, "run_1", SPEC, LINEAR)
    for spec, model in ((SPEC.with_(target_station="a"), LINEAR), (SPEC, ModelSpec("random_forest")), (SPEC, ModelSpec(LINEAR.algorithm))):
        with pytest.raises(ValueError):
            runs.check_alignment(spark, root, "run_1", spec, model)
    with pytest.raises(FileNotFoundError):
        runs.load_stats(spark, root, "absent")
    assert runs.load_stats(spark, root, "absent", "none").method == "none"


def test_saved_forest_for_two_targets(spark, hourly, tmp_path):
    spec, model = SPEC.with_(pollutants=("PM2.5", "NO2")), ModelSpec("extra_trees", {"n_estimators": 20, "min_samples_leaf": 2})
    trained = evaluate.train(hourly, spec, model)
    runs.save_run(spark, str(tmp_path), "f", spec, model, trained.model, trained.stats)
    loaded = runs.load_model(spark, str(tmp_path), "f")
    rows = prepare.prepare_evaluation(hourly, spec, trained.stats).normalized
    known, again = (sorted(map(tuple, m.evaluate(rows).collect())) for m in (trained.model, loaded))
    assert known == again and [r[0] for r in known] == ["target_value__NO2", "target_value__PM2.5"]
    assert all(r[3] > 0.9 for r in known), known  # the target is a mix of its neighbours


def test_only_per_period_results(hourly):
    trained = evaluate.train(hourly, SPEC, LINEAR)
    result = evaluate.evaluate(hourly, SPEC, trained, only_per_period=True)
    names = {r.validation_period_name for r in evaluate.run_metrics(result, "r").select("validation_period_name").distinct().collect()}
    assert names == {"period_01", "period_02", "period_03"}
    bare = SPEC.with_(validation_periods=None, testing_periods=None)
    with pytest.raises(ValueError):
        evaluate.evaluate(hourly, bare, trained, only_per_period=True)


def test_self_fitted_statistics_work_per_period(hourly):
    trained = evaluate.train(hourly, SPEC, LINEAR)
    result = evaluate.evaluate(hourly, SPEC, trained, use_training_stats=False, per_period=True)
    assert result.normalization_source == "evaluation_data"
    assert result.period_metrics.where("row_count > 0").count() == 3


def test_two_targets(hourly):
    spec = SPEC.with_(pollutants=("PM2.5", "NO2"), lags=1)
    trained = evaluate.train(hourly, spec, LINEAR)
    result = evaluate.evaluate(hourly, spec, trained)
    assert {r.target for r in result.metrics.collect()} == {"target_value__PM2.5", "target_value__NO2"}
    names = {r.metric for r in evaluate.run_metrics(result, "r").collect()}
    assert "by_target.target_value__NO2.RMSE" in names


def test_tuning_keeps_first_of_equals(hourly):
    spec = ModelSpec("random_forest", {"n_estimators": 3, "random_state": [4, 4]}, search="grid", param_grid={"max_depth": [1, 3]})
    trained = evaluate.train(hourly, SPEC, spec)
    trials = trained.trials.orderBy("trial").collect()
    assert [t.total_trials for t in trials] == [4] * 4 and trials[0].score == trials[1].score
    assert trained.best_params == {"n_estimators": 3, "random_state": 4, "max_depth": 3}


@pytest.mark.parametrize("bad", [dict(param_grid={}), dict(param_grid={"max_depth": []}), dict(metric="MAE", param_grid={"max_depth": [2]}), dict(search="bayes", param_grid={"max_depth": [2]})])
def test_tuning_errors(hourly, bad):
    with pytest.raises(ValueError):
        evaluate.train(hourly, SPEC, ModelSpec("random_forest", {"n_estimators": 2}, **{"search": "grid", **bad}))


def test_trial_points():
    space = tuning.search_space({"a": [1, 2], "b": 3})
    assert tuning.trial_points(space, "grid_search", 1, 0) == [{"a": 1, "b": 3}, {"a": 2, "b": 3}]
    assert len(tuning.trial_points(space, "random_search", 99, 1)) == 2
    wide = tuning.search_space({"a": list(range(10)), "b": ["x", "y"]})
    drawn = tuning.trial_points(wide, "random_search", 4, 42)
    every = tuning.trial_points(wide, "grid_search", 4, 42)
    assert every == [{"a": a, "b": b} for a in range(10) for b in "xy"]
    assert len(drawn) == 4 and drawn == [p for p in every if p in drawn] == tuning.trial_points(wide, "random_search", 4, 42)
    assert tuning.search_space({"a": [1]}, {"random_state": [1, 2, 3]})["random_state"] == [1, 2, 3]
    for grid, params in (({"a": []}, {}), ({}, {"random_state": []})):
        with pytest.raises(ValueError, match="no values for"):
            tuning.search_space(grid, params)



def test_cross_validation(hourly):
    folds = [{"train_periods": ["2023"], "validation_periods": ["2024"]}, {"name": "late", "train_periods": ["2024"], "validation_periods": ["2025"]}]
    predictions, scored = evaluate.cross_validation(hourly, SPEC, LINEAR, folds)
    assert {r.fold for r in scored.collect()} == {"fold_1", "late"}
    # Each fold scores its own window, whatever testing window is configured.
    years = {(r.fold, r.y) for r in predictions.select("fold", F.year("prediction_time").alias("y")).distinct().collect()}
    assert years == {("fold_1", 2024), ("late", 2025)}
    for bad in ([], [{"train_periods": ["2023"]}]):
        with pytest.raises(ValueError):
            evaluate.cross_validation(hourly, SPEC, LINEAR, bad)


def test_stored_frames_use_the_shared_folder(spark, tmp_path, monkeypatch):
    from stationweave import session

    # The setting itself is fixed when a session starts.
    monkeypatch.setattr(session, "shared_dir", lambda _: str(tmp_path))
    stored = session.materialise(spark.range(3))
    assert stored.count() == 3 and any(p.name.startswith("stationweave-") for p in tmp_path.iterdir())


@pytest.mark.parametrize("strategy", ["median", "random_forest"])
def test_other_missing_value_strategies_keep_rows(hourly, strategy):
    small = hourly.where("year(ts) = 2023").drop("NO2").withColumn("RH", F.col("`PM2.5`") * 0 + F.hour("ts"))
    spec = SPEC.with_(missing_values=strategy)
    cleaned = prepare.clean_readings(small, spec)
    assert cleaned.count() == small.count() and cleaned.where("`PM2.5` IS NULL").count() == 0


def test_comparison_csv(spark, tmp_path):
    rows = spark.sql(
        "SELECT 'c' AS config, 's' AS target_station_id, 'm' AS algorithm, 'overall' AS validation_period_name, "
        "'' AS validation_period_start, '' AS validation_period_end, 1.5D AS RMSE"
    )
    path = results.write_comparison_csv(rows, config_dir=str(tmp_path))
    assert "/outputs/evaluation_comparison_" in path
    assert spark.read.option("header", True).csv(path).first().RMSE == "1.5"
    with pytest.raises(ValueError):
        results.write_comparison_csv(rows.where("false"), str(tmp_path / "x.csv"))
