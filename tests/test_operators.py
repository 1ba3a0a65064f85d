from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stationweave.functions.names import q
from stationweave.operators import baselines, clean, impute, matrix, metrics, normalize, profile, projection, report, scoring, splits
from stationweave.operators import supervised as sv
from stationweave.specs import StationSpec, Task


def hours(*values, start="2025-01-01"):
    """(ts, station, value) rows of one station per list, on an hourly axis."""
    base = pd.Timestamp(start)
    return [
        (str(base + pd.Timedelta(hours=i)), s, float(v)) for s, series in values for i, v in enumerate(series) if v is not None
    ]


def test_lags_and_horizon(readings):
    df = readings(hours(("t", [10.0, 11, 12, 13]), ("a", [1.0, 2, 3, 4]), ("b", [5.0, 6, 7, 8])))
    task = Task("x", "t", ("a", "b"), ("PM2.5",), 3, 1)
    rows = sv.supervised_frame(df, task).collect()
    assert len(rows) == 1
    row = rows[0].asDict()
    assert [row[f"neighbor__a{k}"] for k in ("", "__lag_1", "__lag_2")] == [3, 2, 1]
    assert row["target_value"] == 13 and row["prediction_time"] > row["feature_time"]


def _pandas_rows(df, task):
    """Positional shift over the sorted wide matrix."""
    wide = df.toPandas().pivot_table(index="ts", columns="station_id", values=task.pollutants[0], aggfunc="mean").sort_index()
    out = pd.DataFrame(index=wide.index)
    for s in task.input_stations:
        for k in range(task.lags):
            out[f"neighbor__{s}" + (f"__lag_{k}" if k else "")] = wide[s].shift(k)
    out["target_value"] = wide[task.target_station].shift(-task.horizon)
    out["prediction_time"] = wide.index.to_series().shift(-task.horizon)
    return out.dropna().reset_index().rename(columns={"ts": "feature_time"})


@pytest.mark.parametrize("lags, horizon, block", [(1, 0, 7), (1, 2, 7), (4, 0, 7), (3, 5, 4), (9, 1, 2), (2, 1, 1_024)])
def test_rows_equal_pandas_for_any_block_length(spark, readings, monkeypatch, lags, horizon, block):
    """Gaps, duplicate readings, a station outside the task, and several short blocks."""
    rng = np.random.default_rng(lags * 10 + horizon)
    rows = []
    for i in range(120):
        for s in "abct":
            if rng.random() < 0.85:
                ts = str(pd.Timestamp("2025-01-01") + pd.Timedelta(minutes=int(i * 7 + (i % 5 == 0) * 1440)))
                rows += [(ts, s, float(rng.integers(0, 50)))] * int(rng.integers(1, 3))
    df = readings(rows)
    task = Task("x", "t", ("a", "b"), ("PM2.5",), lags, horizon)
    monkeypatch.setattr(sv.block_windows, "__defaults__", (block,))
    got = sv.supervised_frame(df, task).orderBy("feature_time").toPandas()
    want = _pandas_rows(df, task)
    assert len(got) == len(want) and len(got) > 0
    assert (got.prediction_time.values == want.prediction_time.values).all()
    names = sv.feature_names(task) + ["target_value"]
    assert np.allclose(got[names], want[names])


@pytest.mark.parametrize("names, lags, horizon, most", [(("PM2.5",), 3, 2, 7), (("PM2.5",), 1, 0, 10_000), (("PM2.5", "NO2"), 2, 1, 20)])
def test_listed_tasks_and_tasks_of_a_table_agree(spark, readings, monkeypatch, names, lags, horizon, most):
    """Also where a station's cells meet its slots in several tasks, and with tasks that no row fits."""
    rng = np.random.default_rng(3)
    rows = [
        (f"2025-01-{1 + i // 20:02} {i % 20:02}:00:00", s, *[None if rng.random() < 0.1 else float(rng.integers(90)) for _ in names]) for s in "abcd" for i in range(60)
    ]
    df = readings(rows, names)
    tasks = [*sv.leave_one_out("abcd", names, lags, horizon), Task("odd", "a", ("c",), names, lags, horizon), Task("gone", "a", ("nowhere",), names, lags, horizon)]
    monkeypatch.setattr(sv, "STATION_CELLS", most)
    links = spark.createDataFrame([(t.task_id, t.target_station, list(t.input_stations)) for t in tasks] + [(None, "a", ["b"])], "task_id string, target string, inputs array<string>")
    listed = sv.supervised_tasks(df, tasks).orderBy("task_id", "feature_time").collect()
    linked = sv.supervised_links(df, links, names, lags, horizon).orderBy("task_id", "feature_time").collect()
    assert listed == linked and len(listed) > 50
    with pytest.raises(ValueError):
        sv.supervised_links(df, links, names, 0)


def test_columns_whose_names_run_together(readings):
    """A wide matrix tells `a__b` at station `c` from `a` at `b__c`."""
    pollutants, stations = ("a", "a__b"), ("b__c", "c", *(f"s{i}" for i in range(20)))
    df = readings([("2025-01-01", "c", None, 1.0), ("2025-01-01", "b__c", 2.0, None), ("2025-01-01", "c", 3.0, None)], pollutants)
    wide = matrix.station_matrix(df, pollutants, stations)
    assert len(wide.columns) == 45 and wide.columns.count("a__b__c") == 2
    row = wide.collect()[0]
    assert (row[1], row[2], row[23], row[24]) == (2.0, 3.0, None, 1.0)


def test_profile_of_an_empty_frame(readings):
    got = profile.column_profile(readings([]), ("ts",)).orderBy("column").collect()
    assert [(r.column, r.row_count, r.present_count, r.unique, r["median"]) for r in got] == [("PM2.5", 0, 0, 0, None), ("station_id", 0, 0, 0, None)]


def test_tasks_over_different_pollutants(readings):
    df = readings([("2025-01-01", "a", 1.0, None), ("2025-01-01", "b", 2.0, 3.0), ("2025-01-02", "a", 4.0, 5.0), ("2025-01-02", "b", 6.0, 7.0)], ("x", "y"))
    tasks = [Task("x", "a", ("b",), ("x",)), Task("y", "a", ("b",), ("y",))]
    got = {(r.task_id, tuple(r.features), tuple(r.targets)) for r in sv.supervised_tasks(df, tasks).collect()}
    assert got == {("x", (2.0,), (1.0,)), ("x", (6.0,), (4.0,)), ("y", (7.0,), (5.0,))}


def test_lag_plan_has_no_single_partition_of_readings_and_no_python(spark, readings):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").selectExpr(
        "l_shipdate AS ts", "l_returnflag AS station_id", "l_quantity AS v"
    )
    plan = sv.supervised_frame(df, Task("x", "A", ("N", "R"), ("v",), 3, 1))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert "SinglePartition" not in plan
    # On the stored axis one ordered partition holds a count per calendar day, never rows.
    lines = matrix.time_axis(df, ["v"])._jdf.queryExecution().executedPlan().toString().splitlines()
    singles = [i for i, line in enumerate(lines) if "SinglePartition" in line]
    assert len(singles) == 1 and "__level0" in lines[singles[0] + 1] and "sum(" in lines[singles[0] + 1]
    assert "ReadSchema: struct<l_quantity:double,l_returnflag:string,l_shipdate:timestamp_ntz>" in plan


@pytest.mark.parametrize("bad", [dict(lags=0), dict(horizon=-1)])
def test_task_errors(bad):
    with pytest.raises(ValueError):
        Task("x", "a", ("b",), ("v",), **bad)


def test_matrix_keeps_times_of_other_stations_and_drops_empty_ones(readings):
    df = readings([("2025-01-01", "a", 1.0), ("2025-01-01", "a", 3.0), ("2025-01-02", "z", 5.0), ("2025-01-03", "a", None)])
    rows = matrix.station_matrix(df, ["PM2.5"], ["a"]).orderBy("ts").collect()
    assert [r.a for r in rows] == [2.0, None]


def test_wide_and_pivoted_matrix_agree(readings):
    df = readings([("2025-01-01", "a", 1.0, 2.0), ("2025-01-01", "b", None, 4.0), ("2025-01-02", "b", 5.0, float("nan"))], ("x.1", "y"))
    wide = matrix.station_matrix(df, ["x.1", "y"], ["a", "b"]).orderBy("ts").collect()
    pivoted = matrix._pivoted(df, ["x.1", "y"], ["a", "b"], "ts", "station_id").orderBy("ts").collect()
    assert wide == pivoted and wide[1]["y__b"] is None


def test_drop_rows_counts(readings):
    rows = [("2025-01-01", "a", 1.0, 10.0), ("2025-01-02", "a", None, 20.0), ("2025-01-01", "b", 3.0, None), ("2025-01-02", "b", 4.0, 40.0)]
    df = readings(rows, ("PM2.5", "NO2"))
    kept = clean.drop_missing(df, ["PM2.5", "NO2", "absent"])
    assert kept.count() == 2
    found = {(r.station_id, r["column"]): (r.missing_before, r.missing_after) for r in clean.drop_details(df, ["PM2.5", "NO2"]).collect()}
    assert found[("a", "PM2.5")] == (1, 0) and found[("b", "NO2")] == (1, 0) and found[("__all__", "PM2.5")] == (1, 0)
    dropped = {r.station_id: r.dropped_rows for r in clean.dropped_rows(df, ["PM2.5", "NO2"]).collect()}
    assert dropped == {"a": 1, "b": 1, "__all__": 2}
    assert clean.drop_missing(df, []).count() == 4


def test_profile_values(readings):
    df = readings([("2025-01-01", "a", 1.0, 2.0), ("2025-01-02", "b", None, 4.0)], ("PM2.5", "NO2"))
    found = {r["column"]: r for r in profile.column_profile(df, ("ts", "station_id")).collect()}
    assert found["PM2.5"].present_pct_of_all_rows == 50.0 and found["NO2"].median == 3.0
    assert found["PM2.5"].missing_count == 1 and found["NO2"].unique == 2


def test_profile_of_empty_and_all_missing(readings):
    df = readings([("2025-01-01", "a", None)])
    row = profile.column_profile(df, ("ts", "station_id")).first()
    assert (row.present_count, row.unique, row.median, row["mean"]) == (0, 0, None, None)
    empty = profile.column_profile(df.where("false"), ("ts", "station_id")).first()
    assert (empty.row_count, empty.present_pct_of_all_rows) == (0, 0.0)


def test_correlation_drops_silent_columns(readings):
    rows = [(f"2025-01-0{i}", "a", float(i), 2.0 * i, 5.0) for i in range(1, 5)]
    df = readings(rows, ("PM2.5", "NO2", "flat"))
    found = {(r.col_a, r.col_b): r["corr"] for r in profile.correlation(df, ["PM2.5", "NO2", "flat"]).collect()}
    assert found == {(a, b): 1.0 for a in ("PM2.5", "NO2") for b in ("PM2.5", "NO2")}


@pytest.mark.parametrize(
    "method, train, test",
    [
        ("zscore", ([10.0, 12.0], [1.0, 3.0]), (14.0, 5.0)),
        ("minmax", ([10.0, 20.0], [2.0, 6.0]), (15.0, 4.0)),
        ("robust", ([0.0, 10.0, 20.0], [1.0, 1.0, 9.0]), (15.0, 5.0)),
        ("maxabs", ([-2.0, 4.0], [-10.0, 5.0]), (1.0, -2.5)),
        ("none", ([1.0, 2.0], [3.0, 4.0]), (5.0, 6.0)),
    ],
)
def test_normalisation_round_trip(spark, method, train, test):
    frame = spark.createDataFrame(list(zip(*train)), "f1 double, f2 double")
    stats = normalize.fit(frame, ["f1", "f2"], method)
    f1 = pd.Series(train[0])
    center, scale = {
        "zscore": (f1.mean(), f1.std(ddof=0)),
        "minmax": (f1.min(), f1.max() - f1.min()),
        "robust": (f1.median(), f1.quantile(0.75) - f1.quantile(0.25)),
        "maxabs": (0.0, f1.abs().max()),
        "none": (0.0, 1.0),
    }[method]
    scaled = normalize.apply_stats(spark.createDataFrame([test], "f1 double, f2 double"), stats)
    assert scaled.first().f1 == pytest.approx((test[0] - center) / scale)
    back = scaled.select(normalize.denormalize(q("f1"), stats, "f1").alias("v")).first().v
    assert back == pytest.approx(test[0])


def test_constant_column_scales_by_one(spark):
    frame = spark.createDataFrame([(3.0,), (3.0,)], "f double")
    for method in ("zscore", "minmax", "robust"):
        assert normalize.fit(frame, ["f"], method).columns["f"][1] == 1.0
    assert normalize.fit(frame.selectExpr("0.0D AS f"), ["f"], "maxabs").columns["f"][1] == 1.0


def test_metrics_and_constant_actuals(spark):
    rows = [("perfect", 1.0, 1.0), ("perfect", 2.0, 2.0), ("flat", 5.0, 5.0), ("flat", 5.0, 5.0), ("off", 5.0, 4.0), ("off", 5.0, 5.0)]
    df = spark.createDataFrame(rows, "g string, actual double, prediction double")
    found = {r.g: (r.RMSE, r.R2) for r in metrics.score(df, ["g"]).collect()}
    assert found["perfect"] == (0.0, 1.0) and found["flat"] == (0.0, 1.0)
    assert found["off"][1] == 0.0


def test_baselines(readings):
    df = readings(hours(("a", [1.0, 3.0]), ("b", [3.0, 1.0]), ("t", [2.0, 2.0])))
    task = Task("x", "t", ("a", "b"), ("PM2.5",))
    rows = sv.supervised_frame(df, task)
    found = {r.algorithm: r.RMSE for r in baselines.baseline_metrics(rows, task).collect()}
    assert found["Baseline: Average of Other Stations"] == 0.0
    assert found["Baseline: Replace with Station a"] == 1.0
    wide = baselines.baseline_table(rows, task)
    assert wide.columns == [
        "prediction_time", "actual", "prediction__baseline_average_of_other_stations",
        "prediction__baseline_replace_with_station_a", "prediction__baseline_replace_with_station_b",
    ]


def test_row_mean_skips_missing(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (2.0, 4.0)], "a double, b double")
    got = [r.m for r in df.select(baselines.row_mean([F.col("a"), F.col("b")]).alias("m")).collect()]
    assert got == [1.0, None, 3.0]


def test_predictions_without_pairs(spark):
    with pytest.raises(ValueError):
        baselines.predictions_long(spark.sql("SELECT 1 AS prediction_time, 2 AS other"))


def test_period_scores_keep_empty_periods(spark):
    df = spark.sql("SELECT timestamp_ntz'2025-01-05' AS prediction_time, 'x' AS target, 1.0D AS actual, 2.0D AS prediction")
    rows = {r.period_name: r for r in metrics.score_periods(df, ["2025-01", "2030"], ["target"]).collect()}
    assert rows["period_01"].row_count == 1 and not rows["period_01"].skipped
    assert rows["period_02"].skipped and rows["period_02"].reason


def test_projection_order_and_errors(readings):
    df = readings([("2025-01-01", "a", 1.0, 2.0)], ("PM2.5", "NO2"))
    spec = StationSpec("a", ("b",), ("PM2.5",), columns=("NO2",))
    assert projection.project_required(df, spec).columns == ["NO2", "ts", "station_id", "PM2.5"]
    with pytest.raises(KeyError, match="RH"):
        projection.project_required(df, spec.with_(columns=("RH",)))
    with pytest.raises(KeyError, match="b"):
        projection.check_stations(df, spec)
    assert projection.export_view(df, spec.with_(columns=("RH",))).columns == ["ts", "station_id", "PM2.5"]


def _rows(spark, n=10):
    return spark.range(n).selectExpr(
        "timestamp_ntz'2025-01-01' + make_interval(0, 0, 0, int(id)) AS feature_time",
        "double(id) AS neighbor__b", "double(id) AS target_value",
        "timestamp_ntz'2025-01-01' + make_interval(0, 0, 0, int(id)) AS prediction_time",
    )


def test_positional_split(spark):
    spec = StationSpec("a", ("b",), ("x",), train_frac=0.75)
    train, test = splits.split_rows(_rows(spark), spec)
    assert (train.count(), test.count()) == (7, 3)
    assert splits.select_test_rows(_rows(spark, 1), spec).count() == 0
    assert test.agg(F.min("target_value")).first()[0] == 7.0


def test_split_by_years_and_windows(spark):
    spec = StationSpec("a", ("b",), ("x",), testing_periods=["2025-01-03"], train_years=(2025,))
    train, test = splits.split_rows(_rows(spark), spec)
    assert (train.count(), test.count()) == (9, 1)
    with pytest.raises(ValueError):
        splits.split_rows(_rows(spark), spec.with_(train_years=(2020,)))
    train, test = splits.split_rows(_rows(spark), spec.with_(train_years=(), testing_periods=["2030"]))
    assert (train.count(), test.count()) == (7, 3)


def test_empty_test_falls_back_to_all_rows(spark):
    spec = StationSpec("a", ("b",), ("x",), testing_periods=["2030"])
    assert splits.test_rows_or_all(_rows(spark), spec).count() == 10
    with pytest.raises(ValueError, match="2025-01-01"):
        splits.test_rows_or_all(_rows(spark), spec, strict=True)


def _comparison(spark, rmse=(2.0, 1.0)):
    rows = [
        ("c1", "s1", "forest", "overall", "", "", rmse[0], {"k": "1"}),
        ("c2", "s1", "Baseline: Average of Other Stations", "overall", "", "", rmse[1], None),
    ]
    return spark.createDataFrame(
        rows,
        "config string, target_station_id string, algorithm string, validation_period_name string, "
        "validation_period_start string, validation_period_end string, RMSE double, best_params map<string,string>",
    )


def test_ranks(spark):
    ranked = {r.config: r.rank_by_rmse for r in report.rank_by_rmse(_comparison(spark)).collect()}
    assert ranked == {"c1": 2, "c2": 1}
    tied = {r.config: r.rank_by_rmse for r in report.rank_by_rmse(_comparison(spark, (1.0, 1.0))).collect()}
    assert tied == {"c2": 1, "c1": 2}
    assert {r.rank_by_rmse for r in report.rank_by_rmse(_comparison(spark, (1.0, None))).collect()} == {None}


def test_compact_and_expanded_rows(spark):
    rows = _comparison(spark)
    assert [r.config for r in report.compact_rows(rows).collect()] == ["c1"]
    from stationweave.functions.periods import period_frame

    expanded = report.expand_overall(rows.where("config = 'c1'"), period_frame(spark, ["2024", "2025-02"]))
    assert [(r.validation_period_name, r.validation_period_end) for r in expanded.orderBy("validation_period_name").collect()] == [
        ("period_01", "2024-12-31T23:59:59"), ("period_02", "2025-02-28T23:59:59"),
    ]


def test_wins_and_champion(spark):
    rows = [
        ("overall", "s", f"period_0{p}", "RMSE", a, v)
        for p, values in ((1, {"Baseline x": 1.0, "m": 2.0}), (2, {"Baseline x": 3.0, "m": 2.0}))
        for a, v in values.items()
    ] + [("overall", "s", "period_01", "R2", "m", 0.9), ("overall", "s", "period_01", "R2", "Baseline x", 0.1)]
    df = spark.createDataFrame(rows, "metric_group string, target_station_id string, validation_period_name string, metric_short string, algorithm string, value double")
    wins = {r.algorithm: r.wins for r in report.win_counts(df).collect()}
    assert wins == {"m": 2, "Baseline x": 1}
    assert report.champions(df).first().champion == "m"


def test_series_table(spark):
    df = spark.sql(
        """SELECT CAST(t AS TIMESTAMP_NTZ) AS prediction_time, 's-1' AS target_station_id, 'PM2.5' AS target, a AS algorithm, double(x) AS actual, double(p) AS prediction
        FROM VALUES ('2025-01-01', 'm', 1, 2), ('2025-01-01', 'Baseline: x', 1, 3), ('2025-01-02', 'm', 4, 5) AS v(t, a, x, p)"""
    )
    out = report.series_table(df).orderBy("prediction_time")
    assert set(out.columns) == {"prediction_time", "actual_s_1_PM2_5", "pred_s_1_PM2_5_m", "pred_s_1_PM2_5_Baseline_x"}
    assert [r["pred_s_1_PM2_5_Baseline_x"] for r in out.collect()] == [3.0, None]


def test_vectors(spark):
    task = Task("x", "t", ("a", "b"), ("v",), 2)
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0, 5.0],)], "features array<double>")
    row = scoring.vector_columns(df, task).first()
    assert (row.neighbor__a, row.neighbor__a__lag_1, row.neighbor__b__lag_1, row.surplus) == (1.0, 2.0, 4.0, 1)
    with pytest.raises(Exception, match="expected 4 neighbour values, received 2"):
        scoring.vector_columns(df.selectExpr("array(1.0D, 2.0D) AS features"), task).collect()
    history = df.withColumn("h", F.array(F.lit(9.0), F.lit(8.0)))
    assert scoring.vector_columns(history, task, history="h", target_lags=2).first().target_history_lag_2 == 8.0


def test_forest_imputation(readings):
    rows = [(f"2025-01-0{i + 1}", "s", v, 20.0 + i, 50.0 + 2 * i) for i, v in enumerate([10.0, 12.0, None, 16.0])]
    filled, details = impute.impute_forest(readings(rows, ("PM2.5", "NO2", "RH")), ["PM2.5", "NO2"], ("ts",), station="station_id", params={"n_estimators": 5})
    assert filled.where("`PM2.5` IS NULL").count() == 0 and filled.count() == 4
    assert filled.columns == ["ts", "station_id", "PM2.5", "NO2", "RH"]
    found = details.collect()
    assert [(r.method, r.missing_before, r.missing_after) for r in found] == [("random_forest", 1, 0)]


def test_forests_of_many_stations(spark, readings):
    """Each station is filled as if it were alone, also with medians for feature gaps and features of its own."""
    import numpy as np

    from stationweave.operators.trees import ForestSpec, grow_forest

    rng = np.random.default_rng(8)
    rows = []
    for s in ("a", "b", "c", "d"):
        for i in range(40):
            no2, rh = rng.normal(30, 5), rng.normal(60, 9)
            pm = 2 * no2 + rng.normal() if s in "ab" else -rh + rng.normal()
            rows.append((f"2025-01-01 00:{i:02}:00", s, None if i % 5 == 0 and s != "d" else pm, None if i % 7 == 0 else no2, rh))
    df = readings(rows, ("PM2.5", "NO2", "RH"))
    filled, details = impute.impute_forest(df, ["PM2.5"], ("ts",), top_k=1, station="station_id", params={"n_estimators": 12})
    found = {r.station_id: r for r in details.collect()}
    assert {s: r.selected_features for s, r in found.items()} == {"a": ["NO2"], "b": ["NO2"], "c": ["RH"]}
    assert all(abs(r.feature_correlations[r.selected_features[0]]) > 0.9 and (r.missing_before, r.missing_after) == (8, 0) for r in found.values())
    assert impute.imputation_totals(details).first().asDict() == {"column": "PM2.5", "stations": 3, "missing_before": 24, "missing_after": 0, "method": "per_station"}
    got = {(r.station_id, str(r.ts)): r["PM2.5"] for r in filled.collect()}
    from zlib import crc32

    for s, at in (("a", 3), ("b", 3), ("c", 4)):
        own = [r for r in rows if r[1] == s]
        known = [r for r in own if r[2] is not None]
        middle = np.median([r[at] for r in known if r[at] is not None])
        x = lambda some: np.array([[middle if r[at] is None else r[at]] for r in some])
        trees = grow_forest(x(known), np.array([[r[2]] for r in known]), ForestSpec("random_forest", 12), range(12), crc32(s.encode()))
        gaps = [r for r in own if r[2] is None]
        want = np.mean([t.predict(x(gaps)) for t in trees], 0)[:, 0]
        assert [got[s, r[0]] for r in gaps] == pytest.approx(list(want))


def test_forest_imputation_falls_back_to_medians(readings):
    rows = [("2025-01-01", "s", 4.0, 1.0), ("2025-01-02", "s", None, 2.0), ("2025-01-01", "u", None, 3.0), ("2025-01-02", "u", None, 4.0)]
    filled, details = impute.impute_forest(readings(rows, ("PM2.5", "NO2")), ["PM2.5"], ("ts",), station="station_id")
    methods = {r.station_id: (r.method, r.missing_after) for r in details.collect()}
    assert methods["s"] == ("median_fallback", 0) and methods["u"][0] == "median_fallback"
    assert filled.where("station_id = 's' AND `PM2.5` = 4").count() == 2


def test_median_imputation(readings):
    df = readings([("2025-01-01", "a", 1.0), ("2025-01-02", "a", None), ("2025-01-01", "b", 9.0), ("2025-01-02", "b", None)])
    filled, details = clean.impute_median(df, ["PM2.5"])
    assert sorted(r["PM2.5"] for r in filled.collect()) == [1.0, 5.0, 5.0, 9.0]
    assert details.first().missing_before == 2
    by_station, _ = clean.impute_median(df, ["PM2.5"], "station_id")
    assert sorted(r["PM2.5"] for r in by_station.collect()) == [1.0, 1.0, 9.0, 9.0]
