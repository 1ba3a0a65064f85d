from __future__ import annotations

from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from stationweave.functions import names, periods, positions, quantiles
from stationweave.operators import baselines
from stationweave.functions.choices import normalization_method
from stationweave.specs import StationSpec


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_period_forms_and_years():
    raw = ["2024", {"start": "2025-01", "end": "2025-02"}, {"start": "2025-03-03", "end": "2025-03-04"}]
    found = periods.normalize_periods(raw)
    assert found[0] == periods.Period(datetime(2024, 1, 1), datetime(2024, 12, 31, 23, 59, 59))
    assert found[1].end == datetime(2025, 2, 28, 23, 59, 59)
    assert found[2].end == datetime(2025, 3, 4, 23, 59, 59)
    assert periods.period_years(raw) == [2024, 2025]


def test_period_missing_side_and_full_timestamp():
    only_end = periods.normalize_periods({"end": "2024-02"})[0]
    assert only_end == periods.Period(datetime(2024, 2, 1), datetime(2024, 2, 29, 23, 59, 59))
    exact = periods.normalize_periods("2024-02-03 04:05:06")[0]
    assert exact.start == exact.end == datetime(2024, 2, 3, 4, 5, 6)
    assert periods.normalize_periods(None) == []


@pytest.mark.parametrize("bad, error", [([{}], ValueError), ([{"start": "2025", "end": "2024"}], ValueError), ([3], TypeError), (["  "], ValueError)])
def test_period_errors(bad, error):
    with pytest.raises(error):
        periods.normalize_periods(bad)


def test_split_window_fallbacks():
    spec = StationSpec("a", ("b",), ("x",), test_days=["2024-01-05"])
    assert periods.validation_windows(spec) == periods.testing_windows(spec)
    spec = spec.with_(validation_periods=["2023"])
    assert periods.testing_windows(spec)[0].start.year == 2023
    assert periods.testing_windows(spec.with_(testing_periods=["2022"]))[0].start.year == 2022


def test_mask_is_never_null_and_end_is_a_whole_second(spark):
    df = spark.createDataFrame([("2024-12-31 23:59:59",), ("2024-12-31 23:59:59.5",), (None,)], "t string")
    df = df.withColumn("t", df.t.cast("timestamp_ntz"))
    got = [r.m for r in df.select(periods.in_periods(F.col("t"), ["2024"]).alias("m")).collect()]
    assert got == [True, False, False]
    assert periods.drop_periods(df, F.col("t"), ["2024"]).count() == 2
    assert periods.keep_periods(df, F.col("t"), []).count() == 3
    assert df.where(periods.in_periods(F.col("t"), [])).count() == 0


def test_union_of_periods(spark):
    df = spark.sql("SELECT CAST(d AS TIMESTAMP_NTZ) AS t FROM VALUES ('2025-01-10'), ('2025-02-10'), ('2025-04-10') AS v(d)")
    mask = periods.in_periods(F.col("t"), [{"start": "2025-01", "end": "2025-01"}, "2025-04"])
    assert [r.m for r in df.select(mask.alias("m")).collect()] == [True, False, True]


def test_overlapping_periods_repeat_rows(spark):
    df = spark.sql("SELECT timestamp_ntz'2025-01-10' AS t, 1 AS x")
    rows = periods.assign_periods(df, "t", ["2025", "2025-01", "2024"]).collect()
    assert sorted(r.period_name for r in rows) == ["period_01", "period_02"]


def test_period_filter_reaches_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    plan = periods.keep_periods(df, F.col("o_orderdate"), ["1996"])._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    assert "GreaterThanOrEqual(o_orderdate,1996-01-01T00:00)" in plan.replace(" ", "") or "GreaterThanOrEqual(o_orderdate" in plan


def test_dense_positions_across_days_seconds_and_micros(spark):
    times = [datetime(2024, 1, d, 0, 0, s, u) for d in (1, 3, 2) for s in (5, 0) for u in (7, 1)]
    df = spark.createDataFrame([(t,) for t in times], "ts timestamp_ntz")
    got = {r.ts: r.pos for r in positions.time_position(df, "ts", "pos").collect()}
    assert [got[t] for t in sorted(times)] == list(range(len(times)))


def test_positions_restart_per_key(spark):
    df = spark.sql("SELECT k, CAST(concat('2024-01-0', d) AS TIMESTAMP_NTZ) AS ts FROM VALUES ('a', 3), ('a', 1), ('b', 2) AS v(k, d)")
    got = sorted((r.k, r.pos) for r in positions.time_position(df, "ts", "pos", ["k"]).collect())
    assert got == [("a", 0), ("a", 1), ("b", 0)]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6).map(lambda v: round(v, 3)), min_size=1, max_size=40), st.sampled_from([1, 3, 10**6]))
def test_quantiles_equal_pandas(spark, values, last):
    df = spark.createDataFrame([("k", v) for v in values], "k string, v double")
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = quantiles.exact_quantiles(df, "v", probs, ["k"], last=last).first()
    assert got.n == len(values)
    assert got.quantiles == pytest.approx(list(pd.Series(values).quantile(probs)), abs=1e-9)


def test_quantiles_of_a_large_skewed_key(spark):
    """One key holds nearly all rows, half of them equal, with values far out on both sides."""
    n = 200_000
    far = F.when(F.col("id") % 997 == 1, F.lit(1e300)).when(F.col("id") % 997 == 3, F.lit(-1e300))
    df = spark.range(n).select(
        F.when(F.col("id") < 50, "small").otherwise("large").alias("k"),
        F.when(F.col("id") % 2 == 0, 7.0).otherwise(F.coalesce(far, (F.col("id") * 37 % 10007) / 10.0)).alias("v"),
    )
    got = {r.k: r.quantiles for r in quantiles.exact_quantiles(df, "v", [0.1, 0.25, 0.5, 0.75], ["k"], last=100).collect()}
    pdf = df.toPandas()
    for key, part in pdf.groupby("k"):
        assert got[key] == pytest.approx(list(part.v.quantile([0.1, 0.25, 0.5, 0.75])))


def test_quantiles_without_keys_or_rows(spark):
    df = spark.range(101).select(F.col("id").cast("double").alias("v"))
    assert quantiles.exact_quantiles(df, "v", [0.5], [], last=5).first().quantiles == [50.0]
    assert quantiles.exact_quantiles(df.where("false"), "v", [0.5], []).count() == 0


@pytest.mark.parametrize(
    "text, expected", [("a b/c", "a_b_c"), ("__x__", "x"), ("  ", "config"), ("PM2.5", "PM2_5"), ("a-b", "a-b")]
)
def test_sanitize(spark, text, expected):
    assert one(spark, names.sanitize_identifier(F.lit(text))) == expected
    assert baselines.clean_id(text) == expected


def test_label_functions(spark):
    assert one(spark, names.short_pollutant(F.lit("target_value__PM2.5 (µg/m³)"))) == "PM2_5"
    assert one(spark, names.algorithm_label(F.lit("a.b.Forest"))) == "Forest"
    assert one(spark, names.algorithm_label(F.lit(""))) == "unknown"
    assert one(spark, names.metric_group(F.lit("by_target.target_value__PM2.5.RMSE"))) == "target_value__PM2.5"
    assert one(spark, names.metric_short(F.lit("by_target.target_value__PM2.5.RMSE"))) == "RMSE"
    assert one(spark, names.metric_group(F.lit("RMSE"))) == "overall"
    params = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("[1,2]"))
    assert one(spark, names.params_text(params)) == "a=1, b=[1,2]"
    assert names.render_params({"a": 1, "b": [1, 2]}) == {"a": "1", "b": "[1,2]"}


def test_feature_names():
    assert names.feature_name("s", 0) == "neighbor__s"
    assert names.feature_name("s", 2, "NO2") == "neighbor__NO2__s__lag_2"
    assert names.pollutant_of_target("target_value__PM2.5") == "PM2.5"
    assert names.pollutant_of_target("target_value") is None


def test_nan_and_text_become_null(spark):
    assert one(spark, names.clean_double(F.lit(float("nan")))) is None
    assert one(spark, names.numeric_or_null(F.lit("n/a"))) is None
    assert np.isclose(one(spark, names.numeric_or_null(F.lit("2.5"))), 2.5)


@pytest.mark.parametrize("raw, name", [(True, "zscore"), (False, "none"), (None, "zscore"), ("Min-Max", "minmax"), ("standard", "zscore")])
def test_normalization_aliases(raw, name):
    assert normalization_method(raw) == name


def test_unknown_normalization():
    with pytest.raises(ValueError):
        normalization_method("log")
