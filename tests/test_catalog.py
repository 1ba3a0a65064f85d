"""The registered queries against their SQL on the smallest tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from tests.conftest import DATA
from tools.check_oracles import compare, connect

# One or two queries per family here; tools/check_oracles.py runs them all.
FAST = [
    "a5_station_from_path", "a6_year_file_pruning", "a12_results_scan", "b4_period_bounds", "b11_positional_tail", "b15_report_periods",
    "c4_baseline_table", "c6_evaluation_comparison", "g3_mixed_type_profile", "g5_correlation", "g12_r2", "g14_per_period_metrics",
    "g20_champions", "j6_imputation_stats", "j9_leave_one_station_out", "j9_many_stations", "m4_linear_regression", "m17_tuning_data",
    "r3_multi_pollutant_matrix", "s8_infer_pollutant", "w1_multi_pollutant_lags", "w2_horizon_labels", "w4_rank_by_rmse",
]


@pytest.fixture(scope="module")
def duck():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()) if os.environ.get("ALL_QUERIES") else FAST)
def test_query_equals_sql(spark, duck, name):
    problem = compare(entry.queries()[name](spark, DATA).toPandas(), duck.sql(entry.oracle_sql()[name]).df())
    assert problem == "" or problem.startswith("(types")


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
