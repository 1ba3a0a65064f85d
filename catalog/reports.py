"""Baselines, comparison, ranking and report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from catalog.bindings import (
    FLAGS,
    MODEL_LABEL,
    MONTHS,
    NO2,
    PM,
    all_results,
    lineitem_readings,
    long_results,
    loo_predictions,
    overall_results,
    period_results,
    rounded,
    table,
    task,
)
from catalog.registry import query
from catalog.sql import ISO, MONTH_WINDOWS, R2, RMSE, longer, predictions, r, results
from catalog.stats import TWO_TARGETS
from stationweave.functions import periods
from stationweave.functions.names import metric_short
from stationweave.functions.positions import dense_position, time_levels
from stationweave.operators import baselines, metrics, report, supervised as sv

PRED_COLS = f"prediction_time, target_station_id, algorithm, target, {r('actual', 'actual')}, {r('prediction', 'prediction')}"


@query(f"WITH {predictions()} SELECT {PRED_COLS} FROM preds WHERE algorithm LIKE '%Average%'")
def c1_average_of_others(spark, sf):
    rows = loo_predictions(spark, sf)
    return rounded(rows.where(F.col("algorithm") == baselines.AVERAGE_NAME))


@query(f"WITH {predictions()} SELECT {PRED_COLS} FROM preds WHERE algorithm LIKE '%Replace%'")
def c2_replace_with_station(spark, sf):
    rows = loo_predictions(spark, sf)
    return rounded(rows.where(F.startswith("algorithm", F.lit(baselines.REPLACE_NAME))))


@query(
    f"WITH {predictions()} SELECT target_station_id, algorithm, count(*) AS row_count, {r(RMSE, 'RMSE')}, {r(R2, 'R2')} FROM preds WHERE algorithm LIKE 'Baseline%' GROUP BY ALL"
)
def c3_baseline_metrics(spark, sf):
    base = loo_predictions(spark, sf).where(report.is_baseline(F.col("algorithm")))
    return rounded(metrics.score(base, ["target_station_id", "algorithm"]))


@query(
    f"""WITH {TWO_TARGETS}, x AS (SELECT prediction_time, target, baseline_id, actual, prediction FROM preds)
    SELECT prediction_time, {', '.join(
        f"round(max(CASE WHEN target = 'target_value__{p}' THEN actual END), 6) + 0.0 AS \"actual__target_value__{p}\"" for p in ('PM2.5', 'NO2'))},
      {', '.join(
        f"round(max(CASE WHEN target = 'target_value__{p}' AND baseline_id = 'baseline_{b}' THEN prediction END), 6) + 0.0 AS \"prediction__baseline_{b}__target_value__{p}\""
        for b in ('average_of_other_stations', 'replace_with_station_N', 'replace_with_station_R') for p in ('PM2.5', 'NO2'))}
    FROM x GROUP BY prediction_time"""
)
def c4_baseline_table(spark, sf):
    t = task(1, 0, (PM, NO2))
    return rounded(baselines.baseline_table(sv.supervised_frame(lineitem_readings(spark, sf), t), t))


@query(
    f"""WITH {TWO_TARGETS} SELECT period_name, baseline_id, algorithm, target, count(*) AS row_count, {r(RMSE, 'RMSE')}, {r(R2, 'R2')}
    FROM preds JOIN {MONTH_WINDOWS} ON prediction_time BETWEEN period_start AND period_end GROUP BY ALL"""
)
def c5_per_period_baselines(spark, sf):
    t = task(1, 0, (PM, NO2))
    rows = sv.supervised_frame(lineitem_readings(spark, sf), t)
    scored = baselines.baseline_period_metrics(rows, t, MONTHS)
    return rounded(scored.select("period_name", "baseline_id", "algorithm", "target", "row_count", "RMSE", "R2"))


KEYS = "coalesce(target_station_id, ''), validation_period_start, validation_period_end, validation_period_name, algorithm, config"
RANKED = f"""both_ AS (SELECT * FROM period_rows UNION ALL BY NAME SELECT * FROM overall_rows),
  ranked AS (SELECT *, (row_number() OVER (ORDER BY "RMSE", {KEYS}))::INTEGER AS rank_by_rmse FROM both_)"""
SHOWN = 'run_id, config, target_station_id, algorithm, validation_period_name, validation_period_start, validation_period_end, row_count, "RMSE", "R2"'


def _comparison(spark, sf) -> DataFrame:
    every = all_results(spark, sf).drop("best_params")
    parts = [every.where("validation_period_name <> 'overall'"), every.where("validation_period_name = 'overall'")]
    return report.comparison_rows(*parts)


@query(f"WITH {results()}, {RANKED} SELECT {SHOWN}, rank_by_rmse FROM ranked")
def c6_evaluation_comparison(spark, sf):
    """Model and baseline rows of every window and overall, ranked together."""
    return report.rank_by_rmse(_comparison(spark, sf))


@query(f"WITH {results()} SELECT {SHOWN}, row_number() OVER (ORDER BY {KEYS}) AS line FROM (SELECT * FROM period_rows UNION ALL BY NAME SELECT * FROM overall_rows)")
def w5_comparison_order(spark, sf):
    """Report order with line numbers, counted per first letters and never in one task."""
    rows = _comparison(spark, sf)
    first = F.coalesce(F.col("target_station_id"), F.lit(""))
    placed = dense_position(rows, [report.order_key()], [F.ascii(first), F.ascii(F.substring(first, 2, 1))], "line")
    return report.sort_comparison(placed.withColumn("line", F.col("line") + 1))


@query(
    f"""WITH {results()}, {RANKED} SELECT target_station_id, algorithm, validation_period_name, "RMSE", TRUE AS unranked FROM ranked
    UNION ALL SELECT 'X', 'none', 'overall', NULL, TRUE FROM (SELECT min(target_station_id) FROM ranked)"""
)
def w4_no_rank_without_rmse(spark, sf):
    """One row without an error takes the ranks from the whole table."""
    rows = _comparison(spark, sf)
    gap = rows.groupBy().agg(F.min("target_station_id").alias("x")).select(
        F.lit("X").alias("target_station_id"), F.lit("none").alias("algorithm"), F.lit("overall").alias("validation_period_name")
    )
    ranked = report.rank_by_rmse(rows.unionByName(gap, allowMissingColumns=True))
    return ranked.select(
        "target_station_id", "algorithm", "validation_period_name", "RMSE", F.col("rank_by_rmse").isNull().alias("unranked")
    )


@query(
    """SELECT s_suppkey, (row_number() OVER (ORDER BY abs(s_acctbal), s_suppkey))::INTEGER AS rank_by_rmse FROM supplier"""
)
def w4_rank_by_rmse(spark, sf):
    """Suppliers ranked by the size of their balance, bucket by bucket."""
    rows = table(spark, sf, "supplier").select(
        "s_suppkey", F.abs("s_acctbal").alias("RMSE"), F.format_string("%012d", "s_suppkey").alias("config")
    )
    return report.rank_by_rmse(rows).select("s_suppkey", "rank_by_rmse")


@query(
    f"""WITH {results()}, {RANKED} SELECT {SHOWN}, rank_by_rmse, (row_number() OVER (ORDER BY rank_by_rmse))::INTEGER AS rank_in_table
    FROM ranked WHERE validation_period_name <> 'overall' AND algorithm NOT LIKE 'Baseline%'"""
)
def b14_compact_comparison(spark, sf):
    return report.compact_rows(report.rank_by_rmse(_comparison(spark, sf)))


LONG = f"{results()}, long_ AS ({longer('period_rows')}), long_o AS ({longer('overall_rows')})"


@query(f"WITH {LONG} SELECT * FROM long_ UNION ALL SELECT * FROM long_o WHERE target_station_id = 'R'")
def b15_report_periods(spark, sf):
    """Station R has only overall results, so those are what its report shows."""
    every = all_results(spark, sf)
    some = every.where("validation_period_name <> 'overall'")
    whole = every.where("validation_period_name = 'overall'")
    rows = report.comparison_rows(some.where("target_station_id <> 'R'"), whole).drop("best_params")
    chosen = report.report_periods(long_results(rows), ["target_station_id"])
    late = long_results(some.where("target_station_id = 'R'").drop("best_params"))
    return chosen.unionByName(late)


@query(
    f"""WITH {LONG}, t AS (SELECT target_station_id, algorithm, validation_period_name, metric, value FROM long_
      UNION ALL SELECT target_station_id, algorithm, validation_period_name, 'by_target.target_value__PM2.5.' || metric, value FROM long_)
    SELECT target_station_id, algorithm, validation_period_name, metric, value, 'target_value__PM2.5' AS metric_group, 'RMSE' AS metric_short
    FROM t WHERE metric = 'by_target.target_value__PM2.5.RMSE'"""
)
def b16_metric_subset(spark, sf):
    long = long_results(period_results(spark, sf).drop("best_params"))
    named = long.withColumn("metric", F.concat(F.lit(f"by_target.target_value__{PM}."), "metric"))
    kept = report.select_metrics(long.unionByName(named), ["RMSE"])
    return kept.select("target_station_id", "algorithm", "validation_period_name", "metric", "value", "metric_group", "metric_short")


@query(
    f"""WITH {LONG} SELECT o.run_id, o.config, o.target_station_id, o.algorithm, o.row_count, o."RMSE", o."R2", w.period_name AS validation_period_name,
    strftime(period_start, {ISO}) AS validation_period_start, strftime(period_end, {ISO}) AS validation_period_end FROM overall_rows o, {MONTH_WINDOWS}"""
)
def j7_overall_expansion(spark, sf):
    rows = overall_results(spark, sf).drop("best_params")
    return report.expand_overall(rows, periods.period_frame(spark, MONTHS))


@query(
    f"""WITH {results()} SELECT p.run_id, p.target_station_id, p.algorithm, p.validation_period_name, p."RMSE", n.n_runs FROM period_rows p
    JOIN (SELECT run_id, count(*) AS n_runs FROM overall_rows GROUP BY run_id) n USING (run_id)"""
)
def j8_run_metadata(spark, sf):
    """Run facts joined onto every metric row by run id."""
    every = all_results(spark, sf)
    facts = every.where("validation_period_name = 'overall'").groupBy("run_id").agg(F.count(F.lit(1)).alias("n_runs"))
    rows = every.where("validation_period_name <> 'overall'").select("run_id", "target_station_id", "algorithm", "validation_period_name", "RMSE")
    return rows.join(facts, "run_id")


def _series_sql() -> str:
    def clean(text: str) -> str:
        import re

        return re.sub("[^A-Za-z0-9]+", "_", text).strip("_")

    cols = []
    for s in FLAGS:
        cols.append(f"round(max(CASE WHEN target_station_id = '{s}' THEN actual END), 6) + 0.0 AS \"actual_{s}_target_value\"")
        others = [x for x in FLAGS if x != s]
        for a in ["Baseline: Average of Other Stations", *[f"Baseline: Replace with Station {o}" for o in others], MODEL_LABEL]:
            cols.append(
                f"round(max(CASE WHEN target_station_id = '{s}' AND algorithm = '{a}' THEN prediction END), 6) + 0.0 AS \"pred_{s}_target_value_{clean(a)}\""
            )
    return f"WITH {predictions()} SELECT prediction_time, {', '.join(cols)} FROM preds GROUP BY prediction_time"


@query(_series_sql())
def j2_series_table(spark, sf):
    """All series side by side on the time axis, with the actual values once per station."""
    return rounded(report.series_table(report.prediction_series(loo_predictions(spark, sf))))


@query(f"WITH {LONG} SELECT run_id, algorithm, validation_period_name, 'by_target.' || target_station_id || '.' || metric AS metric, value FROM long_")
def r7_flat_metrics(spark, sf):
    """Held-out stations as targets of one run."""
    rows = period_results(spark, sf).withColumns({"run_id": F.lit("all"), "target": F.col("target_station_id")})
    flat = metrics.flatten_metrics(rows, ["RMSE", "R2"], ["run_id", "algorithm", "validation_period_name"])
    single = F.regexp_extract("metric", r"^by_target\.([^.]+)\.", 1)
    # A model seen for one station only keeps its bare metric name; name those rows alike.
    named = flat.withColumn("station", single)
    lone = rows.groupBy("algorithm", "validation_period_name").agg(F.min("target").alias("only"))
    joined = named.join(lone, ["algorithm", "validation_period_name"])
    station = F.when(F.col("station") == "", F.col("only")).otherwise(F.col("station"))
    return joined.select(
        F.concat(F.lit("run_"), station).alias("run_id"),
        "algorithm",
        "validation_period_name",
        F.concat(F.lit("by_target."), station, F.lit("."), metric_short(F.col("metric"))).alias("metric"),
        "value",
    )


@query(
    f"""WITH {LONG} SELECT run_id, algorithm, validation_period_name, unnest([metric, 'by_target.target_value__PM2.5.' || metric]) AS metric, value FROM long_"""
)
def r8_pollutant_metric_names(spark, sf):
    """Single-target metrics also under the name of their run's pollutant."""
    from catalog.sources import _runs
    from stationweave.sources.results import comparable_metrics

    long = long_results(period_results(spark, sf)).withColumn(
        "source", F.when(report.is_baseline(F.col("algorithm")), "baseline").otherwise("model")
    )
    bare = long.drop("best_params", "config", "target_station_id")
    return comparable_metrics(bare, _runs(spark)).select("run_id", "algorithm", "validation_period_name", "metric", "value")


GRID = f"""{LONG}, s AS (SELECT DISTINCT validation_period_name, validation_period_start, validation_period_end, target_station_id FROM long_),
  a AS (SELECT DISTINCT validation_period_name, algorithm FROM long_)"""


def _report_metrics(spark, sf) -> DataFrame:
    long = long_results(period_results(spark, sf))
    return report.select_metrics(report.report_periods(long))


@query(
    f"""WITH {GRID} SELECT 'overall' AS metric_group, s.*, a.algorithm, p."RMSE", p."R2" FROM s JOIN a USING (validation_period_name)
    LEFT JOIN period_rows p ON p.target_station_id = s.target_station_id AND p.algorithm = a.algorithm AND p.validation_period_name = s.validation_period_name"""
)
def g17_station_algorithm_table(spark, sf):
    return report.station_algorithm_table(_report_metrics(spark, sf))


@query(
    f"""WITH {LONG}, a AS (SELECT DISTINCT target_station_id, algorithm FROM long_), s AS (SELECT DISTINCT target_station_id, validation_period_name, validation_period_start, validation_period_end FROM long_)
    SELECT 'overall' AS metric_group, s.*, a.algorithm, p."RMSE", p."R2", CASE WHEN a.algorithm = '{MODEL_LABEL}' THEN 'depth=3, seeds=[1,2]' ELSE '' END AS best_params
    FROM s JOIN a USING (target_station_id) LEFT JOIN period_rows p ON p.target_station_id = s.target_station_id AND p.algorithm = a.algorithm AND p.validation_period_name = s.validation_period_name"""
)
def g18_period_algorithm_table(spark, sf):
    return report.period_algorithm_table(_report_metrics(spark, sf))


ORDERED = "NOT starts_with(lower(algorithm), 'baseline'), algorithm"
BEST = f"""{LONG}, o AS (SELECT *, CASE WHEN metric = 'R2' THEN -value ELSE value END AS bad FROM long_),
  best AS (SELECT *, row_number() OVER (PARTITION BY target_station_id, validation_period_name, metric ORDER BY bad, {ORDERED}) AS first_,
    row_number() OVER (PARTITION BY target_station_id, validation_period_name, metric ORDER BY bad DESC, starts_with(lower(algorithm), 'baseline'), algorithm DESC) AS last_ FROM o)"""


@query(
    f"""WITH {BEST} SELECT b.target_station_id, b.validation_period_name, b.metric AS metric_short, b.value AS best_value, b.algorithm AS best_algorithm,
    w.value AS worst_value, w.algorithm AS worst_algorithm FROM best b JOIN best w USING (target_station_id, validation_period_name, metric) WHERE b.first_ = 1 AND w.last_ = 1"""
)
def g19_best_and_worst(spark, sf):
    return report.best_and_worst(_report_metrics(spark, sf), ["target_station_id", "validation_period_name"])


WINS = f"""{BEST}, wins AS (SELECT a.target_station_id, a.algorithm, count(b.metric) AS wins FROM (SELECT DISTINCT target_station_id, algorithm FROM long_) a
  LEFT JOIN (SELECT * FROM best WHERE first_ = 1) b USING (target_station_id, algorithm) GROUP BY ALL)"""


@query(f"WITH {WINS} SELECT 'overall' AS metric_group, target_station_id, algorithm, wins FROM wins")
def g20_win_counts(spark, sf):
    return report.win_counts(_report_metrics(spark, sf))


@query(
    f"""WITH {WINS} SELECT 'overall' AS metric_group, target_station_id, algorithm AS champion, wins, possible FROM (SELECT *, sum(wins) OVER (PARTITION BY target_station_id)::BIGINT AS possible,
    row_number() OVER (PARTITION BY target_station_id ORDER BY wins DESC, {ORDERED}) AS r FROM wins) WHERE r = 1"""
)
def g20_champions(spark, sf):
    return report.champions(_report_metrics(spark, sf))


SPLITS = f"""{predictions()}, split_ AS (SELECT *, CASE WHEN year(prediction_time) < 2001 THEN 'training' ELSE 'evaluation' END AS split FROM preds)"""


def _splits(spark, sf) -> DataFrame:
    p = loo_predictions(spark, sf)
    early = F.year("prediction_time") < 2001
    return report.with_splits(p.where(early), p.where(~early))


@query(
    f"""WITH {SPLITS} SELECT target_station_id, algorithm, round(least(min(actual), min(prediction)), 6) + 0.0 AS axis_min, round(greatest(max(actual), max(prediction)), 6) + 0.0 AS axis_max,
    count(*) FILTER (split = 'training') AS n_training, count(*) FILTER (split = 'evaluation') AS n_evaluation FROM split_ GROUP BY ALL"""
)
def g21_shared_range(spark, sf):
    return rounded(report.shared_range(_splits(spark, sf), ["target_station_id", "algorithm"]))


@query(f"WITH {SPLITS} SELECT split, target_station_id, count(*) AS n, {r('avg(prediction)', 'mean_prediction')} FROM split_ GROUP BY ALL")
def u2_union_of_splits(spark, sf):
    rows = _splits(spark, sf).groupBy("split", "target_station_id")
    return rounded(rows.agg(F.count(F.lit(1)).alias("n"), F.avg("prediction").alias("mean_prediction")))


@query(f"WITH {results()} SELECT {SHOWN} FROM period_rows UNION ALL SELECT {SHOWN} FROM overall_rows")
def u3_comparison_union(spark, sf):
    return _comparison(spark, sf)


@query(
    """SELECT name, (row_number() OVER (ORDER BY coalesce(TRY_CAST(nullif(regexp_extract(name, '([0-9]+)', 1), '') AS BIGINT), 1000000000), a, b, name))::INTEGER AS line FROM
    (SELECT o_orderpriority || ' ' || year(o_orderdate) AS name, strftime(min(o_orderdate), '%Y-%m-%d') AS a, strftime(max(o_orderdate), '%Y-%m-%d') AS b FROM orders GROUP BY o_orderpriority, year(o_orderdate)
     UNION ALL SELECT 'overall', '', '' FROM (SELECT max(o_orderdate) FROM orders))"""
)
def w6_period_order(spark, sf):
    from pyspark.sql import Window

    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    named = table(spark, sf, "orders").groupBy(
        F.concat_ws(" ", "o_orderpriority", F.year("o_orderdate").cast("string")).alias("validation_period_name")
    ).agg(day(F.min("o_orderdate")).alias("validation_period_start"), day(F.max("o_orderdate")).alias("validation_period_end"))
    overall = table(spark, sf, "orders").agg(F.max("o_orderdate").alias("m")).select(
        F.lit("overall").alias("validation_period_name"), F.lit("").alias("validation_period_start"), F.lit("").alias("validation_period_end")
    )
    # One row per period.
    line = F.row_number().over(Window.orderBy(*report.period_order()))
    return named.unionByName(overall).select(F.col("validation_period_name").alias("name"), line.alias("line"))


@query(f"WITH {predictions()} SELECT algorithm, (row_number() OVER (ORDER BY {ORDERED}))::INTEGER AS line FROM (SELECT DISTINCT algorithm FROM preds)")
def w7_baselines_first(spark, sf):
    from pyspark.sql import Window

    names = loo_predictions(spark, sf).select("algorithm").distinct()
    # One row per algorithm.
    return names.withColumn("line", F.row_number().over(Window.orderBy(*report.algorithm_order())))


@query(
    """SELECT o_orderpriority AS station_id, o_orderdate AS ts, o_totalprice AS price, row_number() OVER (ORDER BY o_orderdate, o_totalprice, o_orderpriority) AS line
    FROM orders"""
)
def w8_sorted_by_time(spark, sf):
    """Readings in the order of time, each with its line."""
    from catalog.bindings import order_readings

    placed = dense_position(order_readings(spark, sf), ["ts", "price", "station_id"], time_levels(F.col("ts")), "line")
    return placed.withColumn("line", F.col("line") + 1).orderBy("line")


@query(
    f"""WITH {predictions()} SELECT target_station_id, prediction_time, algorithm, {r('actual', 'actual')} FROM
    (SELECT *, row_number() OVER (PARTITION BY target_station_id, prediction_time ORDER BY algorithm) AS n FROM preds) WHERE n = 1"""
)
def w11_series_once(spark, sf):
    """The actual value once per station and time."""
    once = report.unique_series(loo_predictions(spark, sf), ["target_station_id", "prediction_time"], ["algorithm"])
    return rounded(once.select("target_station_id", "prediction_time", "algorithm", "actual"))


@query(
    """SELECT y, period_index, printf('period_%02d', period_index) AS period_name, strftime(a, '%Y-%m-%dT%H:%M:%S') || ' -> ' || strftime(b, '%Y-%m-%dT%H:%M:%S') AS period,
      printf('%02d', period_index) || '_' || strftime(a, '%Y%m%dT%H%M%S') || '_' || strftime(b, '%Y%m%dT%H%M%S') AS period_suffix,
      'Period ' || period_index || ': ' || strftime(a, '%Y-%m-%d') || ' to ' || strftime(b, '%Y-%m-%d') AS period_label
    FROM (SELECT year(o_orderdate)::INTEGER AS y, min(o_orderdate) AS a, max(o_orderdate) AS b, (row_number() OVER (ORDER BY min(o_orderdate)))::INTEGER AS period_index FROM orders GROUP BY 1)"""
)
def w12_period_labels(spark, sf):
    """The years of the orders as numbered windows."""
    windows = table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("y")).agg(
        F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b")
    )
    return periods.label_periods(windows, "a", "b", ["a"]).drop("a", "b")
