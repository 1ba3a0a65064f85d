"""Comparison tables over the results of many runs.

Inputs are long tables. `metrics`: (run_id, config, target_station_id, algorithm,
best_params MAP, validation_period_name, validation_period_start, validation_period_end,
row_count, metric, value). Result tables grow with runs x periods x metrics, not with
readings.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from stationweave.functions.names import metric_group, metric_short, params_text, q, sanitize_series_name
from stationweave.functions.positions import dense_position, magnitude_levels
from stationweave.operators.metrics import badness

OVERALL = "overall"
# Metrics shown when a report does not list any.
REPORT_METRICS = ("RMSE", "R2")

COMPARISON_KEYS = (
    "target_station_id",
    "validation_period_start",
    "validation_period_end",
    "validation_period_name",
    "algorithm",
    "config",
)


def is_baseline(algorithm: Column) -> Column:
    return F.startswith(F.lower(algorithm), F.lit("baseline"))


def comparison_rows(*frames: DataFrame) -> DataFrame:
    """Model, baseline, per-period and overall rows under one schema."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def order_key() -> Column:
    """Text order of a comparison: station, window, algorithm, config; missing sorts as empty."""
    return F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in COMPARISON_KEYS])


def rank_by_rmse(rows: DataFrame, metric: str = "RMSE") -> DataFrame:
    """Unique ranks from the smallest error up; no ranks at all when any row lacks the metric.

    Equal errors keep the comparison order. Ranks are counted per error bucket, so a large
    result table is not sorted in one task.
    """
    complete = rows.agg((F.count(metric) == F.count(F.lit(1))).alias("c")).scalar()
    keyed = rows.withColumn("__error", F.coalesce(F.col(metric), F.lit(0.0)))
    placed = dense_position(
        keyed, [F.col("__error"), *_ordered_keys(rows)], magnitude_levels(F.col("__error")), "__pos"
    )
    rank = F.when(complete, (F.col("__pos") + 1).cast("int"))
    return placed.select(*[q(c) for c in rows.columns], rank.alias("rank_by_rmse"))


def _ordered_keys(rows: DataFrame) -> list[Column]:
    return [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in COMPARISON_KEYS if c in rows.columns]


def sort_comparison(rows: DataFrame) -> DataFrame:
    return rows.orderBy(*_ordered_keys(rows))


def compact_rows(rows: DataFrame) -> DataFrame:
    """Model rows only: the per-period ones when there are any, else the overall ones.

    `rank_in_table` is dense over the rows kept; `rank_by_rmse` keeps its original holes.
    """
    name = F.coalesce("validation_period_name", F.lit(OVERALL))
    models = rows.where(~F.startswith(F.col("algorithm"), F.lit("Baseline")))
    has_periods = models.agg(F.coalesce(F.bool_or(name != OVERALL), F.lit(False)).alias("h")).scalar()
    kept = models.where((name != OVERALL) == has_periods)
    if "rank_by_rmse" not in rows.columns:
        return kept
    # Ranks are whole numbers, so blocks of them are levels in their order.
    block = F.floor(F.coalesce("rank_by_rmse", F.lit(0)) / 100_000)
    placed = dense_position(kept, [F.col("rank_by_rmse"), *_ordered_keys(kept)], [block], "__line")
    return placed.select(*[q(c) for c in kept.columns], F.when(F.col("rank_by_rmse").isNotNull(), (F.col("__line") + 1).cast("int")).alias("rank_in_table"))


def expand_overall(rows: DataFrame, periods: DataFrame) -> DataFrame:
    """Overall rows repeated for every configured period, when only overall results exist.

    `periods` is the configured window table, a few rows; each row carries them as an array
    so there is no join.
    """
    windows = periods.agg(
        F.array_sort(F.collect_list(F.struct("period_index", "period_name", "period_start", "period_end"))).alias("w")
    ).scalar()
    keep = [c for c in rows.columns if not c.startswith("validation_period")]
    return rows.select(*[q(c) for c in keep], F.explode(windows).alias("__w")).select(
        *[q(c) for c in keep],
        F.col("__w.period_name").alias("validation_period_name"),
        F.date_format("__w.period_start", "yyyy-MM-dd'T'HH:mm:ss").alias("validation_period_start"),
        F.date_format("__w.period_end", "yyyy-MM-dd'T'HH:mm:ss").alias("validation_period_end"),
    )


def report_periods(metrics: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows of real periods; the overall rows where a group has nothing else."""
    name = F.lower(F.trim(F.coalesce("validation_period_name", F.lit(""))))
    blank = (F.coalesce("validation_period_start", F.lit("")) == "") & (
        F.coalesce("validation_period_end", F.lit("")) == ""
    )
    real = (name != OVERALL) & ~blank
    if by:
        flags = metrics.groupBy(*by).agg(F.bool_or(real).alias("__has"))
        tagged = metrics.join(flags, list(by))
    else:
        tagged = metrics.withColumn("__has", metrics.agg(F.bool_or(real).alias("h")).scalar())
    return tagged.where(real == F.col("__has")).select(*[q(c) for c in metrics.columns])


def select_metrics(metrics: DataFrame, wanted: Sequence[str] | None = None) -> DataFrame:
    """Rows of the wanted metrics with their group and short name; per-target groups win over overall."""
    names = list(wanted or REPORT_METRICS)
    tagged = metrics.withColumns({"metric_group": metric_group(F.col("metric")), "metric_short": metric_short(F.col("metric"))})
    kept = tagged.where(F.col("metric_short").isin(*names))
    by_target = kept.agg(F.coalesce(F.bool_or(F.col("metric_group") != OVERALL), F.lit(False)).alias("b")).scalar()
    return kept.where((F.col("metric_group") != OVERALL) == by_target)


def period_rank(name: Column) -> Column:
    """Number inside a period name; names without one come last."""
    return F.coalesce(F.nullif(F.regexp_extract(name, r"(\d+)", 1), F.lit("")).try_cast("long"), F.lit(10**9))


def period_order() -> list[Column]:
    return [
        period_rank(F.col("validation_period_name")),
        F.col("validation_period_start"),
        F.col("validation_period_end"),
        F.col("validation_period_name"),
    ]


def algorithm_order() -> list[Column]:
    """Baselines first, then by name."""
    return [~is_baseline(F.col("algorithm")), F.col("algorithm")]


def metric_grid(metrics: DataFrame, names: Sequence[str], cells: Sequence[str], rows: Sequence[str]) -> DataFrame:
    """Complete grid of every group: each `cells` value with each algorithm, NULL where absent.

    `rows` are the grouping columns (a period, or a station); within a group every cell value
    meets every algorithm of that group.
    """
    seen = metrics.select(*rows, *cells).distinct()
    frame = seen.join(metrics.select(*rows, "algorithm").distinct(), list(rows))
    keys = [*rows, *cells, "algorithm"]
    values = metrics.groupBy(*keys).agg(
        *[F.first(F.when(F.col("metric_short") == n, F.col("value")), ignorenulls=True).alias(n) for n in names]
    )
    return frame.join(values, keys, "left")


def station_algorithm_table(metrics: DataFrame, names: Sequence[str] = REPORT_METRICS) -> DataFrame:
    """Per metric group and period: station x algorithm."""
    rows = ["metric_group", "validation_period_name", "validation_period_start", "validation_period_end"]
    return metric_grid(metrics, names, ["target_station_id"], rows)


def period_algorithm_table(metrics: DataFrame, names: Sequence[str] = REPORT_METRICS) -> DataFrame:
    """Per metric group and station: period x algorithm, with the parameters of models as text."""
    rows = ["metric_group", "target_station_id"]
    cells = ["validation_period_name", "validation_period_start", "validation_period_end"]
    grid = metric_grid(metrics, names, cells, rows)
    texts = (
        metrics.where(~is_baseline(F.col("algorithm")) & (F.size("best_params") > 0))
        .groupBy("target_station_id", "algorithm")
        .agg(F.min(params_text(F.col("best_params"))).alias("best_params"))
    )
    return grid.join(texts, ["target_station_id", "algorithm"], "left").withColumn(
        "best_params", F.coalesce("best_params", F.lit(""))
    )


def best_and_worst(metrics: DataFrame, by: Sequence[str]) -> DataFrame:
    """Best and worst value and algorithm per group and metric, direction taken from the metric."""
    bad = badness(F.col("metric_short"), F.col("value"))
    # Ties go to the first algorithm in report order for best, to the last for worst.
    key = F.struct(bad, ~is_baseline(F.col("algorithm")), F.col("algorithm"))
    return (
        metrics.where(F.col("value").isNotNull())
        .groupBy(*by, "metric_short")
        .agg(
            F.min_by("value", key).alias("best_value"),
            F.min_by("algorithm", key).alias("best_algorithm"),
            F.max_by("value", key).alias("worst_value"),
            F.max_by("algorithm", key).alias("worst_algorithm"),
        )
    )


def win_counts(metrics: DataFrame, by: Sequence[str] = ("metric_group", "target_station_id")) -> DataFrame:
    """(by, algorithm, wins): how often each algorithm is best over periods and metrics, zeros kept."""
    by = list(by)
    best = best_and_worst(metrics, [*by, "validation_period_name"])
    wins = best.groupBy(*by, F.col("best_algorithm").alias("algorithm")).agg(F.count(F.lit(1)).alias("wins"))
    everyone = metrics.select(*by, "algorithm").distinct()
    return everyone.join(wins, [*by, "algorithm"], "left").withColumn("wins", F.coalesce("wins", F.lit(0)))


def champions(metrics: DataFrame, by: Sequence[str] = ("metric_group", "target_station_id")) -> DataFrame:
    """The algorithm with most wins per group; ties go to the first in report order."""
    key = F.struct(-F.col("wins"), ~is_baseline(F.col("algorithm")), F.col("algorithm"))
    return win_counts(metrics, by).groupBy(*by).agg(
        F.min_by("algorithm", key).alias("champion"), F.max("wins").alias("wins"), F.sum("wins").alias("possible")
    )


def prediction_series(predictions: DataFrame) -> DataFrame:
    """Long plot series: rows with both sides present."""
    return predictions.na.drop(subset=["actual", "prediction"])


def unique_series(predictions: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the first in the given order. A key holds only its duplicates."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return predictions.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def series_table(series: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Wide table over prediction time: one actual column per station and target, one per prediction series.

    All series meet in one grouping by time, which equals the outer join of all of them.
    """
    part = lambda c: sanitize_series_name(F.col(c))
    actual = F.concat_ws("_", F.lit("actual"), part("target_station_id"), part("target"))
    predicted = F.concat_ws("_", F.lit("pred"), part("target_station_id"), part("target"), part("algorithm"))
    entry = lambda name, v: F.struct(name.alias("series"), F.col(v).alias("value"))
    long = series.select(
        "prediction_time", F.explode(F.array(entry(actual, "actual"), entry(predicted, "prediction"))).alias("__e")
    ).select("prediction_time", "__e.*")
    if columns is None:
        # One name per station, target and algorithm.
        columns = sorted(r.series for r in long.select("series").distinct().collect())
    return long.groupBy("prediction_time").pivot("series", list(columns)).agg(F.first("value", ignorenulls=True))


def with_splits(training: DataFrame, evaluation: DataFrame) -> DataFrame:
    return training.withColumn("split", F.lit("training")).unionByName(
        evaluation.withColumn("split", F.lit("evaluation"))
    )


def shared_range(series: DataFrame, by: Sequence[str]) -> DataFrame:
    """Common axis bounds over both splits, and rows per split."""
    return prediction_series(series).groupBy(*by).agg(
        F.least(F.min("actual"), F.min("prediction")).alias("axis_min"),
        F.greatest(F.max("actual"), F.max("prediction")).alias("axis_max"),
        F.count_if(F.col("split") == "training").alias("n_training"),
        F.count_if(F.col("split") == "evaluation").alias("n_evaluation"),
    )
