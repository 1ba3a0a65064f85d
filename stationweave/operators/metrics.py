"""RMSE, R2 and their relatives as algebraic aggregates over long predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from stationweave.functions.periods import assign_periods, period_frame
from stationweave.session import config_table

# Metrics for which the larger value is the better one.
HIGHER_IS_BETTER = ("R2", "IA")
# Tolerances under which a prediction counts as equal to its actual.
_ATOL, _RTOL = 1e-8, 1e-5


def rmse(actual: Column, prediction: Column) -> Column:
    return F.sqrt(F.avg((actual - prediction) * (actual - prediction)))


def mse(actual: Column, prediction: Column) -> Column:
    return F.avg((actual - prediction) * (actual - prediction))


def mae(actual: Column, prediction: Column) -> Column:
    return F.avg(F.abs(actual - prediction))


def r2(actual: Column, prediction: Column) -> Column:
    """Share of the variance explained; constant actuals give 1 when all rows agree, else 0."""
    total = F.var_pop(actual) * F.count(actual)
    error = F.sum((actual - prediction) * (actual - prediction))
    close = F.max(F.abs(actual - prediction) - (_ATOL + _RTOL * F.abs(prediction))) <= 0
    return F.when(total == 0, F.when(close, 1.0).otherwise(0.0)).otherwise(1 - F.try_divide(error, total))


def metric_columns(extra: bool = False) -> list[Column]:
    a, p = F.col("actual"), F.col("prediction")
    out = [rmse(a, p).alias("RMSE"), r2(a, p).alias("R2")]
    if extra:
        out += [mse(a, p).alias("MSE"), mae(a, p).alias("MAE")]
    return out


def score(predictions: DataFrame, by: Sequence[str], extra: bool = False) -> DataFrame:
    """Metrics and row count per group of (actual, prediction) rows with both sides present."""
    both = predictions.where(F.col("actual").isNotNull() & F.col("prediction").isNotNull())
    return both.groupBy(*by).agg(F.count(F.lit(1)).alias("row_count"), *metric_columns(extra))


def index_of_agreement(predictions: DataFrame, by: Sequence[str]) -> DataFrame:
    """Willmott's index per group, `IA`: 1 for a perfect prediction; NULL where nothing varies.

    The group means come first; they are one small row per group.
    """
    both = predictions.where(F.col("actual").isNotNull() & F.col("prediction").isNotNull())
    means = both.groupBy(*by).agg(F.avg("actual").alias("__mean"))
    error = "sum((prediction - actual) * (prediction - actual))"
    spread = "sum(pow(abs(prediction - __mean) + abs(actual - __mean), 2))"
    return both.join(means, list(by)).groupBy(*by).agg(F.expr(f"1 - try_divide({error}, {spread})").alias("IA"))


def score_periods(
    predictions: DataFrame, periods, by: Sequence[str], extra: bool = False, overall: bool = False
) -> DataFrame:
    """Metrics per (period, group); a period without rows stays, marked as skipped.

    With `overall` the same pass also scores all rows together, as one more period.
    """
    placed = assign_periods(predictions, "prediction_time", periods, overall)
    scored = score(placed, ["period_name", *by], extra)
    spark = predictions.sparkSession
    windows = period_frame(spark, periods).select("period_name", "period_start", "period_end", "period")
    if overall:
        whole = config_table(spark, [("overall", "overall")], "period_name string, period string")
        windows = windows.unionByName(whole, allowMissingColumns=True)
    found = windows.join(scored, "period_name", "left")
    skipped = F.col("row_count").isNull()
    return found.withColumns(
        {
            "row_count": F.coalesce("row_count", F.lit(0)),
            "skipped": skipped,
            "reason": F.when(skipped, "No rows matched this validation period."),
        }
    )


def long_metrics(scored: DataFrame, metrics: Sequence[str], by: Sequence[str]) -> DataFrame:
    """(by, metric, value): one row per present metric."""
    return (
        scored.select(*by, *[F.col(m).cast("double").alias(m) for m in metrics])
        .unpivot(list(by), list(metrics), "metric", "value")
        .where(F.col("value").isNotNull())
    )


def dotted_metric(target: Column, metric: Column, multi: Column) -> Column:
    """`by_target.<target>.<METRIC>` for several targets, the bare metric for one."""
    return F.when(multi, F.concat_ws(".", F.lit("by_target"), target, metric)).otherwise(metric)


def flatten_metrics(scored: DataFrame, metrics: Sequence[str], by: Sequence[str], target: str = "target") -> DataFrame:
    """Long metrics of one or more targets per run, named the way comparison tables name them."""
    # Scored rows are few, one per run, window and algorithm, and read once.
    several = F.size(F.collect_set(target).over(Window.partitionBy(*by))) > 1
    long = long_metrics(scored.withColumn("__multi", several), metrics, [*by, target, "__multi"])
    return long.select(*by, dotted_metric(F.col(target), F.col("metric"), F.col("__multi")).alias("metric"), "value")


def average_folds(fold_metrics: DataFrame, by: Sequence[str], fold: str = "fold") -> DataFrame:
    """Mean of each metric over the folds that have it, plus `cv_fold_count`."""
    means = fold_metrics.groupBy(*by, "metric").agg(F.avg("value").alias("value"))
    folds = fold_metrics.select(*by, fold).distinct().groupBy(*by).agg(
        F.lit("cv_fold_count").alias("metric"), F.count(F.lit(1)).cast("double").alias("value")
    )
    return means.unionByName(folds)


def trial_score(trial_metrics: DataFrame, metric: str, by: Sequence[str]) -> DataFrame:
    """One score per trial: the metric averaged over the targets."""
    return trial_metrics.where(F.col("metric") == metric).groupBy(*by).agg(F.avg("value").alias("score"))


def better_last(metric: Column) -> Column:
    """True where larger is better."""
    return metric.isin(*HIGHER_IS_BETTER)


def badness(metric: Column, value: Column) -> Column:
    """Sort key under which the best value always comes first."""
    return F.when(better_last(metric), -value).otherwise(value)
