"""Writing and re-reading the tables of training and evaluation runs.

Every table lives under one results root and is partitioned by `run_id`, so reading many runs
is one scan and reading a few prunes the rest.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from stationweave.functions.names import algorithm_display_name, infer_pollutant
from stationweave.operators.report import prediction_series, sort_comparison

# Parameters left out of comparison tables.
BOOKKEEPING_PARAMS = ("verbose", "n_jobs", "random_state", "fallback_on_missing_backend", "validation_split", "patience")
METRIC_NAMES = ("RMSE", "MAE", "MSE", "IA", "R2")


def write_run_table(df: DataFrame, root: str, table: str, run_id: str, by: Sequence[str] = ()) -> None:
    """Replace one run's part of a table; other runs stay."""
    out = df.withColumn("run_id", F.lit(run_id))
    (
        out.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_id", *by)
        .parquet(f"{root.rstrip('/')}/{table}")
    )


def read_run_table(spark: SparkSession, root: str, table: str, runs: Iterable[str] | None = None) -> DataFrame:
    df = spark.read.option("mergeSchema", "true").parquet(f"{root.rstrip('/')}/{table}")
    df = df.withColumn("run_id", F.col("run_id").cast("string"))
    return df.where(F.col("run_id").isin(*runs)) if runs is not None else df


def write_training_dump(prepared, root: str, run_id: str) -> None:
    """Supervised rows, raw and model-input features, targets, station matrix and a summary."""
    features, targets = prepared.features, prepared.targets
    names = lambda cols: [F.col(f"`{c}`") for c in cols]
    times = ["feature_time", "prediction_time"]
    write_run_table(prepared.rows, root, "dump_supervised", run_id)
    write_run_table(prepared.rows.select(*times, *names(features)), root, "dump_features_raw", run_id)
    write_run_table(prepared.normalized.select(*times, *names(features)), root, "dump_features_model", run_id)
    write_run_table(prepared.rows.select(*times, *names(targets)), root, "dump_target", run_id)
    write_run_table(prepared.matrix, root, "dump_matrix", run_id)
    summary = prepared.rows.agg(F.count(F.lit(1)).alias("row_count")).select(
        "row_count",
        F.lit(len(features)).alias("feature_count"),
        F.array(*[F.lit(f) for f in features]).alias("feature_names"),
        F.array(*[F.lit(t) for t in targets]).alias("target_columns"),
        F.lit(prepared.spec.target_station).alias("target_station_id"),
        F.array(*[F.lit(s) for s in prepared.spec.input_stations]).alias("input_station_ids"),
        F.lit(prepared.spec.horizon).alias("horizon"),
        F.lit(prepared.stats.method).alias("normalization"),
    )
    write_run_table(summary, root, "dump_summary", run_id)


def comparable_metrics(metrics: DataFrame, runs: DataFrame) -> DataFrame:
    """Long metrics of many runs with each run's metadata, ready for the comparison table.

    Single-target metrics also appear under their pollutant's `by_target.` name, taken from
    the run's pollutant or, for old runs, from its texts. `runs` has one row per run.
    """
    label = algorithm_display_name(
        F.col("algorithm_name"), F.col("algorithm"), F.col("config"), F.coalesce("bidirectional", F.lit(False))
    )
    haystack = F.concat_ws(" ", F.coalesce("algorithm_name", F.lit("")), F.coalesce("config", F.lit("")), F.col("run_id"))
    params = F.map_filter("best_params", lambda k, v: ~k.isin(*BOOKKEEPING_PARAMS))
    meta = runs.select(
        "run_id",
        "config",
        F.coalesce("target_station_id", F.lit("unknown")).alias("target_station_id"),
        label.alias("run_algorithm"),
        F.when(F.size(params) > 0, params).alias("best_params"),
        F.coalesce(F.col("pollutant"), infer_pollutant(haystack)).alias("pollutant"),
    )
    joined = metrics.join(meta, "run_id")
    # A baseline row names its own algorithm and has no parameters.
    model = F.col("source") == "model"
    named = joined.withColumns(
        {
            "algorithm": F.when(model, F.col("run_algorithm")).otherwise(F.col("algorithm")),
            "best_params": F.when(model, F.col("best_params")),
        }
    ).drop("run_algorithm", "source")
    single = ~F.startswith(F.col("metric"), F.lit("by_target.")) & F.col("metric").isin(*METRIC_NAMES)
    by_target = F.concat_ws(".", F.lit("by_target"), F.concat(F.lit("target_value__"), F.col("pollutant")), F.col("metric"))
    names = F.array_compact(F.array(F.col("metric"), F.when(single & F.col("pollutant").isNotNull(), by_target)))
    columns = [c for c in named.columns if c not in ("metric", "pollutant")]
    return named.select(*columns, F.explode(names).alias("metric"))


def load_prediction_series(
    spark: SparkSession, root: str, runs: DataFrame, run_ids: Sequence[str] | None = None
) -> DataFrame:
    """Model and baseline predictions of the runs with station and display names; NULL pairs dropped."""
    label = algorithm_display_name(
        F.col("algorithm_name"), F.col("algorithm"), F.col("config"), F.coalesce("bidirectional", F.lit(False))
    )
    meta = runs.select("run_id", F.coalesce("target_station_id", F.lit("unknown")).alias("target_station_id"), label.alias("algorithm"))
    model = read_run_table(spark, root, "validation", run_ids).join(meta, "run_id")
    baselines = read_run_table(spark, root, "baseline_predictions", run_ids).join(meta.drop("algorithm"), "run_id")
    columns = ["run_id", "target_station_id", "algorithm", "target", "prediction_time", "actual", "prediction"]
    series = prediction_series(model.select(*columns).unionByName(baselines.select(*columns)))
    if series.isEmpty():
        raise ValueError("the runs hold no prediction with both sides present")
    return series


def write_comparison_csv(rows: DataFrame, path: str | None = None, config_dir: str | None = None) -> str:
    """Comparison table as one CSV with a header; an error when there are no rows."""
    if rows.isEmpty():
        raise ValueError("there are no comparison rows to write")
    if path is None:
        stamp = datetime.now(timezone.utc).strftime("%Y%m%d_%H%M%S")
        base = f"{config_dir.rstrip('/')}/outputs/" if config_dir else ""
        path = f"{base}evaluation_comparison_{stamp}.csv"
    text = [
        F.to_json(c).alias(c) if t.startswith("map") else F.col(c) for c, t in rows.dtypes
    ]
    # A comparison table is a report: one line per run, period and algorithm.
    sort_comparison(rows).select(*text).coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    return path
