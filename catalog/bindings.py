"""The given tables in the roles of station readings."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from stationweave.functions.names import feature_name
from stationweave.operators import baselines, metrics
from stationweave.operators.supervised import leave_one_out, supervised_tasks
from stationweave.session import materialise, shared_dir
from stationweave.specs import StationSpec, Task

PM, NO2, RH = "PM2.5", "NO2", "RH"
FLAGS = ("A", "N", "R")
KINDS = ("click", "error", "purchase", "signup", "view")
TRAIN = [{"start": "1995", "end": "1999"}]
VALIDATION = ["2000"]
TESTING = ["2001"]
MONTHS = ["2001-01", "2001-04", "2001-07"]
OVERLAPPING = ["2000", {"start": "2000-07", "end": "2001-03"}, "2001-02-14"]
MODEL = "weave.regression.LargestNeighbour"
MODEL_LABEL = "LargestNeighbour"

SPEC = StationSpec(
    target_station="A",
    input_stations=("N", "R"),
    pollutants=(PM,),
    impute_columns=(PM, NO2),
    lags=2,
    horizon=1,
    train_periods=TRAIN,
    validation_periods=VALIDATION,
    testing_periods=TESTING,
)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def lineitem_readings(spark: SparkSession, sf: str, station: str = "l_returnflag") -> DataFrame:
    """Stations are return flags (or supplier ids); readings go missing with the discount and tax."""
    return table(spark, sf, "lineitem").select(
        F.col("l_shipdate").alias("ts"),
        F.col(station).cast("string").alias("station_id"),
        F.when(F.col("l_discount") < 0.09, F.col("l_quantity")).alias(PM),
        F.when(F.col("l_tax") < 0.07, F.floor(F.col("l_extendedprice") / 100).cast("double")).alias(NO2),
        F.round(F.col("l_tax") * 100).alias(RH),
    )


def hour(ts: str) -> Column:
    c = F.col(ts)
    return F.make_timestamp_ntz(F.year(c), F.month(c), F.day(c), F.hour(c), F.lit(0), F.lit(0))


def event_readings(spark: SparkSession, sf: str) -> DataFrame:
    """Stations are event types on an hourly axis."""
    return table(spark, sf, "events").select(
        hour("ts").alias("ts"),
        F.col("event_type").alias("station_id"),
        F.when(F.col("value") >= 5, F.col("value")).alias("value"),
        F.get_json_object("props", "$.k").try_cast("double").alias("k"),
    )


def order_readings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_orderdate").alias("ts"), F.col("o_orderpriority").alias("station_id"), F.col("o_totalprice").alias("price")
    )


def scratch(spark: SparkSession) -> str:
    """New folder in the shared place of the cluster; a temporary one only in a local session without one."""
    root = shared_dir(spark)
    return f"{root.rstrip('/')}/catalog-{uuid.uuid4().hex}" if root else tempfile.mkdtemp(prefix="run-", dir="/tmp")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, and never a negative zero, so both sides of a check print alike."""
    number = (T.DoubleType, T.FloatType)
    name = lambda f: "`" + f.name.replace("`", "``") + "`"
    return df.selectExpr(
        *[f"round({name(f)}, {digits}) + 0.0D AS {name(f)}" if isinstance(f.dataType, number) else name(f) for f in df.schema]
    )


def task(lags: int = 1, horizon: int = 0, pollutants: tuple[str, ...] = (PM,), target: str = "A") -> Task:
    others = tuple(s for s in FLAGS if s != target)
    return Task(target, target, others, pollutants, lags, horizon)


def features(lags: int, stations=("N", "R")) -> list[str]:
    return [feature_name(s, k) for s in stations for k in range(lags)]


def loo_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Every flag held out in turn: its baselines, and one simple model that takes the largest neighbour."""
    tasks = leave_one_out(FLAGS, [PM])
    rows = supervised_tasks(lineitem_readings(spark, sf), tasks)
    base = baselines.baseline_predictions_tasks(rows, tasks)
    model = rows.select(
        "task_id",
        "prediction_time",
        F.lit(MODEL_LABEL).alias("algorithm"),
        F.lit("target_value").alias("target"),
        F.get("targets", 0).alias("actual"),
        F.array_max("features").alias("prediction"),
    )
    return base.unionByName(model).withColumnRenamed("task_id", "target_station_id")


def all_results(spark: SparkSession, sf: str) -> DataFrame:
    """One comparison row per held-out flag, algorithm and window, and one over all windows.

    A single pass scores everything. The small result is stored, since reports read it more
    than once.
    """
    scored = metrics.score_periods(
        loo_predictions(spark, sf), MONTHS, ["target_station_id", "algorithm"], overall=True
    ).where("row_count > 0")
    iso = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(""))
    params = F.create_map(F.lit("depth"), F.lit("3"), F.lit("seeds"), F.lit("[1,2]"))
    rows = scored.select(
        F.concat(F.lit("run_"), "target_station_id").alias("run_id"),
        F.concat(F.lit("cfg_"), F.lower("target_station_id"), F.lit(".yaml")).alias("config"),
        "target_station_id",
        "algorithm",
        F.when(F.col("algorithm") == MODEL_LABEL, params).alias("best_params"),
        F.col("period_name").alias("validation_period_name"),
        iso("period_start").alias("validation_period_start"),
        iso("period_end").alias("validation_period_end"),
        "row_count",
        "RMSE",
        "R2",
    )
    return materialise(rounded(rows))


def period_results(spark: SparkSession, sf: str) -> DataFrame:
    return all_results(spark, sf).where("validation_period_name <> 'overall'")


def overall_results(spark: SparkSession, sf: str) -> DataFrame:
    return all_results(spark, sf).where("validation_period_name = 'overall'")


def long_results(rows: DataFrame) -> DataFrame:
    """Comparison rows with one line per metric."""
    keys = [c for c in rows.columns if c not in ("RMSE", "R2")]
    entries = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("RMSE", "R2")])
    return rows.select(*keys, F.explode(entries).alias("__m")).select(*keys, "__m.*")
