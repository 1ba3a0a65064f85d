"""Station-replacement baselines read straight off the lag-0 neighbour readings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from stationweave.functions.names import feature_name, q, sanitize_identifier
from stationweave.operators.metrics import score, score_periods
from stationweave.operators.supervised import target_names
from stationweave.session import config_table
from stationweave.specs import Task

# Ids and display names of the baselines.
AVERAGE_ID = "baseline_average_of_other_stations"
AVERAGE_NAME = "Baseline: Average of Other Stations"
REPLACE_ID = "baseline_replace_with_station_"
REPLACE_NAME = "Baseline: Replace with Station "


def row_mean(columns: Sequence[Column]) -> Column:
    """Mean of the present values of a row; NULL when none is present."""
    total = sum((F.coalesce(c, F.lit(0.0)) for c in columns), F.lit(0.0))
    present = sum((F.when(c.isNotNull(), 1).otherwise(0) for c in columns), F.lit(0))
    return F.try_divide(total, present)


def baseline_structs(columns: Sequence[str], task: Task) -> list[Column]:
    """(baseline_id, algorithm, target, actual, prediction) of every baseline that the columns allow."""
    entries = []
    for pollutant, target in zip(task.pollutants, target_names(task)):
        p = pollutant if task.multi else None
        names = [feature_name(s, 0, p) for s in task.input_stations]
        present = [(s, q(n)) for s, n in zip(task.input_stations, names) if n in columns]
        if not present:
            continue
        entries.append((AVERAGE_ID, AVERAGE_NAME, target, row_mean([c for _, c in present])))
        entries += [(s, REPLACE_NAME + s, target, c) for s, c in present]
    return [
        F.struct(
            (F.lit(i) if i == AVERAGE_ID else F.concat(F.lit(REPLACE_ID), sanitize_identifier(F.lit(i)))).alias("baseline_id"),
            F.lit(name).alias("algorithm"),
            F.lit(target).alias("target"),
            q(target).alias("actual"),
            value.alias("prediction"),
        )
        for i, name, target, value in entries
    ]


def baseline_predictions(rows: DataFrame, task: Task, keep: Sequence[str] = ()) -> DataFrame:
    """Long predictions of every baseline: (keep, prediction_time, baseline_id, algorithm, target, actual, prediction)."""
    structs = baseline_structs(rows.columns, task)
    return rows.select(*keep, "prediction_time", F.explode(F.array(*structs)).alias("__b")).select(
        *keep, "prediction_time", "__b.*"
    )


def baseline_predictions_tasks(rows: DataFrame, tasks: Sequence[Task]) -> DataFrame:
    """Baselines of many tasks at once, from the array form of the supervised rows."""
    spark = rows.sparkSession
    entries = []
    for t in tasks:
        for j, target in enumerate(target_names(t)):
            first = j * len(t.input_stations) * t.lags
            at = [first + i * t.lags for i in range(len(t.input_stations))]
            entries.append((t.task_id, AVERAGE_NAME, target, j, at))
            entries += [(t.task_id, REPLACE_NAME + s, target, j, [k]) for s, k in zip(t.input_stations, at)]
    table = config_table(
        spark, entries, "task_id string, algorithm string, target string, target_slot int, feature_slots array<int>"
    )
    picked = F.transform("feature_slots", lambda i: F.get("features", i))
    mean = F.aggregate(picked, F.lit(0.0), lambda a, v: a + v) / F.size("feature_slots")
    return rows.join(table, "task_id").select(
        "task_id",
        "prediction_time",
        "algorithm",
        "target",
        F.get("targets", F.col("target_slot")).alias("actual"),
        mean.alias("prediction"),
    )


def baseline_metrics(rows: DataFrame, task: Task) -> DataFrame:
    return score(baseline_predictions(rows, task), ["baseline_id", "algorithm", "target"])


def baseline_period_metrics(rows: DataFrame, task: Task, periods) -> DataFrame:
    return score_periods(baseline_predictions(rows, task), periods, ["baseline_id", "algorithm", "target"])


def baseline_table(rows: DataFrame, task: Task) -> DataFrame:
    """Wide baseline predictions next to the actual values, one row per prediction time."""
    targets = target_names(task)
    out: list[Column] = [F.col("prediction_time")]
    out += [q(t).alias(f"actual__{t}" if task.multi else "actual") for t in targets]
    for s in [None, *task.input_stations]:
        for pollutant, t in zip(task.pollutants, targets):
            p = pollutant if task.multi else None
            names = [feature_name(x, 0, p) for x in (task.input_stations if s is None else [s])]
            value = row_mean([q(n) for n in names]) if s is None else q(names[0])
            ident = AVERAGE_ID if s is None else REPLACE_ID + clean_id(s)
            out.append(value.alias(f"prediction__{ident}" + (f"__{t}" if task.multi else "")))
    return rows.select(*out)


def clean_id(text: str) -> str:
    """Driver-side twin of `sanitize_identifier` for column names."""
    import re

    return re.sub(r"[^A-Za-z0-9_-]+", "_", text).strip("_") or "config"


def predictions_wide(long: DataFrame, targets: Sequence[str], keys: Sequence[str] = ("prediction_time",)) -> DataFrame:
    """Long (target, actual, prediction) rows to `actual__t` / `prediction__t` columns."""
    if len(targets) == 1:
        return long.select(*keys, "actual", "prediction")
    pick = lambda t, c: F.max(F.when(F.col("target") == t, F.col(c)))
    columns = [pick(t, c).alias(f"{c}__{t}") for t in targets for c in ("actual", "prediction")]
    return long.groupBy(*keys).agg(*columns)


def predictions_long(wide: DataFrame, single_label: str = "target") -> DataFrame:
    """Every actual/prediction column pair of a wide table as (prediction_time, target, actual, prediction)."""
    pairs = []
    if {"actual", "prediction"} <= set(wide.columns):
        pairs.append((single_label, "actual", "prediction"))
    for c in wide.columns:
        name = c[len("actual__"):] if c.startswith("actual__") else None
        if name and f"prediction__{name}" in wide.columns:
            pairs.append((name, c, f"prediction__{name}"))
    if not pairs:
        raise ValueError("no actual/prediction column pairs found")
    structs = [F.struct(F.lit(t).alias("target"), q(a).alias("actual"), q(p).alias("prediction")) for t, a, p in pairs]
    return wide.select("prediction_time", F.explode(F.array(*structs)).alias("__t")).select("prediction_time", "__t.*")


def details(rows: DataFrame, targets: Sequence[str]) -> DataFrame:
    """Predictions with every input feature under an `input__` prefix."""
    skip = {"feature_time", "prediction_time", *targets}
    inputs = [c for c in rows.columns if c not in skip and not c.startswith(("actual", "prediction"))]
    shown = [c for c in rows.columns if c.startswith(("actual", "prediction")) and c != "prediction_time"]
    return rows.select("prediction_time", *[q(c) for c in shown], *[q(c).alias("input__" + c) for c in inputs])
