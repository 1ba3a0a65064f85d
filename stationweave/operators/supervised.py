"""Lagged neighbour features and horizon-shifted labels for any number of tasks at once.

Positions count the times on which any station reported, so a lag steps over gaps. Wide rows,
one per time, get their position and are cut into equal blocks of consecutive positions; a
block also receives the few rows before and after it that its lags and its horizon reach.
Lags are then taken inside each block. Blocks hold the same number of rows whatever the data
looks like, so there is no ordered pass over everything and no skew.

Tasks that are a table, such as every station of a large network from its neighbours, are built from
single cells instead, see supervised_links.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from stationweave.functions.names import feature_name, target_name
from stationweave.functions.positions import time_position
from stationweave.operators.matrix import matrix_column, station_cells, station_matrix, time_axis
from stationweave.session import config_table, materialise
from stationweave.specs import Task

# Consecutive positions handled together. Short blocks spread a short axis over many tasks;
# a long reach makes them longer, so that few rows are repeated.
BLOCK_ROWS = 1_024
# Cells of one station that meet its slots in one task.
STATION_CELLS = 200_000

def feature_names(task: Task) -> list[str]:
    """Pollutant-major, then station, then lag."""
    return [
        feature_name(s, k, p if task.multi else None)
        for p in task.pollutants
        for s in task.input_stations
        for k in range(task.lags)
    ]


def target_names(task: Task) -> list[str]:
    return [target_name(p if task.multi else None) for p in task.pollutants]


def _axis(df: DataFrame, pollutants: Sequence[str], ts: str, station: str) -> DataFrame:
    """Positions on the time axis, stored: two numbers per time, and a size Spark knows.

    Known to be small, it is broadcast and the readings are not shuffled again; too large, both
    sides are joined by time.
    """
    return materialise(time_axis(df, pollutants, ts, station))


def block_windows(rows: DataFrame, index: str, back: int, ahead: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows with the block they are computed in, repeated into neighbour blocks that reach them.

    Adds `__block` and `__own`; a row belongs to the result only where `__own` holds.
    """
    size = max(block_rows, 4 * back, 4 * ahead)
    own, at = f"({index} div {size})", f"{index} % {size}"
    blocks = [own]
    if back:
        blocks.append(f"CASE WHEN {at} >= {size - back} THEN {own} + 1 END")
    if ahead:
        blocks.append(f"CASE WHEN {at} < {ahead} THEN {own} - 1 END")
    placed = rows.select("*", F.expr(f"explode(array_compact(array({', '.join(blocks)})))").alias("__block"))
    return placed.withColumn("__own", F.expr(f"__block = {own}"))


def _over(expression: str) -> str:
    return f"{expression} OVER (PARTITION BY __block ORDER BY ts_idx)"


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def supervised_frame(df: DataFrame, task: Task, ts: str = "ts", station: str = "station_id") -> DataFrame:
    """feature_time, one column per feature, the label columns, prediction_time; complete rows only."""
    if not task.input_stations:
        raise ValueError("at least one input station is required")
    stations = list(dict.fromkeys([*task.input_stations, task.target_station]))
    matrix = station_matrix(df, task.pollutants, stations, ts, station)
    cell = lambda p, s: _quoted(matrix_column(p, s, task.multi))
    features, labels = feature_names(task), target_names(task)
    at = lambda c, k: c if not k else _over(f"lag({c}, {k})") if k > 0 else _over(f"lead({c}, {-k})")
    sources = [(cell(p, s), k) for p in task.pollutants for s in task.input_stations for k in range(task.lags)]
    sources += [(cell(p, task.target_station), -task.horizon) for p in task.pollutants]
    rows, kept = matrix, []
    if task.lags > 1 or task.horizon:
        placed = matrix.join(_axis(df, task.pollutants, ts, station), "ts")
        rows, kept = block_windows(placed, "ts_idx", task.lags - 1, task.horizon), ["__own"]
    lagged = rows.selectExpr(
        "ts AS feature_time",
        *[f"{at(c, k)} AS {_quoted(n)}" for (c, k), n in zip(sources, features + labels)],
        f"{at('ts', -task.horizon)} AS prediction_time",
        *kept,
    )
    complete = " AND ".join([*kept, *[f"{_quoted(n)} IS NOT NULL" for n in features + labels]])
    return lagged.where(complete).drop("__own")


def supervised_tasks(
    df: DataFrame, tasks: Sequence[Task], ts: str = "ts", station: str = "station_id"
) -> DataFrame:
    """All tasks in one plan: (task_id, feature_time, prediction_time, features, targets).

    Both arrays follow the slot order, so `features[i]` is `feature_names(task)[i]`. Tasks
    over different pollutants have different time axes and are built side by side.
    """
    groups: dict[frozenset, list[Task]] = {}
    for task in tasks:
        groups.setdefault(frozenset(task.pollutants), []).append(task)
    frames = []
    for group in groups.values():
        frames.append(_tasks_from_rows(df, group, ts, station))
    return reduce(DataFrame.unionByName, frames)


TASK_SCHEMA = "task_id string, feature_at array<int>, target_at array<int>, horizon int"


def _tasks_from_rows(df: DataFrame, tasks: Sequence[Task], ts: str = "ts", station: str = "station_id") -> DataFrame:
    """Wide rows are shuffled once; every task then picks its features from each row on the spot."""
    pollutants = list(tasks[0].pollutants)
    multi = len(pollutants) > 1
    stations = list(dict.fromkeys(s for t in tasks for s in (*t.input_stations, t.target_station)))
    columns = [matrix_column(p, s, multi) for p in pollutants for s in stations]
    lags, horizons = max(t.lags for t in tasks), sorted({t.horizon for t in tasks})
    width = len(columns)
    position = {(p, s): i * len(stations) + j for i, p in enumerate(pollutants) for j, s in enumerate(stations)}
    specs = [
        (
            t.task_id,
            [k * width + position[p, s] for p in t.pollutants for s in t.input_stations for k in range(t.lags)],
            [position[p, t.target_station] for p in t.pollutants],
            t.horizon,
        )
        for t in tasks
    ]
    matrix = station_matrix(df, pollutants, stations, ts, station)
    rows = matrix.selectExpr("ts", f"array({', '.join(_quoted(c) for c in columns)}) AS v")
    if lags == 1 and horizons == [0]:
        shifted = rows.selectExpr("ts AS feature_time", "v AS past", "map(0, struct(ts AS ts, v AS v)) AS future")
    else:
        placed = rows.join(_axis(df, pollutants, ts, station), "ts")
        blocks = block_windows(placed, "ts_idx", lags - 1, horizons[-1])
        absent = f"array_repeat(CAST(NULL AS DOUBLE), {width})"
        past = ["v", *[f"coalesce({_over(f'lag(v, {k})')}, {absent})" for k in range(1, lags)]]
        ahead = lambda c, h: _over(f"lead({c}, {h})") if h else c
        future = [f"{h}, struct({ahead('ts', h)} AS ts, {ahead('v', h)} AS v)" for h in horizons]
        shifted = blocks.selectExpr(
            "ts AS feature_time", f"concat({', '.join(past)}) AS past", f"map({', '.join(future)}) AS future", "__own"
        ).where("__own")
    # The task list is configuration; it travels as one constant, so there is no join.
    table = config_table(df.sparkSession, specs, TASK_SCHEMA)
    constant = table.agg(F.collect_list(F.struct("*"))).scalar()
    each = shifted.select("feature_time", "past", "future", F.explode(constant).alias("t"))
    picked = each.selectExpr(
        "t.task_id AS task_id",
        "feature_time",
        "future[t.horizon].ts AS prediction_time",
        "transform(t.feature_at, i -> past[i]) AS features",
        "transform(t.target_at, i -> future[t.horizon].v[i]) AS targets",
    )
    return picked.where(
        "prediction_time IS NOT NULL AND NOT exists(features, x -> x IS NULL) AND NOT exists(targets, x -> x IS NULL)"
    )


def task_slots(links: DataFrame, pollutants: Sequence[str], lags: int = 1, horizon: int = 0) -> DataFrame:
    """(task_id, pollutant, station_id, slot, is_label, shift, n_slots): which cell fills which feature or label of a task, and how far it moves.

    links (task_id, target, inputs array<string>) has one row a task; features are pollutant-major, then
    station, then lag, as feature_names has them, and labels follow.
    """
    known = F.array(*map(F.lit, pollutants))
    n_labels, width = len(pollutants), F.size("inputs")
    total = width * n_labels * lags + n_labels
    by_pollutant = links.select("task_id", "target", "inputs", total.alias("n_slots"), F.posexplode(known).alias("p", "pollutant"))
    feature = by_pollutant.select("*", F.posexplode("inputs").alias("i", "station_id")).select("*", F.explode(F.sequence(F.lit(0), F.lit(lags - 1))).alias("shift"))
    features = feature.select("task_id", "pollutant", "station_id", ((F.col("p") * width + F.col("i")) * lags + F.col("shift")).alias("slot"), F.lit(False).alias("is_label"), "shift", "n_slots")
    labels = by_pollutant.select(
        "task_id", "pollutant", F.col("target").alias("station_id"), (F.col("n_slots") - n_labels + F.col("p")).alias("slot"), F.lit(True).alias("is_label"), F.lit(-horizon).alias("shift"), "n_slots"
    )
    return features.union(labels)


def supervised_links(
    df: DataFrame, links: DataFrame, pollutants: Sequence[str], lags: int = 1, horizon: int = 0, ts: str = "ts", station: str = "station_id"
) -> DataFrame:
    """The rows of supervised_tasks for tasks that are a table: links (task_id, target, inputs array<string>), of any number.

    A cell at position i is the lag-k feature of row i + k and the label of row i - h of every task that
    names its station, so cells move to their rows by one join and meet there by one grouping. A group is one row of one task. A
    station with many cells meets its slots in as many tasks as it needs, dealt by time.
    """
    if lags < 1 or horizon < 0 or not pollutants:
        raise ValueError("tasks need a lag of one at least, no negative horizon and a pollutant")
    cells = materialise(station_cells(df, pollutants, ts, station))
    times = cells.select("ts").distinct()
    placed = cells.join(materialise(time_position(times, "ts", "ts_idx")), "ts")
    # One row a station.
    parts = cells.groupBy("station_id").agg(F.ceil(F.count("*") / STATION_CELLS).cast("int").alias("__parts"))
    dealt = placed.join(parts, "station_id").withColumn("__part", F.pmod(F.xxhash64("ts"), F.col("__parts")).cast("int")).drop("__parts")
    slots = task_slots(links.where("task_id IS NOT NULL"), pollutants, lags, horizon).join(parts, "station_id")
    copies = slots.withColumn("__part", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1))).drop("__parts")
    moved = dealt.join(copies, ["station_id", "pollutant", "__part"]).withColumn("row_idx", F.col("ts_idx") + F.col("shift"))
    # Complete rows always hold a lag-0 feature and a label, which carry the two times.
    rows = moved.groupBy("task_id", "row_idx").agg(
        F.max(F.when(~F.col("is_label") & (F.col("shift") == 0), F.col("ts"))).alias("feature_time"),
        F.max(F.when(F.col("is_label"), F.col("ts"))).alias("prediction_time"),
        F.collect_list(F.struct("slot", "value")).alias("__cells"),
        F.max("n_slots").alias("__slots"),
    )
    values = F.transform(F.array_sort("__cells"), lambda e: e["value"])
    n_features = F.col("__slots") - len(pollutants)
    return rows.where(F.size("__cells") == F.col("__slots")).select(
        "task_id",
        "feature_time",
        "prediction_time",
        F.slice(values, F.lit(1), n_features).alias("features"),
        F.slice(values, n_features + 1, F.lit(len(pollutants))).alias("targets"),
    )


def leave_one_out(
    stations: Sequence[str], pollutants: Sequence[str], lags: int = 1, horizon: int = 0
) -> list[Task]:
    """One task per station, with all other stations as its inputs."""
    return [
        Task(s, s, tuple(o for o in stations if o != s), tuple(pollutants), lags, horizon) for s in stations
    ]


def calendar_features(df: DataFrame, ts: str = "feature_time") -> DataFrame:
    """Month, day, day of week (1 = Monday) and hour of the feature time."""
    t = F.col(ts)
    return df.withColumns(
        {"month": F.month(t), "day": F.dayofmonth(t), "day_of_week": F.weekday(t) + 1, "hour": F.hour(t)}
    )
