"""Lags, labels, rankings, and preparation, fitting and scoring of models."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from catalog.bindings import (
    FLAGS,
    KINDS,
    MONTHS,
    NO2,
    PM,
    RH,
    SPEC,
    event_readings,
    lineitem_readings,
    rounded,
    scratch,
    table,
    task,
)
from catalog.registry import query
from catalog.sql import EVENTS, ISO, MONTH_WINDOWS, R2, READINGS, RMSE, least_squares, matrix, r, sup, supervised
from stationweave.functions.names import feature_name, q
from stationweave.operators import impute, models, normalize, profile, scoring, supervised as sv, tuning
from stationweave.plans import evaluate, prepare
from stationweave.session import materialise
from stationweave.sources import results, runs
from stationweave.specs import ModelSpec, Task

LINEAR = "pyspark.ml.regression.LinearRegression"
EVENT_TASK = Task("view", "view", KINDS[:4], ("value",), 3, 1)
EVENT_NAMES = [feature_name(s, k) for s in KINDS[:4] for k in range(3)]


def _list(names) -> str:
    return ", ".join(r(f'"{c}"', c) for c in names)


EVENT_ROWS = f"WITH m AS ({matrix(f'({EVENTS})', 'value', KINDS)}), rows_ AS ({supervised('m', 'view', KINDS[:4], 3, 1)})"


@query(f"{EVENT_ROWS} SELECT feature_time, {_list([*EVENT_NAMES, 'target_value'])}, prediction_time FROM rows_")
def w1_neighbor_lags(spark, sf):
    return rounded(sv.supervised_frame(event_readings(spark, sf), EVENT_TASK))


@query(
    f"""WITH m AS ({matrix(f'({EVENTS})', 'value', KINDS)}), h AS (
      SELECT 0 AS horizon, ts AS feature_time, "view" AS label, ts AS prediction_time, "click" AS f FROM m
      UNION ALL SELECT 1, ts, lead("view", 1) OVER (ORDER BY ts), lead(ts, 1) OVER (ORDER BY ts), "click" FROM m
      UNION ALL SELECT 5, ts, lead("view", 5) OVER (ORDER BY ts), lead(ts, 5) OVER (ORDER BY ts), "click" FROM m)
    SELECT horizon, feature_time, {r('label', 'target_value')}, prediction_time FROM h WHERE label IS NOT NULL AND f IS NOT NULL AND prediction_time IS NOT NULL"""
)
def w2_horizon_labels(spark, sf):
    """Nowcast, one step and five steps ahead as three tasks of one plan."""
    tasks = [Task(str(h), "view", ("click",), ("value",), 1, h) for h in (0, 1, 5)]
    rows = sv.supervised_tasks(event_readings(spark, sf), tasks)
    return rounded(
        rows.select(
            F.col("task_id").cast("int").alias("horizon"),
            "feature_time",
            F.get("targets", 0).alias("target_value"),
            "prediction_time",
        )
    )


@query(f"{EVENT_ROWS} SELECT strftime(prediction_time, '%Y-%m-%d') AS day, count(*) AS n_rows FROM rows_ GROUP BY 1")
def w3_complete_rows(spark, sf):
    rows = sv.supervised_frame(event_readings(spark, sf), EVENT_TASK)
    return rows.groupBy(F.date_format("prediction_time", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n_rows"))


def _multi_sql() -> str:
    cells = ", ".join(
        f"avg(CASE WHEN station_id = '{s}' THEN \"{p}\" END) AS \"{p}__{s}\"" for p in ("PM2.5", "NO2") for s in FLAGS
    )
    w = "OVER (ORDER BY ts)"
    cols, names = [], []
    for p in ("PM2.5", "NO2"):
        for s in ("N", "R"):
            for k in range(2):
                n = f"neighbor__{p}__{s}" + (f"__lag_{k}" if k else "")
                names.append(n)
                cols.append(f'lag("{p}__{s}", {k}) {w} AS "{n}"')
    for p in ("PM2.5", "NO2"):
        names.append(f"target_value__{p}")
        cols.append(f'lead("{p}__A", 1) {w} AS "target_value__{p}"')
    full = " AND ".join(f'"{n}" IS NOT NULL' for n in names)
    return f"""WITH m AS (SELECT ts, {cells} FROM ({READINGS}) WHERE "PM2.5" IS NOT NULL OR "NO2" IS NOT NULL GROUP BY ts)
    SELECT feature_time, {_list(names)}, prediction_time FROM (SELECT ts AS feature_time, {', '.join(cols)}, lead(ts, 1) {w} AS prediction_time FROM m)
    WHERE {full} AND prediction_time IS NOT NULL"""


@query(_multi_sql())
def w1_multi_pollutant_lags(spark, sf):
    return rounded(sv.supervised_frame(lineitem_readings(spark, sf), task(2, 1, (PM, NO2))))


@query(
    "WITH r AS (" + READINGS.replace("l_returnflag", "l_suppkey::VARCHAR") + """), m AS (SELECT ts, station_id, avg("PM2.5") AS v FROM r WHERE "PM2.5" IS NOT NULL GROUP BY ALL),
    x AS (SELECT ts, dense_rank() OVER (ORDER BY ts) AS i FROM (SELECT DISTINCT ts FROM m)), c AS (SELECT m.*, i FROM m JOIN x USING (ts))
    SELECT a.station_id AS target_station, b.station_id AS neighbour, count(*) AS n_rows, round(sum(a.v), 4) + 0.0 AS label_sum, round(sum(b.v), 4) + 0.0 AS feature_sum
    FROM c a JOIN (SELECT DISTINCT l_suppkey::VARCHAR AS t, ((l_suppkey + 1) % (SELECT count(*) FROM supplier))::VARCHAR AS s FROM lineitem) p ON p.t = a.station_id
    JOIN c b ON b.station_id = p.s AND b.i = a.i - 1 GROUP BY ALL"""
)
def j9_many_stations(spark, sf):
    """Every supplier predicted one step ahead from the next supplier: as many tasks as suppliers."""
    df = lineitem_readings(spark, sf, "l_suppkey")
    suppliers = table(spark, sf, "supplier").select("s_suppkey")
    many = suppliers.agg(F.count(F.lit(1)).alias("n")).scalar()
    after = ((F.col("s_suppkey") + 1) % many).cast("string")
    name = F.col("s_suppkey").cast("string")
    links = suppliers.select(name.alias("task_id"), name.alias("target"), F.array(after).alias("inputs"))
    rows = sv.supervised_links(df, links, [PM], 1, 1)
    return rounded(
        rows.groupBy(F.col("task_id").alias("target_station"))
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.sum(F.get("targets", 0)).alias("label_sum"),
            F.sum(F.get("features", 0)).alias("feature_sum"),
        )
        .withColumn("neighbour", ((F.col("target_station").cast("long") + 1) % many).cast("string")),
        4,
    )


@query(
    f"""WITH r AS ({READINGS}), c AS (
      SELECT station_id, 'PM2.5' AS target, 'NO2' AS feature, corr("PM2.5", "NO2") FILTER ("PM2.5" IS NOT NULL AND "NO2" IS NOT NULL) AS c FROM r GROUP BY 1
      UNION ALL SELECT station_id, 'PM2.5', 'RH', corr("PM2.5", "RH") FILTER ("PM2.5" IS NOT NULL) FROM r GROUP BY 1
      UNION ALL SELECT station_id, 'NO2', 'PM2.5', corr("PM2.5", "NO2") FILTER ("PM2.5" IS NOT NULL AND "NO2" IS NOT NULL) FROM r GROUP BY 1
      UNION ALL SELECT station_id, 'NO2', 'RH', corr("NO2", "RH") FILTER ("NO2" IS NOT NULL) FROM r GROUP BY 1)
    SELECT station_id, target, feature, round(c, 5) + 0.0 AS corr, rank::INTEGER AS rank FROM
      (SELECT *, row_number() OVER (PARTITION BY station_id, target ORDER BY abs(c) DESC, feature) AS rank FROM c) WHERE rank <= 1"""
)
def w9_top_correlated(spark, sf):
    corr = profile.correlation(lineitem_readings(spark, sf), (PM, NO2, RH), ["station_id"], decimals=None)
    return rounded(profile.top_correlated(corr, [PM, NO2], 1, ["station_id"]), 5)


@query(
    """SELECT task, trial, score FROM (SELECT o_orderpriority AS task, o_orderkey AS trial, floor(o_totalprice / 100) AS score,
      row_number() OVER (PARTITION BY o_orderpriority ORDER BY floor(o_totalprice / 100) DESC, o_orderkey) AS r FROM orders) WHERE r = 1"""
)
def w10_best_trial(spark, sf):
    """Orders as trials of their priority; the largest score wins, the first among equals."""
    trials = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("task"),
        F.col("o_orderkey").alias("trial"),
        F.floor(F.col("o_totalprice") / 100).cast("double").alias("score"),
    )
    return tuning.best_trial(trials, "R2", ["task"])


# Preparation ---------------------------------------------------------------------------

PREP = ["neighbor__N", "neighbor__N__lag_1", "neighbor__R", "neighbor__R__lag_1"]
TRAIN_SLICE = "ts BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1999-12-31 23:59:59'"


def _z(c: str, source: str = "t") -> str:
    return f'("{c}" - (SELECT avg("{c}") FROM {source})) / (SELECT stddev_pop("{c}") FROM {source})'


@query(
    f"""WITH {sup(2, 1, TRAIN_SLICE, clean=True)} SELECT feature_time, {', '.join(r(_z(c, 'rows_'), c) for c in PREP)},
    {r('target_value', 'target_value')}, prediction_time FROM rows_"""
)
def m16_training_data(spark, sf):
    return rounded(prepare.prepare_training(lineitem_readings(spark, sf), SPEC).normalized)


@query(
    f"""WITH {sup(2, 1, "NOT (year(ts) IN (2000, 2001))", clean=True)} SELECT feature_time, {', '.join(r(_z(c, 'rows_'), c) for c in PREP)},
    {r('target_value', 'target_value')}, prediction_time FROM rows_"""
)
def m16_training_by_exclusion(spark, sf):
    """No training window: everything outside validation and testing."""
    spec = SPEC.with_(train_periods=None)
    return rounded(prepare.prepare_training(lineitem_readings(spark, sf), spec).normalized)


def _held_out(year: int) -> str:
    """CTE list giving training rows `t` and the rows `v` of a year."""
    train = sup(2, 1, TRAIN_SLICE, clean=True).replace("rows_ AS", "t AS")
    own = sup(2, 1, f"year(ts) = {year}", clean=True).replace("r AS (", "r2 AS (", 1).replace("m AS (", "m2 AS (", 1)
    own = own.replace("FROM r ", "FROM r2 ").replace("FROM m)", "FROM m2)").replace("rows_ AS", "v AS")
    return f"{train}, {own}"


def _held_out_sql(year: int) -> str:
    return f"""WITH {_held_out(year)} SELECT feature_time, {', '.join(r(f'(v."{c}" - (SELECT avg("{c}") FROM t)) / (SELECT stddev_pop("{c}") FROM t)', c) for c in PREP)},
    {r('target_value', 'target_value')}, prediction_time FROM v WHERE year(prediction_time) = {year}"""


@query(_held_out_sql(2000))
def m17_tuning_data(spark, sf):
    df = lineitem_readings(spark, sf)
    stats = prepare.prepare_training(df, SPEC).stats
    return rounded(prepare.prepare_tuning(df, SPEC, stats).normalized)


@query(_held_out_sql(2001))
def m18_evaluation_data(spark, sf):
    df = lineitem_readings(spark, sf)
    stats = prepare.prepare_training(df, SPEC).stats
    return rounded(prepare.prepare_evaluation(df, SPEC, stats).normalized)


@query(
    f"""WITH {sup(2, 1, "year(ts) = 2001", clean=True)} SELECT feature_time, {', '.join(r(_z(c, 'rows_'), c) for c in PREP)},
    {r('target_value', 'target_value')}, prediction_time FROM rows_"""
)
def m18_self_fitted_evaluation(spark, sf):
    return rounded(prepare.prepare_evaluation(lineitem_readings(spark, sf), SPEC).normalized)


@query(
    f"""WITH {sup(1, 0)}, s AS (SELECT 'A' AS task_id, "neighbor__N" AS f0, "neighbor__R" AS f1, feature_time FROM rows_
      UNION ALL SELECT 'N', target_value, "neighbor__R", feature_time FROM rows_ UNION ALL SELECT 'R', target_value, "neighbor__N", feature_time FROM rows_)
    SELECT task_id, feature_time, round((f0 - avg(f0) OVER (PARTITION BY task_id)) / stddev_pop(f0) OVER (PARTITION BY task_id), 6) + 0.0 AS f0,
      round((f1 - avg(f1) OVER (PARTITION BY task_id)) / stddev_pop(f1) OVER (PARTITION BY task_id), 6) + 0.0 AS f1 FROM s"""
)
def m16_all_tasks_normalised(spark, sf):
    """Statistics of all held-out stations fitted and applied in one plan."""
    rows = sv.supervised_tasks(lineitem_readings(spark, sf), sv.leave_one_out(FLAGS, [PM]))
    # Inputs of N are A, R and of R are A, N, in station order.
    scaled = normalize.apply_task_stats(rows, normalize.fit_task_stats(rows, "zscore"))
    return rounded(scaled.select("task_id", "feature_time", F.get("features", 0).alias("f0"), F.get("features", 1).alias("f1")))


# Models --------------------------------------------------------------------------------

_BOTH = ", ".join(f"avg(CASE WHEN station_id = '{s}' THEN \"{p}\" END) AS \"{p}__{s}\"" for p in (PM, NO2) for s in FLAGS)
_BOTH_TARGETS = [f"{p}__A" for p in (PM, NO2)]
_BOTH_FEATURES = [f"{p}__{s}" for p in (PM, NO2) for s in ("N", "R")]
_SCORES = f"count(*) AS row_count, {r(RMSE, 'RMSE', 4)}, {r(R2, 'R2', 4)}"
TWO_TARGETS = f"""both_ AS (SELECT ts, {_BOTH} FROM ({READINGS}) GROUP BY ts),
    whole AS (SELECT * FROM both_ WHERE {' AND '.join(f'"{c}" IS NOT NULL' for c in [*_BOTH_FEATURES, *_BOTH_TARGETS])}),
    {least_squares('whole', _BOTH_FEATURES, _BOTH_TARGETS)}"""
# The linear model of SPEC on its training rows and on the rows of 2001.
LINEAR_RUN = f"""{_held_out(2001)}, every AS (SELECT *, TRUE AS learnt FROM t UNION ALL SELECT *, FALSE FROM v),
    {least_squares('every', PREP, ['target_value'], 'learnt')}"""
_MADE = {
    "model": "fit0",
    "Baseline: Average of Other Stations": '("neighbor__N" + "neighbor__R") / 2',
    "Baseline: Replace with Station N": '"neighbor__N"',
    "Baseline: Replace with Station R": '"neighbor__R"',
}
SCORED_RUN = f"""{LINEAR_RUN}, made AS ({' UNION ALL '.join(
    f"SELECT '{'model' if name == 'model' else 'baseline'}' AS source, '{name}' AS algorithm, prediction_time, target_value AS actual, {value} AS prediction FROM fit WHERE NOT learnt"
    for name, value in _MADE.items())})"""


def _run_sql(windows: str, overall: bool) -> str:
    """Long metrics of the run, per window and, if asked for, of all rows of 2001."""
    sums = f"count(*) AS row_count, {RMSE} AS rmse, {R2} AS r2"
    parts = [f"""SELECT source, algorithm, period_name AS name, strftime(period_start, {ISO}) AS first, strftime(period_end, {ISO}) AS last, {sums}
      FROM made JOIN {windows} ON prediction_time BETWEEN period_start AND period_end GROUP BY ALL"""]
    if overall:
        parts.append(f"SELECT source, algorithm, 'overall', '', '', {sums} FROM made WHERE year(prediction_time) = 2001 GROUP BY ALL")
    longer = " UNION ALL ".join(
        f"""SELECT 'run_a' AS run_id, source, algorithm, name AS validation_period_name, first AS validation_period_start, last AS validation_period_end,
      row_count, '{label}' AS metric, {r(column, 'value', 4)} FROM scored""" for label, column in (("RMSE", "rmse"), ("R2", "r2")))
    return f"WITH {SCORED_RUN}, scored AS ({' UNION ALL '.join(parts)}) {longer}"


YEAR_WINDOW = "(VALUES ('period_01', TIMESTAMP '2001-01-01 00:00:00', TIMESTAMP '2001-12-31 23:59:59')) AS w(period_name, period_start, period_end)"


def _two(spark, sf) -> tuple[DataFrame, DataFrame, Task]:
    t = task(1, 1)
    rows = materialise(sv.supervised_frame(lineitem_readings(spark, sf), t))
    early = F.year("prediction_time") < 2001
    return rows.where(early), rows.where(~early), t


OLS = """k AS (SELECT avg(x) AS mx, avg(z) AS mz, avg(y) AS my, var_pop(x) AS sxx, var_pop(z) AS szz, covar_pop(x, z) AS sxz,
  covar_pop(x, y) AS sxy, covar_pop(z, y) AS szy FROM t WHERE year(prediction_time) < 2001),
b AS (SELECT *, (szz * sxy - sxz * szy) / (sxx * szz - sxz * sxz) AS bx, (sxx * szy - sxz * sxy) / (sxx * szz - sxz * sxz) AS bz FROM k)"""


@query(
    f"""WITH {sup(1, 1)}, t AS (SELECT "neighbor__N" AS x, "neighbor__R" AS z, target_value AS y, prediction_time FROM rows_), {OLS}
    SELECT prediction_time, 'target_value' AS target, round(y, 4) + 0.0 AS actual, round(my + bx * (x - mx) + bz * (z - mz), 4) + 0.0 AS prediction
    FROM t, b WHERE year(prediction_time) >= 2001"""
)
def m4_linear_regression(spark, sf):
    train, test, t = _two(spark, sf)
    model = models.fit_model(train, sv.feature_names(t), sv.target_names(t), LINEAR, {"solver": "normal"})
    return rounded(model.predictions(test), 4)


@query(
    f"""WITH {sup(1, 1)}, {least_squares('rows_', ['neighbor__N', 'neighbor__R'], ['target_value'], 'year(prediction_time) < 2001')}
    SELECT algorithm, prediction_time, {r('target_value', 'actual', 4)}, {r('fit0', 'prediction', 4)}
    FROM fit, (VALUES ('LinearRegression'), ('GeneralizedLinearRegression')) AS a(algorithm) WHERE year(prediction_time) >= 2001"""
)
def m1_class_paths(spark, sf):
    """Estimators named by the path of their class, with parameters of their own."""
    train, test, t = _two(spark, sf)
    made = []
    for name, params in (("LinearRegression", {"solver": "normal"}), ("GeneralizedLinearRegression", {"family": "gaussian"})):
        model = models.fit_model(train, sv.feature_names(t), sv.target_names(t), f"pyspark.ml.regression.{name}", params)
        made.append(model.predictions(test).select(F.lit(name).alias("algorithm"), "prediction_time", "actual", "prediction"))
    return rounded(made[0].unionByName(made[1]), 4)


def _forest(spark, sf, algorithm: str) -> DataFrame:
    train, test, t = _two(spark, sf)
    model = models.fit_model(train, sv.feature_names(t), sv.target_names(t), algorithm)
    return model.evaluate(test).withColumn("algorithm", F.lit(algorithm))


@query()
def m2_random_forest(spark, sf):
    return _forest(spark, sf, "random_forest")


@query()
def m3_extra_trees(spark, sf):
    return _forest(spark, sf, "extra_trees")


_FEATURE_LIST = ",".join(feature_name(s, 0, p) for p in (PM, NO2) for s in ("N", "R"))


@query(
    f"""WITH {TWO_TARGETS}, made AS ({' UNION ALL '.join(f"SELECT 'target_value__{p}' AS target, \"{c}\" AS actual, fit{i} AS prediction FROM fit" for i, (p, c) in enumerate(zip((PM, NO2), _BOTH_TARGETS)))})
    SELECT target, {_SCORES}, '{_FEATURE_LIST}' AS features FROM made GROUP BY target"""
)
def m5_fit_two_targets(spark, sf):
    """One model per target; the result names the features each was fitted on."""
    t = task(1, 0, (PM, NO2))
    rows = sv.supervised_frame(lineitem_readings(spark, sf), t)
    model = models.fit_model(rows, sv.feature_names(t), sv.target_names(t), LINEAR, {"solver": "normal"})
    return rounded(model.evaluate(rows).withColumn("features", F.lit(",".join(model.features))), 4)


@query()
def m5_joint_forest(spark, sf):
    """One forest of extra trees for two targets: every cut is judged by both."""
    t = task(2, 1, (PM, NO2))
    rows = materialise(sv.supervised_frame(lineitem_readings(spark, sf), t))
    early = F.year("prediction_time") < 2001
    model = models.fit_model(rows.where(early), sv.feature_names(t), sv.target_names(t), "extra_trees")
    return model.evaluate(rows.where(~early))


@query()
def m6_predict(spark, sf):
    train, test, t = _two(spark, sf)
    model = models.fit_model(train, sv.feature_names(t), sv.target_names(t), "random_forest")
    return model.predict(test)


@query(_run_sql(YEAR_WINDOW, True))
def m7_evaluate_run(spark, sf):
    """Model and baselines scored on the same rows of the testing window, per period."""
    df = lineitem_readings(spark, sf)
    trained = evaluate.train(df, SPEC, ModelSpec(LINEAR, {"solver": "normal"}))
    result = evaluate.evaluate(df, SPEC, trained, per_period=True)
    return rounded(evaluate.run_metrics(result, "run_a"), 4)


@query(_run_sql(MONTH_WINDOWS, False))
def c8_per_period_only(spark, sf):
    """A run that keeps the results of its months alone, without any over all of them."""
    df = lineitem_readings(spark, sf)
    spec = SPEC.with_(testing_periods=MONTHS)
    trained = evaluate.train(df, spec, ModelSpec(LINEAR, {"solver": "normal"}))
    return rounded(evaluate.run_metrics(evaluate.evaluate(df, spec, trained, only_per_period=True), "run_a"), 4)


@query(
    """SELECT vec_id, embedding[1]::DOUBLE AS "neighbor__value__click", embedding[2]::DOUBLE AS "neighbor__value__click__lag_1",
    embedding[3]::DOUBLE AS "neighbor__value__error", embedding[4]::DOUBLE AS "neighbor__value__error__lag_1",
    embedding[5]::DOUBLE AS "neighbor__k__click", embedding[6]::DOUBLE AS "neighbor__k__click__lag_1",
    embedding[7]::DOUBLE AS "neighbor__k__error", embedding[8]::DOUBLE AS "neighbor__k__error__lag_1",
    (len(embedding) - 8)::INTEGER AS surplus FROM embeddings"""
)
def m8_vector_columns(spark, sf):
    """Vectors read pollutant by pollutant, station by station, lag by lag; the rest is surplus."""
    t = Task("view", "view", ("click", "error"), ("value", "k"), 2, 1)
    return scoring.vector_columns(table(spark, sf, "embeddings"), t, "embedding").drop("embedding", "label")


@query(
    f"""WITH {sup(1, 1)}, t AS (SELECT "neighbor__N" AS x, "neighbor__R" AS z, target_value AS y, prediction_time FROM rows_), {OLS}
    SELECT vec_id, round(my + bx * (embedding[1]::DOUBLE * 100 - mx) + bz * (embedding[2]::DOUBLE * 100 - mz), 4) + 0.0 AS prediction FROM embeddings, b"""
)
def m8_batch_scoring(spark, sf):
    """A model fitted on normalised readings scores a table of raw vectors."""
    train, _, t = _two(spark, sf)
    names = sv.feature_names(t)
    stats = normalize.fit(train, names, "zscore")
    model = models.fit_model(normalize.apply_stats(train, stats), names, sv.target_names(t), LINEAR, {"solver": "normal"})
    vectors = table(spark, sf, "embeddings").select(
        "vec_id", F.transform("embedding", lambda v: v.cast("double") * 100).alias("features")
    )
    return rounded(scoring.score_vectors(vectors, t, model, stats).select("vec_id", "prediction"), 4)


@query()
def m12_tuning_trials(spark, sf):
    """Depth and seeds of a forest tried on the validation year."""
    df = lineitem_readings(spark, sf)
    spec = ModelSpec("random_forest", {"random_state": [1, 2]}, search="grid", param_grid={"max_depth": [10, None]})
    return evaluate.train(df, SPEC, spec).trials


@query()
def m13_final_fit(spark, sf):
    """The best parameters refitted on all training rows; predictions of the training window."""
    df = lineitem_readings(spark, sf)
    spec = ModelSpec("random_forest", search="random", max_trials=2, param_grid={"max_depth": [10, 20, None]})
    trained = evaluate.train(df, SPEC, spec)
    return trained.model.evaluate(trained.prepared.normalized)


@query(
    f"""WITH {sup(1, 1, "year(ts) IN (1996, 1997)")}, t AS (SELECT "neighbor__N" AS x, "neighbor__R" AS z, target_value AS y, prediction_time FROM rows_),
    {OLS}, r3 AS (SELECT * FROM ({READINGS}) WHERE year(ts) = 1998), m3 AS ({matrix('r3', 'PM2.5', FLAGS)}),
    v AS (SELECT "neighbor__N" AS x, "neighbor__R" AS z, target_value AS actual, prediction_time FROM ({supervised('m3', 'A', ['N', 'R'], 1, 1)}) WHERE year(prediction_time) = 1998),
    p AS (SELECT actual, my + bx * (x - mx) + bz * (z - mz) AS prediction FROM v, b)
    SELECT 'y98' AS fold, 'target_value' AS target, count(*) AS row_count, round(sqrt(avg((actual - prediction) * (actual - prediction))), 5) + 0.0 AS "RMSE",
      round(1 - sum((actual - prediction) * (actual - prediction)) / (var_pop(actual) * count(*)), 5) + 0.0 AS "R2" FROM p"""
)
def m14_cross_validation_fold(spark, sf):
    """A linear model fitted on two years and scored on the third, checked in closed form."""
    spec = SPEC.with_(lags=1, impute_columns=())
    folds = [{"name": "y98", "train_periods": ["1996", "1997"], "validation_periods": ["1998"]}]
    _, scored = evaluate.cross_validation(lineitem_readings(spark, sf), spec, ModelSpec(LINEAR, {"solver": "normal"}), folds)
    return rounded(scored, 5)


@query()
def m14_cross_validation(spark, sf):
    folds = [{"train_periods": [str(y)], "validation_periods": [str(y + 1)]} for y in (1996, 1997, 1998)]
    _, scored = evaluate.cross_validation(
        lineitem_readings(spark, sf), SPEC, ModelSpec("random_forest"), folds
    )
    return scored


@query(f"SELECT station_id, count(*) AS n, count(*) AS pm_present, count(*) AS no2_present FROM ({READINGS}) GROUP BY station_id")
def m15_forest_imputation(spark, sf):
    filled, _ = impute.impute_forest(lineitem_readings(spark, sf), [PM, NO2], ("ts",), station="station_id")
    return filled.groupBy("station_id").agg(
        F.count(F.lit(1)).alias("n"), F.count(q(PM)).alias("pm_present"), F.count(NO2).alias("no2_present")
    )


@query(
    "SELECT station_id, 'PM2.5' AS \"column\", 'random_forest' AS method, count(*) FILTER (\"PM2.5\" IS NULL) AS missing_before, 0::BIGINT AS missing_after, "
    f"2 AS n_features FROM ({READINGS}) GROUP BY station_id"
)
def m15_forest_imputation_details(spark, sf):
    _, details = impute.impute_forest(lineitem_readings(spark, sf), [PM], ("ts",), station="station_id")
    return details.withColumn("n_features", F.size("selected_features")).drop("selected_features", "feature_correlations")


@query(
    f"""WITH r AS ({READINGS})
    SELECT station_id, "column", feature, round(c, 5) + 0.0 AS corr FROM (
      SELECT station_id, 'PM2.5' AS "column", 'NO2' AS feature, corr("PM2.5", "NO2") FILTER ("PM2.5" IS NOT NULL AND "NO2" IS NOT NULL) AS c FROM r GROUP BY 1
      UNION ALL SELECT station_id, 'PM2.5', 'RH', corr("PM2.5", "RH") FILTER ("PM2.5" IS NOT NULL) FROM r GROUP BY 1)"""
)
def m15_feature_correlations(spark, sf):
    """What each station's forest looks at, and how strongly it goes with the target."""
    _, details = impute.impute_forest(lineitem_readings(spark, sf), [PM], ("ts",), station="station_id", params={"n_estimators": 10})
    return rounded(details.select("station_id", "column", F.explode("feature_correlations").alias("feature", "corr")), 5)


@query(
    "WITH r AS (" + READINGS.replace("l_returnflag", "l_suppkey::VARCHAR") + """)
    SELECT station_id, count(*) AS n, count(*) AS pm_present, count(*) FILTER ("PM2.5" IS NULL) AS filled, TRUE AS within FROM r GROUP BY station_id"""
)
def m15_many_stations(spark, sf):
    """Every supplier's gaps filled by its own forest, in one plan; a forest stays between the values it has seen."""
    df = lineitem_readings(spark, sf, "l_suppkey").withColumn("was", F.col(f"`{PM}`"))
    filled, _ = impute.impute_forest(df, [PM], ("ts", "was"), station="station_id")
    made = F.col("was").isNull()
    value = F.col(f"`{PM}`")
    found = filled.groupBy("station_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(value).alias("pm_present"),
        F.count_if(made).alias("filled"),
        (F.coalesce(F.min(F.when(made, value)), F.min("was")) >= F.min("was")).alias("low"),
        (F.coalesce(F.max(F.when(made, value)), F.max("was")) <= F.max("was")).alias("high"),
    )
    return found.select("station_id", "n", "pm_present", "filled", (F.col("low") & F.col("high")).alias("within"))


@query(
    f"""SELECT 'PM2.5' AS "column", count(DISTINCT station_id) AS stations, (count(*) FILTER ("PM2.5" IS NULL))::BIGINT AS missing_before, 0::BIGINT AS missing_after,
    'per_station' AS method FROM ({READINGS})"""
)
def m15_imputation_totals(spark, sf):
    _, details = impute.impute_forest(lineitem_readings(spark, sf), [PM], ("ts",), station="station_id", params={"n_estimators": 10})
    return impute.imputation_totals(details)


@query(
    """SELECT o_orderpriority AS config, run_id, created_at FROM (SELECT o_orderpriority, o_orderkey::VARCHAR AS run_id, o_orderdate AS created_at,
      row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey::VARCHAR DESC) AS r FROM orders) WHERE r = 1"""
)
def m20_latest_runs(spark, sf):
    """Orders as runs of their priority."""
    table_of_runs = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("config"), F.col("o_orderkey").cast("string").alias("run_id"), F.col("o_orderdate").alias("created_at")
    )
    return runs.latest_runs(table_of_runs)


@query(
    f"""WITH {LINEAR_RUN}, made AS (SELECT 'target_value' AS target, target_value AS actual, fit0 AS prediction FROM fit WHERE NOT learnt AND year(prediction_time) = 2001)
    SELECT target, {_SCORES} FROM made GROUP BY target"""
)
def m19_saved_model(spark, sf):
    """A model stored, loaded again and scored with its stored statistics."""
    root = scratch(spark)
    df = lineitem_readings(spark, sf)
    spec = ModelSpec(LINEAR, {"solver": "normal"})
    trained = evaluate.train(df, SPEC, spec)
    runs.save_run(spark, root, "run_a", SPEC, spec, trained.model, trained.stats)
    runs.check_alignment(spark, root, "run_a", SPEC, spec)
    loaded = runs.load_model(spark, root, "run_a")
    stats = runs.load_stats(spark, root, "run_a")
    return rounded(loaded.evaluate(prepare.prepare_evaluation(df, SPEC, stats).normalized), 4)


@query(
    f"""WITH {sup(2, 1, TRAIN_SLICE, clean=True)} SELECT 'run_a' AS run_id, count(*) AS row_count, 4::INTEGER AS feature_count,
    1::INTEGER AS horizon, 'zscore' AS normalization FROM rows_"""
)
def a10_training_dump(spark, sf):
    root = scratch(spark)
    results.write_training_dump(prepare.prepare_training(lineitem_readings(spark, sf), SPEC), root, "run_a")
    return results.read_run_table(spark, root, "dump_summary").select("run_id", "row_count", "feature_count", "horizon", "normalization")


@query(_run_sql(YEAR_WINDOW, True))
def a11_evaluation_sink(spark, sf):
    root = scratch(spark)
    df = lineitem_readings(spark, sf)
    trained = evaluate.train(df, SPEC, ModelSpec(LINEAR, {"solver": "normal"}))
    evaluate.write_evaluation(evaluate.evaluate(df, SPEC, trained, per_period=True), root, "run_a")
    return rounded(results.read_run_table(spark, root, "metrics"), 4)


@query(
    f"""WITH {LINEAR_RUN} SELECT prediction_time, 'target_value' AS target, {r('target_value', 'actual', 4)}, {r('fit0', 'prediction', 4)}, 'training' AS split
    FROM fit WHERE learnt"""
)
def c7_training_predictions(spark, sf):
    df = lineitem_readings(spark, sf)
    trained = evaluate.train(df, SPEC, ModelSpec(LINEAR, {"solver": "normal"}))
    result = evaluate.evaluate(df, SPEC, trained)
    return rounded(result.training_predictions.withColumn("split", F.lit("training")), 4)
