"""Projections, filters, joins and reshaping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from catalog.bindings import (
    FLAGS,
    KINDS,
    NO2,
    OVERLAPPING,
    PM,
    RH,
    SPEC,
    TESTING,
    event_readings,
    lineitem_readings,
    loo_predictions,
    order_readings,
    rounded,
    table,
    task,
)
from catalog.registry import query
from catalog.sql import EVENTS, ORDERS, READINGS, matrix, predictions, r, sup, supervised
from stationweave.functions import periods
from stationweave.functions.names import q
from stationweave.operators import baselines, clean, matrix as mat, projection, report, splits, supervised as sv
from stationweave.specs import StationSpec

YEAR_COUNT = f"""SELECT year(ts) AS y, station_id, count(*) AS n, {r('sum("NO2")', 'no2_sum', 4)}"""


def _per_year(df: DataFrame) -> DataFrame:
    out = df.groupBy(F.year("ts").cast("long").alias("y"), "station_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("NO2").alias("no2_sum")
    )
    return rounded(out, 4)


@query(f"""SELECT "NO2", ts, station_id, "PM2.5" FROM ({READINGS})""")
def b1_required_columns(spark, sf):
    spec = SPEC.with_(columns=(NO2,))
    return projection.project_required(lineitem_readings(spark, sf), spec)


@query(f"""SELECT ts, station_id, "PM2.5", "NO2" FROM ({READINGS})""")
def b2_export_view(spark, sf):
    spec = SPEC.with_(impute_columns=(PM, NO2, "not there"))
    return projection.export_view(lineitem_readings(spark, sf), spec)


@query(
    """SELECT DISTINCT c_mktsegment AS station_id FROM customer WHERE c_mktsegment NOT IN (SELECT o_orderpriority FROM orders)
    UNION SELECT DISTINCT 'Z' FROM orders"""
)
def b3_missing_stations(spark, sf):
    """Roles taken from the customers' segments, the order priorities and one unknown id."""
    segments = [x[0] for x in table(spark, sf, "customer").select("c_mktsegment").distinct().collect()]
    urgent = [x[0] for x in table(spark, sf, "orders").select("o_orderpriority").distinct().collect()]
    return projection.missing_stations(order_readings(spark, sf), [*segments, *urgent, "Z"])


BOUNDARIES = """SELECT DISTINCT spec FROM (SELECT unnest([strftime(o_orderdate, '%Y'), strftime(o_orderdate, '%Y-%m'),
  strftime(o_orderdate, '%Y-%m-%d'), strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')]) AS spec FROM orders)"""


@query(
    f"""WITH b AS ({BOUNDARIES}) SELECT spec,
      CASE length(spec) WHEN 4 THEN make_timestamp(spec::INT, 1, 1, 0, 0, 0) WHEN 7 THEN (spec || '-01')::TIMESTAMP
        ELSE spec::TIMESTAMP END AS period_start,
      CASE length(spec) WHEN 4 THEN make_timestamp(spec::INT, 12, 31, 23, 59, 59)
        WHEN 7 THEN last_day((spec || '-01')::DATE)::TIMESTAMP + INTERVAL '23:59:59' HOUR TO SECOND
        WHEN 10 THEN spec::TIMESTAMP + INTERVAL '23:59:59' HOUR TO SECOND ELSE spec::TIMESTAMP END AS period_end FROM b""".replace(
        "INTERVAL '23:59:59' HOUR TO SECOND", "to_seconds(86399)"
    )
)
def b4_period_bounds(spark, sf):
    d = F.col("o_orderdate")
    forms = F.array(*[F.date_format(d, f) for f in ("yyyy", "yyyy-MM", "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss")])
    specs = table(spark, sf, "orders").select(F.explode(forms).alias("spec")).distinct()
    return specs.select(
        "spec",
        periods.boundary_start(F.col("spec")).alias("period_start"),
        periods.boundary_end(F.col("spec")).alias("period_end"),
    )


WINDOWS = """((ts BETWEEN TIMESTAMP '2000-01-01' AND TIMESTAMP '2000-12-31 23:59:59')
  OR (ts BETWEEN TIMESTAMP '2000-07-01' AND TIMESTAMP '2001-03-31 23:59:59')
  OR (ts BETWEEN TIMESTAMP '2001-02-14' AND TIMESTAMP '2001-02-14 23:59:59'))"""


@query(f"SELECT station_id, {WINDOWS} AS inside, count(*) AS n FROM ({READINGS}) GROUP BY ALL")
def b5_period_mask(spark, sf):
    inside = periods.in_periods(F.col("ts"), OVERLAPPING)
    return lineitem_readings(spark, sf).groupBy("station_id", inside.alias("inside")).agg(F.count(F.lit(1)).alias("n"))


@query(f"{YEAR_COUNT} FROM ({READINGS}) WHERE {WINDOWS} GROUP BY ALL")
def b6_period_include(spark, sf):
    return _per_year(periods.keep_periods(lineitem_readings(spark, sf), F.col("ts"), OVERLAPPING))


@query(f"{YEAR_COUNT} FROM ({READINGS}) WHERE NOT {WINDOWS} GROUP BY ALL")
def b7_period_exclude(spark, sf):
    return _per_year(periods.drop_periods(lineitem_readings(spark, sf), F.col("ts"), OVERLAPPING))


@query(
    """SELECT DISTINCT unnest(generate_series(year(a), year(b)))::INTEGER AS year FROM
    (SELECT min(o_orderdate) AS a, max(o_orderdate) AS b FROM orders GROUP BY o_custkey)"""
)
def b8_period_years(spark, sf):
    windows = table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.min("o_orderdate").alias("start"), F.max("o_orderdate").alias("end")
    )
    return periods.years_touched(windows, "start", "end")


CLEAN = f"""SELECT * FROM ({READINGS}) WHERE "PM2.5" IS NOT NULL AND "NO2" IS NOT NULL"""


@query(f"{YEAR_COUNT} FROM ({CLEAN}) GROUP BY ALL")
def b10_drop_missing_rows(spark, sf):
    return _per_year(clean.drop_missing(lineitem_readings(spark, sf), [PM, NO2, "absent"]))


@query(
    f"""SELECT coalesce(station_id, '__all__') AS station_id, count(*) AS row_count,
    count(*) FILTER ("PM2.5" IS NULL OR "NO2" IS NULL) AS dropped_rows FROM ({READINGS}) GROUP BY ROLLUP (station_id)"""
)
def b10_dropped_row_counts(spark, sf):
    return clean.dropped_rows(lineitem_readings(spark, sf), [PM, NO2])


ROWS21 = [f"neighbor__{s}{k}" for s in ("N", "R") for k in ("", "__lag_1")]
ROW_LIST = ", ".join(["feature_time", *[r(f'"{c}"', c) for c in [*ROWS21, "target_value"]], "prediction_time"])


@query(f"WITH {sup(2, 1)} SELECT {ROW_LIST} FROM rows_ WHERE prediction_time BETWEEN TIMESTAMP '2001-01-01' AND TIMESTAMP '2001-12-31 23:59:59'")
def b11_test_rows(spark, sf):
    rows = sv.supervised_frame(lineitem_readings(spark, sf), task(2, 1))
    return rounded(splits.select_test_rows(rows, SPEC.with_(testing_periods=TESTING)))


@query(
    f"""WITH {sup(2, 1)}, p AS (SELECT *, row_number() OVER (ORDER BY prediction_time) - 1 AS pos, count(*) OVER () AS n FROM rows_)
    SELECT {ROW_LIST} FROM p WHERE pos >= greatest(1, floor(n * 0.7))"""
)
def b11_positional_tail(spark, sf):
    rows = sv.supervised_frame(lineitem_readings(spark, sf), task(2, 1))
    spec = StationSpec("A", ("N", "R"), (PM,), train_frac=0.7)
    return rounded(splits.select_test_rows(rows, spec))


@query(
    f"""WITH {sup(2, 1)} SELECT CASE WHEN year(prediction_time) = 2001 THEN 'test' ELSE 'train' END AS side, count(*) AS n,
    min(feature_time) AS first_time, max(prediction_time) AS last_time, {r('avg(target_value)', 'mean_target')} FROM rows_
    WHERE year(prediction_time) IN (1997, 1998, 2001) GROUP BY 1"""
)
def b12_train_test_split(spark, sf):
    rows = sv.supervised_frame(lineitem_readings(spark, sf), task(2, 1))
    train, test = splits.split_rows(rows, SPEC.with_(train_years=(1997, 1998, 2001)))
    both = train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))
    return rounded(
        both.groupBy("side").agg(
            F.count(F.lit(1)).alias("n"),
            F.min("feature_time").alias("first_time"),
            F.max("prediction_time").alias("last_time"),
            F.avg("target_value").alias("mean_target"),
        )
    )


@query(f"WITH {sup(2, 1)} SELECT {ROW_LIST} FROM rows_")
def b13_empty_test_fallback(spark, sf):
    """No reading falls into 2050, so all rows are scored."""
    rows = sv.supervised_frame(lineitem_readings(spark, sf), task(2, 1))
    return rounded(splits.test_rows_or_all(rows, SPEC.with_(testing_periods=["2050"])))


# Alignment and joins -------------------------------------------------------------------


@query(
    f"""WITH {sup(1, 3)} SELECT feature_time, {r('"neighbor__N"', 'neighbor__N')}, {r('"neighbor__R"', 'neighbor__R')},
    {r('target_value', 'target_value')}, prediction_time FROM rows_"""
)
def j1_feature_label_alignment(spark, sf):
    return rounded(sv.supervised_frame(lineitem_readings(spark, sf), task(1, 3)))


@query(
    f"""SELECT period_name, period_start, period_end, station_id, count(*) AS n FROM ({READINGS}) JOIN (VALUES
      ('period_01', TIMESTAMP '2000-01-01', TIMESTAMP '2000-12-31 23:59:59'),
      ('period_02', TIMESTAMP '2000-07-01', TIMESTAMP '2001-03-31 23:59:59'),
      ('period_03', TIMESTAMP '2001-02-14', TIMESTAMP '2001-02-14 23:59:59')) AS w(period_name, period_start, period_end)
    ON ts BETWEEN period_start AND period_end GROUP BY ALL"""
)
def j3_period_assignment(spark, sf):
    placed = periods.assign_periods(lineitem_readings(spark, sf), "ts", OVERLAPPING)
    return placed.groupBy("period_name", "period_start", "period_end", "station_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey::VARCHAR AS station_id FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)")
def j4_silent_stations(spark, sf):
    """Customers without any event: both sides of any size."""
    known = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("station_id"))
    heard = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("station_id")).distinct()
    return known.join(heard, "station_id", "left_anti")


@query(
    f"""WITH {predictions()} SELECT baseline_id, algorithm, count(*) AS n, {r('avg(prediction)', 'mean_prediction')} FROM (
      SELECT *, CASE WHEN algorithm LIKE '%Average%' THEN 'baseline_average_of_other_stations'
        ELSE 'baseline_replace_with_station_' || right(algorithm, 1) END AS baseline_id
      FROM preds WHERE target_station_id = 'A' AND algorithm LIKE 'Baseline%') GROUP BY ALL"""
)
def j5_baseline_names(spark, sf):
    """Wide baseline predictions joined back to the display names of their ids."""
    t = task()
    rows = sv.supervised_frame(lineitem_readings(spark, sf), t)
    wide = baselines.baseline_table(rows, t)
    ids = [c for c in wide.columns if c.startswith("prediction__")]
    long = wide.unpivot("prediction_time", ids, "baseline_id", "prediction").withColumn(
        "baseline_id", F.regexp_replace("baseline_id", "^prediction__", "")
    )
    names = baselines.baseline_predictions(rows, t).select("baseline_id", "algorithm").distinct()
    return rounded(
        long.join(names, "baseline_id")
        .groupBy("baseline_id", "algorithm")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("prediction").alias("mean_prediction"))
    )


MISSING = lambda source, cols: " UNION ALL ".join(
    f"SELECT coalesce(station_id, '__all__') AS station_id, '{c}' AS \"column\", count(*) FILTER (\"{c}\" IS NULL) AS missing "
    f"FROM {source} GROUP BY ROLLUP (station_id)"
    for c in cols
)


@query(
    f"""WITH r AS ({READINGS}), k AS ({CLEAN}), b AS ({MISSING('r', ['PM2.5', 'NO2', 'RH'])}), a AS ({MISSING('k', ['PM2.5', 'NO2'])}),
    d AS (SELECT DISTINCT station_id, "column", 'drop_rows' AS method FROM a)
    SELECT station_id, "column", coalesce(b.missing, 0) AS missing_before, coalesce(a.missing, 0) AS missing_after, method,
      '' AS selected_features FROM b FULL JOIN a USING (station_id, "column") FULL JOIN d USING (station_id, "column")"""
)
def j6_imputation_stats(spark, sf):
    df = lineitem_readings(spark, sf)
    kept = clean.drop_missing(df, [PM, NO2])
    count = lambda x, cols: clean.missing_by_station(x, cols).select("station_id", "column", F.col("missing_before").alias("missing"))
    return clean.imputation_stats(count(df, [PM, NO2, RH]), count(kept, [PM, NO2]), clean.drop_details(df, [PM, NO2]))


LOO6 = [f"{f}{s}" for f in FLAGS for s in ("F", "O")]


def _six(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_shipdate").alias("ts"),
        F.concat("l_returnflag", "l_linestatus").alias("station_id"),
        F.when(F.col("l_discount") < 0.09, F.col("l_quantity")).alias("qty"),
    )


def _loo_sql(stations, lags, horizon) -> str:
    source = "r AS (SELECT l_shipdate AS ts, l_returnflag || l_linestatus AS station_id, CASE WHEN l_discount < 0.09 THEN l_quantity END AS qty FROM lineitem)"
    parts = []
    for t in stations:
        others = [s for s in stations if s != t]
        rows = supervised("m", t, others, lags, horizon)
        names = [f"neighbor__{s}" + (f"__lag_{k}" if k else "") for s in others for k in range(lags)]
        total = " + ".join(f'"{n}"' for n in names)
        parts.append(
            f"SELECT '{t}' AS task_id, feature_time, prediction_time, {len(names)} AS n_features, {r(total, 'feature_sum')}, "
            f'{r(chr(34) + names[-1] + chr(34), "last_feature")}, {r("target_value", "target_value")} FROM ({rows})'
        )
    return f"WITH {source}, m AS ({matrix('r', 'qty', stations)}) " + " UNION ALL ".join(parts)


@query(_loo_sql(LOO6, 2, 1))
def j9_leave_one_station_out(spark, sf):
    """Six stations, each held out in turn, with two lags and one step ahead, in one plan."""
    rows = sv.supervised_tasks(_six(spark, sf), sv.leave_one_out(LOO6, ["qty"], 2, 1))
    total = F.aggregate("features", F.lit(0.0), lambda a, v: a + v)
    return rounded(
        rows.select(
            "task_id",
            "feature_time",
            "prediction_time",
            F.size("features").alias("n_features"),
            total.alias("feature_sum"),
            F.element_at("features", -1).alias("last_feature"),
            F.get("targets", 0).alias("target_value"),
        )
    )


# Reshaping -----------------------------------------------------------------------------


@query(f"""SELECT ts, station_id, pollutant, {r('value', 'value')} FROM (SELECT ts, station_id, unnest(['PM2.5', 'NO2']) AS pollutant,
  unnest(["PM2.5", "NO2"]) AS value FROM ({READINGS}))""")
def r1_unpivot(spark, sf):
    return rounded(mat.unpivot_readings(lineitem_readings(spark, sf), [PM, NO2]))


def _rounded_matrix(inner: str, names) -> str:
    return f"SELECT ts, {', '.join(r(chr(34) + n + chr(34), n) for n in names)} FROM ({inner})"


@query(_rounded_matrix(matrix(f"({EVENTS})", "value", KINDS), KINDS))
def r2_station_matrix(spark, sf):
    return rounded(mat.station_matrix(event_readings(spark, sf), ["value"], KINDS))


_BOTH = '"value" IS NOT NULL OR "k" IS NOT NULL'
_MULTI = [f"{p}__{s}" for p in ("value", "k") for s in KINDS]


@query(
    _rounded_matrix(
        f"SELECT * FROM ({matrix(f'({EVENTS})', 'value', KINDS, _BOTH, 'value__')}) JOIN "
        f"({matrix(f'({EVENTS})', 'k', KINDS, _BOTH, 'k__')}) USING (ts)",
        _MULTI,
    )
)
def r3_multi_pollutant_matrix(spark, sf):
    return rounded(mat.station_matrix(event_readings(spark, sf), ["value", "k"], KINDS))


@query(
    f"""WITH {predictions()} SELECT prediction_time, {r('"A"', 'actual__A')}, {r('greatest("N", "R")', 'prediction__A')},
    {r('"N"', 'actual__N')}, {r('greatest("A", "R")', 'prediction__N')}, {r('"R"', 'actual__R')},
    {r('greatest("A", "N")', 'prediction__R')} FROM (SELECT ts AS prediction_time, "A", "N", "R" FROM full_)"""
)
def r5_predictions_wide(spark, sf):
    long = loo_predictions(spark, sf).where(~report.is_baseline(F.col("algorithm")))
    return rounded(baselines.predictions_wide(long.withColumn("target", F.col("target_station_id")), FLAGS))


@query(
    f"""WITH {predictions()} SELECT prediction_time, target_station_id AS target, {r('actual', 'actual')},
    {r('prediction', 'prediction')} FROM preds WHERE algorithm NOT LIKE 'Baseline%'"""
)
def r5_predictions_long(spark, sf):
    long = loo_predictions(spark, sf).where(~report.is_baseline(F.col("algorithm")))
    wide = baselines.predictions_wide(long.withColumn("target", F.col("target_station_id")), FLAGS)
    return rounded(baselines.predictions_long(wide))


@query(
    f"""WITH {sup(2, 1)} SELECT prediction_time, {r('target_value', 'actual')}, {r('("neighbor__N" + "neighbor__R") / 2', 'prediction')},
    {', '.join(r(f'"{c}"', 'input__' + c) for c in ROWS21)} FROM rows_"""
)
def r6_details(spark, sf):
    rows = sv.supervised_frame(lineitem_readings(spark, sf), task(2, 1))
    scored = rows.withColumns(
        {"actual": F.col("target_value"), "prediction": baselines.row_mean([q("neighbor__N"), q("neighbor__R")])}
    )
    return rounded(baselines.details(scored, ["target_value"]))



@query("SELECT DISTINCT l_partkey::VARCHAR AS station_id FROM lineitem WHERE l_partkey NOT IN (SELECT o_custkey FROM orders)")
def u4_station_difference(spark, sf):
    """Parts as stations that have readings, less the numbers that occur as customers."""
    required = lineitem_readings(spark, sf, "l_partkey").select("station_id").distinct()
    available = table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("station_id")).distinct()
    return required.join(available, "station_id", "left_anti")


@query(
    f"""WITH e AS (SELECT DISTINCT station_id, 'value' AS "column" FROM ({EVENTS})), o AS (SELECT DISTINCT station_id, 'price' AS "column" FROM ({ORDERS}))
    SELECT station_id, "column" FROM e UNION SELECT station_id, "column" FROM o"""
)
def u5_key_union(spark, sf):
    keys = lambda df, c: df.select("station_id", F.lit(c).alias("column")).distinct()
    e, o = keys(event_readings(spark, sf), "value"), keys(order_readings(spark, sf), "price")
    return e.join(o, ["station_id", "column"], "full_outer")
