"""Scans, sinks and path functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from catalog.bindings import (
    FLAGS,
    MODEL_LABEL,
    NO2,
    PM,
    RH,
    SPEC,
    event_readings,
    lineitem_readings,
    loo_predictions,
    order_readings,
    rounded,
    scratch,
    table,
)
from catalog.registry import query
from catalog.sql import EVENTS, ORDERS, READINGS, predictions, r, results as result_rows
from stationweave.operators import report
from stationweave.sources import files, materialize, results
from stationweave.session import config_table

CSV_SUMMARY = f"""SELECT station_id, count(*) AS n, count("PM2.5") AS present, {r('sum("PM2.5")', 'pm_sum', 4)},
  {r('sum("NO2")', 'no2_sum', 4)}, min(ts) AS first_ts, max(ts) AS last_ts FROM ({READINGS}) GROUP BY station_id"""


def _summary(df: DataFrame) -> DataFrame:
    return rounded(
        df.groupBy("station_id").agg(
            F.count(F.lit(1)).alias("n"),
            F.count("`PM2.5`").alias("present"),
            F.sum("`PM2.5`").alias("pm_sum"),
            F.sum("NO2").alias("no2_sum"),
            F.min("ts").alias("first_ts"),
            F.max("ts").alias("last_ts"),
        ),
        4,
    )


def _write_csv(df: DataFrame, path: str, **options) -> None:
    writer = df.write.option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss")
    writer.options(**options).csv(path)


def _write_by_site(df: DataFrame, path: str) -> None:
    """A folder for each site. Tasks keep the few sites' files open side by side, so that they needn't sort their rows."""
    conf, key = df.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(key)
    conf.set(key, "32")
    try:
        df.write.option("header", True).partitionBy("site").csv(path)
    finally:
        conf.set(key, before)


@query(CSV_SUMMARY)
def a1_station_csv_scan(spark, sf):
    """Files whose header is padded, in another case and holds the station id."""
    path = scratch(spark) + "/csv"
    df = lineitem_readings(spark, sf).select("station_id", F.col("ts").alias(" TS "), F.col(f"`{PM}`"), NO2, RH)
    _write_csv(df, path, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return _summary(files.read_station_csv(spark, path, "ts").drop("__path"))


@query(CSV_SUMMARY)
def a1_forms_of_time_by_file(spark, sf):
    """One station's files in ISO 8601, one's month first, one's day first; no file says which it is."""
    root = scratch(spark)
    df = lineitem_readings(spark, sf)
    for flag, form in zip(FLAGS, ("yyyy-MM-dd HH:mm:ss", "MM/dd/yyyy HH:mm", "d/M/yyyy H:mm:ss")):
        text = df.where(F.col("station_id") == flag).withColumn("ts", F.date_format("ts", form))
        text.select("station_id", "ts", F.col(f"`{PM}`"), NO2, RH).write.option("header", True).csv(f"{root}/{flag}")
    return _summary(files.read_station_folder(spark, root, "ts", pattern="**/*.csv"))


@query(CSV_SUMMARY)
def a2_folder_scan(spark, sf):
    """One folder per station and two column orders; the id comes from the folder name."""
    root = scratch(spark)
    df = lineitem_readings(spark, sf).withColumn("site", F.col("station_id"))
    early = df.where("ts < TIMESTAMP_NTZ'1998-01-01'").select("site", "ts", F.col(f"`{PM}`"), NO2)
    late = df.where("ts >= TIMESTAMP_NTZ'1998-01-01'").select("site", NO2, "ts", RH, F.col(f"`{PM}`"))
    for name, part in (("early", early), ("late", late)):
        _write_by_site(part, f"{root}/{name}")
    out = files.read_station_folder(
        spark, root, "ts", pattern="**/*.csv", station_regex=r"site=([^/]+)", columns=[PM, NO2]
    )
    return _summary(out)


@query(CSV_SUMMARY)
def a3_station_file_mapping(spark, sf):
    """Explicit file lists per station; the key replaces the id in the files."""
    root = scratch(spark) + "/csv"
    df = lineitem_readings(spark, sf)
    df.withColumn("site", F.col("station_id")).withColumn("station_id", F.lit("wrong")).write.option(
        "header", True
    ).partitionBy("site").csv(root)
    listed = files.list_files(spark, root).withColumn("site", F.regexp_extract("path", "site=([^/]+)", 1))
    mapping: dict[str, list[str]] = {}
    for row in listed.select("site", "path").collect():
        mapping.setdefault(row.site, []).append(row.path)
    return _summary(files.read_station_mapping(spark, mapping, "ts"))


@query(
    f"""SELECT 'orders' AS station_id, count(*) AS n, {r('sum(price)', 'price_sum', 2)},
    min(ts) AS first_ts, max(ts) AS last_ts FROM ({ORDERS}) WHERE year(ts) IN (1996, 1998)"""
)
def a4_single_file_scan(spark, sf):
    """A file without a station column, its id from the folder, restricted to two years."""
    path = scratch(spark) + "/site_orders"
    _write_csv(order_readings(spark, sf).select("ts", "price"), path)
    one = files.read_station_file(spark, path, "ts", station_regex=r"site_([a-z]+)", years=[1996, 1998])
    return rounded(
        one.groupBy("station_id").agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("price").alias("price_sum"),
            F.min("ts").alias("first_ts"),
            F.max("ts").alias("last_ts"),
        ),
        2,
    )


def _paths(spark, sf) -> DataFrame:
    """File paths in three shapes, derived from the shipments."""
    parts = table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("flag"),
        F.year("l_shipdate").cast("string").alias("y"),
        F.col("l_suppkey").cast("string").alias("s"),
        "l_linestatus",
    ).distinct()
    shapes = F.array(
        F.concat(F.lit("data/"), F.col("flag"), F.lit("/Raw_1Hr_"), F.col("y"), F.lit("_site_"), F.col("s"), F.lit("_x.csv")),
        F.concat(F.lit("data/"), F.col("flag"), F.lit("/st_"), F.col("s"), F.lit("00_"), F.col("l_linestatus"), F.lit(".csv")),
        F.concat(F.lit("data/"), F.col("flag"), F.lit("/name"), F.col("l_linestatus"), F.lit(".csv")),
    )
    return parts.select(F.explode(shapes).alias("path")).distinct()


PATHS = """SELECT DISTINCT path FROM (SELECT unnest([
  'data/' || l_returnflag || '/Raw_1Hr_' || year(l_shipdate) || '_site_' || l_suppkey || '_x.csv',
  'data/' || l_returnflag || '/st_' || l_suppkey || '00_' || l_linestatus || '.csv',
  'data/' || l_returnflag || '/name' || l_linestatus || '.csv']) AS path FROM lineitem)"""


@query(
    f"""WITH p AS ({PATHS}), s AS (SELECT path, regexp_replace(regexp_extract(path, '([^/]+)$', 1), '\\.[^.]*$', '') AS stem FROM p)
    SELECT path, coalesce(nullif(regexp_extract(stem, '(?i)(?:^|[_-])site[_-]?([A-Za-z0-9]+)(?:[_-]|$)', 1), ''),
      nullif(regexp_extract(stem, '([0-9]{{3,}})', 1), ''), stem) AS by_name,
      regexp_extract(path, '^data/([^/]+)/', 1) AS by_folder, regexp_extract(path, '/([^/]+)/', 1) AS by_auto,
      coalesce(nullif(regexp_extract(path, 'st_([0-9]+)', 1), ''),
        nullif(regexp_extract(stem, '(?i)(?:^|[_-])site[_-]?([A-Za-z0-9]+)(?:[_-]|$)', 1), ''),
        nullif(regexp_extract(stem, '([0-9]{{3,}})', 1), ''), stem) AS by_pattern FROM s"""
)
def a5_station_from_path(spark, sf):
    p = F.col("path")
    return _paths(spark, sf).select(
        "path",
        files.station_from_path(p, "filename").alias("by_name"),
        files.station_from_path(p, "folder", root="data").alias("by_folder"),
        files.station_from_path(p, "auto", root="data").alias("by_auto"),
        files.station_from_path(p, "filename", regex=r"st_(\d+)").alias("by_pattern"),
    )


@query(
    f"""WITH p AS ({PATHS}), y AS (SELECT path, TRY_CAST(coalesce(
      nullif(regexp_extract(regexp_extract(path, '([^/]+)$', 1), '(?:^|[^0-9])((?:19|20)[0-9][0-9])(?:[^0-9]|$)', 1), ''),
      nullif(regexp_extract(path, '(?:^|[^0-9])((?:19|20)[0-9][0-9])(?:[^0-9]|$)', 1), '')) AS INTEGER) AS year FROM p)
    SELECT path, year FROM y WHERE year IN (1996, 1997, 2000)"""
)
def a6_year_file_pruning(spark, sf):
    kept = files.prune_years(_paths(spark, sf), [1996, 1997, 2000])
    return kept.select("path", files.year_from_path(F.col("path")).alias("year"))


@query()
def a7_file_signature(spark, sf):
    """Size and time of each table file that Spark would scan."""
    return files.file_signature(spark, sf, "*.parquet").select(
        F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "size"
    )


@query(
    f"""WITH r AS ({READINGS}), s AS (SELECT station_id, count(*) FILTER ("PM2.5" IS NULL) AS pb,
      count(*) FILTER ("NO2" IS NULL) AS nb FROM r GROUP BY ROLLUP (station_id))
    SELECT coalesce(station_id, '__all__') AS station_id, 'PM2.5' AS "column", pb AS missing_before, 0::BIGINT AS missing_after,
      'drop_rows' AS method, '' AS selected_features, TRUE AS reused FROM s
    UNION ALL SELECT coalesce(station_id, '__all__'), 'NO2', nb, 0::BIGINT, 'drop_rows', '', TRUE FROM s"""
)
def a8_materialise_if_changed(spark, sf):
    """Build the cleaned tables, ask again with the same inputs, and show the reused stats."""
    root = scratch(spark)
    df = lineitem_readings(spark, sf)
    sources = files.list_files(spark, f"{sf}/lineitem.parquet", "*.parquet")
    materialize.cleaned_dataset(spark, df, sources, SPEC, root)
    again = materialize.cleaned_dataset(spark, df, sources, SPEC, root)
    return again.stats.withColumn("reused", F.lit(again.reused))


@query(
    f"""WITH r AS (SELECT * FROM ({READINGS}) WHERE "PM2.5" IS NOT NULL AND "NO2" IS NOT NULL)
    SELECT 'PM2.5' AS col_a, 'NO2' AS col_b, round(corr("PM2.5", "NO2"), 5) + 0.0 AS corr FROM r
    UNION ALL SELECT 'PM2.5', 'RH', round(corr("PM2.5", "RH"), 5) + 0.0 FROM r
    UNION ALL SELECT 'NO2', 'RH', round(corr("NO2", "RH"), 5) + 0.0 FROM r"""
)
def a9_cleaned_dataset_sink(spark, sf):
    """The correlation table stored next to the cleaned rows, upper triangle."""
    df = lineitem_readings(spark, sf)
    sources = files.list_files(spark, f"{sf}/lineitem.parquet", "*.parquet")
    stored = materialize.cleaned_dataset(spark, df, sources, SPEC, scratch(spark))
    order = F.array(*[F.lit(c) for c in (PM, NO2, RH)])
    upper = F.array_position(order, F.col("col_a")) < F.array_position(order, F.col("col_b"))
    return rounded(stored.correlation.where(upper), 5)


@query(
    f"""WITH {predictions()} SELECT * FROM (SELECT target_station_id, algorithm, target, prediction_time,
      {r('actual', 'actual')}, {r('prediction', 'prediction')} FROM preds) WHERE actual IS NOT NULL AND prediction IS NOT NULL"""
)
def a13_prediction_series_scan(spark, sf):
    """Predictions of three runs written, then read back with their run names."""
    root = scratch(spark)
    preds = loo_predictions(spark, sf).withColumn("run_id", F.concat(F.lit("run_"), "target_station_id"))
    own = F.col("algorithm") == MODEL_LABEL
    columns = ["run_id", "algorithm", "target", "prediction_time", "actual", "prediction"]
    for name, part in (("validation", preds.where(own)), ("baseline_predictions", preds.where(~own))):
        kept = part.select(*columns) if name == "baseline_predictions" else part.select(*columns).drop("algorithm")
        kept.write.partitionBy("run_id").parquet(f"{root}/{name}")
    runs = _runs(spark)
    series = results.load_prediction_series(spark, root, runs)
    return rounded(series.drop("run_id"))


def _runs(spark) -> DataFrame:
    """Names of the runs, as the runs table holds them."""
    rows = [(f"run_{s}", f"cfg_{s.lower()}.yaml", s, f"weave.regression.{MODEL_LABEL}", None, False, PM) for s in FLAGS]
    return config_table(
        spark,
        rows,
        "run_id string, config string, target_station_id string, algorithm string, algorithm_name string, "
        "bidirectional boolean, pollutant string",
    ).withColumn("best_params", F.create_map(F.lit("depth"), F.lit("3"), F.lit("n_jobs"), F.lit("-1")))


@query(
    f"""WITH {predictions()}, s AS (SELECT 'run_' || target_station_id AS run_id, target_station_id, algorithm, count(*) AS row_count,
      sqrt(avg((actual - prediction) * (actual - prediction))) AS v FROM preds GROUP BY ALL)
    SELECT run_id, 'cfg_' || lower(target_station_id) || '.yaml' AS config, target_station_id, algorithm, row_count,
      CASE WHEN algorithm = '{MODEL_LABEL}' THEN 'depth=3' ELSE '' END AS params_text,
      unnest(['RMSE', 'by_target.target_value__PM2.5.RMSE']) AS metric, {r('v', 'value')} FROM s"""
)
def a12_results_scan(spark, sf):
    """Metrics of all runs in one scan, named by their run, bookkeeping parameters left out."""
    root = scratch(spark)
    from stationweave.functions.names import params_text
    from stationweave.operators.metrics import score

    scored = score(loo_predictions(spark, sf), ["target_station_id", "algorithm"])
    model = F.col("algorithm") == MODEL_LABEL
    long = scored.select(
        F.concat(F.lit("run_"), "target_station_id").alias("run_id"),
        F.when(model, "model").otherwise("baseline").alias("source"),
        "algorithm",
        "row_count",
        F.lit("RMSE").alias("metric"),
        F.col("RMSE").alias("value"),
    )
    long.write.partitionBy("run_id").parquet(f"{root}/metrics")
    named = results.comparable_metrics(results.read_run_table(spark, root, "metrics"), _runs(spark))
    text = F.coalesce(params_text(F.col("best_params")), F.lit(""))
    return rounded(named.withColumn("params_text", text).drop("best_params"))


@query(
    f"""WITH {result_rows()} SELECT target_station_id, algorithm, validation_period_name, (row_number() OVER (ORDER BY "RMSE",
    target_station_id, validation_period_start, validation_period_end, validation_period_name, algorithm, config))::INTEGER AS rank_by_rmse FROM period_rows"""
)
def a14_comparison_csv(spark, sf):
    """The comparison written as one CSV and read back."""
    from catalog.bindings import period_results

    ranked = report.rank_by_rmse(period_results(spark, sf))
    path = results.write_comparison_csv(ranked.drop("best_params"), scratch(spark) + "/comparison.csv")
    return spark.read.option("header", True).csv(path).select(
        "target_station_id", "algorithm", "validation_period_name", F.col("rank_by_rmse").cast("int")
    )


@query(
    f"""SELECT source, station_id, count(*) AS n, {r('sum(value)', 'value_sum', 2)}, {r('sum(k)', 'k_sum', 2)} FROM (
      SELECT 'events' AS source, station_id, value, k FROM ({EVENTS})
      UNION ALL BY NAME SELECT 'orders' AS source, price AS value, station_id FROM ({ORDERS})) GROUP BY source, station_id"""
)
def u1_union_by_name(spark, sf):
    a = event_readings(spark, sf).select(F.lit("events").alias("source"), "station_id", "value", "k")
    b = order_readings(spark, sf).select(F.lit("orders").alias("source"), F.col("price").alias("value"), "station_id")
    both = a.unionByName(b, allowMissingColumns=True)
    return rounded(
        both.groupBy("source", "station_id").agg(
            F.count(F.lit(1)).alias("n"), F.sum("value").alias("value_sum"), F.sum("k").alias("k_sum")
        ),
        2,
    )
