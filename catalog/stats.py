"""Counts, profiles, correlations, normalisation, metrics and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from catalog.bindings import (
    FLAGS,
    KINDS,
    MONTHS,
    NO2,
    PM,
    RH,
    event_readings,
    features,
    lineitem_readings,
    loo_predictions,
    rounded,
    table,
    task,
)
from catalog.frames import CLEAN, MISSING
from catalog.registry import query
from catalog.sql import EVENTS, MONTH_WINDOWS, R2, READINGS, RMSE, predictions, r, sup
from stationweave.functions import names
from stationweave.functions.names import q
from stationweave.session import materialise
from stationweave.operators import baselines, clean, metrics, normalize, profile, supervised as sv

COLS = (PM, NO2, RH)


@query(
    "WITH r AS (" + READINGS + ') SELECT "column", missing FROM (SELECT unnest([\'PM2.5\', \'NO2\', \'RH\', \'__total__\']) AS "column", '
    'unnest([count(*) FILTER ("PM2.5" IS NULL), count(*) FILTER ("NO2" IS NULL), count(*) FILTER ("RH" IS NULL), '
    'count(*) FILTER ("PM2.5" IS NULL) + count(*) FILTER ("NO2" IS NULL) + count(*) FILTER ("RH" IS NULL)]) AS missing FROM r)'
)
def g1_missing_counts(spark, sf):
    return clean.missing_counts(lineitem_readings(spark, sf), COLS)


@query(
    "WITH r AS (" + READINGS.replace("l_returnflag", "l_suppkey::VARCHAR") + ") "
    + MISSING("r", ["PM2.5", "NO2"]).replace("AS missing", "AS missing_before")
)
def g2_missing_counts_by_station(spark, sf):
    """Suppliers as stations: the totals are rolled up from the per-station counts."""
    return clean.missing_by_station(lineitem_readings(spark, sf, "l_suppkey"), (PM, NO2)).drop("missing_after")


def _profile_sql(source: str, stage: str | None = None) -> str:
    head = f"'{stage}' AS stage, " if stage else ""
    parts = []
    for c, kind in (("PM2.5", "double"), ("NO2", "double"), ("RH", "double")):
        col = f'"{c}"'
        parts.append(
            f"""SELECT {head}'{c}' AS "column", '{kind}' AS dtype, count(*) AS row_count, count({col}) AS present_count,
            count(*) - count({col}) AS missing_count, {r(f'count({col}) * 100.0 / count(*)', 'present_pct_of_all_rows')},
            {r(f'(count(*) - count({col})) * 100.0 / count(*)', 'missing_pct_of_all_rows')}, count(DISTINCT {col}) AS "unique",
            {r(f'avg({col})', 'mean')}, {r(f'median({col})', 'median')}, {r(f'min({col})', 'min')}, {r(f'max({col})', 'max')} FROM ({source})"""
        )
    return " UNION ALL ".join(parts)


@query(_profile_sql(READINGS))
def g3_column_profile(spark, sf):
    return rounded(profile.column_profile(lineitem_readings(spark, sf), ("ts", "station_id")))


@query(
    """SELECT "column", dtype, row_count, present_count, "unique", round(mean, 6) + 0.0 AS mean, round(median, 6) + 0.0 AS median FROM (
    SELECT 'event_type' AS "column", 'string' AS dtype, count(*) AS row_count, count(event_type) AS present_count,
      count(DISTINCT event_type) AS "unique", NULL::DOUBLE AS mean, NULL::DOUBLE AS median FROM events
    UNION ALL SELECT 'user_id', 'bigint', count(*), count(user_id), count(DISTINCT user_id), avg(user_id), median(user_id) FROM events
    UNION ALL SELECT 'value', 'double', count(*), count(value), count(DISTINCT value), avg(value), median(value) FROM events)"""
)
def g3_mixed_type_profile(spark, sf):
    df = profile.column_profile(table(spark, sf, "events"), ("event_id", "ts", "props"))
    return rounded(df.select("column", "dtype", "row_count", "present_count", "unique", "mean", "median"))


@query(_profile_sql(READINGS, "before") + " UNION ALL " + _profile_sql(CLEAN, "after"))
def g4_profile_stages(spark, sf):
    df = lineitem_readings(spark, sf)
    skip = ("ts", "station_id")
    kept = clean.drop_missing(df, [PM, NO2])
    return rounded(profile.column_profile(df, skip, "before").unionByName(profile.column_profile(kept, skip, "after")))


def _corr_sql(columns, by: str = "") -> str:
    head, tail = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    parts = []
    for a in columns:
        for b in columns:
            both = f'"{a}" IS NOT NULL AND "{b}" IS NOT NULL'
            value = "max(1.0)" if a == b else f'corr("{a}", "{b}") FILTER ({both})'
            parts.append(f"SELECT {head}'{a}' AS col_a, '{b}' AS col_b, {r(value, 'corr', 5)} FROM src {tail}")
    return " UNION ALL ".join(parts)


@query(f"WITH src AS ({READINGS}) {_corr_sql(COLS)}")
def g5_correlation(spark, sf):
    """A constant column joins in and is left out of the result."""
    df = lineitem_readings(spark, sf).withColumn("constant", F.lit(5.0))
    return rounded(profile.correlation(df, [*COLS, "constant"]), 5)


STATS_ROWS = features(2)


def _stats_sql(method: str, center: str, scale: str) -> str:
    parts = [
        f"SELECT '{method}' AS method, '{c}' AS \"column\", round(ct, 6) + 0.0 AS center, "
        f"round(CASE WHEN s = 0 THEN 1 ELSE s END, 6) + 0.0 AS scale, round(s, 6) + 0.0 AS raw_scale FROM "
        f"(SELECT {center.format(c=chr(34) + c + chr(34))} AS ct, {scale.format(c=chr(34) + c + chr(34))} AS s FROM rows_)"
        for c in STATS_ROWS
    ]
    return f"WITH {sup(2, 1)} " + " UNION ALL ".join(parts)


def _fit(spark, sf, method: str) -> DataFrame:
    rows = sv.supervised_frame(lineitem_readings(spark, sf), task(2, 1))
    return rounded(normalize.fit_stats(rows, STATS_ROWS, method))


@query(_stats_sql("zscore", "avg({c})", "stddev_pop({c})"))
def g6_fit_zscore(spark, sf):
    return _fit(spark, sf, "standard")


@query(_stats_sql("minmax", "min({c})", "max({c}) - min({c})"))
def g7_fit_minmax(spark, sf):
    return _fit(spark, sf, "min-max")


@query(_stats_sql("robust", "median({c})", "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)"))
def g8_fit_robust(spark, sf):
    return _fit(spark, sf, "robust")


@query(_stats_sql("maxabs", "avg(0.0)", "max(abs({c}))"))
def g9_fit_maxabs(spark, sf):
    return _fit(spark, sf, "max_abs")


@query(
    """SELECT s AS station_id, 'price' AS "column", count(*) AS n, round(quantile_cont(p, 0.25), 6) + 0.0 AS q25,
    round(median(p), 6) + 0.0 AS q50, round(quantile_cont(p, 0.75), 6) + 0.0 AS q75 FROM
    (SELECT l_suppkey::VARCHAR AS s, l_extendedprice AS p FROM lineitem) GROUP BY s"""
)
def g8_quantiles_by_station(spark, sf):
    """Exact quartiles of every supplier, read off bracketed value counts."""
    from stationweave.functions.quantiles import quantile_columns

    df = table(spark, sf, "lineitem").select(F.col("l_suppkey").cast("string").alias("station_id"), F.col("l_extendedprice").alias("price"))
    found = quantile_columns(df, ["price"], [0.25, 0.5, 0.75], ["station_id"])
    return rounded(found.select("station_id", "column", "n", *[F.get("quantiles", i).alias(f"q{p}") for i, p in enumerate((25, 50, 75))]))


@query(f"""WITH {predictions()} SELECT target_station_id, algorithm, {r(RMSE, 'RMSE')}, {r('avg((actual - prediction) * (actual - prediction))', 'MSE')},
    {r('avg(abs(actual - prediction))', 'MAE')} FROM preds GROUP BY ALL""")
def g11_rmse(spark, sf):
    scored = metrics.score(loo_predictions(spark, sf), ["target_station_id", "algorithm"], extra=True)
    return rounded(scored.drop("R2", "row_count"))


R2_SETS = f"""WITH {predictions()}, sets AS (SELECT 'as is' AS kind, target_station_id, actual, prediction FROM preds
    UNION ALL SELECT 'constant, all close', target_station_id, 7.0, 7.0 + actual * 1e-12 FROM preds
    UNION ALL SELECT 'constant, not close', target_station_id, 7.0, prediction FROM preds)"""


@query(f"{R2_SETS} SELECT kind, target_station_id, {r(R2, 'R2')} FROM sets GROUP BY ALL")
def g12_r2(spark, sf):
    """Constant actual values count as explained only when every prediction meets them."""
    p = loo_predictions(spark, sf)
    kind = lambda name, a, b: F.struct(F.lit(name).alias("kind"), a.alias("actual"), b.alias("prediction"))
    seven = F.lit(7.0)
    sets = F.array(
        kind("as is", F.col("actual"), F.col("prediction")),
        kind("constant, all close", seven, seven + F.col("actual") * 1e-12),
        kind("constant, not close", seven, F.col("prediction")),
    )
    rows = p.select("target_station_id", F.explode(sets).alias("s")).select("target_station_id", "s.*")
    return rounded(metrics.score(rows, ["kind", "target_station_id"]).drop("RMSE", "row_count"))


@query(
    f"""WITH {predictions()}, means_ AS (SELECT *, avg(actual) OVER (PARTITION BY target_station_id, algorithm) AS mean FROM preds)
    SELECT target_station_id, algorithm, round(1 - sum((prediction - actual) * (prediction - actual)) / sum(pow(abs(prediction - mean) + abs(actual - mean), 2)), 6) + 0.0 AS "IA"
    FROM means_ GROUP BY target_station_id, algorithm"""
)
def g12_index_of_agreement(spark, sf):
    return rounded(metrics.index_of_agreement(loo_predictions(spark, sf), ["target_station_id", "algorithm"]))


def _two_targets() -> str:
    both = ['"PM2.5"', '"NO2"']
    cells = ", ".join(
        f"avg(CASE WHEN station_id = '{s}' THEN {c} END) AS \"{c.strip(chr(34))}__{s}\"" for c in both for s in FLAGS
    )
    full = " AND ".join(f'"{p}__{s}" IS NOT NULL' for p in ("PM2.5", "NO2") for s in FLAGS)
    return f"""r AS ({READINGS}), w AS (SELECT * FROM (SELECT ts, {cells} FROM r GROUP BY ts) WHERE {full}),
    t AS (SELECT ts AS prediction_time, 'target_value__PM2.5' AS target, "PM2.5__A" AS actual, "PM2.5__N" AS n, "PM2.5__R" AS r FROM w
      UNION ALL SELECT ts, 'target_value__NO2', "NO2__A", "NO2__N", "NO2__R" FROM w),
    preds AS (SELECT target, 'Baseline: Average of Other Stations' AS algorithm, 'baseline_average_of_other_stations' AS baseline_id, actual, (n + r) / 2 AS prediction, prediction_time FROM t
      UNION ALL SELECT target, 'Baseline: Replace with Station N', 'baseline_replace_with_station_N', actual, n, prediction_time FROM t
      UNION ALL SELECT target, 'Baseline: Replace with Station R', 'baseline_replace_with_station_R', actual, r, prediction_time FROM t)"""


TWO_TARGETS = _two_targets()


@query(f"WITH {TWO_TARGETS} SELECT baseline_id, algorithm, target, count(*) AS row_count, {r(RMSE, 'RMSE')}, {r(R2, 'R2')} FROM preds GROUP BY ALL")
def g13_multi_target_metrics(spark, sf):
    t = task(1, 0, (PM, NO2))
    rows = sv.supervised_frame(lineitem_readings(spark, sf), t)
    return rounded(baselines.baseline_metrics(rows, t))


@query(
    f"""WITH {predictions()}, s AS (SELECT target_station_id, algorithm, period_name, count(*) AS row_count, {r(RMSE, 'RMSE')}, {r(R2, 'R2')}
      FROM preds JOIN {MONTH_WINDOWS} ON prediction_time BETWEEN period_start AND period_end GROUP BY ALL)
    SELECT period_name, strftime(period_start, '%Y-%m-%dT%H:%M:%S') || ' -> ' || strftime(period_end, '%Y-%m-%dT%H:%M:%S') AS period,
      target_station_id, algorithm, coalesce(row_count, 0) AS row_count, "RMSE", "R2", row_count IS NULL AS skipped
    FROM (SELECT * FROM {MONTH_WINDOWS} UNION ALL SELECT 4, 'period_04', TIMESTAMP '2050-01-01', TIMESTAMP '2050-12-31 23:59:59') LEFT JOIN s USING (period_name)"""
)
def g14_per_period_metrics(spark, sf):
    scored = metrics.score_periods(loo_predictions(spark, sf), [*MONTHS, "2050"], ["target_station_id", "algorithm"])
    return rounded(scored.drop("period_start", "period_end", "reason"))


@query(
    f"""WITH {predictions()}, f AS (SELECT target_station_id, algorithm, year(prediction_time) AS fold, {RMSE} AS rm, {R2} AS r2 FROM preds GROUP BY ALL)
    SELECT target_station_id, algorithm, unnest(['RMSE', 'R2', 'cv_fold_count']) AS metric,
      unnest([round(avg(rm), 6) + 0.0, round(avg(r2), 6) + 0.0, count(DISTINCT fold)::DOUBLE]) AS value FROM f GROUP BY target_station_id, algorithm"""
)
def g15_fold_average(spark, sf):
    """Calendar years as folds."""
    by_year = loo_predictions(spark, sf).withColumn("fold", F.year("prediction_time"))
    keys = ["target_station_id", "algorithm"]
    scored = metrics.score(by_year, [*keys, "fold"])
    return rounded(metrics.average_folds(metrics.long_metrics(scored, ["RMSE", "R2"], [*keys, "fold"]), keys))


@query(
    f"""WITH {predictions()}, f AS (SELECT algorithm, target_station_id, {RMSE} AS rm FROM preds GROUP BY ALL)
    SELECT algorithm, {r('avg(rm)', 'score')} FROM f GROUP BY algorithm"""
)
def g16_trial_score(spark, sf):
    """Algorithms as trials, held-out stations as targets."""
    scored = metrics.score(loo_predictions(spark, sf), ["algorithm", "target_station_id"])
    long = metrics.long_metrics(scored, ["RMSE", "R2"], ["algorithm", "target_station_id"])
    return rounded(metrics.trial_score(long, "RMSE", ["algorithm"]))


@query(
    f"""WITH r AS ({READINGS}), f AS (SELECT median("PM2.5") AS p, median("NO2") AS n FROM r)
    SELECT station_id, {r('avg(coalesce("PM2.5", p))', 'pm_mean')}, {r('avg(coalesce("NO2", n))', 'no2_mean')}, count(*) FILTER ("RH" IS NULL) AS rh_missing
    FROM r, f GROUP BY station_id"""
)
def g22_median_imputation(spark, sf):
    filled, _ = clean.impute_median(lineitem_readings(spark, sf), [PM, NO2, RH])
    return rounded(
        filled.groupBy("station_id").agg(
            F.avg(q(PM)).alias("pm_mean"), F.avg(NO2).alias("no2_mean"), F.count_if(F.col(RH).isNull()).alias("rh_missing")
        )
    )


@query(
    "WITH r AS (" + READINGS.replace("l_returnflag", "l_suppkey::VARCHAR") + """)
    SELECT station_id, 'PM2.5' AS "column", 'median' AS method, round(median("PM2.5"), 6) + 0.0 AS fill_value,
      count(*) FILTER ("PM2.5" IS NULL) AS missing_before, 0::BIGINT AS missing_after FROM r GROUP BY station_id HAVING count(*) FILTER ("PM2.5" IS NULL) > 0
    UNION ALL SELECT station_id, 'NO2', 'median', round(median("NO2"), 6) + 0.0, count(*) FILTER ("NO2" IS NULL), 0::BIGINT
      FROM r GROUP BY station_id HAVING count(*) FILTER ("NO2" IS NULL) > 0"""
)
def g22_median_imputation_by_station(spark, sf):
    _, details = clean.impute_median(lineitem_readings(spark, sf, "l_suppkey"), [PM, NO2], "station_id")
    return rounded(details.withColumn("missing_after", F.col("missing_after").cast("long")))


# Scalar functions ----------------------------------------------------------------------


def _applied_sql(center: str, scale: str) -> str:
    parts = ", ".join(
        r(f"({chr(34)}{c}{chr(34)} - (SELECT {center.format(c=chr(34) + c + chr(34))} FROM rows_)) / (SELECT {scale.format(c=chr(34) + c + chr(34))} FROM rows_)", c)
        for c in STATS_ROWS
    )
    return f"WITH {sup(2, 1)} SELECT prediction_time, {parts} FROM rows_"


def _applied(spark, sf, method: str, undo: bool = False) -> DataFrame:
    rows = materialise(sv.supervised_frame(lineitem_readings(spark, sf), task(2, 1)).select("prediction_time", *STATS_ROWS))
    stats = normalize.fit(rows, STATS_ROWS, method)
    scaled = normalize.apply_stats(rows, stats)
    if undo:
        scaled = scaled.select("prediction_time", *[normalize.denormalize(q(c), stats, c).alias(c) for c in STATS_ROWS])
    return rounded(scaled)


@query(_applied_sql("avg({c})", "stddev_pop({c})"))
def s1_apply_zscore(spark, sf):
    return _applied(spark, sf, "zscore")


@query(_applied_sql("min({c})", "(max({c}) - min({c}))"))
def s1_apply_minmax(spark, sf):
    return _applied(spark, sf, "minmax")


@query(_applied_sql("median({c})", "(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25))"))
def s1_apply_robust(spark, sf):
    return _applied(spark, sf, "robust")


@query(_applied_sql("avg(0.0)", "max(abs({c}))"))
def s1_apply_maxabs(spark, sf):
    return _applied(spark, sf, "maxabs")


@query(
    f"""WITH {sup(2, 1)} SELECT prediction_time, method, {r('"neighbor__N"', 'neighbor__N')}, {r('"neighbor__R__lag_1"', 'neighbor__R__lag_1')}
    FROM rows_, (SELECT unnest(['zscore', 'minmax', 'robust', 'maxabs', 'none']) AS method)"""
)
def s2_denormalize(spark, sf):
    """Scaling there and back returns the readings, whichever the method."""
    parts = [
        _applied(spark, sf, m, undo=True).select("prediction_time", F.lit(m).alias("method"), "neighbor__N", "neighbor__R__lag_1")
        for m in ("zscore", "minmax", "robust", "maxabs", "none")
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


_KIND_MEANS = ", ".join(f"avg(CASE WHEN station_id = '{k}' THEN value END) AS m{i}" for i, k in enumerate(KINDS))
_MEANS = [f"m{i}" for i in range(len(KINDS))]


@query(
    f"""WITH m AS (SELECT ts, {_KIND_MEANS} FROM ({EVENTS}) WHERE value IS NOT NULL GROUP BY ts)
    SELECT ts, round(({' + '.join(f'coalesce({c}, 0)' for c in _MEANS)}) / nullif({' + '.join(f'({c} IS NOT NULL)::INT' for c in _MEANS)}, 0), 9) + 0.0 AS row_mean FROM m"""
)
def s3_row_mean(spark, sf):
    from stationweave.operators.matrix import station_matrix

    m = station_matrix(event_readings(spark, sf), ["value"], list(KINDS))
    return rounded(m.select("ts", baselines.row_mean([F.col(c) for c in KINDS]).alias("row_mean")), 9)


@query(
    "SELECT page_id, coalesce(nullif(trim(regexp_replace(url, '[^A-Za-z0-9_-]+', '_', 'g'), '_'), ''), 'config') AS clean_id, "
    "coalesce(nullif(trim(regexp_replace(regexp_replace(url, '[A-Za-z0-9]', '', 'g'), '[^A-Za-z0-9_-]+', '_', 'g'), '_'), ''), 'config') AS rest_id FROM pages"
)
def s4_sanitize_identifier(spark, sf):
    url = F.col("url")
    return table(spark, sf, "pages").select(
        "page_id",
        names.sanitize_identifier(url).alias("clean_id"),
        names.sanitize_identifier(F.regexp_replace(url, "[A-Za-z0-9]", "")).alias("rest_id"),
    )


@query("SELECT conv_id, turn, trim(regexp_replace(text, '[^A-Za-z0-9]+', '_', 'g'), '_') AS series_name FROM conversations")
def s5_sanitize_series_name(spark, sf):
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", names.sanitize_series_name(F.col("text")).alias("series_name")
    )


@query(
    """WITH t AS (SELECT p_partkey, CASE WHEN p_size > 25 THEN 'target_value__' ELSE '' END || p_name || CASE WHEN p_retailprice > 1000 THEN ' (µg/m³)' ELSE '' END AS label FROM part),
    b AS (SELECT p_partkey, label, CASE WHEN starts_with(label, 'target_value__') THEN substr(label, 15) ELSE label END AS bare FROM t)
    SELECT p_partkey, label, coalesce(nullif(trim(regexp_replace(CASE WHEN strpos(bare, '(') > 1 THEN trim(substr(bare, 1, strpos(bare, '(') - 1)) ELSE bare END, '[^A-Za-z0-9_-]+', '_', 'g'), '_'), ''), 'config') AS token,
      CASE p_partkey % 4 WHEN 0 THEN 'PM2_5' WHEN 1 THEN 'PM2_5' WHEN 2 THEN 'NO2' ELSE 'target' END AS single FROM b"""
)
def s6_short_pollutant(spark, sf):
    label = F.concat(
        F.when(F.col("p_size") > 25, "target_value__").otherwise(""),
        F.col("p_name"),
        F.when(F.col("p_retailprice") > 1000, " (µg/m³)").otherwise(""),
    )
    return table(spark, sf, "part").select("p_partkey", label.alias("label")).withColumn(
        "token", names.short_pollutant(F.col("label"))
    ).withColumn(
        "single",
        names.short_pollutant(F.lit("target"), F.concat_ws(" ", "label", F.element_at(F.array(*map(F.lit, ("forest_PM25", "pm2.5 run", "NO2 forest", "linear"))), (F.col("p_partkey") % 4 + 1).cast("int")))),
    )


@query(
    """SELECT p_partkey, coalesce(nullif(trim(CASE WHEN p_size > 40 THEN p_name ELSE ' ' END), ''),
      CASE WHEN p_type = 'ECONOMY' THEN CASE WHEN p_size > 20 THEN 'BiLSTM (NO2)' WHEN p_size > 10 THEN 'LSTM' ELSE 'LocalLSTMRegressor' END
        ELSE regexp_extract('lib.' || p_type || '.' || p_brand, '([^.]*)$', 1) END) AS display_name FROM part"""
)
def s7_algorithm_label(spark, sf):
    recurrent = F.col("p_type") == "ECONOMY"
    algorithm = F.when(recurrent, "weave.LocalLSTMRegressor").otherwise(F.concat(F.lit("lib."), "p_type", F.lit("."), "p_brand"))
    config = F.when(F.col("p_size") > 20, "x/bilstm_no2.yaml").when(F.col("p_size") > 10, "x/lstm.yaml").otherwise("x/y.yaml")
    explicit = F.when(F.col("p_size") > 40, F.col("p_name")).otherwise(" ")
    label = names.algorithm_display_name(explicit, algorithm, config, recurrent & (F.col("p_size") > 20))
    return table(spark, sf, "part").select("p_partkey", label.alias("display_name"))


@query(
    """SELECT doc_id, CASE WHEN contains(lower(text), 'pm25') OR contains(lower(text), 'pm2.5') OR n_chars > 2000 THEN 'PM2.5 (µg/m³)'
      WHEN contains(lower(text), 'no2') OR lang = 'en' THEN 'NO2 (µg/m³)' ELSE 'target' END AS pollutant FROM documents"""
)
def s8_infer_pollutant(spark, sf):
    """Whole texts, with a run-like name added for the long and the English ones."""
    text = F.concat_ws(
        " ", "text", F.when(F.col("n_chars") > 2000, "run_PM25_1"), F.when(F.col("lang") == "en", "run_NO2_7")
    )
    return table(spark, sf, "documents").select("doc_id", names.infer_pollutant(text, "target").alias("pollutant"))


@query(
    """WITH m AS (SELECT p_partkey, CASE WHEN p_size > 20 THEN 'by_target.' || p_name || '.v1.' || p_brand ELSE p_brand END AS metric FROM part)
    SELECT p_partkey, metric, CASE WHEN starts_with(metric, 'by_target.') THEN regexp_extract(metric, '^by_target\\.(.*)\\.([^.]*)$', 1) ELSE 'overall' END AS metric_group,
      CASE WHEN starts_with(metric, 'by_target.') THEN regexp_extract(metric, '^by_target\\.(.*)\\.([^.]*)$', 2) ELSE metric END AS metric_short FROM m"""
)
def s10_metric_split(spark, sf):
    metric = F.when(
        F.col("p_size") > 20, F.concat(F.lit("by_target."), "p_name", F.lit(".v1."), "p_brand")
    ).otherwise(F.col("p_brand"))
    df = table(spark, sf, "part").select("p_partkey", metric.alias("metric"))
    return df.withColumns({"metric_group": names.metric_group(F.col("metric")), "metric_short": names.metric_short(F.col("metric"))})


@query("SELECT p_partkey, 'brand=' || p_brand || ', sizes=[' || p_size || ',' || (p_size + 1) || '], type=' || p_type AS params FROM part")
def s11_params_text(spark, sf):
    size = F.col("p_size")
    sizes = F.concat(F.lit("["), size.cast("string"), F.lit(","), (size + 1).cast("string"), F.lit("]"))
    params = F.create_map(F.lit("brand"), "p_brand", F.lit("sizes"), sizes, F.lit("type"), "p_type")
    return table(spark, sf, "part").select("p_partkey", names.params_text(params).alias("params"))


@query(
    """SELECT o_orderkey, TRY_CAST(CASE WHEN o_orderstatus = 'F' THEN 'n/a' ELSE o_totalprice::VARCHAR END AS DOUBLE) AS price,
    TRY_CAST(o_orderpriority AS DOUBLE) AS priority FROM orders"""
)
def s12_numeric_coercion(spark, sf):
    text = F.when(F.col("o_orderstatus") == "F", "n/a").otherwise(F.col("o_totalprice").cast("string"))
    return table(spark, sf, "orders").select(
        "o_orderkey",
        names.numeric_or_null(text).alias("price"),
        names.numeric_or_null(F.col("o_orderpriority")).alias("priority"),
    )


@query(
    f"WITH {sup(2, 1)} SELECT year(prediction_time)::INTEGER AS y, strftime(prediction_time, '%Y-%m-%d') AS day, count(*) AS n FROM rows_ GROUP BY ALL"
)
def s14_year_and_day(spark, sf):
    rows = sv.supervised_frame(lineitem_readings(spark, sf), task(2, 1))
    when = F.col("prediction_time")
    return rows.groupBy(F.year(when).alias("y"), F.date_format(when, "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {sup(1, 0)} SELECT feature_time, month(feature_time)::INTEGER AS "month", day(feature_time)::INTEGER AS "day",
    isodow(feature_time)::INTEGER AS day_of_week, hour(feature_time)::INTEGER AS "hour" FROM rows_"""
)
def w1_calendar_features(spark, sf):
    rows = sv.supervised_frame(lineitem_readings(spark, sf), task(1, 0))
    return sv.calendar_features(rows.select("feature_time"))
