"""Column quoting, feature names and label text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Prefixes of generated columns and labels of inferred pollutants.
FEATURE_PREFIX = "neighbor__"
TARGET = "target_value"
PM25_LABEL = "PM2.5 (µg/m³)"
NO2_LABEL = "NO2 (µg/m³)"


def q(name: str) -> Column:
    """Column by its exact name, also when the name holds dots or brackets."""
    return F.col("`" + name.replace("`", "``") + "`")


def feature_name(station: str, lag: int = 0, pollutant: str | None = None) -> str:
    body = station if pollutant is None else f"{pollutant}__{station}"
    return f"{FEATURE_PREFIX}{body}" + (f"__lag_{lag}" if lag else "")


def target_name(pollutant: str | None = None) -> str:
    return TARGET if pollutant is None else f"{TARGET}__{pollutant}"


def pollutant_of_target(name: str) -> str | None:
    head = TARGET + "__"
    return name[len(head):] if name.startswith(head) else None


def sanitize_identifier(text: Column) -> Column:
    """Letters, digits, `_` and `-` only; `config` when nothing is left."""
    clean = F.btrim(F.regexp_replace(text, "[^A-Za-z0-9_-]+", "_"), F.lit("_"))
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit("config"))


def sanitize_series_name(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, "[^A-Za-z0-9]+", "_"), F.lit("_"))


def short_pollutant(label: Column, described: Column | None = None) -> Column:
    """`target_value__PM2.5 (µg/m³)` becomes `PM2_5`. A single target is labelled `target` only; its
    pollutant is then read off `described`, the run's own texts, where these name one."""
    bare = F.regexp_replace(F.regexp_replace(label, f"^{TARGET}__", ""), r"(?s)^([^(]+)\(.*$", "$1")
    token = sanitize_identifier(F.coalesce(F.trim(bare), F.lit("")))
    if described is None:
        return token
    named = infer_pollutant(described)
    return F.when((label == "target") & named.isNotNull(), short_pollutant(named)).otherwise(token)


def algorithm_label(algorithm: Column) -> Column:
    """Last dotted part of an estimator path; `unknown` when empty."""
    return F.coalesce(
        F.substring_index(F.nullif(algorithm, F.lit("")), ".", -1), F.lit("unknown")
    )


def algorithm_display_name(
    explicit: Column, algorithm: Column, config: Column, bidirectional: Column
) -> Column:
    """Explicit name first, then the known recurrent variants of saved runs, then the label."""
    label = algorithm_label(algorithm)
    where = F.lower(F.coalesce(config, F.lit("")))
    # Class label and display names of recurrent models in saved runs.
    recurrent = label == "LocalLSTMRegressor"
    variant = (
        F.when(bidirectional & where.contains("bilstm_pm25"), "BiLSTM (PM2.5)")
        .when(bidirectional & where.contains("bilstm_no2"), "BiLSTM (NO2)")
        .when(bidirectional & where.contains("bilstm"), "BiLSTM (PM2.5+NO2)")
        .when(bidirectional, "BiLSTM")
        .when(where.contains("lstm"), "LSTM")
    )
    return F.coalesce(F.nullif(F.trim(explicit), F.lit("")), F.when(recurrent, variant), label)


def infer_pollutant(text: Column, default: str | None = None) -> Column:
    """Pollutant named in free run text, for saved runs without a pollutant column."""
    low = F.lower(text)
    return (
        F.when(low.contains("pm25") | low.contains("pm2.5"), PM25_LABEL)
        .when(low.contains("no2"), NO2_LABEL)
        .otherwise(F.lit(default))
    )


_BY_TARGET = r"^by_target\.(.*)\.([^.]*)$"


def metric_group(metric: Column) -> Column:
    return F.when(metric.rlike(_BY_TARGET), F.regexp_extract(metric, _BY_TARGET, 1)).otherwise("overall")


def metric_short(metric: Column) -> Column:
    return F.when(metric.rlike(_BY_TARGET), F.regexp_extract(metric, _BY_TARGET, 2)).otherwise(metric)


def params_text(params: Column) -> Column:
    """`a=1, b=[2,3]` from a MAP<STRING,STRING> in its own order."""
    return F.concat_ws(
        ", ", F.transform(F.map_entries(params), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    )


def render_params(params: dict | None) -> dict[str, str]:
    """Parameter values as text; lists keep their brackets."""
    return {
        str(k): "[" + ",".join(str(x) for x in v) + "]" if isinstance(v, (list, tuple)) else str(v)
        for k, v in (params or {}).items()
    }


def numeric_or_null(value: Column) -> Column:
    return value.try_cast("double")


def clean_double(value: Column) -> Column:
    """Double with NaN turned into NULL, so missing has one form."""
    number = value.cast("double")
    return F.when(~F.isnan(number), number)
