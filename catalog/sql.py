"""Building blocks of the check SQL."""

from __future__ import annotations

from collections.abc import Sequence

from catalog.bindings import FLAGS, KINDS, MODEL_LABEL

READINGS = """SELECT l_shipdate AS ts, l_returnflag AS station_id,
  CASE WHEN l_discount < 0.09 THEN l_quantity END AS "PM2.5",
  CASE WHEN l_tax < 0.07 THEN floor(l_extendedprice / 100) END AS "NO2",
  round(l_tax * 100) AS "RH" FROM lineitem"""
EVENTS = """SELECT date_trunc('hour', ts)::TIMESTAMP AS ts, event_type AS station_id,
  CASE WHEN value >= 5 THEN value END AS value,
  TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events"""
ORDERS = "SELECT o_orderdate AS ts, o_orderpriority AS station_id, o_totalprice AS price FROM orders"


def r(expr: str, alias: str, digits: int = 6) -> str:
    return f'round({expr}, {digits}) + 0.0 AS "{alias}"'


def matrix(source: str, value: str, stations: Sequence[str], present: str | None = None, prefix: str = "") -> str:
    """Wide mean matrix over the times with any reading."""
    cols = ", ".join(f"avg(CASE WHEN station_id = '{s}' THEN \"{value}\" END) AS \"{prefix}{s}\"" for s in stations)
    return f"SELECT ts, {cols} FROM {source} WHERE {present or f'\"{value}\" IS NOT NULL'} GROUP BY ts"


def supervised(
    mat: str, target: str, inputs: Sequence[str], lags: int, horizon: int, extra: str = ""
) -> str:
    """Positional lags and lead over a matrix relation; complete rows only."""
    w = "OVER (ORDER BY ts)"
    names, parts = [], []
    for s in inputs:
        for k in range(lags):
            name = f"neighbor__{s}" + (f"__lag_{k}" if k else "")
            names.append(name)
            parts.append(f'lag("{s}", {k}) {w} AS "{name}"')
    parts.append(f'lead("{target}", {horizon}) {w} AS target_value')
    parts.append(f"lead(ts, {horizon}) {w} AS prediction_time")
    full = " AND ".join(f'"{n}" IS NOT NULL' for n in [*names, "target_value", "prediction_time"])
    return f"SELECT * FROM (SELECT ts AS feature_time, {', '.join(parts)}{extra} FROM {mat}) WHERE {full}"


def sup(lags: int, horizon: int, where: str = "TRUE", target: str = "A", clean: bool = False) -> str:
    """CTE list giving `rows`: supervised rows of one flag over (a slice of) the readings."""
    cond = f"({where})" + (' AND "PM2.5" IS NOT NULL AND "NO2" IS NOT NULL' if clean else "")
    others = [s for s in FLAGS if s != target]
    return (
        f"r AS (SELECT * FROM ({READINGS}) WHERE {cond}), "
        f"m AS ({matrix('r', 'PM2.5', FLAGS)}), "
        f"rows_ AS ({supervised('m', target, others, lags, horizon)})"
    )


def predictions() -> str:
    """CTE list giving `preds`: held-out flags with baselines and the simple model."""
    parts = []
    for s in FLAGS:
        a, b = [x for x in FLAGS if x != s]
        algos = [
            ("Baseline: Average of Other Stations", f'("{a}" + "{b}") / 2'),
            (f"Baseline: Replace with Station {a}", f'"{a}"'),
            (f"Baseline: Replace with Station {b}", f'"{b}"'),
            (MODEL_LABEL, f'greatest("{a}", "{b}")'),
        ]
        parts += [
            f"SELECT ts AS prediction_time, '{s}' AS target_station_id, '{n}' AS algorithm, "
            f"'target_value' AS target, \"{s}\" AS actual, {e} AS prediction FROM full_"
            for n, e in algos
        ]
    both = " AND ".join(f'"{s}" IS NOT NULL' for s in FLAGS)
    return (
        f"r AS ({READINGS}), m AS ({matrix('r', 'PM2.5', FLAGS)}), full_ AS (SELECT * FROM m WHERE {both}), "
        f"preds AS ({' UNION ALL '.join(parts)})"
    )


def least_squares(source: str, features: Sequence[str], targets: Sequence[str], train: str = "TRUE") -> str:
    """CTE list giving `fit`: the source with fit0, fit1, … for the targets, by least squares over the rows of `train`.

    One feature after the other is taken out of all later columns; what stays of a target is its error.
    """
    columns = [*features, *targets]
    over = f"FILTER (WHERE {train}) OVER ()"
    steps = [f"""s0 AS (SELECT *, {', '.join(f'"{c}" - avg("{c}") {over} AS d{i}' for i, c in enumerate(columns))} FROM {source})"""]
    for i in range(len(features)):
        left = ", ".join(f"d{j} - d{i} * (sum(d{i} * d{j}) {over} / sum(d{i} * d{i}) {over}) AS d{j}" for j in range(i + 1, len(columns)))
        steps.append(f"s{i + 1} AS (SELECT * REPLACE ({left}) FROM s{i})")
    made = ", ".join(f'"{t}" - d{len(features) + i} AS fit{i}' for i, t in enumerate(targets))
    return ", ".join([*steps, f"fit AS (SELECT *, {made} FROM s{len(features)})"])


RMSE = "sqrt(avg((actual - prediction) * (actual - prediction)))"
R2 = (
    "CASE WHEN var_pop(actual) * count(*) = 0 THEN "
    "CASE WHEN max(abs(actual - prediction) - (1e-8 + 1e-5 * abs(prediction))) <= 0 THEN 1.0 ELSE 0.0 END "
    "ELSE 1 - sum((actual - prediction) * (actual - prediction)) / (var_pop(actual) * count(*)) END"
)
MONTH_WINDOWS = """(VALUES
  (1, 'period_01', TIMESTAMP '2001-01-01 00:00:00', TIMESTAMP '2001-01-31 23:59:59'),
  (2, 'period_02', TIMESTAMP '2001-04-01 00:00:00', TIMESTAMP '2001-04-30 23:59:59'),
  (3, 'period_03', TIMESTAMP '2001-07-01 00:00:00', TIMESTAMP '2001-07-31 23:59:59')
) AS w(period_index, period_name, period_start, period_end)"""
ISO = "'%Y-%m-%dT%H:%M:%S'"


def results() -> str:
    """CTE lists giving `period_rows` and `overall_rows` as the comparison table has them."""
    head = (
        "'run_' || target_station_id AS run_id, 'cfg_' || lower(target_station_id) || '.yaml' AS config, "
        "target_station_id, algorithm, "
    )
    vals = f"count(*) AS row_count, {r(RMSE, 'RMSE')}, {r(R2, 'R2')}"
    return (
        predictions()
        + f""", period_rows AS (SELECT {head} period_name AS validation_period_name,
      strftime(period_start, {ISO}) AS validation_period_start, strftime(period_end, {ISO}) AS validation_period_end, {vals}
      FROM preds JOIN {MONTH_WINDOWS} ON prediction_time BETWEEN period_start AND period_end
      GROUP BY target_station_id, algorithm, period_name, period_start, period_end),
    overall_rows AS (SELECT {head} 'overall' AS validation_period_name, '' AS validation_period_start,
      '' AS validation_period_end, {vals} FROM preds GROUP BY target_station_id, algorithm)"""
    )


def longer(source: str) -> str:
    keys = (
        "run_id, config, target_station_id, algorithm, validation_period_name, validation_period_start, "
        "validation_period_end, row_count"
    )
    return " UNION ALL ".join(f"SELECT {keys}, '{m}' AS metric, \"{m}\" AS value FROM {source}" for m in ("RMSE", "R2"))


EVENT_FULL = " AND ".join(f'"{s}" IS NOT NULL' for s in KINDS)
