"""Filling gaps in target columns with a forest on the best-correlated other columns, for all stations at once."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from stationweave.functions.names import clean_double, q
from stationweave.functions.quantiles import quantile_columns
from stationweave.operators.clean import is_missing, missing_by_station
from stationweave.operators.forests import fill_forests
from stationweave.operators.profile import correlation, numeric_columns
from stationweave.operators.trees import ForestSpec
from stationweave.session import config_table, materialise, release

DETAILS = "station_id string, column string, method string, selected_features array<string>, feature_correlations map<string,double>, missing_before long"
ONE = "__all__"  # the station of a frame that is filled as a whole
_KEY = "__station"


def impute_forest(
    df: DataFrame,
    targets: Sequence[str],
    exclude: Sequence[str] = (),
    top_k: int = 3,
    station: str | None = None,
    params: dict | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(filled frame, details): each (station, target) with gaps gets its own forest.

    Feature gaps take the station's median over rows whose target is known. Without usable features, or
    with fewer than two known values, the target's own median fills the gaps. Targets are filled one after
    the other, so a later target sees the earlier ones filled. What a station needs, its features, medians
    and counts, is a row of a table; the stations' forests are fitted and applied in one plan per target.
    """
    spec = ForestSpec.of("random_forest", params)
    current = materialise(df.withColumn(_KEY, q(station).cast("string") if station else F.lit(ONE)))
    skip = {*exclude, _KEY, *([station] if station else [])}
    numeric = [c for c in numeric_columns(df) if c not in skip]
    related = materialise(correlation(current, numeric, [_KEY]))
    done: list[tuple[str, DataFrame]] = []
    for target in [t for t in targets if t in df.columns]:
        plan = materialise(_plan(current, related, target, numeric, top_k))
        if plan.isEmpty():
            release(plan)
            continue
        filled = _filled(current, plan, target, numeric, spec)
        release(current)
        current = filled
        done.append((target, plan))
    release(related)

    rows = [plan.select(F.col(_KEY).alias("station_id"), F.lit(t).alias("column"), "method", "selected_features", "feature_correlations", F.col("gaps").alias("missing_before")) for t, plan in done]
    details = reduce(DataFrame.unionByName, rows, config_table(df.sparkSession, [], DETAILS))
    names = [t for t, _ in done] or numeric[:1]
    left = missing_by_station(current, names, _KEY).select("station_id", "column", F.col("missing_before").alias("missing_after"))
    return current.drop(_KEY), details.join(left, ["station_id", "column"], "left") if done else details.withColumn("missing_after", F.lit(0).cast("long"))


def imputation_totals(details: DataFrame) -> DataFrame:
    """Per column over all stations that had gaps in it: stations, gaps before and after."""
    totals = details.groupBy("column").agg(F.count("*").alias("stations"), F.sum("missing_before").alias("missing_before"), F.sum("missing_after").alias("missing_after"))
    return totals.withColumn("method", F.lit("per_station"))


def _plan(df: DataFrame, related: DataFrame, target: str, numeric: Sequence[str], top_k: int) -> DataFrame:
    """One row per station with gaps: its features with their correlations, medians, and how its gaps are filled."""
    gone = is_missing(df, target)
    counts = df.groupBy(_KEY).agg(F.count_if(~gone).alias("known"), F.count_if(gone).alias("gaps")).where("gaps > 0")
    # Best-correlated columns first; a target without any correlation takes columns in frame order.
    others = related.where(F.col("col_a") != target).select(_KEY, F.col("col_a").alias("feature")).distinct()
    own = related.where((F.col("col_a") == target) & (F.col("col_b") != target)).select(_KEY, F.col("col_b").alias("feature"), "corr")
    place = F.array_position(F.array(*map(F.lit, numeric)), F.col("feature"))
    entry = F.struct((-F.abs(F.coalesce("corr", F.lit(0.0)))).alias("worth"), place.alias("place"), "feature", F.coalesce("corr", F.lit(0.0)).alias("corr"))
    ranked = others.join(own, [_KEY, "feature"], "left").groupBy(_KEY).agg(F.slice(F.array_sort(F.collect_list(entry)), 1, max(1, top_k)).alias("best"))
    known = df.where(~gone)
    medians = quantile_columns(known, list(dict.fromkeys([*numeric, target])), [0.5], [_KEY])
    mapped = medians.groupBy(_KEY).agg(F.map_from_entries(F.collect_list(F.struct("column", F.get("quantiles", F.lit(0))))).alias("medians"))
    joined = counts.join(ranked, _KEY, "left").join(mapped, _KEY, "left")
    best = F.coalesce("best", F.array().cast("array<struct<worth: double, place: bigint, feature: string, corr: double>>"))
    features = F.transform(best, lambda b: b["feature"])
    forest = (F.size(features) > 0) & (F.col("known") >= 2)
    median = F.try_element_at("medians", F.lit(target))
    return joined.select(
        _KEY,
        "gaps",
        features.alias("selected_features"),
        F.map_from_entries(F.transform(best, lambda b: F.struct(b["feature"], b["corr"]))).alias("feature_correlations"),
        F.transform(features, lambda f: F.coalesce(F.try_element_at("medians", f), F.lit(0.0))).alias("fills"),
        forest.alias("forest"),
        F.when(forest, "random_forest").otherwise("median_fallback").alias("method"),
        F.coalesce(median, F.when(F.size(features) > 0, 0.0)).alias("fallback"),
    )


def _value_of(feature: Column, numeric: Sequence[str]) -> Column:
    return F.coalesce(*[F.when(feature == c, clean_double(q(c))) for c in numeric], F.lit(None).cast("double"))


def _filled(df: DataFrame, plan: DataFrame, target: str, numeric: Sequence[str], spec: ForestSpec) -> DataFrame:
    """df with the target's gaps filled by the plan of each row's station, stored."""
    gone = is_missing(df, target)
    # One row per station; joined by its size, not by hint.
    joined = df.join(plan.select(_KEY, "selected_features", "fills", "forest", "fallback"), _KEY)
    x = F.zip_with("selected_features", "fills", lambda f, fill: F.coalesce(_value_of(f, numeric), fill)).alias("x")
    train = joined.where(F.col("forest") & ~gone)
    rows = materialise(train.select(F.col(_KEY).alias("key"), x, F.array(clean_double(q(target))).alias("y")))
    columns = [q(c) for c in df.columns]
    gaps = materialise(joined.where(gone).select(*columns, x.alias("__x"), "forest", "fallback"))
    scored, stored = fill_forests(rows, gaps, [spec], 1, _KEY, "__x", "__made")
    value = F.when(F.col("forest"), F.get("__made", F.lit(0))).otherwise(F.col("fallback"))
    filled = scored.withColumn(target, value).select(*columns)
    out = materialise(df.where(~gone).withColumn(target, q(target).cast("double")).unionByName(filled))
    for frame in (rows, gaps, *stored):
        release(frame)
    return out
