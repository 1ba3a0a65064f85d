"""Inclusive time windows given as year, month, day, timestamp or start/end pairs."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime
from functools import reduce, singledispatch
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from stationweave.session import config_table


@dataclass(frozen=True)
class Step:
    """A length of calendar time that a boundary can name: how its texts look, and what makes them a date."""

    unit: str
    pattern: str
    rest: str

    def first(self, text: str) -> np.datetime64:
        """The named step, on the calendar of such steps."""
        return np.datetime64(pd.Timestamp(text + self.rest).to_datetime64(), self.unit[0].upper())


# A text that is none of these is a moment.
STEPS = (Step("year", r"\d{4}", "-01-01"), Step("month", r"\d{4}-\d{2}", "-01"), Step("day", r".{10}", ""))


@dataclass(frozen=True)
class Period:
    """All seconds from start to end, both included."""

    start: datetime
    end: datetime

    def __post_init__(self) -> None:
        if self.start > self.end:
            raise ValueError(f"a period can't end ({self.end}) before it starts ({self.start})")

    @property
    def iso(self) -> tuple[str, str]:
        return self.start.isoformat(), self.end.isoformat()


@singledispatch
def as_period(item: Any) -> Period:
    """What one entry of a configuration covers: a text the step or moment it names, a mapping from its first side to its last."""
    raise TypeError(f"neither a text nor a mapping: {type(item).__name__}")


@as_period.register
def _(item: Period) -> Period:
    return item


@as_period.register
def _(item: str) -> Period:
    text = item.strip()
    step = next((s for s in STEPS if re.fullmatch(s.pattern, text)), None)
    if step is None:
        moment = pd.Timestamp(text).to_pydatetime() if text else None
        if moment is None:
            raise ValueError("no time is named")
        return Period(moment, moment)
    named = step.first(text)
    # The last second is the one before the next step begins.
    begin, following = (t.astype("datetime64[s]") for t in (named, named + 1))
    return Period(begin.item(), (following - 1).item())


@as_period.register
def _(item: Mapping) -> Period:
    sides = [as_period(str(item[side])) for side in ("start", "end") if side in item]
    if not sides:
        raise ValueError("a mapping names a start, an end or both")
    return Period(sides[0].start, sides[-1].end)


def normalize_periods(raw: Any) -> list[Period]:
    """The windows of a configuration, which has none, one or a list of them."""
    alone = isinstance(raw, (str, Mapping, Period))
    return [as_period(item) for item in ([raw] if alone else raw or ())]


def validation_windows(spec: Any) -> list[Period]:
    """Validation windows, else the older list of test days."""
    raw = spec.validation_periods
    return normalize_periods(raw if raw is not None else list(spec.test_days or []))


def testing_windows(spec: Any) -> list[Period]:
    """Testing windows, else whatever validation resolves to."""
    if spec.testing_periods is not None:
        return normalize_periods(spec.testing_periods)
    return validation_windows(spec)


def period_years(raw: Any) -> list[int]:
    return sorted({y for p in normalize_periods(raw) for y in range(p.start.year, p.end.year + 1)})


def ntz(value: datetime) -> Column:
    """Timestamp literal without zone, so comparisons reach the Parquet scan."""
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def in_periods(ts: Column, raw: Any) -> Column:
    """True inside any window; never NULL, and False when there is no window."""
    hits = [ts.between(ntz(p.start), ntz(p.end)) for p in normalize_periods(raw)]
    return F.coalesce(reduce(Column.__or__, hits), F.lit(False)) if hits else F.lit(False)


def keep_periods(df: DataFrame, ts: Column, raw: Any) -> DataFrame:
    """Rows inside the windows; every row when none is given. Pushes down as plain bounds."""
    periods = normalize_periods(raw)
    if not periods:
        return df
    return df.where(reduce(Column.__or__, [ts.between(ntz(p.start), ntz(p.end)) for p in periods]))


def drop_periods(df: DataFrame, ts: Column, raw: Any) -> DataFrame:
    """Rows outside the windows; a NULL time is in no window and stays."""
    return df.where(~in_periods(ts, raw)) if normalize_periods(raw) else df


def _step_of(text: Column, found) -> Column:
    """found(step) of the step that a text names, null for a moment."""
    return F.coalesce(*[F.when(text.rlike(f"^(?:{s.pattern})$"), found(s)) for s in STEPS])


def boundary_start(text: Column) -> Column:
    """Column form of the first second named by a boundary text."""
    t = F.trim(text)
    return F.concat(t, F.coalesce(_step_of(t, lambda s: F.lit(s.rest)), F.lit(""))).cast("timestamp_ntz")


def boundary_end(text: Column) -> Column:
    """Column form of the last second named by a boundary text: the one before the next step begins."""
    start = boundary_start(text)
    last = _step_of(F.trim(text), lambda s: start + F.expr(f"INTERVAL 1 {s.unit}") - F.expr("INTERVAL 1 SECOND"))
    return F.coalesce(last, start)


def years_touched(df: DataFrame, start: str, end: str, out: str = "year") -> DataFrame:
    """Distinct calendar years covered by a table of windows."""
    return df.select(F.explode(F.sequence(F.year(start), F.year(end))).alias(out)).distinct()


def period_row(period: Period, index: int) -> tuple:
    start, end = period.iso
    return (
        index,
        f"period_{index:02d}",
        period.start,
        period.end,
        f"{start} -> {end}",
        f"{index:02d}_{period.start:%Y%m%dT%H%M%S}_{period.end:%Y%m%dT%H%M%S}",
        f"Period {index}: {period.start:%Y-%m-%d} to {period.end:%Y-%m-%d}",
    )


PERIOD_SCHEMA = T.StructType(
    [
        T.StructField("period_index", T.IntegerType(), False),
        T.StructField("period_name", T.StringType(), False),
        T.StructField("period_start", T.TimestampNTZType(), False),
        T.StructField("period_end", T.TimestampNTZType(), False),
        T.StructField("period", T.StringType(), False),
        T.StructField("period_suffix", T.StringType(), False),
        T.StructField("period_label", T.StringType(), False),
    ]
)


def period_frame(spark: SparkSession, raw: Any) -> DataFrame:
    rows = [period_row(p, i) for i, p in enumerate(normalize_periods(raw), 1)]
    return config_table(spark, rows, PERIOD_SCHEMA)


def label_periods(df: DataFrame, start: str, end: str, order_by: Sequence[str]) -> DataFrame:
    """Number a table of windows and give each its name, suffix and label."""
    from pyspark.sql import Window

    # One row per configured window: a few rows, so one ordered partition is enough.
    n = F.row_number().over(Window.orderBy(*order_by))
    day = lambda c: F.date_format(F.col(c), "yyyy-MM-dd")
    stamp = lambda c: F.date_format(F.col(c), "yyyyMMdd'T'HHmmss")
    iso = lambda c: F.date_format(F.col(c), "yyyy-MM-dd'T'HH:mm:ss")
    return df.withColumn("period_index", n).withColumns(
        {
            "period_name": F.format_string("period_%02d", "period_index"),
            "period": F.concat_ws(" -> ", iso(start), iso(end)),
            "period_suffix": F.concat_ws("_", F.format_string("%02d", "period_index"), stamp(start), stamp(end)),
            "period_label": F.concat(
                F.lit("Period "), F.col("period_index").cast("string"), F.lit(": "), day(start), F.lit(" to "), day(end)
            ),
        }
    )


def assign_periods(df: DataFrame, ts: str, raw: Any, overall: bool = False) -> DataFrame:
    """One output row per (row, window holding it); overlapping windows repeat the row.

    The windows are literals inside the projection: no join, no shuffle, no broadcast. With
    `overall` every row also belongs to a window of that name without bounds.
    """
    periods = normalize_periods(raw)
    if not periods:
        raise ValueError("at least one period is required")
    hits = [
        F.when(
            F.col(ts).between(ntz(p.start), ntz(p.end)),
            F.struct(
                F.lit(f"period_{i:02d}").alias("period_name"),
                ntz(p.start).alias("period_start"),
                ntz(p.end).alias("period_end"),
            ),
        )
        for i, p in enumerate(periods, 1)
    ]
    if overall:
        nowhere = F.lit(None).cast("timestamp_ntz")
        everything = F.struct(
            F.lit("overall").alias("period_name"), nowhere.alias("period_start"), nowhere.alias("period_end")
        )
        hits.append(everything)
    return df.select("*", F.explode(F.array_compact(F.array(*hits))).alias("__p")).select(
        *[f"`{c}`" for c in df.columns], "__p.period_name", "__p.period_start", "__p.period_end"
    )
