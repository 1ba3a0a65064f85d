"""Times written as text: every file is read in one form, which all of its rows must fit.

A row says which forms could have written its time, one bit for each. The `and` of these bits over a
file is what the whole file may be written in; it is found by an aggregate, wherever the rows lie.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Forms of a time besides ISO 8601, in the order of preference.
TIME_FORMATS = (
    "M/d/yyyy[ H:mm[:ss]]", "M-d-yyyy[ H:mm[:ss]]", "d/M/yyyy[ H:mm[:ss]]", "d-M-yyyy[ H:mm[:ss]]", "yyyy/M/d[ H:mm[:ss]]", "yyyy-M-d[ H:mm[:ss]]", "d.M.yyyy[ H:mm[:ss]]",
)
MOST_FORMATS = 60  # bits of a number


def shape(pattern: str) -> str:
    """A regular expression that texts of a pattern match, so that others needn't be parsed."""
    out = []
    for found in re.finditer(r"([A-Za-z])\1*|'[^']*'|.", pattern):
        part, letter = found.group(), found.group(1)
        if part in "[]":
            out.append("(?:" if part == "[" else ")?")
        elif letter and letter in "yuMdHhms" and len(part) != 3:
            out.append(r"\d{1,2}" if len(part) == 1 else rf"\d{{{len(part)},}}")
        else:
            out.append(".+" if letter else re.escape(part.strip("'") or "'"))
    return "".join(out)


def parsed(text: Column, pattern: str | None) -> Column:
    """The time, or null if the text isn't of this form; no pattern stands for ISO 8601."""
    if pattern is None:
        return text.try_cast("timestamp_ntz")
    return F.when(text.rlike(f"^(?:{shape(pattern)})$"), F.try_to_timestamp(text, F.lit(pattern)).cast("timestamp_ntz"))


def forms(formats: Sequence[str]) -> list[str | None]:
    """ISO 8601 and the formats; the number of a form is its place here."""
    if len(formats) > MOST_FORMATS:
        raise ValueError(f"at most {MOST_FORMATS} time formats can be told apart")
    return [None, *dict.fromkeys(formats)]


def rivals(formats: Sequence[str]) -> list[tuple[int, int]]:
    """Forms that texts of one look can be read in with different results."""
    known = [None if f is None else shape(f) for f in forms(formats)]
    return [(i, j) for j in range(len(known)) for i in range(1, j) if known[i] == known[j]]


def evidence(df: DataFrame, text: Column, formats: Sequence[str]) -> DataFrame:
    """df with `fits`, a bit for each form that reads the text (null for no text), and `differs`, a bit for each pair of rivals that read it differently."""
    listed, pairs = forms(formats), rivals(formats)
    read = df.withColumn("__read", F.array(*[parsed(text, f) for f in listed]))
    at = lambda i: F.get("__read", F.lit(i))
    fits = sum((F.when(at(i).isNotNull(), 1 << i).otherwise(0) for i in range(len(listed))), F.lit(0)).cast("long")
    differs = sum((F.when(at(i) != at(j), 1 << k).otherwise(0) for k, (i, j) in enumerate(pairs)), F.lit(0)).cast("long")
    return read.withColumns({"fits": F.when(text.isNotNull(), fits), "differs": differs}).drop("__read")


def gathered() -> list[Column]:
    """Aggregates of a file's evidence: what all rows fit, which pairs differ somewhere, and how many texts nothing fits.

    All are numbers, so they are gathered by hash; the least of texts would have every task sort its rows.
    """
    return [
        F.coalesce(F.bit_and("fits"), F.lit(1)).alias("fits"),
        F.bit_or("differs").alias("differs"),
        F.count_if(F.col("fits") == 0).alias("strangers"),
    ]


def _undecided(formats: Sequence[str]) -> Column:
    both = lambda i, j: F.col("fits").bitwiseAND(F.lit(1 << i | 1 << j)) == F.lit(1 << i | 1 << j)
    open_pairs = [both(i, j) & (F.col("differs").bitwiseAND(F.lit(1 << k)) != 0) for k, (i, j) in enumerate(rivals(formats))]
    out = F.lit(False)
    for pair in open_pairs:
        out = out | pair
    return out


def decided(files: DataFrame, formats: Sequence[str], group: str, in_order: bool) -> DataFrame:
    """files (…, fits, differs) with `form`, the number of each file's form; null if none fits all rows, -1 if several do and nothing decides.

    With in_order the first form that fits counts. Otherwise a file that two forms read differently takes
    the one that all decided files of its group allow.
    """
    if not in_order:
        marked = files.withColumn("__open", _undecided(formats))
        agreed = marked.groupBy(group).agg(F.bit_and(F.when(~F.col("__open"), F.col("fits"))).alias("__agreed"))
        common = F.col("fits").bitwiseAND(F.col("__agreed"))
        narrowed = F.when(F.col("__open") & (common != 0), common).otherwise(F.col("fits"))
        files = marked.join(agreed, group).withColumn("fits", narrowed).drop("__open", "__agreed")
    first = F.coalesce(*[F.when(F.col("fits").bitwiseAND(F.lit(1 << i)) != 0, i) for i in range(len(forms(formats)))])
    return files.withColumn("form", first if in_order else F.when(_undecided(formats), -1).otherwise(first))


def read_time(text: Column, formats: Sequence[str], form: Column | int | None) -> Column:
    """The time in its file's form, or, without one, in whichever reads it. Other text fails the job."""
    listed = forms(formats)
    if form is None:
        found = F.coalesce(*[parsed(text, f) for f in listed])
    elif isinstance(form, int):
        found = parsed(text, listed[form])
    else:
        found = F.coalesce(*[F.when(form == i, parsed(text, f)) for i, f in enumerate(listed)])
    return F.when(text.isNotNull() & found.isNull(), F.raise_error(F.concat(F.lit("not a time: "), text)).cast("timestamp_ntz")).otherwise(found)
