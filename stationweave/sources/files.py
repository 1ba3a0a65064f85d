"""Station CSV files as one readings frame.

Headers differ between files in order, case and padding, and times in form. Tasks first open every file
for its header line only; the different headers, not the files, come to the driver. One scan then
reads all files by position, and a table of the files says which position and which form of time holds
for a row's file. Where all files are alike, nothing is joined.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, replace
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession, functions as F, types as T

from stationweave.functions import time_forms
from stationweave.functions.names import q
from stationweave.functions.time_forms import TIME_FORMATS
from stationweave.session import config_table, materialise, release

# Texts read as missing, in any column.
MISSING_TOKENS = (
    "", "NA", "N/A", "n/a", "#N/A", "#N/A N/A", "#NA", "<NA>", "NaN", "nan", "-NaN", "-nan",
    "NULL", "null", "None", "1.#IND", "-1.#IND", "1.#QNAN", "-1.#QNAN",
)

# Ids and years in paths, as published archives name them.
_SITE = r"(?i)(?:^|[_-])site[_-]?([A-Za-z0-9]+)(?:[_-]|$)"
_DIGITS = r"(?<!\d)(\d{3,})(?!\d)"
_YEAR = r"(?<!\d)(?:19|20)\d{2}(?!\d)"

_HEAD = 1 << 16  # bytes read at a time in search of a header


def file_name(path: Column) -> Column:
    return F.substring_index(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1)


def file_stem(path: Column) -> Column:
    name = file_name(path)
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def station_from_name(path: Column) -> Column:
    """`site_<id>` first, then the first run of three or more digits, then the whole stem."""
    stem = file_stem(path)
    return F.coalesce(_found(stem, _SITE), _found(stem, _DIGITS), stem)


def station_from_folder(path: Column, root: str | None = None) -> Column:
    """First folder below the root; without a root the file's own folder; else the stem."""
    slashed = F.regexp_replace(path, r"\\", "/")
    parent = F.regexp_extract(slashed, r"([^/]+)/[^/]*$", 1)
    folder = F.nullif(parent, F.lit(""))
    if root is not None:
        head = root.replace("\\", "/").rstrip("/") + "/"
        inside = F.when(F.contains(slashed, F.lit(head)), F.substring_index(slashed, head, -1))
        folder = F.coalesce(_found(inside, r"^([^/]+)/", 1), folder)
    return F.coalesce(folder, file_stem(path))


def station_from_path(path: Column, mode: str = "auto", regex: str | None = None, root: str | None = None) -> Column:
    """Station id of a file: a user pattern first, then by mode `auto`, `filename` or `folder`."""
    mode = (mode or "auto").lower()
    if mode == "filename":
        found = station_from_name(path)
    elif mode == "folder":
        found = station_from_folder(path, root)
    elif mode == "auto":
        found = station_from_name(path)
        if root is not None:
            head = root.replace("\\", "/").rstrip("/") + "/"
            tail = F.substring_index(F.regexp_replace(path, r"\\", "/"), head, -1)
            found = F.when(F.contains(tail, F.lit("/")), station_from_folder(path, root)).otherwise(found)
    else:
        raise ValueError("station id mode must be auto, filename or folder")
    if regex:
        group = 1 if re.compile(regex).groups else 0
        found = F.coalesce(_found(path, regex, group), found)
    return found


def year_from_path(path: Column) -> Column:
    """First 19xx/20xx run of the file name, else of the whole path."""
    year = F.lit(_YEAR)
    return F.coalesce(F.regexp_substr(file_name(path), year), F.regexp_substr(path, year)).cast("int")


def decoded(path: Column) -> Column:
    """Path as it was written; the file metadata column percent-encodes it."""
    return F.when(path.contains("%"), F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))).otherwise(path)


@dataclass(frozen=True)
class FileSet:
    """Files named by roots and patterns; Spark lists them where it reads them, so no list of them exists."""

    roots: tuple[str, ...]
    recursive: bool = True
    name: str | None = None
    below: str | None = None  # a regular expression of whole paths
    years: tuple[int, ...] = ()
    exact: bool = True  # the roots exist as they are, not as patterns that may match nothing

    def scan(self, reader: DataFrameReader, form: str) -> DataFrame:
        """Rows of the files and the metadata column, narrowed by paths, which prunes files before they are opened."""
        reader = reader.format(form).option("recursiveFileLookup", str(self.recursive).lower())
        if self.name:
            reader = reader.option("pathGlobFilter", self.name)
        df = reader.load(list(self.roots))
        path = decoded(F.col("_metadata.file_path"))
        if self.below:
            df = df.where(path.rlike(self.below))
        return df.where(year_from_path(path).isin(*self.years)) if self.years else df


def file_set(paths: str | Sequence[str], pattern: str = "*.csv", recursive: bool = True, years: Iterable[int] | None = None) -> FileSet:
    """Files below the paths. A pattern without folders matches file names, below all folders if recursive.

    A pattern with folders is taken from each path on; `**` stands for any number of folders.
    """
    roots = [paths] if isinstance(paths, str) else list(paths)
    wanted = tuple(int(y) for y in years or [])
    folders, _, name = pattern.rpartition("/")
    if folders and "**" not in folders:
        return FileSet(tuple(f"{root.rstrip('/')}/{pattern}" for root in roots), False, None, None, wanted, False)
    below = None
    if folders.strip("/*"):
        # Folders between, before or after the stars are matched on the path below the roots.
        parts = [r"(?:[^/]+/)*" if part == "**" else _glob(part) + "/" for part in folders.split("/")]
        starts = "|".join(re.escape(_plain(root).rstrip("/")) for root in roots)
        below = f"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:/{{0,2}}[^/]*)?(?:{starts})/{''.join(parts)}[^/]*$"
    return FileSet(tuple(roots), recursive or bool(folders), name or "*", below, wanted)


def list_files(spark: SparkSession, paths: str | Sequence[str], pattern: str = "*.csv", recursive: bool = True) -> DataFrame:
    """(path, size, modified): a distributed listing that opens no file. Hidden folders are skipped."""
    try:
        listing = file_set(paths, pattern, recursive).scan(spark.read, "binaryFile")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND" or file_set(paths, pattern, recursive).exact:
            raise
        nothing = F.lit(None)
        listing = spark.range(0).select(nothing.cast("string").alias("path"), nothing.cast("long").alias("length"), nothing.cast("timestamp").alias("modificationTime"))
    return listing.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def _plain(path: str) -> str:
    """The path without scheme and host."""
    return re.sub(r"^[a-zA-Z][a-zA-Z0-9+.-]*:(?://[^/]*)?(?=/)", "", path)


def _glob(part: str) -> str:
    """A pattern of one folder name as a regular expression."""
    return "".join({"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)) for c in part)


def prune_years(files: DataFrame, years: Iterable[int] | None) -> DataFrame:
    """Files whose path names one of the years; no years keeps all."""
    wanted = [int(y) for y in years or []]
    if not wanted:
        return files
    kept = files.where(year_from_path(F.col("path")).isin(*wanted))
    if kept.isEmpty():
        raise FileNotFoundError(f"no input file matches the years {sorted(wanted)}")
    return kept


def _first_line(path: str) -> str | None:
    """First line of a file that isn't blank, compressed or not; empty without one, None if Python can't open the path."""
    scheme, _, rest = path.partition(":")
    try:
        if not rest or not scheme.isalnum() or scheme == "file":
            system, place = fs.LocalFileSystem(), unquote(urlsplit(path).path if rest else path)
        else:
            system, place = fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", path))
        with system.open_input_stream(place, compression="detect", buffer_size=_HEAD) as source:
            text = b""
            while piece := source.read(_HEAD):
                text += piece
                lines = text.lstrip(b"\r\n \t").splitlines(True)
                if lines and lines[0].endswith((b"\r", b"\n")):
                    break
            lines = text.lstrip(b"\r\n \t").splitlines()
            return lines[0].decode("utf-8", "replace") if lines else ""
    except (pa.ArrowException, OSError, ValueError):
        return None


def first_lines(spark: SparkSession, files: FileSet) -> DataFrame:
    """(path, header) of every file that has a line, stored. Tasks open the listed files and read their first block.

    Where Python has no access to a file system that Spark reads, the lines come from a scan instead.
    """
    listing = files.scan(spark.read, "binaryFile").select("path")

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = [_first_line(path) for path in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lines, pa.string())], names=["path", "header"])

    found = materialise(listing.mapInArrow(opened, "path string, header string").select(decoded(F.col("path")).alias("path"), "header"))
    if found.where("header IS NULL").isEmpty():
        return found.where("header <> ''")
    release(found)
    place = F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    lines = files.scan(spark.read, "text").select("value", decoded(F.col("_metadata.file_path")).alias("path"), place.alias("place"))
    return materialise(lines.where(F.trim("value") != "").groupBy("path").agg(F.min_by("value", "place").alias("header")))


def _columns_of(header: str) -> list[str]:
    """Trimmed names; a name that comes again gets a number."""
    names: list[str] = []
    for name in next(csv.reader([header.lstrip("\ufeff")])):
        name, again = name.strip(), 0
        while (numbered := f"{name}.{again}" if again else name) in names:
            again += 1
        names.append(numbered)
    return names


def _token(cell: Column) -> Column:
    return F.when(~F.trim(cell).isin(*MISSING_TOKENS), F.trim(cell))


class _Scan:
    """One scan of all files by position, with the names that each layout gives to the positions."""

    def __init__(self, spark: SparkSession, files: FileSet, layouts: list[list[str]], wanted: list[str] | None):
        self.layouts = layouts
        self.names = [c for c in dict.fromkeys(n for names in layouts for n in names) if wanted is None or c in wanted]
        width = max(map(len, layouts))
        schema = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(width)])
        reader = spark.read.schema(schema).option("header", True).option("enforceSchema", True)
        self.rows = files.scan(reader, "csv").select(*[f"_c{i}" for i in range(width)], decoded(F.col("_metadata.file_path")).alias("__path"))

    def cell(self, name: str) -> Column:
        """The column by name: its position in the row's layout, null where that has none."""
        at = [names.index(name) if name in names else None for names in self.layouts]
        if len(set(at)) == 1:
            return F.col(f"_c{at[0]}")
        return F.coalesce(*[F.when(F.col("__layout") == i, F.col(f"_c{k}")) for i, k in enumerate(at) if k is not None])

    def cells(self, files: DataFrame | None) -> DataFrame:
        """Cleaned cells with `__path`, and what the table of files says about it."""
        rows = self.rows if files is None else self.rows.join(files, "__path")
        more = [c for c in rows.columns if c.startswith("__")]
        return rows.select(*[_token(self.cell(c)).alias(c) for c in self.names], *more)


def _readings(spark: SparkSession, files: FileSet, ts: str, station: str | None, columns: Sequence[str] | None, formats: Sequence[str] | None) -> DataFrame:
    try:
        heads = first_lines(spark, files)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND" or files.exact:
            raise
        raise FileNotFoundError(f"no file matches {files.roots}") from None
    # As many rows as there are different headers.
    headers = sorted(r.header for r in heads.select("header").distinct().collect())
    if not headers:
        years = f" of the years {sorted(files.years)}" if files.years else ""
        raise FileNotFoundError(f"no file{years} matches {files.name or '*'!r} in {', '.join(files.roots)}")
    layouts = []
    for header in headers:
        names = _columns_of(header)
        lowered = {n.lower(): n for n in names}
        if ts.strip().lower() not in lowered:
            raise KeyError(f"no column {ts!r} among {names}")
        layouts.append([ts if n == lowered[ts.strip().lower()] else n for n in names])
    scan = _Scan(spark, files, layouts, None if columns is None else [ts, *([station] if station else []), *columns])

    table, form, numeric = None, None, {c for c in scan.names if c not in (ts, station)}
    if len(layouts) > 1:
        numbers = config_table(spark, [(h, i) for i, h in enumerate(headers)], "header string, __layout int")
        table = heads.join(numbers, "header").select(F.col("path").alias("__path"), "__layout")
    given = TIME_FORMATS if formats is None else formats
    rivals = bool(time_forms.rivals(given))
    if rivals or columns is None:
        by_file = materialise(_evidence(scan.cells(table), ts, sorted(numeric) if columns is None else [], given))
        if columns is None:
            counts = [F.sum(f"bad{i}") for i in range(len(numeric))]
            unparsed = by_file.agg(F.lit(0), *counts).first()[1:]
            numeric = {c for c, n in zip(sorted(numeric), unparsed) if not n}
        if rivals:
            chosen = materialise(time_forms.decided(by_file, given, "__layout", formats is not None).select("__path", "__layout", "form", "strangers"))
            _check_forms(chosen, scan.cells(table), ts, given)
            found = [r.form for r in chosen.select("form").distinct().collect()]
            if len(found) == 1:
                form = found[0]
            else:
                table, form = chosen.select("__path", "__layout", "form").withColumnRenamed("form", "__form"), F.col("__form")
            if form is found[0]:
                release(chosen)
        release(by_file)
    cells = scan.cells(table)
    kinds = {c: q(c).try_cast("double") if c in numeric else q(c) for c in scan.names if c != ts}
    kinds[ts] = time_forms.read_time(q(ts), given, form)
    return cells.select(*[kinds[c].alias(c) for c in scan.names], "__path")


def _evidence(cells: DataFrame, ts: str, numbers: Sequence[str], formats: Sequence[str]) -> DataFrame:
    """Per file: the forms its times fit, and how many cells of each column are no numbers."""
    layout = F.col("__layout") if "__layout" in cells.columns else F.lit(0)
    told = time_forms.evidence(cells.withColumn("__layout", layout), q(ts), formats)
    bad = [F.count_if(q(c).isNotNull() & q(c).try_cast("double").isNull()).alias(f"bad{i}") for i, c in enumerate(numbers)]
    return told.groupBy("__path", "__layout").agg(*time_forms.gathered(), *bad)


def _check_forms(files: DataFrame, cells: DataFrame, ts: str, formats: Sequence[str]) -> None:
    """Every file has one form of time that all its rows fit. The text that none fits is looked up only for the error."""
    wrong = files.where("form IS NULL OR form < 0").orderBy("__path").first()
    if wrong is None:
        return
    if wrong.strangers:
        read = time_forms.evidence(cells.where(F.col("__path") == wrong["__path"]), q(ts), formats)
        stranger = read.where("fits = 0").agg(F.min(q(ts))).first()[0]
        raise ValueError(f"not a time: {stranger} in {wrong['__path']}")
    if wrong.form is None:
        raise ValueError(f"the times of {wrong['__path']} contradict each other: no form fits all of them")
    raise ValueError(f"the times of {wrong['__path']} can be read month first or day first; name the form in `formats`")


def read_station_csv(
    spark: SparkSession,
    paths: str | Sequence[str],
    ts: str = "ts",
    station: str | None = "station_id",
    columns: Sequence[str] | None = None,
    formats: Sequence[str] | None = None,
) -> DataFrame:
    """Readings of the files with trimmed headers, the time column found in any case, and `__path`.

    `columns`, where given, are the numeric columns to read; this avoids the pass that finds out which
    columns are numeric. All times of a file are read in one form: ISO 8601 or one of `formats`. Without
    `formats` a file that is both month first and day first to read takes the form that all other files of
    its layout allow, and is an error if that doesn't decide; with `formats` the first that fits counts.
    """
    files = FileSet(tuple([paths] if isinstance(paths, str) else paths), False)
    return _readings(spark, files, ts, station, columns, formats)


def read_station_folder(
    spark: SparkSession,
    folder: str,
    ts: str = "ts",
    sort_col: str | None = None,
    pattern: str = "*.csv",
    station: str = "station_id",
    station_from: str = "auto",
    station_regex: str | None = None,
    years: Iterable[int] | None = None,
    columns: Sequence[str] | None = None,
    formats: Sequence[str] | None = None,
) -> DataFrame:
    """All matching files below a folder; a station column in a file wins over its path."""
    df = _readings(spark, file_set(folder, pattern, "**" in pattern, years), ts, station, columns, formats)
    if (sort_col or ts) not in df.columns:
        raise KeyError(f"sort column {sort_col!r} is not in the files")
    inferred = station_from_path(F.col("__path"), station_from, station_regex, folder)
    given = q(station).cast("string") if station in df.columns else F.lit(None).cast("string")
    return df.withColumn(station, F.coalesce(given, inferred)).drop("__path")


def read_station_file(
    spark: SparkSession,
    path: str,
    ts: str = "ts",
    station: str = "station_id",
    station_from: str = "auto",
    station_regex: str | None = None,
    years: Iterable[int] | None = None,
    formats: Sequence[str] | None = None,
) -> DataFrame:
    """One file with a station column, or with its id taken from the path; years filter the rows."""
    df = read_station_csv(spark, path, ts, station, formats=formats)
    root = path.replace("\\", "/").rpartition("/")[0] or None
    given = q(station).cast("string") if station in df.columns else F.lit(None).cast("string")
    out = df.withColumn(station, F.coalesce(given, station_from_path(F.col("__path"), station_from, station_regex, root)))
    wanted = [int(y) for y in years or []]
    return (out.where(F.year(q(ts)).isin(*wanted)) if wanted else out).drop("__path")


def read_station_mapping(
    spark: SparkSession,
    station_files: Mapping[str, Sequence[str]],
    ts: str = "ts",
    station: str = "station_id",
    root: str | None = None,
    years: Iterable[int] | None = None,
    formats: Sequence[str] | None = None,
) -> DataFrame:
    """Explicit file lists per station, as the caller's configuration has them; the mapping's id replaces any station column."""
    full = lambda p: p if root is None or p.startswith("/") or "://" in p else f"{root.rstrip('/')}/{p}"
    pairs = [(full(f), str(s)) for s, files in station_files.items() for f in files]
    if not pairs:
        raise FileNotFoundError("the station mapping names no files")
    # The scan leaves out files of other years by their paths.
    named = replace(FileSet(tuple(dict.fromkeys(p for p, _ in pairs)), False), years=tuple(int(y) for y in years or []))
    df = _readings(spark, named, ts, station, None, formats)
    # Paths come back as URIs; compare the part after the scheme.
    plain = lambda c: F.regexp_replace(c, r"^[a-zA-Z][a-zA-Z0-9+.-]*:/{0,2}(?=/)", "")
    mapping = config_table(spark, pairs, "path string, mapped string").select(plain(F.col("path")).alias("__plain"), "mapped")
    joined = df.withColumn("__plain", plain(F.col("__path"))).join(mapping, "__plain")
    return joined.withColumn(station, F.col("mapped")).drop("mapped", "__plain", "__path")


def file_signature(spark: SparkSession, paths: str | Sequence[str], pattern: str = "*.csv") -> DataFrame:
    """(path, size, modified) of the source files."""
    return list_files(spark, paths, pattern)


def land_parquet(df: DataFrame, path: str, ts: str = "ts", station: str = "station_id") -> None:
    """Store readings by year and station, so later periods and stations prune their files.

    The rebalance hint groups rows by folder but lets the runtime split a station that holds
    far more rows than the others.
    """
    df.withColumn("year", F.year(q(ts))).hint("rebalance", F.col("year"), q(station)).write.mode("overwrite").partitionBy(
        "year", station
    ).parquet(path)
