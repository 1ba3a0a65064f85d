from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from stationweave import session
from stationweave.functions.names import q
from stationweave.sources import files, materialize
from stationweave.specs import StationSpec


def write(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_messy_header(spark, tmp_path):
    path = write(tmp_path, "sample.csv", " DateTime , station_id , PM2.5 \n2023-01-02,a,2\n2023-01-01,a,1\n")
    df = files.read_station_csv(spark, path, "datetime").drop("__path")
    assert df.columns == ["datetime", "station_id", "PM2.5"]
    assert dict(df.dtypes) == {"datetime": "timestamp_ntz", "station_id": "string", "PM2.5": "double"}
    assert [r["PM2.5"] for r in df.orderBy("datetime").collect()] == [1.0, 2.0]


def test_missing_tokens_numeric_ids_and_text_columns(spark, tmp_path):
    path = write(tmp_path, "x.csv", "ts,station_id,a,b\n2023-01-01,0124,NA,red\n2023-01-02,0124,nan,\n2023-01-03,0124,3.5,blue\n")
    df = files.read_station_csv(spark, path)
    assert dict(df.dtypes)["b"] == "string" and dict(df.dtypes)["a"] == "double"
    rows = df.orderBy("ts").collect()
    assert [r.a for r in rows] == [None, None, 3.5] and rows[0].station_id == "0124" and rows[1].b is None


def test_bad_time_fails(spark, tmp_path):
    path = write(tmp_path, "x.csv", "ts,station_id,a\nnot a time,s,1\n")
    with pytest.raises(Exception, match="not a time: not a time"):
        files.read_station_csv(spark, path).collect()


@pytest.mark.parametrize(
    "text, other, found",
    [
        ("2024-01-02 10:00:00", "2024-02-13", "2024-01-02 10:00:00"), ("2024-01-02T10:00", "2024-02-13T00:00", "2024-01-02 10:00:00"),
        ("2/1/2024 10:00", "13/2/2024", "2024-01-02 10:00:00"), ("01/02/2024 10:00", "02/13/2024", "2024-01-02 10:00:00"),
        ("02-01-2024 10:00", "13-02-2024", "2024-01-02 10:00:00"), ("2024/01/02 10:00:00", "2024/2/13", "2024-01-02 10:00:00"), ("2.1.2024 10:00", "13.2.2024 0:00", "2024-01-02 10:00:00"),
    ],
)
def test_one_form_of_time_for_a_file(spark, tmp_path, text, other, found):
    path = write(tmp_path, "x.csv", f"ts,station_id,a\n{text},s,1\n,s,2\n{other},s,3\nNA,s,4\n")
    rows = files.read_station_csv(spark, path).orderBy("a").collect()
    assert [str(r.ts) for r in rows] == [found, "None", "2024-02-13 00:00:00", "None"]


def test_times_that_contradict_each_other(spark, tmp_path):
    for i, pair in enumerate([("13/02/2024", "02/13/2024"), ("2024-01-02", "13-02-2024"), ("1/2/2024", "1-2-2024"), ("13/13/2024", "1/1/2024")]):
        path = write(tmp_path, f"x{i}.csv", "ts,a\n" + "".join(f"{t},1\n" for t in pair))
        with pytest.raises(ValueError, match="contradict" if i < 3 else "not a time: 13/13/2024"):
            files.read_station_csv(spark, path)


def test_times_that_nothing_decides(spark, tmp_path):
    """Told by the other files of the layout, else by the caller, else an error; one reading in two forms is none."""
    open_file = write(tmp_path, "open.csv", "ts,a\n02/03/2024,1\n04/04/2024,2\n")
    with pytest.raises(ValueError, match="day first"):
        files.read_station_csv(spark, open_file)
    read = lambda paths, **kw: sorted(str(r.ts)[:10] for r in files.read_station_csv(spark, paths, **kw).collect())
    assert read(open_file, formats=("d/M/yyyy",)) == read(open_file, formats=("d/M/yyyy", "M/d/yyyy")) == ["2024-03-02", "2024-04-04"]
    assert read(open_file, formats=("M/d/yyyy", "d/M/yyyy")) == ["2024-02-03", "2024-04-04"]
    late = write(tmp_path, "late.csv", "ts,a\n25/12/2023,1\n")
    assert read([open_file, late]) == ["2023-12-25", "2024-03-02", "2024-04-04"]
    other_layout = write(tmp_path, "other.csv", "a,ts\n1,12/25/2023\n")
    assert read([open_file, late, other_layout]) == ["2023-12-25", "2023-12-25", "2024-03-02", "2024-04-04"]
    with pytest.raises(ValueError, match="day first"):
        read([open_file, late, write(tmp_path, "early.csv", "ts,a\n12/25/2023,1\n")])
    same = write(tmp_path, "same.csv", "ts,a\n05/05/2024,1\n")
    assert read(same) == ["2024-05-05"]
    with pytest.raises(Exception, match="not a time: 13/25/2024"):
        read(write(tmp_path, "bad.csv", "ts,a\n13/25/2024,1\n"), formats=("d/M/yyyy",), columns=["a"])


def test_many_files_in_one_scan(spark, tmp_path):
    """Three layouts and three forms, big and empty files: one scan of data, every header read without reading on."""
    for i in range(12):
        day = f"{i + 13}"
        text = [f"ts,v\n2024-01-{day},{i}\n", f"v,TS ,w\n{i},{day}/01/2024,{-i}\n", f"w,v,ts\n{-i},{i},01/{day}/2024\n"][i % 3]
        write(tmp_path, f"d{i % 4}/station_{i + 100}.csv", text + ("\n" * (i % 2)))
    write(tmp_path, "d0/empty.csv", "")
    write(tmp_path, "d0/station_999.csv", "ts,v\n" + "2024-03-01 00:00:00,7\n" * 60_000)
    df = files.read_station_folder(spark, str(tmp_path), pattern="**/*.csv", station_from="filename")
    assert df.columns == ["ts", "v", "w", "station_id"]
    assert str(df._jdf.queryExecution().optimizedPlan()).count(" csv") == 1
    small = {r.station_id: (str(r.ts)[:10], r.v, r.w) for r in df.where("station_id <> '999'").collect()}
    assert small == {str(i + 100): (f"2024-01-{i + 13}", float(i), None if i % 3 == 0 else float(-i)) for i in range(12)}
    assert df.where("station_id = '999'").count() == 60_000


@pytest.mark.parametrize(
    "pattern, names",
    [
        ("*.csv", ["top.csv"]), ("x/*.csv", ["x/raw_2024.csv"]), ("*/*.csv", ["x/raw_2024.csv", "y/raw_2024.csv"]), ("**/*.csv", ["top.csv", "x/deep/z.csv", "x/raw_2024.csv", "y/raw_2024.csv"]),
        ("x/**/*.csv", ["x/deep/z.csv", "x/raw_2024.csv"]), ("**/deep/*.csv", ["x/deep/z.csv"]), ("?/raw_*.csv", ["x/raw_2024.csv", "y/raw_2024.csv"]), ("none/*.csv", []),
    ],
)
def test_patterns_with_folders(spark, tmp_path, pattern, names):
    for name in ("x/raw_2024.csv", "y/raw_2024.csv", "top.csv", "x/deep/z.csv", "x/other.txt"):
        write(tmp_path, name, "ts,a\n2024-01-01,1\n")
    found = files.list_files(spark, str(tmp_path), pattern, recursive="**" in pattern)
    assert sorted(r.path.split(tmp_path.name + "/")[1] for r in found.collect()) == names


def test_no_time_column(spark, tmp_path):
    path = write(tmp_path, "x.csv", "when,a\n2023-01-01,1\n")
    with pytest.raises(KeyError):
        files.read_station_csv(spark, path)


def test_folder_with_different_column_orders(spark, tmp_path):
    write(tmp_path, "a.csv", "datetime,PM2.5,NO2\n2023-01-01,1,10\n")
    write(tmp_path, "b.csv", "NO2,datetime,PM2.5\n20,2023-01-02,2\n")
    write(tmp_path, "c.csv", "datetime,RH\n2023-01-03,30\n")
    df = files.read_station_folder(spark, str(tmp_path), "datetime", station_from="filename")
    rows = df.orderBy("datetime").collect()
    assert [(r.station_id, r["PM2.5"], r.NO2, r.RH) for r in rows] == [("a", 1, 10, None), ("b", 2, 20, None), ("c", None, None, 30)]
    with pytest.raises(KeyError):
        files.read_station_folder(spark, str(tmp_path), "datetime", sort_col="absent")


def test_hidden_folders_and_empty_matches(spark, tmp_path):
    write(tmp_path, "station_a.csv", "datetime,PM2.5\n2023-01-01,1\n")
    write(tmp_path, ".hidden/x.csv", "stage,column\nafter,PM2.5\n")
    write(tmp_path, "__pycache__/x.csv", "stage,column\nafter,PM2.5\n")
    df = files.read_station_folder(spark, str(tmp_path), "datetime", pattern="**/*.csv", station_from="filename")
    assert [r.station_id for r in df.collect()] == ["station_a"]
    with pytest.raises(FileNotFoundError):
        files.read_station_folder(spark, str(tmp_path), "datetime", pattern="*.txt")


def test_folder_ids_station_column_wins_and_year_pruning(spark, tmp_path):
    write(tmp_path, "s1/raw_2023.csv", "ts,v\n2023-05-01,1\n")
    write(tmp_path, "s2/raw_2024.csv", "ts,v,station_id\n2024-05-01,2,own\n")
    read = lambda **kw: files.read_station_folder(spark, str(tmp_path), pattern="**/*.csv", **kw)
    assert sorted(r.station_id for r in read().collect()) == ["own", "s1"]
    assert [r.station_id for r in read(years=[2024]).collect()] == ["own"]
    with pytest.raises(FileNotFoundError):
        read(years=[1999])


def test_mapping_overwrites_station(spark, tmp_path):
    write(tmp_path, "x.csv", "ts,station_id,v\n2023-01-01,wrong,1\n")
    write(tmp_path, "y y.csv", "ts,v\n2023-01-02,2\n")
    df = files.read_station_mapping(spark, {"one": ["x.csv"], "two": ["y y.csv"]}, root=str(tmp_path))
    assert sorted((r.station_id, r.v) for r in df.collect()) == [("one", 1.0), ("two", 2.0)]


@pytest.mark.parametrize(
    "path, mode, root, expected",
    [
        ("Raw_data_1Hr_2025_site_1426_Narela.csv", "filename", None, "1426"),
        ("data\\1426\\sample.csv", "folder", "data", "1426"),
        ("x/target_station_2024.csv", "filename", None, "2024"),
        ("x/station_a.csv", "filename", None, "station_a"),
        ("data/s7/deep/f.csv", "auto", "data", "s7"),
        ("data/f_12.csv", "auto", "data", "f_12"),
    ],
)
def test_station_ids(spark, path, mode, root, expected):
    got = spark.range(1).select(files.station_from_path(F.lit(path), mode, root=root).alias("s")).first().s
    assert got == expected


def test_station_mode_error():
    with pytest.raises(ValueError):
        files.station_from_path(F.lit("x"), "other")


@pytest.mark.parametrize("path, year", [("d/1999/x_2024.csv", 2024), ("d/2023/x.csv", 2023), ("d/12023/x.csv", None)])
def test_years(spark, path, year):
    assert spark.range(1).select(files.year_from_path(F.lit(path)).alias("y")).first().y == year


def test_cleaned_dataset_is_reused_until_something_changes(spark, tmp_path):
    write(tmp_path, "in/a.csv", "ts,station_id,x,y\n2023-01-01,s,1,5\n2023-01-02,s,,6\n2023-01-03,s,3,8\n")
    spec = StationSpec("s", ("s",), ("x",), columns=("y",), impute_columns=("x",))
    source = str(tmp_path / "in")

    def build(spec=spec, **kw):
        df = files.read_station_csv(spark, source + "/*.csv").drop("__path")
        listed = files.list_files(spark, source)
        return materialize.cleaned_dataset(spark, df, listed, spec, str(tmp_path / "out"), **kw)

    first, second = build(), build()
    assert (first.reused, second.reused) == (False, True) and first.path == second.path
    assert second.dataset.columns == ["y", "ts", "station_id", "x"] and second.dataset.count() == 2
    counts = {(r.station_id, r["column"]): (r.missing_before, r.missing_after) for r in second.stats.collect()}
    assert counts[("s", "x")] == (1, 0) and counts[("__all__", "y")] == (0, 0)
    assert {r.stage for r in second.profile.collect()} == {"before", "after"}
    assert not build(rebuild=True).reused
    assert build(spec.with_(impute_columns=())).path != first.path
    write(tmp_path, "in/b.csv", "ts,station_id,x,y\n2023-01-04,s,9,9\n")
    changed = build()
    assert not changed.reused and changed.dataset.count() == 3


def test_landed_parquet_prunes_by_year_and_station(spark, tmp_path):
    df = spark.sql("SELECT CAST(concat(y, '-02-03') AS TIMESTAMP_NTZ) AS ts, s AS station_id, 1.0D AS v FROM VALUES (2023, 'a'), (2024, 'a'), (2024, 'b') AS t(y, s)")
    files.land_parquet(df, str(tmp_path / "p"))
    back = spark.read.parquet(str(tmp_path / "p")).where("year = 2024 AND station_id = 'b'")
    assert back.count() == 1 and "PartitionFilters: [isnotnull(year" in back._jdf.queryExecution().executedPlan().toString()


def test_signature_columns(spark, tmp_path):
    write(tmp_path, "a.csv", "x\n1\n")
    row = files.file_signature(spark, str(tmp_path)).first()
    assert row["size"] == 4 and row.path.endswith("a.csv")


def test_declared_columns_skip_the_type_pass(spark, tmp_path):
    path = write(tmp_path, "x.csv", "ts,station_id,a,b\n2023-01-01,s,1,oops\n")
    row = files.read_station_csv(spark, path, columns=["b"]).select("ts", "station_id", q("b")).first()
    assert row.b is None


@pytest.mark.parametrize("strategy, rows, method", [("drop", 2, "drop_rows"), ("median", 3, "median"), ("random_forest", 3, "median_fallback")])
def test_stored_dataset_follows_the_strategy(spark, tmp_path, strategy, rows, method):
    write(tmp_path, "raw/s.csv", "ts,station_id,a\n2024-01-01,s,1\n2024-01-02,s,\n2024-01-03,s,3\n")
    df = files.read_station_folder(spark, str(tmp_path / "raw"))
    spec = StationSpec("s", ("s",), ("a",), impute_columns=("a",), missing_values=strategy)
    listed = files.file_signature(spark, str(tmp_path / "raw"))
    made = materialize.cleaned_dataset(spark, df, listed, spec, str(tmp_path / "out"))
    assert made.dataset.count() == rows and made.dataset.where("a is null").isEmpty()
    assert {r.method for r in made.details.collect()} == {method}
    total = made.stats.where("station_id = '__all__'").first()
    assert (total.missing_before, total.missing_after) == (1, 0)
    assert materialize.cleaned_dataset(spark, df, listed, spec, str(tmp_path / "out")).reused


def test_shared_folder_is_needed_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()
        conf = spark.conf

    if not spark.conf.get("spark.checkpoint.dir", None):
        with pytest.raises(ValueError, match="all executors share"):
            session.shared_dir(Session())


def test_release(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_dir", lambda spark: str(tmp_path))
    stored = session.materialise(spark.range(5))
    assert stored.count() == 5 and len(list(tmp_path.iterdir())) == 1
    session.release(stored)
    assert list(tmp_path.iterdir()) == []


def test_evidence_of_files_is_gathered_without_sorting(spark, tmp_path):
    """A task must not hold and sort its rows to find out a file's form; the text that no form fits is looked up for the error."""
    for name, ending in (("a", "2020-01-02"), ("b", "nope")):
        (tmp_path / f"{name}.csv").write_text(f"ts,station_id,v\n2020-01-01,{name},1\n{ending},{name},x\n")
    scan = files._Scan(spark, files.file_set(str(tmp_path)), [["ts", "station_id", "v"]], None)
    told = files._evidence(scan.cells(None), "ts", ["v"], files.TIME_FORMATS)
    assert sorted((r["__path"][-5:], r.strangers, r.bad0) for r in told.collect()) == [("a.csv", 0, 1), ("b.csv", 1, 1)]
    plan = told._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "Sort" not in plan
    with pytest.raises(ValueError, match="not a time: nope in .*b.csv"):
        files.read_station_csv(spark, str(tmp_path))


def test_folders_of_sites_are_written_side_by_side(spark, tmp_path):
    """The session's own setting comes back, and unsorted sites land in one file each."""
    from catalog.sources import _write_by_site

    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key)
    df = spark.range(300).coalesce(1).select("id", F.element_at(F.array(*map(F.lit, "ANR")), (F.col("id") % 3 + 1).cast("int")).alias("site"))
    _write_by_site(df, str(tmp_path / "out"))
    assert spark.conf.get(key) == before
    assert sorted(f.parent.name for f in (tmp_path / "out").glob("site=*/*.csv")) == ["site=A", "site=N", "site=R"]
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).groupBy("site").count().where("count = 100").count() == 3
