"""Helpers that several operators of this folder share."""

from __future__ import annotations

import inspect
import os
import tempfile
import uuid
import zipfile
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

# White space that separates words, and A-Z with a-z.
SPACE = "\\x20\\x09-\\x0D"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

# A side of at most so many rows may be broadcast; beyond it the joins shuffle both sides.
BROADCAST_ROWS = 200_000


def any_names(operator):
    """The operator for rows that have columns of any names.

    Internal names begin with an underscore; columns of the first argument that do so too are renamed while the
    operator works, also where its parameters key, text, lang, url, html or ids name them.
    """
    kind = inspect.signature(operator)

    @wraps(operator)
    def apart(rows: DataFrame, *args, **kwargs) -> DataFrame:
        prefix = "own"
        while any(c.lower().startswith(f"{prefix}_") for c in rows.columns):
            prefix += "n"
        other = {c: prefix + c for c in rows.columns if c.startswith("_")}
        if not other:
            return operator(rows, *args, **kwargs)
        call = kind.bind(rows.withColumnsRenamed(other), *args, **kwargs)
        call.arguments.update({k: other.get(v, v) for k, v in call.arguments.items() if k in ("key", "text", "lang", "url", "html", "ids")})
        return operator(*call.args, **call.kwargs).withColumnsRenamed({new: old for old, new in other.items()})

    return apart


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers once, for clusters on which it isn't installed."""
    context = spark.sparkContext
    if any(name.startswith("stationweave-") for name in context._python_includes):
        return
    folder = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="stationweave-"), f"stationweave-{uuid.uuid4().hex}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for at, _, names in os.walk(folder):
            for name in names:
                if name.endswith(".py"):
                    whole = os.path.join(at, name)
                    out.write(whole, os.path.relpath(whole, os.path.dirname(folder)))
    context.addPyFile(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_LOCAL_ROOTS: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one in local mode only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[context.applicationId] = tempfile.mkdtemp(prefix="stationweave-")
    return _LOCAL_ROOTS[context.applicationId]


def settle(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read back: lineage ends, and the true size is known."""
    path = f"{scratch_root(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Delete what settle() wrote for a frame that no later plan reads."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/llm-" in path:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def sweep(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that are done. It does so when the driver collects garbage and finds
    the plan gone, which a driver with room to spare puts off while the files of one step after the other fill the disk."""
    spark._jvm.System.gc()


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """A settled frame, hinted for broadcast if its counted rows stay within the limit; and whether they do."""
    stored = settle(df)
    few = stored.count() <= limit
    return (F.broadcast(stored) if few else stored), few


def lookup(big: DataFrame, few: DataFrame, key: str, how: str = "left", salts: int = 32) -> DataFrame:
    """Join of `big` to `few` on a key that may hold most rows of `big`.

    `few` is broadcast if it is counted small; else its rows are repeated under every salt, so that
    the rows of a hot key are dealt over that many tasks.
    """
    side, fits = small(few)
    if fits:
        return big.join(side, key, how)
    others = [F.col(f"`{c}`") for c, kind in big.dtypes if "map<" not in kind and "variant" not in kind]
    salted = side.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return big.withColumn("_salt", F.pmod(F.xxhash64(*others), F.lit(salts)).cast("int")).join(salted, [key, "_salt"], how).drop("_salt")


HOT_ROWS = 50_000  # rows of one key that may meet in one task


def hot_join(big: DataFrame, few: DataFrame, key: str, n: str, by: str) -> DataFrame:
    """Inner join of `big` to `few`, which has a row for each key with the number `n` of its rows in `big`.

    Keys of more than HOT_ROWS rows are dealt by column `by` over as many tasks as they need. There is at
    most one such key for HOT_ROWS rows, so the table of them is small.
    """
    hot, _ = small(few.where(F.col(n) > HOT_ROWS).select(key, F.ceil(F.col(n) / HOT_ROWS).cast("int").alias("_parts")))
    part = F.coalesce(F.pmod(F.xxhash64(by), F.col("_parts")).cast("int"), F.lit(0)).alias("_part")
    dealt = big.join(hot, key, "left").select(*(f"`{c}`" for c in big.columns), part)
    copies = F.explode(F.sequence(F.lit(0), F.ceil(F.col(n) / HOT_ROWS).cast("int") - 1)).alias("_part")
    return dealt.join(few.select("*", copies).drop(n), [key, "_part"]).drop("_part")


def attach(pairs: DataFrame, texts: DataFrame, side: str, other: str, name: str, share: int, tasks: int | None = None) -> DataFrame:
    """The pairs with the text of the id in column `side` as column `name`.

    texts is (id, text), one row per id. An id with many pairs is dealt over tasks by `other`, `share`
    pairs each, and its text goes to just as many. `tasks`, where given, is how many tasks the pairs are
    dealt to, for work that their bytes don't tell.
    """
    parts = F.ceil(F.col("count") / share).cast("int").alias("_parts")
    degree = settle(pairs.groupBy(side).count().select(side, parts))
    dealt = pairs.join(degree, side).withColumn("_part", F.pmod(F.xxhash64(other), F.col("_parts")).cast("int")).drop("_parts")
    copies = texts.toDF(side, name).join(degree, side).select(side, name, F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))
    if tasks:
        dealt, copies = (rows.repartition(tasks, side, "_part") for rows in (dealt, copies))
    return dealt.join(copies, [side, "_part"]).drop("_part")


def texts_of(docs: DataFrame, text: str, wanted: DataFrame, key) -> DataFrame:
    """(id, digest, text) once for each distinct text whose key is wanted, settled; text as bytes, digest its md5 sum.

    key makes the id out of the column `text`; wanted has one column of distinct ids.
    """
    ids, _ = small(wanted.toDF("id"))
    found = docs.select(as_bytes(text).alias("text")).withColumn("id", key("text")).join(ids, "id", "left_semi")
    return settle(found.groupBy("id", F.md5("text").alias("digest")).agg(F.first("text").alias("text")))


def let(value: F.Column, body) -> F.Column:
    """body(value) with the value computed once per row, however often the body names it, also inside
    lambdas. A column of an inner select would be put back in each place by the optimizer."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def modest_batches(spark: SparkSession, size: str = "8m") -> None:
    """Arrow batches of whole texts in pieces that fit small workers, unless the session asks for a size of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in ("67108864", "67108864b", "64m", "64MB"):
        spark.conf.set(key, size)


def as_bytes(column: str) -> F.Column:
    """A text column as UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def remainder(column: str, n: int) -> F.Column:
    """crc32 of the value as text, modulo n; null for null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """An Arrow list column from the joined values and the size of each list."""
    ends = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))


def mixed(h: np.ndarray) -> np.ndarray:
    """Each 64-bit value spread over all its bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))
