"""Session defaults and lineage cutting."""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, types as T


def local_session(cores: str = "*", app: str = "stationweave", shared: str | None = None) -> SparkSession:
    """Session for tests and the benchmark; a cluster brings its own settings."""
    n = "8" if cores == "*" else cores
    builder = SparkSession.builder
    if shared:
        builder = builder.config("spark.checkpoint.dir", shared)
    return (
        builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", n)
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str | None:
    """Folder every executor can reach, as the cluster names it. Only a local session may go without."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not re.match(r"local($|\[)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return root


def materialise(df: DataFrame) -> DataFrame:
    """Compute a frame once, now, for the several jobs that will read it.

    With a shared checkpoint folder the rows are written there and survive lost executors.
    A local session without one persists the frame. Either way Spark then knows the true size,
    which decides later joins. `release` gives the space back.
    """
    root = shared_dir(df.sparkSession)
    if not root:
        stored = df.persist(StorageLevel.MEMORY_AND_DISK)
        stored.count()
        return stored
    path = f"{root.rstrip('/')}/stationweave-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Give back what `materialise` stored for a frame that no later plan reads."""
    spark = df.sparkSession
    df.unpersist()
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        if folder.rsplit("/", 1)[-1].startswith("stationweave-"):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_ARROW = {
    "string": pa.string(),
    "integer": pa.int32(),
    "long": pa.int64(),
    "double": pa.float64(),
    "boolean": pa.bool_(),
    "timestamp_ntz": pa.timestamp("us"),
}


def _arrow_type(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow_type(kind.elementType))
    if isinstance(kind, T.MapType):
        return pa.map_(_arrow_type(kind.keyType), _arrow_type(kind.valueType))
    return _ARROW[kind.typeName()]


def config_table(spark: SparkSession, rows: Sequence[tuple], schema: str | T.StructType) -> DataFrame:
    """Small driver-side configuration as a local relation.

    Spark knows the exact size of a local relation, so its own broadcast threshold decides
    how the table is joined.
    """
    kinds = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    columns = [pa.array([r[i] for r in rows], _arrow_type(f.dataType)) for i, f in enumerate(kinds)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, names=kinds.names))
