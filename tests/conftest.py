from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from stationweave.session import local_session  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", "tests")
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session


@pytest.fixture
def readings(spark):
    """Literal readings: rows of (ts text, station, value…) under the given column names."""

    def make(rows, columns=("PM2.5",)):
        fields = ", ".join(f"`{c}` double" for c in columns)
        df = spark.createDataFrame(rows, f"ts string, station_id string, {fields}")
        return df.withColumn("ts", df.ts.cast("timestamp_ntz"))

    return make
