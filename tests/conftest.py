import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.local.dir", folder)
        .config("spark.checkpoint.dir", f"file://{folder}/shared")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_frames(spark):
    """Packed frames from [[(element, x, y, z), ...], ...]."""

    def build(frames, run="r"):
        rows = [
            (run, n, [a[0] for a in atoms], [dict(x=float(a[1]), y=float(a[2]), z=float(a[3])) for a in atoms])
            for n, atoms in enumerate(frames)
        ]
        return spark.createDataFrame(
            rows, "run_id string, frame_id bigint, elements array<string>, pos array<struct<x:double,y:double,z:double>>"
        )

    return build
