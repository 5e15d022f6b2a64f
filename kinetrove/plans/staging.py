"""Ending lineage and attaching small tables without betting on their size."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: stored bytes a build side may have to be broadcast; compressed columns take several times that in memory
BROADCAST_BYTES = 8 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which the driver and all executors share.

    A session on one machine may do without: it uses a folder beside the warehouse's tables.
    """
    folder = (
        spark.conf.get("spark.checkpoint.dir", None)
        or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        or spark.sparkContext.getCheckpointDir()
    )
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = spark.conf.get("spark.sql.warehouse.dir") + "/_staged"
    return folder.rstrip("/")


def _store(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there is removed when the session ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    at, store = _store(spark, path)
    store.deleteOnExit(at)
    return path


def stage(df: DataFrame, name: str = "kinetrove") -> DataFrame:
    """Write a derived table to the shared folder and read it back.

    Lineage ends at the files, which outlive any executor, and the planner sees their real size.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_bytes(df: DataFrame) -> int:
    """Bytes of the files that a staged table is read from."""
    total, files = 0, set(df.inputFiles())
    for folder in {file.rpartition("/")[0] for file in files}:
        at, store = _store(df.sparkSession, folder)
        total += sum(status.getLen() for status in store.listStatus(at) if status.isFile())
    return total


def attach(
    big: DataFrame,
    small: DataFrame,
    on: list[str],
    how: str = "inner",
    spread: str = "frame_id",
    limit: int = BROADCAST_BYTES,
    staged: bool = False,
) -> DataFrame:
    """Join a per-run table to per-frame rows.

    The per-run table is staged. Up to ``limit`` stored bytes it is broadcast and ``big`` does not
    move. Beyond that both sides are hashed on the key plus a salt drawn from ``spread``: the small
    side is copied once per salt, so a run holding a third of all frames is split over as many tasks
    as a shuffle has. ``staged`` tells that ``small`` is materialised already.
    """
    small = small if staged else stage(small)
    if stored_bytes(small) <= limit:
        return big.join(F.broadcast(small), on, how)
    salts = int(big.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    keyed = big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    return keyed.join(salted, [*on, "_salt"], how).drop("_salt")
