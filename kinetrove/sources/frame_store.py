"""A store of packed frames laid out by run and range of frames, so that selections leave files unread.

Frames lie in Parquet folders ``run_id=.../span=...``, one for each ``size`` frames of a run, in frame order. Selections
by run, interval and stride become conditions on the folder columns too, and Spark drops the other folders when it plans
the scan; inside of the files row groups are left out by their statistics. Appended frames go into the folders of their
own ranges, so the layout stays the same however a run grows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Frames in a folder. It is part of the layout: a store is read with the size it was written with.
SIZE = 4096


def append(frames: DataFrame, path: str, size: int = SIZE) -> None:
    """Add packed frames (run_id, frame_id and any other columns) to the store."""
    spanned = frames.withColumn("span", F.expr(f"frame_id div {size}L"))
    # Folders are dealt by range, so one long run is written by many tasks and a small one by one.
    ordered = spanned.repartitionByRange("run_id", "span", "frame_id").sortWithinPartitions("run_id", "span", "frame_id")
    ordered.write.mode("append").partitionBy("run_id", "span").parquet(path)


def _holds_pick(start: int, stop: int, stride: int, size: int):
    """Whether a folder's range has one of start, start + stride, ... up to stop: a condition on ``span`` alone."""
    low, high = F.col("span") * size, (F.col("span") + 1) * size
    first = F.when(low <= start, F.lit(start)).otherwise(F.lit(start) + F.ceil((low - start) / stride) * stride)
    return (first < high) & (first <= stop)


def select(
    spark: SparkSession, path: str, runs: list[str] | None = None, start: int = 0, stop: int | None = None, skip: int = 0, size: int = SIZE
) -> DataFrame:
    """Every (skip+1)-th frame of the closed interval [start, stop] of the given runs (all if None).

    The rule is that of :func:`kinetrove.operators.frames.select_frames`.
    """
    if start < 0 or skip < 0:
        raise ValueError("start and skip must not be negative")
    last = (1 << 62) if stop is None else stop
    stored = spark.read.option("basePath", path).parquet(path)
    stored = stored.withColumns({"run_id": F.col("run_id").cast("string"), "span": F.col("span").cast("long")})
    if runs is not None:
        stored = stored.where(F.col("run_id").isin(*runs))
    chosen = stored.where(_holds_pick(start, last, skip + 1, size))
    frame = F.col("frame_id")
    return chosen.where((frame >= start) & (frame <= last) & ((frame - start) % (skip + 1) == 0)).drop("span")
