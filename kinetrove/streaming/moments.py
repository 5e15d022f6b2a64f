"""Running statistics of internal coordinates, as frames come in drops.

A drop gives one row of moments (n, mean, sum of squared deviations) for each coordinate. They are stored by drop, so a
drop that is written again after a failure replaces itself, and merged when they are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kinetrove.operators.topology import internal_stats, labels_of

_MOMENTS = ("n", "degenerate", "mean", "m2")


def moments(frames: DataFrame, topology: DataFrame, kind: str) -> DataFrame:
    """run_id, labels, n, degenerate, mean, m2 of every internal coordinate of these frames."""
    stats = internal_stats(frames, topology, kind)
    return stats.select("run_id", *labels_of(kind), "n", "degenerate", "mean", (F.col("variance") * F.col("n")).alias("m2"))


def merged(stored: DataFrame, kind: str) -> DataFrame:
    """One row of moments for each coordinate, from those of several drops (column ``drop``), merged in their order."""

    def add(a, b):
        n = a["n"] + b["n"]
        step = b["mean"] - a["mean"]
        # Means of empty drops are null and weigh nothing.
        both = (a["n"] > 0) & (b["n"] > 0)
        mean = F.when(both, a["mean"] + step * b["n"] / n).otherwise(F.coalesce(a["mean"], b["mean"]))
        m2 = F.when(both, a["m2"] + b["m2"] + step * step * a["n"] * b["n"] / n).otherwise(F.coalesce(a["m2"], b["m2"]))
        return F.struct(n.alias("n"), (a["degenerate"] + b["degenerate"]).alias("degenerate"), mean.alias("mean"), m2.alias("m2"))

    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("degenerate"), F.lit(None).cast("double").alias("mean"), F.lit(None).cast("double").alias("m2"))
    parts = stored.groupBy("run_id", *labels_of(kind)).agg(F.array_sort(F.collect_list(F.struct("drop", *_MOMENTS))).alias("parts"))
    total = parts.withColumn("total", F.aggregate("parts", zero, add))
    return total.select("run_id", *labels_of(kind), *[F.col(f"total.{m}").alias(m) for m in _MOMENTS])


def statistics(stored: DataFrame, kind: str) -> DataFrame:
    """The columns of :func:`internal_stats`, from stored moments."""
    rows = merged(stored, kind).withColumn("variance", F.when(F.col("n") > 0, F.col("m2") / F.col("n")))
    return rows.select("run_id", *labels_of(kind), "n", "degenerate", "mean", "variance", F.sqrt("variance").alias("std_dev"))


def write_drop(frames: DataFrame, drop: int, topology: DataFrame, kind: str, path: str) -> None:
    """Moments of one drop; writing it again replaces it."""
    moments(frames, topology, kind).write.mode("overwrite").parquet(f"{path}/drop={drop}")


def read_moments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def compact(spark: SparkSession, path: str, kind: str, into: str) -> None:
    """All stored drops as one, under another path: the last drop's number goes on."""
    stored = read_moments(spark, path)
    last = stored.agg(F.max("drop")).first()[0]
    merged(stored, kind).write.mode("overwrite").parquet(f"{into}/drop={last}")


def stream_moments(frames: DataFrame, topology: DataFrame, kind: str, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Start a stream that stores the moments of every micro-batch of packed frames."""
    sink = lambda batch, drop: write_drop(batch, drop, topology, kind, path)
    return frames.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def running_stats(frames: DataFrame, topology: DataFrame, kind: str) -> DataFrame:
    """The statistics as a streaming aggregate over a stream of packed frames, for sinks in update mode."""
    return internal_stats(frames, topology, kind)
