"""Text files as numbered lines, without reading a file in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinetrove.plans.staging import attach, stage

RUN_BY_FILE = r"([^/]+)$"
RUN_BY_FOLDER = r"([^/]+)/[^/]+$"


def number_lines(spark: SparkSession, path: str | list[str], run_pattern: str | None = None, measured: bool = False) -> DataFrame:
    """Lines of text files: run_id, line_no (from 0), value, head (first line of the file), n_lines.

    The text is read once. Its lines are written with the split they came from and a rising
    identifier, so however a later job cuts files into splits, line counts and lines speak of the
    same cut. One small row per split gives its line count; a running sum over the splits of a file
    turns identifiers into line numbers. ``run_pattern`` is a regular expression whose group 1 names
    the run; by default the run is the file's path. Two files of one run are an error. ``measured`` adds the file and
    the bytes that each line takes in it, line end included.
    """
    run = F.col("_metadata.file_path") if run_pattern is None else F.regexp_extract("_metadata.file_path", run_pattern, 1)
    value, more = F.col("value"), []
    if measured:  # cut at line feeds alone, so that a carriage return counts
        value, more = F.regexp_replace("value", "\\r$", "").alias("value"), [(F.octet_length("value") + 1).cast("long").alias("bytes")]
    text = spark.read.option("lineSep", "\n").text(path) if measured else spark.read.text(path)
    lines = stage(
        text.select(
            run.alias("run_id"), F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"), value, *more,
        ),
        "lines",
    )
    splits = lines.groupBy("run_id", "_file", "_block").agg(
        F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"), F.min_by("value", "_id").alias("_head")
    )
    before = Window.partitionBy("run_id").orderBy("_block")  # one row per split of a file
    whole = Window.partitionBy("run_id")
    two = F.min("_file").over(whole) != F.max("_file").over(whole)
    splits = splits.select(
        "run_id", "_block", "_first",
        F.coalesce(F.sum("_n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.when(two, F.raise_error(F.concat(F.lit("two files have the run name "), F.col("run_id"))).cast("bigint"))
        .otherwise(F.sum("_n").over(whole)).alias("n_lines"),
        F.min_by("_head", "_block").over(whole).alias("head"),
    )
    return attach(lines, splits, ["run_id", "_block"], spread="_id").select(
        "run_id", (F.col("_before") + F.col("_id") - F.col("_first")).alias("line_no"), "value", "head", "n_lines",
        *([F.col("_file").alias("file"), "bytes"] if measured else []),
    )
