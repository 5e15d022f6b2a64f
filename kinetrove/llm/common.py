"""Helpers shared by the operators: tables, labelled samples, bounded memories, files that tasks write and read."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetrove.plans.staging import scratch, stage  # noqa: F401  for all operators

#: Deleting every match of this normalises a text; splitting at it yields its words. ASCII white space only.
WHITE = "[\\x20\\x09-\\x0D]+"
#: One word.
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """``df``, with at most ``rows`` rows in an Arrow batch of its session, so that long texts do not fill a worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key)) <= rows:
        df.sparkSession.conf.set(key, str(rows))
    return df


def text_bytes(text: Column | str) -> Column:
    """UTF-8 of a text, null as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary")


def word_count(text: Column | str) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def held_out(doc_id: Column | str) -> Column:
    """True for the quarter of the documents that no label is learnt from; false for a null id."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, seed: str) -> DataFrame:
    """At most ``rows`` labelled rows (doc_id, text, label), half of them of either label where there are as many.

    Rows are chosen by a hash of their id, so the choice does not depend on partitions. Held-out rows, null
    labels, null ids take no part; of several labels for an id the largest counts.
    """
    marks = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out("doc_id"))
        .groupBy("doc_id").agg(F.max(F.col(label)).cast("int").alias("label"))
        .where(F.col("label").isin(0, 1))
        .withColumn("_draw", F.xxhash64(F.lit(seed), "doc_id"))
    )
    chosen = None
    for value in (0, 1):
        part = marks.where(F.col("label") == value).orderBy("_draw", "doc_id").limit(rows // 2)
        chosen = part if chosen is None else chosen.unionByName(part)
    # At most ``rows`` ids are broadcast. Of several rows with one id the smallest text counts.
    found = docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id", "label")), "doc_id")
    return found.groupBy("doc_id", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))


class Memory(dict):
    """Results by key, in two generations of ``most`` keys: what was not asked for in a whole generation is forgotten."""

    def __init__(self, compute, most: int, longest: int = 40):
        self.compute, self.most, self.longest, self.older = compute, most, longest, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


def open_output(path: str):
    """(stream, path) of a new file on any store that pyarrow knows; plain paths and file: URIs are local."""
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}")
    store.create_dir(os.path.dirname(name), recursive=True)
    return store.open_output_stream(name, compression=None)


def open_input(path: str):
    """A seekable file; a local one is memory-mapped."""
    import pyarrow as pa
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}")
    return pa.memory_map(name) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(name)
