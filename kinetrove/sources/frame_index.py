"""Frames of XYZ files by their place in the file: an index, and a reader that opens only the wanted ranges.

The index has one row for each complete frame before the first damaged one of its run: run_id, frame_id, n_atoms, file,
offset, length. It is built by one look at the text and kept as a table of its own; blank lines, changing counts and
either kind of line end are allowed. Ranges are read through ``pyarrow.fs``, so files lie in a store that it knows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetrove.functions.text import number, tokens, word
from kinetrove.plans.prefix import running
from kinetrove.sources.lines import number_lines
from kinetrove.sources.xyz import placed_frames

#: Neighbouring frames are read at once up to so many bytes, and dealt to tasks by pieces of a file of that size.
AT_ONCE = 16 << 20
_TEXT = "run_id string, frame_id long, n_atoms long, text string"


def index_frames(spark: SparkSession, path: str | list[str], run_pattern: str | None = None) -> DataFrame:
    """run_id, frame_id, n_atoms, file, offset, length of the frames of XYZ files."""
    lines = number_lines(spark, path, run_pattern, measured=True)
    ends = running(lines.select("run_id", "line_no", "file", "bytes"), ["run_id"], "line_no", {"_end": ("sum", F.col("bytes"))})
    frames = placed_frames(lines.drop("file", "bytes")).select("run_id", "frame_id", F.col("count").alias("n_atoms"), "line_no")
    points = F.array(F.struct(F.col("line_no").alias("at"), F.lit(True).alias("first")), F.struct((F.col("line_no") + F.col("n_atoms") + 1).alias("at"), F.lit(False).alias("first")))
    wanted = frames.select("run_id", "frame_id", "n_atoms", F.explode(points).alias("p")).select("run_id", "frame_id", "n_atoms", F.col("p.at").alias("line_no"), "p.first")
    met = wanted.join(ends, ["run_id", "line_no"])
    found = met.groupBy("run_id", "frame_id", "n_atoms").agg(
        F.first("file").alias("file"), F.min(F.when(F.col("first"), F.col("_end") - F.col("bytes"))).alias("offset"), F.max(F.when(~F.col("first"), F.col("_end"))).alias("_stop")
    )
    return found.select("run_id", "frame_id", "n_atoms", "file", "offset", (F.col("_stop") - F.col("offset")).alias("length"))


def _read_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of frames that come ordered by file and offset; those that follow each other are read at once."""
    from pyarrow import fs

    open_path, stream, held = None, None, []

    def read() -> Iterator[pa.RecordBatch]:
        begin = held[0][4]
        stream.seek(begin)
        data = stream.read(held[-1][4] + held[-1][5] - begin)
        rows = [(run, frame, n, data[at - begin : at - begin + length].decode("utf-8", "replace")) for run, frame, n, _, at, length in held]
        yield pa.record_batch([pa.array(c) for c in zip(*rows)], ["run_id", "frame_id", "n_atoms", "text"])

    names = ["run_id", "frame_id", "n_atoms", "file", "offset", "length"]
    for batch in batches:
        for row in zip(*(batch[c].to_pylist() for c in names)):
            _, _, _, file, offset, length = row
            if held and (file != open_path or offset != held[-1][4] + held[-1][5] or offset + length - held[0][4] > AT_ONCE):
                yield from read()
                held = []
            if file != open_path:
                if stream is not None:
                    stream.close()
                store, name = fs.FileSystem.from_uri(file)
                open_path, stream = file, store.open_input_file(name)
            held.append(row)
    if held:
        yield from read()
    if stream is not None:
        stream.close()


def read_texts(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """run_id, frame_id, n_atoms, text of the wanted frames (run_id, frame_id)."""
    chosen = index.join(wanted.select("run_id", "frame_id"), ["run_id", "frame_id"], "left_semi")
    dealt = chosen.withColumn("_piece", F.expr(f"offset div {AT_ONCE}L")).repartition("file", "_piece").sortWithinPartitions("file", "offset")
    return dealt.select("run_id", "frame_id", "n_atoms", "file", "offset", "length").mapInArrow(_read_texts, _TEXT)


def read_frames(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """Atoms of the wanted frames, as :func:`kinetrove.sources.xyz.read_xyz` gives them."""
    lines = F.slice(F.split("text", "\r?\n"), F.lit(3), F.col("n_atoms").cast("int"))
    rows = read_texts(index, wanted).select("run_id", "frame_id", F.posexplode(lines).alias("_a", "_line")).withColumn("_w", tokens(F.col("_line")))

    def value(k: int):
        what = F.concat(F.lit("coordinate is not a number in frame "), (F.col("frame_id") + 1).cast("string"), F.lit(" of "), F.col("run_id"))
        return F.coalesce(number(word(F.col("_w"), k)), F.raise_error(what).cast("double"))

    return rows.select(
        "run_id", "frame_id", (F.col("_a") + 1).cast("int").alias("atom_id"), word(F.col("_w"), 0).alias("element"),
        *[value(k).alias(c) for k, c in ((1, "x"), (2, "y"), (3, "z"))],
    )
