"""Frames that must be followed one after another: each tells where the next one begins.

Following a chain takes one step a frame, so it is cut into chunks of lines. A backward pass over a chunk gives, for
every line that may begin a frame, the line where its chain leaves the chunk. Such a map is composed of jumps, so
chunks need no order yet; only the few distinct lines where chains leave are entries of later chunks. One row for each
entry then goes to one task a run, which walks the entries and numbers their frames, and a last pass over the entered
chunks lists their frames. A run of 10^12 lines leaves some millions of entries at ``CHUNK`` lines a chunk.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lines in a chunk of the chain, and of the text that frames are laid over.
CHUNK = 1 << 20
PLACE = 1 << 16

_ENTRIES = "run_id string, line_no long, base long, _c long"
_NODES = "run_id string, line_no long, leaves long, frames long"
_STARTS = "run_id string, begin long, count long, frame_id long, last_line long"


def _table(key: str, schema: str, *columns) -> pa.Table:
    names = [f.split()[0] for f in schema.split(", ")]
    arrays = [pa.array(c, pa.int64()) for c in columns]
    return pa.table([pa.array([key] * len(arrays[0]), pa.string()), *arrays], names)


def _jumps(live: pa.Table) -> dict[int, tuple[int, int]]:
    """Of every live line: the line that follows, and 1 if it begins a frame."""
    return dict(zip(live["line_no"].to_pylist(), zip(live["after"].to_pylist(), live["frame"].to_pylist())))


def _left(jumps: dict[int, tuple[int, int]]) -> dict[int, tuple[int, int]]:
    """Of every live line: the first line of its chain that is not live in this chunk, and the frames before it."""
    found: dict[int, tuple[int, int]] = {}
    for line in sorted(jumps, reverse=True):
        after, frame = jumps[line]
        at, more = found.get(after, (after, 0))
        found[line] = (at, more + frame)
    return found


def starts(lines: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """run_id, begin, count, frame_id, last_line of all frames on the chain that starts at line 0 of each run.

    ``lines``: run_id, line_no, count, skip, last_line. A frame is as long as its count says and two lines more; a line
    to skip is followed by the next one. A line that is neither ends the chain: it is given as a frame without a count.
    """
    length = F.when(F.col("skip"), F.lit(1).cast("long")).otherwise(F.greatest(F.col("count"), F.lit(0).cast("long")) + 2)
    live = lines.where(F.col("skip") | F.col("count").isNotNull()).select(
        "run_id", "line_no", "count", "last_line", (F.col("line_no") + length).alias("after"),
        (~F.col("skip")).cast("long").alias("frame"), F.expr(f"line_no div {chunk}L").alias("_c"),
    )
    grouped = live.groupBy("run_id", "_c")

    def exits(key: tuple, table: pa.Table) -> pa.Table:
        out = np.unique([at for at, _ in _left(_jumps(table)).values()])
        return _table(key[0].as_py(), _ENTRIES, out, np.zeros(len(out)), out // chunk)

    def cross(key: tuple, table: pa.Table, entries: pa.Table) -> pa.Table:
        found = _left(_jumps(table))
        lines = np.unique(entries["line_no"].to_numpy()).tolist()
        crossed = [found.get(line, (None, 0)) for line in lines]
        return _table(key[0].as_py(), _NODES, lines, [c[0] for c in crossed], [c[1] for c in crossed])

    def walk(key: tuple, nodes: pa.Table) -> pa.Table:
        step = dict(zip(nodes["line_no"].to_pylist(), zip(nodes["leaves"].to_pylist(), nodes["frames"].to_pylist())))
        line, base, seen = 0, 0, []
        while line is not None:
            seen.append((line, base))
            after, frames = step.get(line, (None, 0))
            # A chain that ends inside of the chunk is listed with the chunk.
            line, base = None if after is None or after // chunk == line // chunk else after, base + frames
        lines, bases = zip(*seen)
        return _table(key[0].as_py(), _ENTRIES, lines, bases, [n // chunk for n in lines])

    def frames(key: tuple, table: pa.Table, entered: pa.Table) -> pa.Table:
        found = []
        if entered.num_rows:
            jumps, end = _jumps(table), (key[1].as_py() + 1) * chunk
            counts = dict(zip(table["line_no"].to_pylist(), table["count"].to_pylist()))
            line, frame_id = entered["line_no"][0].as_py(), entered["base"][0].as_py()
            while line in jumps:
                after, frame = jumps[line]
                if frame:
                    found.append((line, counts[line], frame_id))
                line, frame_id = after, frame_id + frame
            if line < end:  # the chain ends in this chunk
                found.append((line, None, frame_id))
        last = table["last_line"][0].as_py() if table.num_rows else None
        return _table(key[0].as_py(), _STARTS, *(zip(*found) if found else ([], [], [])), [last] * len(found))

    begin = lines.where("line_no = 0").select("run_id", "line_no", F.lit(0).cast("long").alias("base"), F.lit(0).cast("long").alias("_c"))
    entries = grouped.applyInArrow(exits, _ENTRIES).unionByName(begin)
    nodes = grouped.cogroup(entries.groupBy("run_id", "_c")).applyInArrow(cross, _NODES)
    entered = nodes.groupBy("run_id").applyInArrow(walk, _ENTRIES)
    return grouped.cogroup(entered.groupBy("run_id", "_c")).applyInArrow(frames, _STARTS)


def laid_over(lines: DataFrame, begun: DataFrame, place: int = PLACE) -> DataFrame:
    """``lines`` (run_id, line_no, value) that belong to a frame of ``begun``: with frame_id, row and count.

    A frame is also given to every later piece of ``place`` lines that it reaches into, so no order goes beyond one.
    """
    end = F.least(F.col("begin") + F.greatest(F.coalesce("count", F.lit(-1).cast("long")), F.lit(0).cast("long")) + 1, F.coalesce("last_line", "begin"))
    end = F.when(F.col("count").isNull(), F.col("begin")).otherwise(end)
    marks = begun.withColumn("_end", end).withColumn("_p", F.explode(F.sequence(F.expr(f"begin div {place}L"), F.expr(f"_end div {place}L"))))
    marks = marks.select("run_id", F.col("begin").alias("line_no"), "_p", F.struct("begin", "_end", "count", "frame_id").alias("_frame"))
    rows = lines.withColumn("_p", F.expr(f"line_no div {place}L"))
    both = rows.unionByName(marks, allowMissingColumns=True)
    order = Window.partitionBy("run_id", "_p").orderBy("line_no", F.col("_frame").isNull())
    frame: Column = F.last("_frame", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    placed = both.withColumn("_at", frame).where(F.col("_frame").isNull() & (F.col("line_no") <= F.col("_at._end")))
    return placed.select(*lines.columns, "_at.frame_id", (F.col("line_no") - F.col("_at.begin")).alias("row"), "_at.count")
