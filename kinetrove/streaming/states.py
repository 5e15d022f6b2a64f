"""Frames and electronic states that both still come in.

A frame and the log row of its position are joined as soon as both are there. A frame whose row is missing is "unknown",
but only once the log has passed it: time is the frame number, and each stream's watermark stays ``delay`` frames
behind the largest number that it has shown. The slower one counts. So runs of one stream have to advance together
within ``delay`` frames; rows that come later than that are dropped, and Spark's progress counts them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _watched(rows: DataFrame, number: str, name: str, delay: int) -> DataFrame:
    # From second 1 on: what lies at the first watermark, second 0, counts as late.
    return rows.withColumn(name, F.timestamp_seconds(F.col(number) + 1)).withWatermark(name, f"{int(delay)} seconds")


def frames_by_state_stream(frames: DataFrame, states: DataFrame, delay: int) -> DataFrame:
    """A stream of packed frames with the state of the k-th log row; see :func:`kinetrove.operators.states.frames_by_state`.

    ``states``: run_id, row_idx, state. For append mode. Rows of a run that is known to have ended far enough behind the
    last frame, as :func:`closing_row` gives them, let the last frames go.
    """
    left = _watched(frames, "frame_id", "_at", delay)
    log = states.select(F.col("run_id").alias("_run"), F.col("row_idx"), F.col("state").cast("string").alias("_state"))
    right = _watched(log, "row_idx", "_row_at", delay)
    joined = left.join(right, (F.col("run_id") == F.col("_run")) & (F.col("_at") == F.col("_row_at")), "leftOuter")
    return joined.select(*frames.columns, F.coalesce("_state", F.lit("unknown")).alias("state"))


def closing_row(rows: DataFrame, number: str, last: int, delay: int) -> DataFrame:
    """One row with the columns of ``rows`` and an empty run_id, far enough behind ``last`` to move the watermark past it.

    Rows without a run would not do: Spark leaves them out before it looks at their time.
    """
    given = {number: F.lit(last + delay + 1).cast("long"), "run_id": F.lit("")}
    values = [given.get(c, F.lit(None).cast(t)).alias(c) for c, t in rows.dtypes]
    return rows.sparkSession.range(1).select(*values)
