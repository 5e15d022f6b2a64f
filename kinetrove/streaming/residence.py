"""Residence events of running trajectories, found as the frames come in.

State is kept for each (run, object): the next frame to be read, the event that is still open, and frames that came
early. Frames are read in order. One that is missing is waited for until ``delay`` frames beyond it have come; then the
run is taken to have a hole there, which ends an event. That limit is drawn from the frames of the run itself, so
a slow run is not cut off by a fast one. Frames that come after it, or twice, are given out as ``late`` and counted so.

An event is final once ``tolerance`` + 1 empty frames have followed it. A row with a null ``h`` says that its run ends
before that frame, and closes the last event. Read in batch, :func:`kinetrove.operators.residence.residence_events`
gives the same events.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "run_id string, object_id long, kind string, start_frame long, n_frames long"
_STATE = "next long, start long, stop long, frames array<long>, ones array<int>"
#: The next frame of a run that has ended.
ENDED = 1 << 62
#: h of the row that ends a run.
_END = -1


def read_on(state: tuple, frames: np.ndarray, h: np.ndarray, tolerance: int, delay: int) -> tuple[tuple, list[tuple[int, int]], list[int]]:
    """(new state, closed events as (start, frames), late frames) after more frames of one object.

    A state is (next frame, start and last one of the open event or -1, early frames, their h).
    """
    upto, start, stop, early, early_h = state
    order = np.argsort(frames, kind="stable")
    frames, h = frames[order], h[order]
    late = frames < upto
    known = np.isin(frames, np.asarray(early, np.int64))
    again = np.concatenate([[False], frames[1:] == frames[:-1]]) if len(frames) else np.zeros(0, bool)
    drop = late | known | again
    lost = frames[drop].tolist()
    frames = np.concatenate([np.asarray(early, np.int64), frames[~drop]])
    h = np.concatenate([np.asarray(early_h, np.int64), h[~drop]])
    order = np.argsort(frames, kind="stable")
    frames, h = frames[order], h[order]
    events: list[tuple[int, int]] = []

    def close() -> None:
        nonlocal start, stop
        if start >= 0:
            events.append((start, stop - start + 1))
        start = stop = -1

    while len(frames):
        if frames[0] > upto:
            if frames[-1] - delay <= upto:
                break
            close()  # the missing frames are given up
            upto = int(frames[0])
        gaps = np.flatnonzero(np.diff(frames) != 1)
        n = int(gaps[0]) + 1 if len(gaps) else len(frames)
        piece, inside = frames[:n], h[:n]
        frames, h = frames[n:], h[n:]
        for one in piece[inside == 1].tolist():
            if start >= 0 and one - stop - 1 > tolerance:
                close()
            start, stop = one if start < 0 else start, one
        upto = int(piece[-1]) + 1
        if start >= 0 and upto - 1 - stop > tolerance:
            close()
        if inside[-1] == _END:
            close()
            lost += frames.tolist()
            frames, h, upto = frames[:0], h[:0], ENDED
    return (upto, start, stop, frames.tolist(), h.tolist()), events, lost


def _reader(tolerance: int, delay: int):
    def read(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        columns = [(p["frame_id"].to_numpy(np.int64), p["h"].fillna(_END).to_numpy(np.int64)) for p in parts]
        now = state.get if state.exists else (0, -1, -1, [], [])
        frames, h = (np.concatenate(x) for x in zip(*columns))
        now, events, late = read_on(now, frames, h, tolerance, delay)
        state.update(now)
        found = [("event", *e) for e in events] + [("late", f, None) for f in late]
        if found:
            kind, first, n = zip(*found)
            yield pd.DataFrame({"run_id": key[0], "object_id": key[1], "kind": kind, "start_frame": pd.array(first, "Int64"), "n_frames": pd.array(n, "Int64")})

    return read


def residence_event_stream(occupancy: DataFrame, tolerance: int = 0, delay: int = 1000) -> DataFrame:
    """Events and late frames of a stream of occupancies (run_id, object_id, frame_id, h); see ``EVENTS``.

    Written in append mode. State passes to the Python workers with the rows, so no state server and no port is opened.
    """
    if tolerance < 0 or delay < 0:
        raise ValueError("tolerance and delay must not be negative")
    rows = occupancy.selectExpr("run_id", "cast(object_id AS long) AS object_id", "cast(frame_id AS long) AS frame_id", "cast(h AS int) AS h")
    return rows.groupBy("run_id", "object_id").applyInPandasWithState(_reader(tolerance, delay), EVENTS, _STATE, "append", GroupStateTimeout.NoTimeout)


def open_events(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Events that were still open at the last committed batch of a stream: run_id, object_id, start_frame, n_frames."""
    state = spark.read.format("statestore").load(checkpoint)
    rows = state.selectExpr("key.run_id AS run_id", "key.object_id AS object_id", "value.groupState.start AS start_frame", "value.groupState.stop AS stop")
    return rows.where("start_frame >= 0").selectExpr("run_id", "object_id", "start_frame", "stop - start_frame + 1 AS n_frames")
