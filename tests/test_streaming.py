import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetrove.operators import residence, states, topology
from kinetrove.streaming import moments
from kinetrove.streaming import states as growing
from kinetrove.streaming import residence as online

OCCUPANCY = "run_id string, object_id long, frame_id long, h int"


def batch_events(h, tolerance):
    h = list(h)
    ones = [k for k, x in enumerate(h) if x == 1]
    found = []
    for k in ones:
        if found and k - found[-1][1] - 1 <= tolerance:
            found[-1][1] = k
        else:
            found.append([k, k])
    return [(a, b - a + 1) for a, b in found]


@pytest.mark.parametrize("tolerance", [0, 1, 3])
def test_any_cut_and_order_gives_the_events_of_the_whole(tolerance):
    rng = random.Random(tolerance)
    for _ in range(150):
        h = [rng.choice((0, 0, 1)) for _ in range(rng.choice((1, 5, 60)))]
        rows = list(enumerate([*h, -1]))
        # Frames come at most 20 places out of order.
        rows.sort(key=lambda r: r[0] + rng.uniform(0, 20))
        state, events = (0, -1, -1, [], []), []
        while rows:
            n = rng.randrange(1, 12)
            part, rows = rows[:n], rows[n:]
            state, more, late = online.read_on(state, np.array([r[0] for r in part]), np.array([r[1] for r in part]), tolerance, 40)
            assert not late
            events += more
        assert sorted(events) == batch_events(h, tolerance) and state[0] == online.ENDED


def test_holes_and_late_frames():
    start = (0, -1, -1, [], [])
    state, events, late = online.read_on(start, np.array([0, 1, 3, 4]), np.array([1, 1, 1, 0]), 0, 5)
    assert (state[0], events, late) == (2, [], [])
    state, events, late = online.read_on(state, np.array([5, 6, 7, 8]), np.array([0, 0, 0, 0]), 0, 5)
    # Frame 2 is given up: the event before it ends there.
    assert (state[0], events, late) == (9, [(0, 2), (3, 1)], [])
    state, events, late = online.read_on(state, np.array([2, 9, 9]), np.array([1, 1, 1]), 0, 5)
    assert (state[0], events, sorted(late)) == (10, [], [2, 9])


@pytest.fixture
def occupancy(spark):
    rng = random.Random(3)
    rows = [(f"r{r}", o, f, rng.choice((0, 0, 1, 1))) for r, n in (("a", 120), ("b", 40)) for o in range(1, 4) for f in range(n)]
    return spark.createDataFrame(rows, OCCUPANCY)


def write_drop(spark, occupancy, folder, low, high, ends=False):
    rows = occupancy.where((F.col("frame_id") >= low) & (F.col("frame_id") < high))
    if ends:
        last = occupancy.groupBy("run_id", "object_id").agg((F.max("frame_id") + 1).alias("frame_id")).withColumn("h", F.lit(None).cast("int"))
        rows = rows.unionByName(last)
    rows.coalesce(1).write.mode("append").parquet(folder)


def run_stream(spark, folder, out, checkpoint):
    stream = spark.readStream.schema(OCCUPANCY).option("maxFilesPerTrigger", 1).parquet(folder)
    events = online.residence_event_stream(stream, tolerance=1, delay=100)
    query = events.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        assert query.awaitTermination(300)
    finally:
        query.stop()


def test_a_file_stream_gives_the_events_of_the_batch_operator(spark, occupancy, tmp_path):
    folder, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "state"))
    write_drop(spark, occupancy, folder, 30, 60)  # out of order
    write_drop(spark, occupancy, folder, 0, 30)
    run_stream(spark, folder, out, checkpoint)
    still_open = {(r.run_id, r.object_id) for r in online.open_events(spark, checkpoint).collect()}
    # Started again from its checkpoint, with frames that it has read before and the rest.
    write_drop(spark, occupancy, folder, 10, 12)
    write_drop(spark, occupancy, folder, 60, 1000, ends=True)
    run_stream(spark, folder, out, checkpoint)
    got = spark.read.parquet(out)
    key = ["run_id", "object_id", "start_frame", "n_frames"]
    want = residence.residence_events(residence.fill_gaps(occupancy, 1)).select(*key)
    events = got.where("kind = 'event'").select(*key)
    assert sorted(map(tuple, events.collect())) == sorted(map(tuple, want.collect()))
    late = got.where("kind = 'late'")
    assert late.count() == 2 * 6 and {r.start_frame for r in late.collect()} == {10, 11}
    assert online.open_events(spark, checkpoint).count() == 0 and len(still_open) > 0


def random_frames(make_frames, n):
    rng = random.Random(8)
    base = [(e, 1.2 * k, 0.0, 0.0) for k, e in enumerate("COHNOH")]
    return make_frames([[(e, x + rng.gauss(0, 0.1), rng.gauss(0, 0.1), rng.gauss(0, 0.1)) for e, x, _, _ in base] for _ in range(n)])


def close(a, b):
    pairs = zip(sorted(map(tuple, a)), sorted(map(tuple, b)), strict=True)
    return all(x[:5] == y[:5] and all(p == q or abs(p - q) < 1e-9 for p, q in zip(x[5:], y[5:])) for x, y in pairs)


def test_moments_of_drops_merge_to_those_of_the_whole(spark, make_frames, tmp_path):
    frames, path = random_frames(make_frames, 60), str(tmp_path / "moments")
    bonds = topology.bonds(frames, 1.5)
    want = topology.internal_stats(frames, bonds, "bond").collect()
    for drop, (low, high) in enumerate([(0, 1), (1, 20), (20, 20), (20, 60)]):
        moments.write_drop(frames.where((F.col("frame_id") >= low) & (F.col("frame_id") < high)), drop, bonds, "bond", path)
    moments.write_drop(frames.where("frame_id < 1"), 0, bonds, "bond", path)  # once more: replaces itself
    stored = moments.read_moments(spark, path)
    assert len(want) > 3 and close(moments.statistics(stored, "bond").collect(), want)
    moments.compact(spark, path, "bond", str(tmp_path / "compact"))
    again = moments.read_moments(spark, str(tmp_path / "compact"))
    assert again.count() == len(want) and close(moments.statistics(again, "bond").collect(), want)


def test_running_stats_in_update_mode(spark, make_frames, tmp_path):
    frames, folder = random_frames(make_frames, 30), str(tmp_path / "frames")
    bonds = topology.bonds(frames, 1.5)
    for low in (0, 10, 20):
        frames.where((F.col("frame_id") >= low) & (F.col("frame_id") < low + 10)).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    query = moments.running_stats(stream, bonds, "bond").writeStream.outputMode("update").format("memory").queryName("bond_stats_now").trigger(availableNow=True).start()
    assert query.awaitTermination(200)
    rows = spark.table("bond_stats_now").collect()
    want = topology.internal_stats(frames, bonds, "bond").collect()
    newest = {r[:3]: r for r in sorted(map(tuple, rows), key=lambda r: r[3])}
    assert len(rows) == 3 * len(want) and close(newest.values(), want)
    # The same through stored moments, one drop a micro-batch.
    path = str(tmp_path / "stored")
    again = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    assert moments.stream_moments(again, bonds, "bond", path, str(tmp_path / "c")).awaitTermination(200)
    assert close(moments.statistics(moments.read_moments(spark, path), "bond").collect(), want)


@pytest.mark.parametrize("log_first", [True, False])
def test_states_and_frames_that_both_grow(spark, tmp_path, log_first):
    frames = spark.createDataFrame([(r, f, float(f)) for r in ("a", "b") for f in range(30)], "run_id string, frame_id long, x double")
    # Run a's log is complete, b's ends early and lacks one row.
    log = spark.createDataFrame([(r, f, f % 3) for r, n in (("a", 30), ("b", 20)) for f in range(n) if (r, f) != ("b", 7)], "run_id string, row_idx long, state int")
    folders, out = [str(tmp_path / x) for x in ("frames", "log")], str(tmp_path / "out")

    def drop(which, low, high, end=False):
        rows, number = ((frames, "frame_id"), (log, "row_idx"))[which]
        part = rows.where((F.col(number) >= low) & (F.col(number) < high))
        part = part.unionByName(growing.closing_row(rows, number, 30, 10)) if end else part
        part.coalesce(1).write.mode("append").parquet(folders[which])

    def run():
        read = lambda df, folder: spark.readStream.schema(df.schema).parquet(folder)
        joined = growing.frames_by_state_stream(read(frames, folders[0]), read(log, folders[1]), delay=10)
        query = joined.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert query.awaitTermination(200)

    one, two = (1, 0) if log_first else (0, 1)
    drop(one, 0, 15)
    drop(two, 0, 8)
    run()
    drop(two, 8, 30, end=True)
    drop(one, 15, 30, end=True)
    run()
    want = states.frames_by_state(frames, log)
    got = spark.read.parquet(out).where("run_id <> ''")
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert got.where("state = 'unknown'").count() == 11
