import random

import pytest
from pyspark.sql import functions as F

from kinetrove.sources import chain, xyz


def followed(lines):
    """(begin, count, frame_id) read one line after another; lines: [(count or None, skip)]."""
    found, at, frame = [], 0, 0
    while at < len(lines):
        count, skip = lines[at]
        if skip:
            at += 1
            continue
        found.append((at, count, frame))
        if count is None:
            break
        at, frame = at + max(count, 0) + 2, frame + 1
    return found


@pytest.fixture(scope="module")
def runs():
    rng = random.Random(9)
    made = {"empty line": [(None, True)], "dead": [(None, False)] * 40, "all blank": [(None, True)] * 50, "one jump": [(90, False)] + [(None, False)] * 95, "zero": [(0, False)] * 30}
    for k in range(12):
        lines = []
        while len(lines) < rng.choice((5, 60, 200)):
            lines += [(None, True)] * rng.choice((0, 0, 1, 3))
            count = rng.choice((-1, 0, 1, 4, 4, 4, 25))
            lines.append((count, False))
            lines += [(rng.choice((None, None, 3)), False) for _ in range(max(count, 0) + 1)]
        if k % 3 == 0:
            lines[len(lines) // 2] = (None, False)
        made[f"r{k}"] = lines
    return made


@pytest.mark.parametrize("chunk", [1, 7, 16, 1 << 20])
def test_starts_equal_reading_line_by_line(spark, runs, chunk):
    rows = [(run, n, count, skip, len(lines) - 1) for run, lines in runs.items() for n, (count, skip) in enumerate(lines)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "run_id string, line_no long, count long, skip boolean, last_line long").repartition(3)
    got = {}
    for r in chain.starts(df, chunk).collect():
        if r.begin < len(runs[r.run_id]):  # a chain that ends with its file points behind it
            got.setdefault(r.run_id, []).append((r.begin, r["count"], r.frame_id))
    for run, lines in runs.items():
        assert sorted(got.get(run, [])) == followed(lines), run


@pytest.mark.parametrize("place", [1, 5, 1 << 16])
def test_lines_get_their_frame(spark, runs, place):
    rows = [(run, n, str(n), count, skip, len(lines) - 1) for run, lines in runs.items() for n, (count, skip) in enumerate(lines)]
    df = spark.createDataFrame(rows, "run_id string, line_no long, value string, count long, skip boolean, last_line long")
    got = {(r.run_id, r.line_no, r.frame_id, r.row, r["count"]) for r in chain.laid_over(df.select("run_id", "line_no", "value"), chain.starts(df, 16), place).collect()}
    want = set()
    for run, lines in runs.items():
        for begin, count, frame in followed(lines):
            last = begin if count is None else min(begin + max(count, 0) + 1, len(lines) - 1)
            want |= {(run, n, frame, n - begin, count) for n in range(begin, last + 1)}
    assert got == want


def test_a_million_lines_with_one_blank_line(spark):
    """23 lines a frame; the blank line stands between two of them."""
    frames, size, blank = 43_479, 23, 500_000 // 23 * 23
    row = (F.col("id") % size).cast("int")
    value = F.when(row == 0, "21").when(row == 1, "note").otherwise(F.concat(F.lit("C 1 2 "), F.floor(F.col("id") / size).cast("string")))
    text = spark.range(frames * size, numPartitions=8).select((F.col("id") + (F.col("id") >= blank).cast("long")).alias("line_no"), value.alias("value"))
    text = text.unionByName(spark.createDataFrame([(blank, "")], "line_no long, value string"))
    lines = text.select(F.lit("run").alias("run_id"), "line_no", "value", F.lit("21").alias("head"), F.lit(frames * size + 1).cast("long").alias("n_lines"))
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup(None))
    atoms = xyz.parse_xyz(lines, mode="PERMISSIVE")
    got = atoms.groupBy("frame_id").agg(F.count("*").alias("n"), F.min("z").alias("a"), F.max("z").alias("b"))
    whole = got.agg(F.count("*").alias("frames"), F.sum((F.col("n") == 21).cast("int")).alias("full"), F.sum(((F.col("a") == F.col("frame_id")) & (F.col("b") == F.col("frame_id"))).cast("int")).alias("own")).first()
    assert (whole.frames, whole.full, whole.own) == (frames, frames, frames)
    # The number of jobs does not grow with the number of frames.
    assert len(tracker.getJobIdsForGroup(None)) - before < 40
