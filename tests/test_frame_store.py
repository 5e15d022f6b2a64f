import pytest
from pyspark.sql import functions as F

from kinetrove.operators.frames import select_frames
from kinetrove.sources import frame_store


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    """Runs of 100 and 37 frames, stored in three parts that cut folders in two; folders hold 8 frames."""
    path = str(tmp_path_factory.mktemp("store") / "frames")
    rows = [(run, f, ["C"], [(float(f), 0.0, 0.0)]) for run, n in (("7", 100), ("run b", 37)) for f in range(n)]
    frames = spark.createDataFrame(rows, "run_id string, frame_id long, elements array<string>, pos array<struct<x:double,y:double,z:double>>")
    for low, high in ((0, 20), (20, 21), (21, 100)):
        frame_store.append(frames.where((F.col("frame_id") >= low) & (F.col("frame_id") < high)), path, size=8)
    return frames, path


def scanned(df):
    """(rows, files that the plan reads)."""
    rows = df.collect()
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return rows, leaf.metrics().apply("numFiles").value()


@pytest.mark.parametrize("runs", [None, ["7"], ["run b", "none"]])
@pytest.mark.parametrize("start,stop,skip", [(0, None, 0), (3, 11, 0), (10, 50, 3), (5, None, 20), (2, 90, 40), (99, 99, 0), (200, None, 1), (9, 3, 0)])
def test_selections_equal_those_of_the_whole(spark, store, runs, start, stop, skip):
    frames, path = store
    whole = frames if runs is None else frames.where(F.col("run_id").isin(*runs))
    want = select_frames(whole, start, 10**9 if stop is None else stop, skip)
    got, files = scanned(frame_store.select(spark, path, runs, start, stop, skip, size=8))
    assert sorted((r.run_id, r.frame_id, r.pos[0].x) for r in got) == sorted((r.run_id, r.frame_id, r.pos[0].x) for r in want.collect())
    # A folder is read only if it holds a pick: one file, or two where a part ended inside of it.
    picks = {(run, f // 8) for run, n in (("7", 100), ("run b", 37)) if runs is None or run in runs for f in range(start, (stop if stop is not None else 10**4) + 1, skip + 1) if f // 8 <= (n - 1) // 8}
    assert len(picks) <= files <= 3 * len(picks)


def test_layout_stays_with_appended_frames(spark, store):
    frames, path = store
    stored = spark.read.parquet(path)
    assert stored.where("frame_id div 8 <> span").count() == 0 and stored.count() == frames.count()
    spans = stored.select("run_id", "span").distinct().count()
    assert spans == 13 + 5
