import random

import pytest
from pyspark.sql import functions as F

from kinetrove.operators import residence
from kinetrove.sources import frame_index, xyz


@pytest.mark.parametrize("tolerance", [0, 2])
def test_any_cut_of_runs_gives_the_events_of_the_whole(spark, tolerance):
    rng = random.Random(tolerance)
    rows = [(f"r{r}", o, f, rng.choice((0, 0, 1, 1))) for r, n in ((0, 60), (1, 25)) for o in range(1, 5) for f in range(n)]
    rows += [("r2", 1, f, 1) for f in range(60)]
    occ = spark.createDataFrame(rows, "run_id string, object_id int, frame_id long, h int").cache()
    want = sorted(map(tuple, residence.residence_events(residence.fill_gaps(occ, tolerance)).select("run_id", "object_id", "start_frame", "n_frames").collect()))
    borders, got = residence.border_states(spark), []
    for low, high in ((0, 1), (1, 22), (22, 23), (23, 60)):
        final, after = residence.append_events(occ.where((F.col("frame_id") >= low) & (F.col("frame_id") < high)), borders, tolerance)
        got += map(tuple, final.select("run_id", "object_id", "start_frame", "n_frames").collect())
        borders = spark.createDataFrame(after.collect(), after.schema)  # stored, as a caller does
    got += map(tuple, residence.open_events(borders).collect())
    assert sorted(got) == want
    with pytest.raises(Exception, match="do not go on at the border of run r0"):
        residence.append_events(occ.where("run_id = 'r0' AND frame_id > 30"), borders, tolerance)[1].collect()


def xyz_files(folder, end):
    """Two runs: changing counts, blank lines between frames, comments of several bytes a character, no last line end."""
    rng = random.Random(7)
    for run in ("a", "b"):
        (folder / run).mkdir()
        text = ""
        for f in range(120):
            n = 3 + f % 3
            text += end * rng.choice((0, 0, 2)) + f"{n}{end}{'né漢'[: f % 4]} {f}{end}"
            text += "".join(f"C {f}.5 {rng.random():.6f} {k}{end}" for k in range(n))
        (folder / run / "T.xyz").write_bytes(text.encode()[: -len(end)])


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_frames_are_read_by_their_place(spark, tmp_path, end):
    xyz_files(tmp_path, end)
    path, pattern = f"{tmp_path}/*/T.xyz", "([^/]+)/[^/]+$"
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        index = frame_index.index_frames(spark, path, pattern)
        index = spark.createDataFrame(index.collect(), index.schema)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert index.count() == 240
    for run in ("a", "b"):
        data = (tmp_path / run / "T.xyz").read_bytes()
        for r in index.where(F.col("run_id") == run).orderBy("frame_id").collect():
            part = data[r.offset : r.offset + r.length].decode().split(end)
            assert int(part[0]) == r.n_atoms == 3 + r.frame_id % 3 and part[1].endswith(f" {r.frame_id}") and len([x for x in part if x]) == r.n_atoms + 2
    wanted = index.where("frame_id IN (0, 7, 8, 119)")
    rows = frame_index.read_frames(index, wanted)
    got = sorted(map(tuple, rows.collect()))
    # All frames in one read give what reading the file gives.
    lines = frame_index.number_lines(spark, path, pattern)
    whole = xyz.frame_rows(lines).where("row >= 2").select("run_id", "frame_id", (F.col("row") - 1).cast("int"), F.split("value", " "))
    want = sorted((run, f, a, w[0], *map(float, w[1:])) for run, f, a, w in whole.collect())
    assert sorted(map(tuple, frame_index.read_frames(index, index).collect())) == want
    assert got == [r for r in want if r[1] in (0, 7, 8, 119)]
    # Bytes read: the wanted frames alone.
    read = wanted.agg(F.sum("length")).first()[0]
    assert read < 0.05 * sum((tmp_path / run / "T.xyz").stat().st_size for run in ("a", "b"))
    texts = frame_index.read_texts(index, wanted).agg(F.sum(F.octet_length("text"))).first()[0]
    assert read - 2 * len(end) <= texts <= read


def test_index_stops_at_the_first_damaged_frame(spark, tmp_path):
    (tmp_path / "T.xyz").write_text("1\nx\nC 0 0 0\n1\nx\nC 1 0 0\n1\nx\nC 2 bad 0\n1\nx\nC 3 0 0\n")
    index = frame_index.index_frames(spark, f"{tmp_path}/T.xyz")
    assert [(r.frame_id, r.offset, r.length) for r in index.orderBy("frame_id").collect()] == [(0, 0, 12), (1, 12, 12)]
