import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetrove.operators import alignment, clash, frames, histogram, neighbors, series, topology

BONDS = [
    [("C", 0, 1, 0), ("C", 0, 0, 0), ("C", 1, 0, 0), ("H", 1, 0, 1), ("O", 0, 0.5, 0)],
    [("C", 0, 1.1, 0), ("C", 0, 0, 0), ("C", 1.1, 0, 0), ("H", 1, 0, 1.1), ("O", 0, 0.5, 0)],
]
ANGLES = [
    [("H", 0, 0, 0), ("O", 1, 0, 0), ("H", 1, 1, 0), ("H", 1, 0.5, 0)],
    [("H", 0, 0, 0), ("O", 1, 0, 0), ("H", 0.5, 0.8660254, 0), ("H", 1, 0.5, 0)],
]
TORSIONS = [
    [("C", 0, 1, 0), ("C", 0, 0, 0), ("C", 1, 0, 0), ("H", 1, 0, 1), ("O", 0, 0.5, 0)],
    [("C", 0, 1, 0), ("C", 0, 0, 0), ("C", 1, 0, 0), ("H", 1, 0, -1), ("O", 0, 0.5, 0)],
]


def values(df, col="value"):
    return [r[col] for r in df.orderBy("frame_id").collect()]


def test_all_bonds_worked_example(make_frames):
    f = make_frames(BONDS)
    rows = {(r.i, r.j): r for r in topology.internal_stats(f, topology.bonds(f, 1.5, [1, 2, 3, 4]), "bond").collect()}
    assert set(rows) == {(1, 2), (1, 3), (2, 3), (2, 4), (3, 4)}
    assert rows[1, 2].mean == pytest.approx(1.05)
    assert rows[1, 2].variance == pytest.approx(0.0025)
    assert rows[1, 2].std_dev == pytest.approx(0.05)


def test_all_angles_worked_example(make_frames):
    f = make_frames(ANGLES)
    found = topology.angles(topology.bonds(f, 1.1, [1, 2, 3]))
    (row,) = topology.internal_stats(f, found, "angle").collect()
    assert (row.i, row.j, row.k, row.degenerate) == (1, 2, 3, 0)
    assert row.mean == pytest.approx(74.99999995)
    assert row.variance == pytest.approx(225.00000163)


def test_all_dihedrals_worked_example(make_frames):
    f = make_frames(TORSIONS)
    found = topology.dihedrals(topology.bonds(f, 1.1, [1, 2, 3, 4]), f)
    (row,) = topology.internal_stats(f, found, "dihedral").collect()
    assert (row.i, row.j, row.k, row.l) == (1, 2, 3, 4)
    assert row.mean == pytest.approx(0.0, abs=1e-12)
    assert row.variance == pytest.approx(8100.0)
    assert values(series.dihedral_series(f, 1, 2, 3, 4, wrap_180=True)) == pytest.approx([-90.0, 90.0])
    assert values(series.dihedral_series(f, 1, 2, 3, 4)) == pytest.approx([270.0, 90.0])
    assert values(series.dihedral_series(f, 1, 2, 3, 4, wrap_180=True, convention="iupac")) == pytest.approx([90.0, -90.0])


def test_solute_labels_are_checked(make_frames):
    f = make_frames(BONDS)
    with pytest.raises(ValueError):
        topology.bonds(f, 1.5, [1, 1])


def test_degenerate_frames_are_left_out(make_frames):
    f = make_frames([[("C", 0, 0, 0), ("C", 0, 0, 0), ("C", 1, 0, 0), ("C", 2, 0, 0)], ANGLES[0]])
    assert [r.frame_id for r in series.angle_series(f, 1, 2, 3).collect()] == [1]
    assert series.dihedral_series(f.where("frame_id = 0"), 1, 2, 3, 4).count() == 0
    (row,) = topology.internal_stats(f, f.sparkSession.createDataFrame([("r", 1, 2, 3)], "run_id string, i int, j int, k int"), "angle").collect()
    assert (row.n, row.degenerate) == (1, 1)


def test_long_atoms_give_the_same_series(make_frames):
    f = make_frames(TORSIONS)
    atoms = frames.unpack_frames(f)
    assert values(series.dihedral_series(atoms, 1, 2, 3, 4)) == values(series.dihedral_series(f, 1, 2, 3, 4))
    assert values(series.distance_series(atoms, 1, 5, 1.0)) == pytest.approx([0.5, 0.5])
    packed = frames.pack_frames(atoms)
    assert sorted(map(str, packed.select(*f.columns).collect())) == sorted(map(str, f.collect()))


def test_rigid_motion_and_reflection(make_frames):
    rng = np.random.default_rng(1)
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    q *= np.sign(np.linalg.det(q))
    p = rng.normal(size=(4, 3))
    variants = [p, p @ q.T + 5.0, p * [1, 1, -1]]
    f = make_frames([[("C", *row) for row in v] for v in variants])
    torsion = values(series.dihedral_series(f, 1, 2, 3, 4, wrap_180=True))
    assert torsion[1] == pytest.approx(torsion[0])
    assert torsion[2] == pytest.approx(-torsion[0])
    bend = values(series.angle_series(f, 1, 2, 3))
    assert bend[1] == pytest.approx(bend[0]) and bend[2] == pytest.approx(bend[0])


def test_time_axis_and_hbond(make_frames):
    f = make_frames(ANGLES)
    times = [r.time_ps for r in series.hbond_series(f, 1, 2, 3, 5.0, 2).orderBy("frame_id").collect()]
    step = 5.0 * 2 * 0.02418884326505 / 1000
    assert times == pytest.approx([step, 2 * step])
    assert [r.time_ps for r in series.distance_series(f, 1, 2, 5.0, 2).orderBy("frame_id").collect()] == pytest.approx([0, step])


def hist_of(spark, data, *args, **kw):
    s = spark.createDataFrame([("r", n, float(v)) for n, v in enumerate(data)], "run_id string, frame_id bigint, value double")
    return {r["bin"]: r for r in histogram.histogram(s, *args, **kw).collect()}


def test_histogram_edges(spark):
    assert len(hist_of(spark, [0.05], 0.3, 0.1)) == 2  # 0.3/0.1 truncates to two bins
    opened = hist_of(spark, [0.0, 1.0, 2.0, -0.5], 2.0, 1.0)
    assert [opened[b]["count"] for b in (0, 1)] == [2, 1]  # the limit is dropped, (-1, 0) truncates to bin 0
    clamped = hist_of(spark, [0.0, 1.0, 2.0, 3.5], 2.0, 1.0, edge="clamp")
    assert [clamped[b]["count"] for b in (0, 1)] == [1, 2]
    assert sum(r["pct"] for r in clamped.values()) == pytest.approx(100.0)
    data = np.random.default_rng(0).uniform(-1, 7, 500)
    edges = np.arange(0, 6.0, 0.25)
    want, _ = np.histogram([*data, edges[-1], 0.75], edges, density=True)
    got = hist_of(spark, [*data, edges[-1], 0.75], 6.0, 0.25, edge="closed", norm="density")
    assert [got[b]["density"] for b in range(len(want))] == pytest.approx(list(want))


@pytest.mark.parametrize("n", [3, 5, 6, 30, 150])
def test_smoothing_against_numpy(spark, n):
    p = np.random.default_rng(n).uniform(0.1, 1, n)
    df = spark.createDataFrame([("r", 2 * i, float(v)) for i, v in enumerate(p)], "run_id string, bin int, p double")
    got = [r.p for r in histogram.smooth_edge_padded(df, "p").orderBy("bin").collect()]
    w = 1 if n < 5 else max(5, min(11, n // 12)) | 1
    w = w if n < 5 else min(w, n if n % 2 else n - 1)
    padded = np.pad(p, w // 2, mode="edge")
    assert got == pytest.approx(list(np.convolve(padded, np.ones(w) / w, mode="valid")))


@pytest.mark.parametrize("cell", [None, (9.0, 7.0, 4.0)])
def test_neighbor_pairs_against_brute_force(spark, cell):
    rng = np.random.default_rng(3)
    p = rng.uniform(-6, 12, size=(150, 3))
    p[:40] = p[0] + rng.normal(scale=0.2, size=(40, 3))  # one crowded cell
    df = spark.createDataFrame([("r", i, *map(float, x)) for i, x in enumerate(p)], "run_id string, atom_id int, x double, y double, z double")
    got = {(r.i, r.j): r.d2 for r in neighbors.neighbor_pairs(df, 1.5, ["run_id"], cell=cell).collect()}
    want = {}
    for i in range(150):
        for j in range(i + 1, 150):
            d = p[i] - p[j]
            if cell:
                d = d - np.array(cell) * np.rint(d / np.array(cell))
            if d @ d <= 2.25:
                want[i, j] = d @ d
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k]) for k in want)


@pytest.mark.parametrize("cell", [None, (9.0, 7.0, 4.0), (1.7, 3.5, 20.0)])
def test_packed_pairs_equal_joined_pairs(make_frames, cell):
    rng = np.random.default_rng(4)
    f = make_frames([[("C", *p) for p in rng.uniform(-4, 9, size=(n, 3))] for n in (60, 1, 35, 80)])
    key = ["run_id", "frame_id"]
    read = lambda d: sorted((r.frame_id, r.i, r.j, round(r.d2, 9)) for r in d.collect())
    want = read(neighbors.neighbor_pairs(frames.unpack_frames(f), 1.6, key, cell=cell))
    assert read(neighbors.frame_pairs(f, 1.6, cell=cell)) == want and len(want) > 20
    a = read(topology.dynamic_bonds(f, 1.6).withColumnRenamed("distance", "d2"))
    assert a == read(topology.dynamic_bonds(frames.unpack_frames(f), 1.6).withColumnRenamed("distance", "d2"))


def test_neighbor_rows_are_unique(spark):
    df = spark.createDataFrame([("r", i, 0.1 * i, 0.0, 0.0) for i in range(12)], "run_id string, atom_id int, x double, y double, z double")
    pairs = neighbors.neighbor_pairs(df, 0.3, ["run_id"], cell=(1.2, 1.2, 1.2))
    assert pairs.count() == pairs.select("i", "j").distinct().count()


def test_dynamic_bonds_unknown_element(make_frames):
    f = make_frames([[("H", 0, 0, 0), ("H", 1.2, 0, 0), ("Qq", 0, 1.4, 0), ("C", 0, 0, 1.2)]])
    got = {(r.i, r.j) for r in topology.dynamic_bonds(f, 1.5).collect()}
    assert got == {(1, 3), (1, 4)}  # H-H needs 1.07


def test_alignment_against_numpy(make_frames):
    rng = np.random.default_rng(5)
    clouds = [rng.normal(size=(n, 3)) * [3, 1, 2] for n in (6, 9, 1)]
    f = make_frames([[("C", *row) for row in c] for c in clouds])
    rows = {r.frame_id: np.array([[p.x, p.y, p.z] for p in r.pos]) for r in alignment.align_principal_axes(f).collect()}
    for n, c in enumerate(clouds[:2]):
        q = rows[n]
        cov = q.T @ q / len(q)
        assert np.allclose(q.mean(axis=0), 0)
        assert np.allclose(cov, np.diag(np.sort(np.linalg.eigvalsh(np.cov(c.T, bias=True)))))
        for axis in (0, 2):
            assert q[np.abs(q[:, axis]).argmax(), axis] > 0
        # a rotation, not a reflection
        assert np.linalg.det(np.linalg.lstsq(c - c.mean(axis=0), q, rcond=None)[0]) == pytest.approx(1.0)
    assert np.allclose(rows[2], 0)


def test_clash_pairs_across_the_border(make_frames):
    f = make_frames([[("O", 0.2, 5, 5), ("O", 9.9, 5, 5), ("O", 5, 5, 5)]])
    mol = F.col("atom_id")
    assert [(r.mol_a, r.mol_b) for r in clash.clash_pairs(f, mol, (10, 10, 10), 0.5).collect()] == [(1, 2)]
    assert clash.clash_pairs(f, mol, (10, 10, 10), 0.5, periodic=False).count() == 0


def test_selection(make_frames):
    f = make_frames([BONDS[0]] * 20)
    ids = lambda d: sorted(r.frame_id for r in d.collect())
    assert ids(frames.select_frames(f, 3, 12, 2)) == [3, 6, 9, 12]
    assert ids(frames.select_frames_phase_space(f, 2, 10, 3)) == [1, 4, 7]
    assert ids(frames.select_frames_phase_space(f, 2, 9, 3, overshoot=True)) == [1, 4, 7, 10]
    assert ids(frames.select_frames_phase_space(f, 2, 8, 3, overshoot=True)) == [1, 4, 7]
    with pytest.raises(ValueError):
        frames.select_frames_phase_space(f, 1, 5, 0)
    assert frames.changed_symbol_order(f).count() == 0
    assert math.isclose(frames.range_summary(f, 1, 2, 0, 2).first().mean_distance, 1.0)


# ---- unknown elements, labels, resting runs, cells smaller than the radius ------------------------
@pytest.mark.parametrize("symbol", ["o", "Xx"])
@pytest.mark.parametrize("size", [2, 80])
def test_unknown_elements_are_named(make_frames, symbol, size):
    from kinetrove.operators import ensemble
    from kinetrove.operators.residence import occupancy
    f = make_frames([[(symbol, 0, 0, 0), *[("H", i, 0, 0) for i in range(1, size)]]])
    everyone = list(range(1, size + 1))
    for run in (
        lambda: ensemble.center_of_mass(f, [everyone]), lambda: ensemble.density(f, (9, 9, 9)),
        lambda: occupancy(f, [2], [everyone], 1.0, observed_mode="group_list_com"), lambda: ensemble.bounding_radius(f, [everyone]),
    ):
        with pytest.raises(Exception, match=f"unknown element {symbol}"):
            run().collect()
    assert ensemble.center_of_mass(f, [everyone[1:]]).count() == 1
    assert ensemble.geometric_center(f, [everyone]).count() == 1


@pytest.mark.parametrize("size", [1, 64, 65])
def test_bad_labels_are_refused(make_frames, size):
    from kinetrove.operators import ensemble
    from kinetrove.operators.residence import occupancy
    f = make_frames([[("H", i, 0, 0) for i in range(70)]])
    for bad in (-1, 0):
        group = [*range(1, size), bad]
        for run in (lambda: ensemble.geometric_center(f, [group]), lambda: ensemble.inside_box(f, [group], (9, 9, 9)), lambda: occupancy(f, [1], [group], 1.0, observed_mode="group_list_geometric")):
            with pytest.raises(ValueError, match="start at 1"):
                run()
    with pytest.raises(ValueError):
        occupancy(f, [1], [[-1]], 1.0)


def test_a_run_at_rest_has_no_curve(spark):
    from kinetrove.operators.correlation import autocorrelation
    kind = "run_id string, frame_id bigint, pos array<struct<x:double,y:double,z:double,vx:double,vy:double,vz:double>>"
    rows = [(run, n, [(1.0, 2.0, 3.0, v, 0.0, 0.0)]) for run, v in (("rest", 0.0), ("moves", 1.0)) for n in range(6)]
    got = {(r.run_id, r.lag): r.vaf for r in autocorrelation(spark.createDataFrame(rows, kind), 1, None, 3).collect()}
    assert got["moves", 1] == 1.0 and got["rest", 1] is None and got["rest", 2] is None


def test_images_reach_the_radius(make_frames):
    from kinetrove.operators.rdf import rdf
    f = make_frames([[("C", 0, 0, 0), ("O", 1, 1, 1)]])
    got = rdf(f, 1, "O", 10.0, 0.5, (4, 4, 4)).orderBy("bin").collect()
    near = sum(1 for i in range(-4, 5) for j in range(-4, 5) for k in range(-4, 5) if (1 + 4 * i) ** 2 + (1 + 4 * j) ** 2 + (1 + 4 * k) ** 2 <= 100)
    assert got[-1].coordination == near > 27


def test_gaps_in_frames_are_told(spark):
    from kinetrove.operators.correlation import occupancy_shape
    occ = spark.createDataFrame([("r", 1, f, 1) for f in (0, 2, 4)], "run_id string, object_id int, frame_id bigint, h int")
    with pytest.raises(Exception, match="not consecutive"):
        occupancy_shape(occ).collect()


def test_crowded_cells_are_checked_in_slices(make_frames, monkeypatch):
    from kinetrove.operators import neighbors
    rng = np.random.default_rng(5)
    points = rng.uniform(0, 1, size=(400, 3))
    flat = neighbors.Flat(None, points, np.array([400]), np.array([0]), np.zeros(400, np.int64))
    whole = sorted((int(min(a, b)), int(max(a, b))) for part in neighbors._close(flat, 0.9, None) for a, b in zip(*part[:2]))
    monkeypatch.setattr(neighbors, "CANDIDATES", 1000)
    parts = list(neighbors._close(flat, 0.9, None))
    assert max(len(p[0]) for p in parts) <= 1400 and len(parts) > 20
    assert sorted((int(min(a, b)), int(max(a, b))) for part in parts for a, b in zip(*part[:2])) == whole
    d = np.linalg.norm(points[:, None] - points[None], axis=2)
    assert len(whole) == int((np.triu(d <= 0.9, 1)).sum())


def test_circular_mean_of_angles_around_the_cut(spark):
    rows = spark.createDataFrame([("a", 179.0), ("a", -179.0), ("b", 0.0), ("b", 180.0)], "run_id string, value double")
    got = {r.run_id: r for r in series.circular_stats(rows).collect()}
    assert abs(got["a"].mean) == pytest.approx(180.0) and got["a"].std_dev == pytest.approx(1.0, rel=1e-3)
    assert got["b"].mean is None and got["b"].std_dev is None


def test_full_range_keeps_negative_torsions(spark):
    rows = spark.createDataFrame([("a", v) for v in (-180.0, -91.0, -0.5, 0.5, 180.0)], "run_id string, value double")
    got = {r.center: r["count"] for r in histogram.full_range_histogram(rows, 90.0).collect()}
    assert got == {-135.0: 2, -45.0: 1, 45.0: 1, 135.0: 1}
