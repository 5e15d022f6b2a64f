import pytest
from pyspark.sql import functions as F

from kinetrove.functions.units import unit_rows
from kinetrove.operators import energy, ensemble, frames, states
from kinetrove.sinks import render
from kinetrove.sources import lines as L
from kinetrove.sources import logs, structures, xyz

PO4 = [("P", 0.0, 0.0, 0.0), ("O", 1.5, 0.0, 0.0), ("O", -0.5, 1.4, 0.0), ("O", -0.5, -0.7, 1.2), ("O", -0.5, -0.7, -1.2)]


def block(atoms, comment="c", shift=0.0):
    return f"{len(atoms)}\n{comment}\n" + "".join(f"{s} {x + shift} {y} {z}\n" for s, x, y, z in atoms)


def write(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def rows(df):
    return [(r.frame_id, r.atom_id, r.element, r.x) for r in df.orderBy("frame_id", "atom_id").collect()]


def expected(n, atoms=PO4):
    return [(f, i + 1, a[0], a[1] + f) for f in range(n) for i, a in enumerate(atoms)]


def test_xyz_round_trip(spark, tmp_path):
    p = write(tmp_path, "a.xyz", "".join(block(PO4, shift=f) for f in range(4)))
    atoms = xyz.read_xyz(spark, p)
    assert rows(atoms) == expected(4)
    comp = {r.element: r.n_atoms for r in frames.composition(atoms).collect()}
    assert comp == {"P": 1, "O": 4}
    stats = frames.frame_stats(atoms).first()
    assert (stats.n_frames, stats.min_atoms, stats.max_atoms) == (4, 5, 5)
    out = str(tmp_path / "out")
    render.write_text(render.render_xyz(frames.pack_frames(atoms).withColumn("run_id", F.lit("one"))), out)
    assert rows(xyz.read_xyz(spark, f"{out}/run_id=one")) == expected(4)


@pytest.mark.parametrize("gap,comment", [("\n", "c"), ("\n\n", ""), (" \n", "5"), ("", ""), ("\n", "3 4")])
def test_blank_lines_and_odd_comments(spark, tmp_path, gap, comment):
    p = write(tmp_path, "a.xyz", gap.join(block(PO4, comment, f) for f in range(5)) + "\n\n")
    assert rows(xyz.read_xyz(spark, p)) == expected(5)


def test_many_files_and_splits(spark, tmp_path):
    for n in range(3):
        write(tmp_path, f"run{n}/TRAJEC.xyz", "".join(block(PO4, shift=f) for f in range(200 + n)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = L.number_lines(spark, f"{tmp_path}/run*/TRAJEC.xyz", L.RUN_BY_FOLDER)
        assert lines.rdd.getNumPartitions() > 3
        atoms = xyz.parse_xyz(lines)
        for n in range(3):
            assert rows(atoms.where(F.col("run_id") == f"run{n}")) == expected(200 + n)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


@pytest.mark.parametrize("bad,message", [
    (block(PO4) + block(PO4[:4]) + block(PO4), "atom"),
    (block(PO4) + "5\nc\nP 0 0 0\n", "truncated"),
    (block(PO4).replace("1.5 0.0 0.0", "1.5 0.0"), "four words"),
    (block(PO4).replace("1.5 0.0 0.0", "1.5 abc 0.0"), "not a number"),
])
def test_strict_and_permissive(spark, tmp_path, bad, message):
    p = write(tmp_path, "bad.xyz", block(PO4) + bad)
    with pytest.raises(Exception, match=message):
        xyz.read_xyz(spark, p).collect()
    kept = {r.frame_id for r in xyz.read_xyz(spark, p, mode="PERMISSIVE").collect()}
    assert kept and max(kept) <= 1


def test_symbols_and_order(spark, tmp_path):
    p = write(tmp_path, "a.xyz", "2\n\ncl 0 0 0 extra\nH 1 1 1\n2\n\nH 0 0 0\nCL 1 1 1\n")
    packed = frames.pack_frames(xyz.read_xyz(spark, p, normalise=True))
    assert [r.elements for r in packed.orderBy("frame_id").collect()] == [["Cl", "H"], ["H", "Cl"]]
    assert frames.changed_symbol_order(packed).count() == 1


def test_validation_report(spark, tmp_path):
    text = block(PO4) + "5\n\nP 0 0 0\nO 1 1\nO x 1 1\nO 1 1 1 1\nO 1 1 1\nsix\nc\n"
    p = write(tmp_path, "v.xyz", text)
    found = [(r.line_no, r.error) for r in xyz.validate_xyz(L.number_lines(spark, p)).orderBy("line_no").collect()]
    assert found == [
        (11, "expected 4 items, found 3"), (12, "non-numeric coordinate"), (13, "expected 4 items, found 5"), (15, "invalid number of atoms"),
    ]


def test_phase_space(spark, tmp_path):
    text = "".join(f"{f} {a} {f} 0 0.1 0.2 0.3\n" for f in (10, 20, 30) for a in range(2)) + "40 1 1 1 1 1 1\n"
    p = write(tmp_path, "TRAJECTORY", text)
    symbols = spark.createDataFrame([(1, "O"), (2, "H")], "atom_id int, element string")
    atoms = logs.read_phase_space(spark, p, symbols)
    assert [(r.frame_id, r.element, r.x, r.y, r.vz) for r in atoms.orderBy("frame_id", "atom_id").collect()][:3] == [
        (0, "O", 0.0, 10.0, 0.3), (0, "H", 1.0, 10.0, 0.3), (1, "O", 0.0, 20.0, 0.3)]
    assert atoms.count() == 6
    assert logs.validate_phase_space(spark, p, 2).count() == 0
    assert logs.validate_phase_space(spark, p, 3).count() > 0


def test_plane_wave_files(spark, tmp_path):
    deck = write(tmp_path, "cp.in", "&system\n nat = 2,\n/\nATOMIC_POSITIONS bohr\nO 0 0 0\nH 1 1 1\n")
    labels = logs.read_cp_labels(spark, deck)
    data = write(tmp_path, "a.pos", "t 1\n1 0 0\n3 0 4\nt 2\n2 0 0\n0 0 1\n")
    pos = logs.read_cp_frames(spark, data, labels).orderBy("frame_id", "atom_id").collect()
    assert [(r.element, round(r.x, 6)) for r in pos] == [("O", 0.529177), ("H", 1.587532), ("O", 1.058354), ("H", 0.0)]
    force = logs.read_cp_frames(spark, data, labels, "for").orderBy("frame_id", "atom_id").collect()
    assert [r.force for r in force] == [1.0, 5.0, 2.0, 1.0]


def test_snapshots(spark, tmp_path):
    a = write(tmp_path, "s/a", "2\nnote\nO 0 0 0 1 0 0\nH 1 0 0 0 2 0 7 8 9\n")
    b = write(tmp_path, "s/b", "# note\n\nO 0 0 0 1 0 0\n# x\nH 1 0 0 0 2 0 7 8 9\n")
    for p in (a, b):
        got = logs.read_snapshot(spark, p).orderBy("atom_id").collect()
        assert [(r.atom_id, r.element, r.vx, r.vy, r.fz) for r in got] == [(1, "O", 1.0, 0.0, 0.0), (2, "H", 0.0, 2.0, 9.0)]
    fast = logs.read_snapshot(spark, a, unit="angstrom_fs").orderBy("atom_id").first()
    assert fast.vx == pytest.approx(1 / 21.8769126379)


@pytest.mark.parametrize("text", ["3\nnote\nO 0 0 0 1 0 0\nH 1 0 0 0 2 0\n", "2\n", "1\nnote"])
def test_cut_snapshots_fail(spark, tmp_path, text):
    write(tmp_path, "s/whole", "1\nnote\nO 0 0 0 1 0 0\n")
    write(tmp_path, "s/cut", text)
    with pytest.raises(Exception, match="fewer atom lines.*cut"):
        logs.read_snapshot(spark, str(tmp_path / "s")).collect()


def test_runs_without_symbols_fail(spark, tmp_path):
    for run in ("one", "two"):
        write(tmp_path, f"{run}/T", "1 0 0 0 1 1 1\n1 1 0 0 1 1 1\n")
        write(tmp_path, f"{run}/P", "t\n1 0 0\n1 0 1\n")
    symbols = spark.createDataFrame([("one", 1, "O"), ("one", 2, "H")], "run_id string, atom_id int, element string")
    sizes = symbols.groupBy("run_id").count().withColumnRenamed("count", "n_atoms")
    path = [f"{tmp_path}/one/T", f"{tmp_path}/two/T"]
    with pytest.raises(Exception, match="no symbols or size for run two"):
        logs.read_phase_space(spark, path, symbols, run_pattern=L.RUN_BY_FOLDER).collect()
    with pytest.raises(Exception, match="no symbols or size for run two"):
        logs.validate_phase_space(spark, path, sizes, run_pattern=L.RUN_BY_FOLDER).collect()
    with pytest.raises(Exception, match="no symbols or size for run two"):
        logs.read_cp_frames(spark, f"{tmp_path}/*/P", symbols, run_pattern=L.RUN_BY_FOLDER).collect()
    gap = spark.createDataFrame([(1, "O"), (3, "H")], "atom_id int, element string")
    with pytest.raises(Exception, match="no symbol for atom 2 of run one"):
        logs.read_phase_space(spark, path[0], gap, run_pattern=L.RUN_BY_FOLDER).collect()


def test_states(spark, tmp_path):
    write(tmp_path, "r1/SH_STATE.dat", "0 1\n1 1\n2 2\n3 0\n")
    write(tmp_path, "r2/SH_STATE.dat", "0 1\n1 3\n")
    write(tmp_path, "r3/SH_STATE.dat", "0 1\n1 9\nx 1\n1 2 3\n")
    log = logs.read_states(spark, f"{tmp_path}/r*/SH_STATE.dat", 3)
    assert log.where("error is not null").count() == 3
    good = states.valid_states(log, 3)
    got = {r.state: (r.average, r.percent) for r in states.state_population(good, 3).collect()}
    assert got[1] == (2.0, pytest.approx(50.0)) and got[2] == (1.0, pytest.approx(25.0)) and got[3] == (1.0, pytest.approx(25.0))
    f = spark.createDataFrame([("r1", 2), ("r1", 7)], "run_id string, frame_id bigint")
    assert {r.frame_id: r.state for r in states.frames_by_state(f, good).collect()} == {2: "2", 7: "unknown"}


def test_energy_logs(spark, tmp_path):
    p = write(tmp_path, "ENERGY", "1 0.1 300 -10 -9 -8.9 0 1.5\n2 0.2 310 -11 -9.5 -9.3 0 1.6\n")
    e = energy.energy_columns(logs.read_energy(spark, p), 5.0, "fs").orderBy("step").collect()
    assert e[1].ionic_kinetic == pytest.approx(1.5) and e[1].x == pytest.approx(2 * 5 * 0.024188)
    with pytest.raises(Exception, match="invalid format"):
        logs.read_energy(spark, write(tmp_path, "BAD", "1 2 3\n")).collect()
    for text in ("\ntime, T\n1.0, 300\n2.0,x\n3.0,1,2\n", "time T\n1.0 300\n2.0 x\n\n3.0 1 2\n"):
        good, bad = logs.read_energy_headered(spark, write(tmp_path, f"h{len(text)}", text))
        assert good.columns == ["run_id", "line_no", "T", "time"] and [tuple(r)[2:] for r in good.collect()] == [(300.0, 1.0)]
        assert bad.count() == 2
    with pytest.raises(Exception, match="duplicate column names"):
        logs.read_energy_headered(spark, write(tmp_path, "dup", "a a\n1 2\n"))


@pytest.mark.parametrize("fmt,digits", [("xyz", 8), ("pdb", 3), ("ent", 3), ("hin", 6), ("mol", 4), ("mol2", 4), ("gaussian", 8)])
def test_structure_round_trip(spark, make_frames, fmt, digits):
    f = make_frames([[("Cl", 0.123456789, -12.5, 100.25), ("H", 1, 2, 3)], [("O", 1, 1, -1)]])
    text = render.render_structures(f, fmt).select(F.col("frame_id").cast("string").alias("run_id"), F.col("text").alias("value"))
    got = structures.parse_structures(text, fmt).orderBy("run_id", "atom_id").collect()
    assert [(r.run_id, r.atom_id, r.element) for r in got] == [("0", 1, "Cl"), ("0", 2, "H"), ("1", 1, "O")]
    assert got[0].x == pytest.approx(0.123456789, abs=0.5 * 10**-digits) and got[0].z == 100.25


def test_decks_and_gaussian_inputs(spark, make_frames, tmp_path):
    deck = "&SYSTEM\n CELL\n 10 1 1 0 0 0\n&END\n&ATOMS\n*SI_VDB.psp FORMATTED\n LMAX=P\n 2\n 1.0D0 0 0\n\n 2.0 0 0\n*H_x\n LMAX=S\n1\n0 0 1\n&END\n"
    p = write(tmp_path, "in.cpmd", deck)
    got = structures.read_structures(spark, p, "cpmd").orderBy("atom_id").collect()
    assert [(r.element, round(r.x, 6), round(r.z, 6)) for r in got] == [("Si", 0.529177, 0), ("Si", 1.058354, 0), ("H", 0, 0.529177)]
    angstrom = structures.read_structures(spark, write(tmp_path, "b.cpmd", deck.replace(" CELL", " ANGSTROM\n CELL")), "cpmd")
    assert angstrom.orderBy("atom_id").first().x == 1.0
    with pytest.raises(Exception, match="header says"):
        structures.read_structures(spark, write(tmp_path, "bad.xyz", "3\n\nH 0 0 0\n"), "xyz").collect()
    text = render.gaussian_inputs(make_frames([PO4]), "a.chk", "4GB", "8", "b3lyp", -3, 1).first().text
    assert text.startswith("%chk=a.chk\n%Mem=4GB\n%nproc=8\n# b3lyp\n\n") and "\n-3 1\nP " in text


def test_units(spark):
    df = spark.createDataFrame([(1.0, "Eh", "eV"), (2.0, "KCAL/MOL", "cal/mol"), (1.0, "nope", "ev")], "v double, a string, b string")
    got = energy.convert_units(df, "v", "a", "b", "energy").collect()
    assert {r.a: r.converted for r in got if r.unit_error is None} == {"Eh": pytest.approx(27.211386245988, rel=1e-10), "KCAL/MOL": pytest.approx(2000.0)}
    assert [r.unit_error for r in got if r.unit_error] == ["Unsupported unit nope"]
    speeds = {name: factor for name, _, factor in unit_rows("velocity")}
    assert speeds["kph"] == pytest.approx(1 / 3.6) and speeds["mph"] == pytest.approx(0.44704) and speeds["yard/minute"] == pytest.approx(0.01524)
    with pytest.raises(ValueError):
        unit_rows("colour")


def test_long_and_packed_centres_agree(spark, make_frames):
    f = make_frames([PO4, PO4])
    groups = [[1, 2], [3, 4, 5]]
    table = spark.createDataFrame([(g + 1, a) for g, ids in enumerate(groups) for a in ids], "group_id int, atom_id int")
    for masses in (None, "general"):
        a = sorted(tuple(r) for r in ensemble.group_centers(f, groups, masses).collect())
        b = sorted(tuple(r) for r in ensemble.group_centers(frames.unpack_frames(f), table, masses).collect())
        assert [x[:3] for x in a] == [x[:3] for x in b]
        assert [v for x in a for v in x[3:]] == pytest.approx([v for x in b for v in x[3:]])
    wide = ensemble.geometric_center(f, [list(range(1, 6)) * 20]).first()
    assert wide.x == pytest.approx(0.0)


def test_rate_against_formula(spark):
    import math
    r = energy.rate_constant(spark.createDataFrame([(50000.0, -10.0)], "ea double, entropy double"), 300.0).first()
    want = 1.380649e-23 * 300 / 6.62607015e-34 * math.exp(-10 / 8.3144621) * math.exp(-50000 / (8.3144621 * 300))
    assert r.rate == pytest.approx(want, rel=1e-12)


def test_frames_written_by_state(spark, make_frames, tmp_path):
    f = make_frames([PO4] * 6, run="r1")
    log = spark.createDataFrame([("r1", k, k, 1 + k % 2) for k in range(5)], "run_id string, row_idx bigint, step int, state int")
    for _ in range(2):
        render.write_frames_by_state(states.frames_by_state(f, log), str(tmp_path / "s"))
    counts = {s: xyz.read_xyz(spark, str(tmp_path / "s" / f"state={s}")).count() for s in ("1", "2", "unknown")}
    assert counts == {"1": 15, "2": 10, "unknown": 5}


def test_kinetic_energy_and_aim(spark):
    names = ("x", "y", "z", "vx", "vy", "vz")
    atoms = [(0, 0, 0, 0.001, 0, 0), (2, 0, 0, 0, 0.001, 0), (9, 9, 9, 1, 1, 1)]
    f = spark.createDataFrame([("r", 0, ["H", "H", "O"], [dict(zip(names, map(float, a))) for a in atoms])],
        "run_id string, frame_id bigint, elements array<string>, pos array<struct<%s>>" % ",".join(f"{c}:double" for c in names))
    k = ensemble.kinetic_energy(f, [1, 2]).first()
    v = 2.18769126379e6 * 0.001
    assert k.kj_mol == pytest.approx(0.5 * 2 * 1.00784e-3 * (v * v / 2) / 1000)
    assert k.kcal_mol == pytest.approx(k.kj_mol * 0.239005736)
    aimed = {r.atom_id: r for r in ensemble.aim_velocity(f, [1, 2], (1.0, 5.0, 0.0), 0.01).collect()}
    assert (aimed[1].vx, aimed[1].vy) == (pytest.approx(0.0005), pytest.approx(0.0095))
    assert aimed[3].vx == 1.0
    body = {r.atom_id: r for r in ensemble.aim_velocity(f, [1, 2], (1.0, 5.0, 0.0), 0.01, False, True).collect()}
    assert (body[1].vx, body[2].vy, body[3].vz) == (0.0, pytest.approx(0.01), 0.0)


def test_box_measures(spark, make_frames):
    f = make_frames([[("O", 1, 1, 1), ("H", 9, 5, 5), ("H", 5, 5, 5)]])
    got = {r.group_id: r.inside for r in ensemble.inside_box(f, [[1], [2, 3], [3]], (10, 10, 10), 1.5).collect()}
    assert got == {1: False, 2: False, 3: True}
    slab = {r.group_id: r.inside for r in ensemble.inside_box(f, [[1], [3]], (10, 10, 10), 1.0, slab=(0.0, 5.0)).collect()}
    assert slab == {1: True, 2: True}
    d = ensemble.density(f, (10, 10, 10)).first().density
    assert d == pytest.approx((15.999 + 2 * 1.00784) * 1.66053906660e-24 / 1e-21)
    specs = spark.createDataFrame([(30.0, 30.0, 30.0, 1.0, 100.0, 18.015)], "a double, b double, c double, density double, solute_mass double, molecule_mass double")
    raw = (27000 * 1e-24 / 1.66053906660e-24 - 100) / 18.015
    assert ensemble.target_molecules(specs).first().n_molecules == int(raw)
    assert ensemble.target_molecules(specs, "round").first().n_molecules == round(raw)


def test_uniform_points_have_flat_rdf(make_frames):
    import numpy as np
    from kinetrove.operators.rdf import rdf
    rng = np.random.default_rng(0)
    cloud = lambda: [("C", 5, 5, 5)] + [("O", *p) for p in rng.uniform(0, 10, size=(300, 3))]
    got = rdf(make_frames([cloud() for _ in range(20)]), 1, "O", 4.5, 0.5, (10, 10, 10)).orderBy("bin").collect()
    assert [r.g for r in got[2:]] == pytest.approx([1.0] * 7, abs=0.12)
    assert got[-1].coordination == pytest.approx(300 * 4 / 3 * np.pi * 4.5**3 / 1000, rel=0.05)


# ---- nothing may be lost without an error ----------------------------------------------------------
@pytest.mark.parametrize("built,acted", [(2, 4), (4, 2)])
def test_lines_survive_another_cut_of_the_file(spark, tmp_path, built, acted):
    p = write(tmp_path, "big.xyz", "".join(f"3\nc\nO {f} 0 0\nH 0 1 0\nH 0 0 1\n" for f in range(20_000)))
    try:
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", built)
        spark.conf.set("spark.sql.files.openCostInBytes", "1024")
        atoms, lines = xyz.read_xyz(spark, p), L.number_lines(spark, p)
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", acted)
        assert atoms.count() == 60_000 and atoms.agg(F.max("frame_id")).first()[0] == 19_999
        last = lines.agg(F.count("*"), F.max("line_no"), F.countDistinct("line_no")).first()
        assert tuple(last) == (100_000, 99_999, 100_000)
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
        spark.conf.unset("spark.sql.files.openCostInBytes")


WATER = [("O", 0.0, 0.0, 0.0), ("H", 1.0, 0.0, 0.0)]


def test_leading_blank_line(spark, tmp_path):
    p = write(tmp_path, "a.xyz", "\n" + block(WATER) + block(WATER, shift=1.0))
    assert rows(xyz.read_xyz(spark, p)) == expected(2, WATER)


@pytest.mark.parametrize("text,message", [
    ("two\nc\nO 0 0 0\nH 1 0 0\n", "invalid atom count in frame 1, line 1"),
    ("-2\nc\nO 0 0 0\nH 1 0 0\n", "invalid atom count in frame 1, line 1"),
    ("\n0\nc\n" + block(WATER), "invalid atom count in frame 1, line 2"),
    (block(WATER) + "\n" + block(WATER)[:-len("H 1.0 0.0 0.0\n")] + block(WATER), "in frame 2"),
    (block(WATER) + "x\n" + block(WATER), "invalid atom count in frame 2, line 5"),
    (block(WATER) + "2\n", "truncated frame in frame 2, line 5"),
])
def test_strict_names_the_bad_frame(spark, tmp_path, text, message):
    p = write(tmp_path, "bad.xyz", text)
    # Which of several bad lines STRICT meets first depends on the tasks; the report names the first one.
    with pytest.raises(Exception, match=r"in frame \d+, line \d+"):
        xyz.read_xyz(spark, p).collect()
    found = xyz.corrupt_frames(L.number_lines(spark, p)).collect()
    assert len(found) == 1 and message in found[0].error
    kept = xyz.read_xyz(spark, p, mode="PERMISSIVE").count()
    assert kept == 2 * found[0].frame_id


def test_validation_follows_changing_counts(spark, tmp_path):
    three = [*WATER, ("C", 2.0, 0.0, 0.0)]
    bad = block(WATER).replace("O 0.0 0.0 0.0", "O 0.0 0.0").replace("H 1.0 0.0 0.0", "H 1.0 x 0.0")
    p = write(tmp_path, "v.xyz", block(WATER) + block(three) + bad + block(three))
    found = [(r.line_no, r.error) for r in xyz.validate_xyz(L.number_lines(spark, p)).orderBy("line_no").collect()]
    assert found == [(12, "expected 4 items, found 3"), (13, "non-numeric coordinate")]


def test_two_files_of_one_run_are_refused(spark, tmp_path):
    for name in ("a.xyz", "b.xyz"):
        write(tmp_path, f"run/{name}", block(WATER))
    with pytest.raises(Exception, match="two files have the run name run"):
        xyz.read_xyz(spark, f"{tmp_path}/run/*.xyz", run_pattern=L.RUN_BY_FOLDER).collect()


def test_headered_energies_of_several_files(spark, tmp_path):
    write(tmp_path, "e1/E", "step,T\n1,300\n2,310\n")
    write(tmp_path, "e2/E", '"T","E, total"\n"301","-5.5"\n302,bad\n')
    good, bad = logs.read_energy_headered(spark, f"{tmp_path}/e*/E", L.RUN_BY_FOLDER)
    got = sorted(tuple(r) for r in good.select("run_id", "T", "step", "E, total").fillna(-1.0).collect())
    assert got == [("e1", 300.0, 1.0, -1.0), ("e1", 310.0, 2.0, -1.0), ("e2", 301.0, -1.0, -5.5)]
    assert [(r.run_id, r.line_no, r.error) for r in bad.collect()] == [("e2", 3, "column 'E, total' is not numeric")]


def test_symbols_of_the_own_run(spark, tmp_path):
    write(tmp_path, "p1/T", "1 0 0 0 0 0 0\n1 1 0 0 0 0 0\n2 0 0 0 0 0 0\n2 1 0 0 0 0 0\n")
    write(tmp_path, "p2/T", "1 5 0 0 0 0 0\n2 6 0 0 0 0 0\n")
    symbols = spark.createDataFrame([("p1", 1, "O"), ("p1", 2, "H"), ("p2", 1, "Xe")], "run_id string, atom_id int, element string")
    atoms = logs.read_phase_space(spark, f"{tmp_path}/p*/T", symbols, run_pattern=L.RUN_BY_FOLDER)
    got = sorted((r.run_id, r.frame_id, r.atom_id, r.element, r.x) for r in atoms.collect())
    assert got == [("p1", 0, 1, "O", 0.0), ("p1", 0, 2, "H", 1.0), ("p1", 1, 1, "O", 0.0), ("p1", 1, 2, "H", 1.0), ("p2", 0, 1, "Xe", 5.0), ("p2", 1, 1, "Xe", 6.0)]


def test_runs_need_sound_trajectories_too(spark):
    log = spark.createDataFrame([(r, k, k, 1) for r in "abc" for k in range(3)], "run_id string, row_idx bigint, step int, state int")
    errors = spark.createDataFrame([("b", 3, "x"), ("b", 9, "y")], "run_id string, line_no bigint, error string")
    assert {r.run_id for r in states.valid_states(log, 2, errors).collect()} == {"a", "c"}
