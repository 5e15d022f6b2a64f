"""Queries over text: the given tables are rendered as the files a program writes and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetrove.operators import histogram, rdf, series, states, tiles, topology
from kinetrove.operators.frames import unpack_frames
from kinetrove.plans import tables as T
from kinetrove.plans.queries import CONNECT, DT, SAMPLING, N_STATES, _bond, _round, query
from kinetrove.plans.staging import attach, scratch, stage
from kinetrove.sinks import render
from kinetrove.sources import logs, structures, xyz

SHORT_FRAME, BROKEN_FRAME = 97, 89
WIDE_R, WIDE_BIN = 14.0, 0.2


def _lines(rows: DataFrame, line_no: Column, value: Column) -> DataFrame:
    """run_id, line_no, value with the head and number of lines of the run, as a file reader gives them.

    The text is written once, as a reader does, and not rendered again for every look at it.
    """
    lines = stage(rows.select("run_id", line_no.cast("bigint").alias("line_no"), value.alias("value")), "lines")
    per_run = lines.groupBy("run_id").agg(F.min_by("value", "line_no").alias("head"), (F.max("line_no") + 1).alias("n_lines"))
    return attach(lines, per_run, ["run_id"], spread="line_no")


def _atom_lines(frames: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """One row per atom with its fields as words separated by blanks."""
    rows = frames.select("run_id", "frame_id", F.posexplode(F.arrays_zip("elements", "pos")).alias("a", "e"))
    words = F.concat_ws(" ", *[F.col(f"e.pos.{c}").cast("string") for c in fields])
    return rows.select("run_id", "frame_id", "a", F.col("e.elements").alias("element"), words.alias("words"))


# ---- damaged XYZ runs ----------------------------------------------------------------------------
def _run_lines(spark, sf) -> DataFrame:
    """XYZ files of many runs. Some frames have an atom line that is no number, some tell one atom more than they have."""
    frames = T.traj_runs(spark, sf)
    text = render.render_xyz(frames, keep=("vec_id",))
    lines = text.select("run_id", "frame_id", "vec_id", F.posexplode(F.split("text", "\n")).alias("k", "v"))
    broken = (F.col("vec_id") % BROKEN_FRAME == 7) & (F.col("k") == 9)
    short = (F.col("vec_id") % SHORT_FRAME == 3) & (F.col("k") == 0)
    value = F.when(broken, F.regexp_replace("v", r"\S+$", "abc")).when(short, str(T.N_ATOMS + 1)).otherwise(F.col("v"))
    return _lines(lines, F.col("frame_id") * (T.N_ATOMS + 2) + F.col("k"), value)


@query
def xyz_permissive(spark, sf):
    atoms = xyz.parse_xyz(_run_lines(spark, sf), mode="PERMISSIVE")
    return atoms.groupBy("run_id", "frame_id").agg(F.count(F.lit(1)).alias("n_atoms"), F.round(F.sum("x"), 7).alias("sum_x"))


@query
def xyz_corrupt(spark, sf):
    return xyz.corrupt_frames(_run_lines(spark, sf)).select("run_id", "frame_id", "line_no", "error")


@query
def xyz_changing_counts(spark, sf):
    """Files whose frames differ in size: every third frame has lost its last atom, and says so."""
    text = render.render_xyz(T.traj_frames(spark, sf)).select("run_id", "frame_id", F.split("text", "\n").alias("l"))
    less = F.concat(F.array(F.lit(str(T.N_ATOMS - 1))), F.slice("l", 2, T.N_ATOMS))
    third = F.col("frame_id") % 3 == 2
    frames = text.select("run_id", "frame_id", F.posexplode(F.when(third, less).otherwise(F.col("l"))).alias("k", "v"))
    at = F.col("frame_id") * (T.N_ATOMS + 2) - F.floor((F.col("frame_id")) / 3) + F.col("k")
    broken = (F.col("frame_id") % 10 == 3) & (F.col("k") == 6)
    return xyz.validate_xyz(_lines(frames, at, F.when(broken, F.regexp_replace("v", r"\S+$", "abc")).otherwise(F.col("v"))))


def _state_log(spark, sf) -> DataFrame:
    """State logs as text; some lines miss a word, some hold a state that does not exist."""
    rows = T.sh_states(spark, sf)
    state = F.when(F.col("step") % 101 == 5, F.lit(" 9")).when(F.col("step") % 103 == 6, F.lit("")).otherwise(F.concat(F.lit(" "), F.col("state").cast("string")))
    return _lines(rows, F.col("row_idx"), F.concat(F.col("step").cast("string"), state))


@query
def state_log(spark, sf):
    return logs.parse_states(_state_log(spark, sf), N_STATES).withColumn("state", F.coalesce("state", F.lit(-1)))


@query
def valid_runs(spark, sf):
    """Populations of the runs whose state log and trajectory are both sound; damage is rare enough to leave some."""
    rows = T.sh_states(spark, sf)
    state = F.when((F.col("run_id") == "3") & (F.col("row_idx") == 5), F.lit("9")).otherwise(F.col("state").cast("string"))
    log = logs.parse_states(_lines(rows, F.col("row_idx"), F.concat_ws(" ", F.col("step").cast("string"), state)), N_STATES)
    text = render.render_xyz(T.traj_runs(spark, sf))
    lines = text.select("run_id", "frame_id", F.posexplode(F.split("text", "\n")).alias("k", "v"))
    broken = F.col("run_id").isin("1", "7") & (F.col("frame_id") == 4) & (F.col("k") == 9)
    lines = _lines(lines, F.col("frame_id") * (T.N_ATOMS + 2) + F.col("k"), F.when(broken, F.regexp_replace("v", r"\S+$", "")).otherwise(F.col("v")))
    sound = states.valid_states(log, N_STATES, xyz.validate_xyz(lines))
    return _round(states.state_population(sound, N_STATES), 6, "average", "percent")


# ---- phase space and plane-wave files --------------------------------------------------------------
def _two_runs(spark, sf) -> DataFrame:
    """Even frames and odd frames as two systems of their own size."""
    f = T.traj_vel(spark, sf)
    odd = F.col("frame_id") % 2 == 1
    size = F.when(odd, T.N_ATOMS_VEL - 3).otherwise(T.N_ATOMS_VEL)
    return f.select(
        F.when(odd, "odd").otherwise("even").alias("run_id"), F.floor(F.col("frame_id") / 2).alias("frame_id"),
        F.slice("elements", 1, size).alias("elements"), F.slice("pos", 1, size).alias("pos"), size.alias("size"),
    )


def _symbols(frames: DataFrame) -> DataFrame:
    first = frames.where(F.col("frame_id") == 0).select("run_id", F.posexplode("elements").alias("a", "element"))
    return first.select("run_id", (F.col("a") + 1).alias("atom_id"), "element")


def _phase_space(frames: DataFrame, first_word: Column) -> DataFrame:
    rows = _atom_lines(frames, ("x", "y", "z", "vx", "vy", "vz")).join(_sizes(frames), "run_id")
    return _lines(rows, F.col("frame_id") * F.col("size") + F.col("a"), F.concat_ws(" ", first_word, "words"))


def _sizes(frames: DataFrame) -> DataFrame:
    return frames.groupBy("run_id").agg(F.max("size").alias("size"))


@query
def phase_space(spark, sf):
    frames = _two_runs(spark, sf)
    atoms = logs.parse_phase_space(_phase_space(frames, F.col("frame_id").cast("string")), _symbols(frames))
    return _round(atoms, 6, "x", "y", "z", "vx", "vy", "vz")


@query
def phase_space_errors(spark, sf):
    frames = _two_runs(spark, sf)
    odd = F.when((F.col("frame_id") % 20 == 3) & (F.col("a") == 2), "x").when((F.col("frame_id") % 30 == 7) & (F.col("a") == 4), "0")
    lines = _phase_space(frames, F.coalesce(odd, F.col("frame_id").cast("string")))
    return logs.phase_space_errors(lines, _sizes(frames).withColumnRenamed("size", "n_atoms"))


def _plane_wave(spark, sf, kind: str, fields: tuple[str, ...]) -> DataFrame:
    frames = _two_runs(spark, sf)
    rows = _atom_lines(frames, fields).join(_sizes(frames), "run_id")
    start = F.col("frame_id") * (F.col("size") + 1)
    title = rows.where("a = 0").select("run_id", start.alias("n"), F.lit(" 1 0.5").alias("v"))
    body = rows.select("run_id", (start + F.col("a") + 1).alias("n"), F.regexp_replace("words", "E", "D").alias("v"))
    deck = _lines(
        rows.where("frame_id = 0").groupBy("run_id", "size").agg(F.sort_array(F.collect_list(F.struct("a", "element"))).alias("e"))
        .select("run_id", F.posexplode(F.concat(
            F.array(F.lit("&system"), F.concat(F.lit(" nat = "), F.col("size").cast("string"), F.lit(",")), F.lit("/"), F.lit("ATOMIC_POSITIONS bohr")),
            F.transform("e.element", lambda s: F.concat(s, F.lit(" 0 0 0"))),
        )).alias("n", "v")), F.col("n"), F.col("v"))
    return logs.parse_cp_frames(_lines(title.unionByName(body), F.col("n"), F.col("v")), logs.parse_cp_labels(deck), kind)


@query
def cp_frames(spark, sf):
    return _round(_plane_wave(spark, sf, "pos", ("x", "y", "z")), 6, "x", "y", "z")


@query
def cp_forces(spark, sf):
    return _round(_plane_wave(spark, sf, "for", ("vx", "vy", "vz")), 6, "force")


@query
def snapshots(spark, sf):
    """A file per frame; even ones begin with a count and a note, odd ones have a comment and a blank line."""
    frames = T.traj_vel(spark, sf).withColumn("run_id", F.concat("run_id", F.lit("/"), F.col("frame_id").cast("string")))
    rows = _atom_lines(frames, ("x", "y", "z", "vx", "vy", "vz")).select("run_id", "frame_id", "a", F.concat_ws(" ", "element", "words").alias("v"))
    even = F.col("frame_id") % 2 == 0
    body = rows.select("run_id", (F.col("a") + F.when(even | (F.col("a") < 4), 2).otherwise(3)).alias("n"), "v")
    count = F.array(F.lit(str(T.N_ATOMS_VEL)), F.lit("note"))
    head = frames.select("run_id", F.posexplode(F.when(even, count).otherwise(F.array(F.lit("# note"), F.lit("")))).alias("n", "v"))
    blank = frames.where(~even).select("run_id", F.lit(6).alias("n"), F.lit("  # between").alias("v"))
    lines = _lines(body.unionByName(head).unionByName(blank), F.col("n"), F.col("v"))
    return _round(logs.parse_snapshots(lines).drop("fx", "fy", "fz"), 6, "x", "y", "z", "vx", "vy", "vz")


# ---- energies ------------------------------------------------------------------------------------
@query
def energy_log(spark, sf):
    e = T.energy_log(spark, sf)
    text = F.concat_ws("  ", *[F.col(c).cast("string") for c in ("step", *logs.ENERGY_COLUMNS)])
    lines = e.select(F.expr("concat('r', step div 1000000000000L)").alias("run_id"), F.col("step").alias("n"), text.alias("v"))
    return _round(logs.parse_energy(_lines(lines, F.col("n"), F.col("v"))), 6, *logs.ENERGY_COLUMNS)


@query
def energy_headered(spark, sf):
    """Three runs with headers of their own: quoted cells, plain commas, blanks. A few cells are no numbers."""
    e = T.energy_log(spark, sf).withColumn("k", F.col("step") % 3)
    run = F.element_at(F.array(F.lit("blanks"), F.lit("commas"), F.lit("quotes")), (F.col("k") + 1).cast("int"))
    t, ks = F.col("temperature").cast("string"), F.when(F.col("step") % 50 == 7, "bad").otherwise(F.col("e_ks").cast("string"))
    step = F.col("step").cast("string")
    value = F.when(F.col("k") == 0, F.concat_ws("   ", step, t)).when(F.col("k") == 1, F.concat_ws(" , ", step, ks, t)).otherwise(
        F.concat(F.lit('"'), step, F.lit('","'), t, F.lit('",'), ks))
    rows = e.select(run.alias("run_id"), (F.floor(F.col("step") / 3) + 2).alias("n"), value.alias("v"))
    heads = rows.groupBy("run_id").agg(F.max("n").alias("n")).select("run_id", F.lit(1).cast("bigint").alias("n"), F.expr(
        """CASE run_id WHEN 'blanks' THEN 'step T' WHEN 'commas' THEN 'step,E KS,T' ELSE '"step","T","E KS"' END""").alias("v"))
    found = logs.parse_energy_headered(_lines(rows.unionByName(heads), F.col("n"), F.col("v")))
    named = [logs.energy_column(found, c).alias(n) for c, n in (("step", "step"), ("T", "temperature"), ("E KS", "e_ks"))]
    return _round(found.select("run_id", "line_no", *named, "error"), 6, "temperature", "e_ks")


# ---- written results, read back --------------------------------------------------------------------
@query
def series_csv(spark, sf):
    """A bond series as CSV with a header."""
    rows = _bond(spark, sf)
    path = scratch(spark, "series")
    render.write_series(rows, path)
    return _round(spark.read.schema(rows.schema).option("header", True).csv(path), 6, "time_ps", "value")


@query
def state_files(spark, sf):
    """Frames of all runs, split by state and written as XYZ files, then read as trajectories."""
    path = scratch(spark, "states")
    render.write_frames_by_state(states.frames_by_state(T.traj_runs(spark, sf), T.cut_states(spark, sf)), path)
    atoms = xyz.read_xyz(spark, f"{path}/*")
    state = F.regexp_extract("run_id", "/state=([^/]+)/[^/]+$", 1).alias("state")
    return _round(atoms.select(state, "atom_id", "element", "x", "y", "z"), 7, "x", "y", "z")


# ---- decks and inputs ------------------------------------------------------------------------------
@query
def structures_cpmd(spark, sf):
    """A deck per frame with one section for each element in turn."""
    frames = T.traj_frames(spark, sf)

    def section(e: str) -> Column:
        own = F.filter(F.arrays_zip("elements", "pos"), lambda a: a["elements"] == e)
        lines = F.transform(own, lambda a: F.concat_ws(" ", *[F.regexp_replace(a["pos"][c].cast("string"), "E", "D") for c in "xyz"]))
        return F.concat(F.lit(f"*{e}_PBE.psp\n LMAX=P\n "), F.size(own).cast("string"), F.lit("\n"), F.array_join(lines, "\n"), F.lit("\n"))

    text = F.concat(F.lit("&SYSTEM\n CELL\n 12 1 1 0 0 0\n&END\n&ATOMS\n"), *[section(e) for e in T.ELEMENTS], F.lit("&END\n"))
    files = frames.select(F.concat("run_id", F.lit("/"), F.col("frame_id").cast("string")).alias("run_id"), text.alias("value"))
    return _round(structures.parse_structures(files, "cpmd"), 6, "x", "y", "z")


@query
def gaussian_inputs(spark, sf):
    text = render.gaussian_inputs(T.traj_frames(spark, sf), "run.chk", "4GB", 8, "b3lyp/6-31g*", -1, 2)
    files = text.select(F.concat("run_id", F.lit("/"), F.col("frame_id").cast("string")).alias("run_id"), F.col("text").alias("value"))
    return structures.parse_structures(files, "gaussian")


# ---- pair correlation beyond one cell --------------------------------------------------------------
@query
def coordination_wide(spark, sf):
    g = rdf.rdf(T.traj_frames(spark, sf), 1, "O", WIDE_R, WIDE_BIN, T.CELL, exclude=(3,))
    return _round(g, 5, "r", "g", "coordination")


# ---- options beside the usual rules ------------------------------------------------------------------
def _torsion(spark, sf) -> DataFrame:
    return series.dihedral_series(T.traj_frames(spark, sf), 1, 2, 3, 4, DT, SAMPLING, wrap_180=True)


@query
def dihedral_full_range(spark, sf):
    return _round(histogram.full_range_histogram(_torsion(spark, sf), 10.0), 6, "center", "pct")


@query
def dihedral_circular(spark, sf):
    return _round(series.circular_stats(_torsion(spark, sf)), 6, "mean", "resultant", "std_dev")


@query
def static_bonds(spark, sf):
    return _round(topology.static_bonds(T.traj_frames(spark, sf), CONNECT), 6, "distance")


@query
def tiled_pairs(spark, sf):
    """Close pairs in a periodic cell, each frame cut into tiles."""
    pairs = tiles.tile_pairs(unpack_frames(T.traj_frames(spark, sf)), CONNECT, edge=4.0, cell=T.CELL)
    return pairs.select("run_id", "frame_id", "i", "j", F.round("d2", 6).alias("d2"))


@query
def solute_bonds(spark, sf):
    """Bonds among the first twelve atoms only, averaged over all frames."""
    f = T.traj_frames(spark, sf)
    stats = topology.internal_stats(f, topology.bonds(f, CONNECT, solute=list(range(1, 13))), "bond")
    return _round(stats, 6, "mean", "variance", "std_dev")
