"""One query per operator over the given tables. Values are rounded so that two engines can be compared."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetrove.functions import constants as K
from kinetrove.operators import alignment, clash, correlation, energy, ensemble, frames, histogram, rdf, residence
from kinetrove.operators import series, states, topology
from kinetrove.plans import tables as T
from kinetrove.sinks import render
from kinetrove.sources import structures, xyz

DT, SAMPLING, TEMPERATURE = 5.0, 1, 300.0
MAX_R, BOND_WIDTH, ANGLE_WIDTH, DIHEDRAL_WIDTH = 6.0, 0.25, 5.0, 10.0
CONNECT = 1.5
SHELL_CUTOFF = 2.0
OBSERVED = [[i] for i in range(2, 22)]
TRIPLES = [[3 * m + 1, 3 * m + 2, 3 * m + 3] for m in range(7)]
BLOCK = 50
N_STATES = 3

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _round(df: DataFrame, digits: int, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in cols})


# ---- one bond ----------------------------------------------------------------------------------
def _bond(spark, sf):
    return series.distance_series(T.traj_frames(spark, sf), 1, 2, DT, SAMPLING)


def _bond_hist(spark, sf):
    return histogram.histogram(_bond(spark, sf), MAX_R, BOND_WIDTH)


@query
def bond_series(spark, sf):
    return _round(_bond(spark, sf), 6, "time_ps", "value")


@query
def bond_stats(spark, sf):
    return _round(series.series_stats(_bond(spark, sf)), 6, "mean", "smallest", "largest", "variance", "std_dev")


@query
def bond_hist(spark, sf):
    return _round(_bond_hist(spark, sf), 6, "center", "pct")


@query
def bond_free_energy(spark, sf):
    return _round(histogram.free_energy(_bond_hist(spark, sf), TEMPERATURE), 6, "center", "free_energy")


@query
def bond_fe_min(spark, sf):
    fe = histogram.free_energy(_bond_hist(spark, sf), TEMPERATURE)
    return _round(histogram.fe_minimum(fe), 6, "center", "free_energy")


@query
def min_image_distance(spark, sf):
    d = series.distance_series(T.traj_frames(spark, sf), 1, 2, DT, SAMPLING, cell=(4.0, 4.0, 4.0))
    return _round(d, 6, "time_ps", "value")


# ---- one angle, one dihedral, one hydrogen bond --------------------------------------------------
def _angle(spark, sf):
    return series.angle_series(T.traj_frames(spark, sf), 1, 2, 3, 180.0, DT, SAMPLING)


def _angle_hist(spark, sf):
    return histogram.histogram(_angle(spark, sf), 180.0, ANGLE_WIDTH, edge="clamp")


def _dihedral(spark, sf, **options):
    return series.dihedral_series(T.traj_frames(spark, sf), 1, 2, 3, 4, DT, SAMPLING, **options)


def _dihedral_hist(spark, sf):
    return histogram.histogram(_dihedral(spark, sf), 360.0, DIHEDRAL_WIDTH, edge="clamp")


def _hbond(spark, sf):
    return series.hbond_series(T.traj_frames(spark, sf), 1, 2, 3, DT, SAMPLING)


def _hbond_density(spark, sf):
    return histogram.hbond_density(_hbond(spark, sf), MAX_R, BOND_WIDTH, ANGLE_WIDTH)


@query
def angle_series(spark, sf):
    return _round(_angle(spark, sf), 6, "time_ps", "value")


@query
def angle_clamped_stats(spark, sf):
    low = series.angle_series(T.traj_frames(spark, sf), 1, 2, 3, 90.0, DT, SAMPLING)
    return _round(series.series_stats(low), 6, "mean", "smallest", "largest", "variance", "std_dev")


@query
def angle_hist(spark, sf):
    return _round(_angle_hist(spark, sf), 6, "center", "pct")


@query
def angle_fe_jacobian(spark, sf):
    fe = histogram.free_energy(_angle_hist(spark, sf), TEMPERATURE, jacobian=True, smooth=True)
    return _round(fe, 6, "center", "free_energy")


@query
def dihedral_series(spark, sf):
    return _round(_dihedral(spark, sf), 6, "time_ps", "value")


@query
def dihedral_iupac(spark, sf):
    return _round(_dihedral(spark, sf, wrap_180=True, convention="iupac"), 6, "time_ps", "value")


@query
def dihedral_hist(spark, sf):
    return _round(_dihedral_hist(spark, sf), 6, "center", "pct")


@query
def dihedral_fe(spark, sf):
    fe = histogram.free_energy(_dihedral_hist(spark, sf), TEMPERATURE, smooth=True)
    return _round(fe, 6, "center", "free_energy")


@query
def hbond_series(spark, sf):
    return _round(_hbond(spark, sf), 6, "time_ps", "d_dh", "d_ha", "angle")


@query
def hbond_density(spark, sf):
    return _round(_hbond_density(spark, sf), 6, "center", "density")


@query
def hbond_fe(spark, sf):
    fe = histogram.free_energy(_hbond_density(spark, sf), TEMPERATURE, keys=("run_id", "coord"))
    return _round(fe, 6, "center", "free_energy")


# ---- topology and all internal coordinates -------------------------------------------------------
@query
def all_bonds(spark, sf):
    f = T.traj_frames(spark, sf)
    return _round(topology.internal_stats(f, topology.bonds(f, CONNECT), "bond"), 6, "mean", "variance", "std_dev")


@query
def all_angles(spark, sf):
    f = T.traj_frames(spark, sf)
    found = topology.angles(topology.bonds(f, CONNECT))
    return _round(topology.internal_stats(f, found, "angle"), 6, "mean", "variance", "std_dev")


@query
def all_dihedrals(spark, sf):
    f = T.traj_frames(spark, sf)
    found = topology.dihedrals(topology.bonds(f, CONNECT), f)
    return _round(topology.internal_stats(f, found, "dihedral"), 5, "mean", "variance", "std_dev")


@query
def dynamic_bonds(spark, sf):
    return _round(topology.dynamic_bonds(T.traj_frames(spark, sf), CONNECT), 6, "distance")


# ---- frames --------------------------------------------------------------------------------------
@query
def frame_stats(spark, sf):
    return frames.frame_stats(T.traj_runs(spark, sf))


@query
def composition(spark, sf):
    return frames.composition(T.traj_frames(spark, sf))


def _nine_tenths(spark, sf) -> int:
    """A stop that leaves out the last tenth of the frames, however many there are."""
    return T.read(spark, sf, "embeddings").count() * 9 // 10


@query
def select_frames(spark, sf):
    kept = frames.select_frames(T.traj_frames(spark, sf), 10, _nine_tenths(spark, sf), 4)
    return _round(frames.unpack_frames(kept), 6, "x", "y", "z")


@query
def select_frames_b(spark, sf):
    kept = frames.select_frames_phase_space(T.traj_vel(spark, sf), 5, _nine_tenths(spark, sf), 7, overshoot=True)
    return _round(frames.unpack_frames(kept), 6, "x", "y", "z", "vx", "vy", "vz")


@query
def range_frames(spark, sf):
    kept = frames.select_range(T.traj_frames(spark, sf), 1, 2, 2.0, 4.0)
    return _round(kept.select("run_id", "frame_id", "distance"), 6, "distance")


@query
def range_summary(spark, sf):
    s = frames.range_summary(T.traj_frames(spark, sf), 1, 2, 2.0, 4.0)
    return _round(s, 6, "mean_distance", "std_distance")


@query
def closest_frame(spark, sf):
    c = frames.closest_frame(T.traj_frames(spark, sf), 1, 2, 2.0, 4.0)
    return _round(c, 6, "distance", "mean_distance")


# ---- pair correlation ----------------------------------------------------------------------------
def _rdf(spark, sf):
    return rdf.rdf(T.traj_frames(spark, sf), 1, "O", 6.0, 0.1, T.CELL, exclude=(3,))


@query
def radial_distribution(spark, sf):
    return _round(_rdf(spark, sf), 6, "r", "g").drop("coordination")


@query
def coordination(spark, sf):
    return _round(_rdf(spark, sf), 6, "r", "coordination").drop("g")


# ---- residence -----------------------------------------------------------------------------------
def _occ(spark, sf):
    return residence.occupancy(T.traj_frames(spark, sf), [1], OBSERVED, SHELL_CUTOFF)


def _shell(spark, sf):
    return residence.fill_gaps(residence.shell_occupancy(T.traj_frames(spark, sf), 1, "O", 2.5), 1)


@query
def occupancy(spark, sf):
    return _occ(spark, sf)


@query
def occupancy_groups(spark, sf):
    occ = residence.occupancy(
        T.traj_frames(spark, sf), TRIPLES[0], TRIPLES[1:], SHELL_CUTOFF, "center_of_mass", "group_list_com"
    )
    mean = occ.groupBy("run_id", "object_id").agg(F.sum("h").alias("n_inside"), F.avg("h").alias("h_mean"))
    return _round(mean, 6, "h_mean")


@query
def gap_fill(spark, sf):
    return residence.fill_gaps(_occ(spark, sf), 2)


@query
def residence_events(spark, sf):
    return residence.residence_events(_occ(spark, sf))


@query
def survival(spark, sf):
    return _round(residence.survival(residence.residence_events(_occ(spark, sf))), 6, "t", "value")


@query
def intermittent(spark, sf):
    return _round(correlation.intermittent(_occ(spark, sf)), 6, "t", "c", "r")


@query
def intermittent_bounded(spark, sf):
    return _round(correlation.intermittent(_occ(spark, sf), max_lag=40), 6, "t", "c", "r")


@query
def mrt_summary(spark, sf):
    s = correlation.mrt_summary(residence.fill_gaps(_occ(spark, sf), 2), 0.5)
    return _round(s, 6, "occupancy_mean", "direct_mrt", "continuous_mrt", "intermittent_mrt")


@query
def shell_totals(spark, sf):
    return _round(residence.shell_totals(_shell(spark, sf), DT, SAMPLING), 6, "time_ps")


@query
def shell_residence(spark, sf):
    return _round(residence.shell_residence(_shell(spark, sf), DT, SAMPLING), 6, "total_rt", "mrt")


# ---- autocorrelation -----------------------------------------------------------------------------
def _acf(spark, sf):
    return correlation.autocorrelation(T.traj_vel(spark, sf), 1, None, BLOCK)


@query
def paf(spark, sf):
    return _round(_acf(spark, sf), 6, "paf").drop("vaf")


@query
def vaf(spark, sf):
    return _round(_acf(spark, sf), 6, "vaf").drop("paf")


@query
def psd(spark, sf):
    p = correlation.psd(_acf(spark, sf), DT, SAMPLING)
    return _round(p.withColumn("frequency", F.col("frequency") / 1e12), 6, "frequency", "power")


# ---- states and logs -----------------------------------------------------------------------------
@query
def state_population(spark, sf):
    s = states.valid_states(T.sh_states(spark, sf), N_STATES)
    return _round(states.state_population(s, N_STATES), 6, "average", "percent")


@query
def state_frames(spark, sf):
    """Logs that end before the trajectory: the last tenth of each run is unknown. Every atom comes along."""
    log = T.cut_states(spark, sf)
    f = states.frames_by_state(T.traj_runs(spark, sf), log)
    atoms = f.select("run_id", "frame_id", "state", F.posexplode("pos").alias("_a", "p"))
    return atoms.select("run_id", "frame_id", "state", (F.col("_a") + 1).alias("atom_id"), *[F.round(F.col("p")[c], 6).alias(c) for c in "xyz"])


@query
def energy_columns(spark, sf):
    e = energy.energy_columns(T.energy_log(spark, sf), DT, "ps")
    return _round(_round(e, 9, "x"), 6, *[c for c in e.columns if c not in ("step", "x")])


@query
def unit_convert(spark, sf):
    c = energy.convert_units(T.unit_values(spark, sf), "quantity", "from_unit", "to_unit", "energy")
    return _round(c, 4, "converted")


@query
def unit_categories(spark, sf):
    """Units of every category in turn, names in any case, aliases, and names that no unit has."""
    found = None
    for category in T.UNIT_PAIRS:
        part = energy.convert_units(T.unit_pairs(spark, sf, category), "quantity", "from_unit", "to_unit", category)
        found = part if found is None else found.unionByName(part)
    # Ten significant digits: values lie many powers of ten apart.
    digits = F.col("converted") / F.pow(F.lit(10.0), F.floor(F.log10("converted")))
    return found.select("category", "l_orderkey", "l_linenumber", "from_unit", "to_unit", F.round(digits, 8).alias("digits"),
                        F.floor(F.log10("converted")).cast("int").alias("power"), "unit_error")


@query
def rate_constants(spark, sf):
    r = energy.rate_constant(T.reactions(spark, sf), TEMPERATURE)
    return r.select("reaction", F.round(F.log10("rate"), 6).alias("log10_rate"))


@query
def arrhenius(spark, sf):
    a = energy.arrhenius(T.reactions(spark, sf), 250.0, 450.0)
    return _round(a.select("reaction", "point", "temperature", "inv_t", "ln_k"), 6, "temperature", "inv_t", "ln_k")


# ---- groups, boxes, rotations --------------------------------------------------------------------
@query
def center_of_mass(spark, sf):
    return _round(ensemble.center_of_mass(T.traj_frames(spark, sf), TRIPLES), 6, "x", "y", "z")


@query
def geometric_center(spark, sf):
    return _round(ensemble.geometric_center(T.traj_frames(spark, sf), TRIPLES), 6, "x", "y", "z")


@query
def bounding_radius(spark, sf):
    return _round(ensemble.bounding_radius(T.traj_frames(spark, sf), TRIPLES, K.VDW_RADII), 6, "radius")


@query
def kinetic_energy(spark, sf):
    k = ensemble.kinetic_energy(T.traj_vel(spark, sf), [1, 2, 3])
    return _round(_round(k, 6, "molar_mass_kg"), 2, "kj_mol", "kcal_mol")


@query
def atom_kinetic_energy(spark, sf):
    return _round(ensemble.atom_kinetic_energy(T.traj_vel(spark, sf), [1, 2, 3]), 2, "kj_mol", "kcal_mol")


@query
def aim_velocity(spark, sf):
    a = ensemble.aim_velocity(T.traj_vel(spark, sf), [1, 2, 3], (20.0, 10.0, 5.0), 0.01)
    return _round(a, 6, "x", "y", "z", "vx", "vy", "vz")


@query
def principal_axes(spark, sf):
    a = frames.unpack_frames(alignment.align_principal_axes(T.traj_frames(spark, sf)))
    return _round(a, 5, "x", "y", "z")


@query
def clash_pairs(spark, sf):
    radii = {e: K.VDW_RADII[e] for e in T.ELEMENTS}
    c = clash.clash_pairs(T.traj_frames(spark, sf), F.expr("(atom_id - 1) div 3"), T.CELL, 0.3, radii=radii)
    return _round(c, 6, "min_distance")


@query
def inside_box(spark, sf):
    return ensemble.inside_box(T.traj_frames(spark, sf, shift=6.0), TRIPLES, T.CELL, 3.5)


@query
def density(spark, sf):
    d = ensemble.density(T.traj_frames(spark, sf), T.CELL, slab=(0.0, 6.0))
    return _round(d, 6, "mass", "density")


@query
def target_molecules(spark, sf):
    specs = T.box_specs(spark, sf)
    low = ensemble.target_molecules(specs, "floor").withColumnRenamed("n_molecules", "n_floor")
    both = ensemble.target_molecules(low, "round").withColumnRenamed("n_molecules", "n_round")
    return both.select("p_partkey", "n_floor", "n_round")


@query
def rescale(spark, sf):
    atoms = frames.unpack_frames(T.traj_frames(spark, sf))
    return _round(energy.rescale(atoms, ["x", "y", "z"], K.ANGSTROM_TO_BOHR), 6, "x", "y", "z")


@query
def force_magnitude(spark, sf):
    atoms = frames.unpack_frames(T.traj_vel(spark, sf))
    f = ensemble.force_magnitude(atoms, ("vx", "vy", "vz")).select("run_id", "frame_id", "atom_id", "force")
    return _round(f, 6, "force")


# ---- text in and out -----------------------------------------------------------------------------
def _xyz_lines(spark, sf):
    """Frames rendered as XYZ text and cut into numbered lines again, as a file reader would see them."""
    text = render.render_xyz(T.traj_frames(spark, sf))
    lines = text.select("run_id", "frame_id", F.posexplode(F.split("text", "\n")).alias("k", "value"))
    return lines.select(
        "run_id", (F.col("frame_id") * (T.N_ATOMS + 2) + F.col("k")).alias("line_no"), "value",
        F.lit(str(T.N_ATOMS)).alias("head"), "frame_id", "k",
    )


@query
def xyz_roundtrip(spark, sf):
    return xyz.parse_xyz(_xyz_lines(spark, sf))


@query
def xyz_errors(spark, sf):
    """Every tenth frame loses the last word of its fifth atom line, every fifteenth has a word for a number."""
    v, f = F.col("value"), F.col("frame_id")
    broken = F.when((f % 10 == 3) & (F.col("k") == 6), F.regexp_replace(v, r"\S+$", "")).when(
        (f % 15 == 4) & (F.col("k") == 9), F.regexp_replace(v, r"\S+$", "abc")
    )
    return xyz.validate_xyz(_xyz_lines(spark, sf).withColumn("value", F.coalesce(broken, v)))


def _structure_query(fmt: str) -> Query:
    def run(spark, sf):
        text = render.render_structures(T.traj_frames(spark, sf), fmt)
        files = text.select(F.concat("run_id", F.lit("/"), F.col("frame_id").cast("string")).alias("run_id"), F.col("text").alias("value"))
        return structures.parse_structures(files, fmt)

    run.__name__ = f"structures_{fmt}"
    return run


STRUCTURE_DIGITS = {"xyz": 8, "pdb": 3, "hin": 6, "mol": 4, "mol2": 4, "gaussian": 8}
for _fmt in STRUCTURE_DIGITS:
    query(_structure_query(_fmt))


@query
def symbol_order_check(spark, sf):
    """One frame in 97 lists its elements backwards; runs that hold one are reported."""
    f = T.traj_runs(spark, sf)
    turned = F.when(F.col("vec_id") % 97 == 5, F.reverse("elements")).otherwise(F.col("elements"))
    return frames.changed_symbol_order(f.withColumn("elements", turned))


@query
def pack_frames(spark, sf):
    packed = frames.pack_frames(frames.unpack_frames(T.traj_frames(spark, sf)))
    rows = packed.select("run_id", "frame_id", F.posexplode(F.arrays_zip("elements", "pos")).alias("_a", "e"))
    return rows.select(
        "run_id", "frame_id", (F.col("_a") + 1).alias("atom_id"), F.col("e.elements").alias("element"), *[F.round(F.col(f"e.pos.{c}"), 6).alias(c) for c in "xyz"]
    )


@query
def bond_series_atoms(spark, sf):
    d = series.distance_series(frames.unpack_frames(T.traj_frames(spark, sf)), 1, 21, DT, SAMPLING)
    return _round(d, 6, "time_ps", "value")
