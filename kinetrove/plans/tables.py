"""The given tables seen as trajectories.

``embeddings`` is one trajectory: each vector is a frame of 21 atoms (or of 10 atoms with
velocities). Positions are built as plain array expressions, so a query that needs two atoms reads
and computes just those six numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetrove.plans.prefix import ordinal
from kinetrove.plans.staging import attach

ELEMENTS = ("C", "H", "O", "N")
N_ATOMS = 21
N_ATOMS_VEL = 10
CELL = (12.0, 12.0, 12.0)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _elements(n: int):
    return F.expr("array(" + ", ".join(f"'{ELEMENTS[a % 4]}'" for a in range(n)) + ")").alias("elements")


def _atoms(n_atoms: int, fields: tuple[str, ...], scale: float = 1.0, shift: float = 0.0):
    """ARRAY<STRUCT> of consecutive vector components, as one SQL expression."""

    def component(k: int) -> str:
        value = f"double(embedding[{k}])"
        value = f"{scale!r}D * {value}" if scale != 1.0 else value
        return f"{value} + {shift!r}D" if shift else value

    step = len(fields)
    atoms = (
        "named_struct(" + ", ".join(f"'{c}', {component(step * a + n)}" for n, c in enumerate(fields)) + ")"
        for a in range(n_atoms)
    )
    # Exploding a one-element array fixes the value of the frame, so that a later loop over bonds
    # or atoms reads it instead of building it again for every element.
    return F.explode(F.array(F.expr("array(" + ", ".join(atoms) + ")"))).alias("pos")


def _run():
    """The one run of the table. Not a literal: joins on it stay hash joins."""
    return F.expr("concat('r', vec_id div 1000000000000L)").alias("run_id")


def traj_frames(spark: SparkSession, sf_dir: str, shift: float = 0.0) -> DataFrame:
    """One run of 21-atom frames; coordinates are ten times the vector components, in angstrom."""
    return read(spark, sf_dir, "embeddings").select(
        _run(), F.col("vec_id").alias("frame_id"), _elements(N_ATOMS), _atoms(N_ATOMS, ("x", "y", "z"), 10.0, shift)
    )


def traj_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same frames split into one run per label, numbered from 0 within the run."""
    numbered = ordinal(
        read(spark, sf_dir, "embeddings").select("label", "vec_id", "embedding"), ["label"], "vec_id", "frame_id"
    )
    return numbered.select(
        F.col("label").cast("string").alias("run_id"), "frame_id", _elements(N_ATOMS),
        _atoms(N_ATOMS, ("x", "y", "z"), 10.0), "vec_id",
    )


def traj_vel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run of 10-atom frames with positions and velocities."""
    return read(spark, sf_dir, "embeddings").select(
        _run(), F.col("vec_id").alias("frame_id"), _elements(N_ATOMS_VEL),
        _atoms(N_ATOMS_VEL, ("x", "y", "z", "vx", "vy", "vz")),
    )


def sh_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State log per run: one row per frame, states 0 .. 3."""
    rows = ordinal(read(spark, sf_dir, "embeddings").select("label", "vec_id"), ["label"], "vec_id", "row_idx")
    return rows.select(
        F.col("label").cast("string").alias("run_id"), "row_idx", F.col("vec_id").alias("step"),
        (F.col("vec_id") % 4).cast("int").alias("state"),
    )


def cut_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State logs that stop after nine tenths of their run."""
    log = sh_states(spark, sf_dir)
    lengths = log.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
    return attach(log, lengths, ["run_id"], spread="row_idx").where(F.col("row_idx") * 10 < F.col("n") * 9).drop("n")


def energy_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    e_ks = F.lit(-100.0) - v / 100.0
    c4 = e_ks + v / 500.0
    fict = v / 1000.0
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("step"), fict.alias("e_fict"), v.alias("temperature"), e_ks.alias("e_ks"),
        c4.alias("c4"), (c4 + fict).alias("e_total"), F.lit(0.0).alias("c6"), (v / 10.0).alias("cpu_s"),
    )


def reactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One reaction per supplier: activation energy in J/mol and activation entropy in J/(mol K)."""
    return read(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("reaction"),
        ((F.abs("s_acctbal") / 200.0 + 40.0) * 1000.0).alias("ea"),
        (-(F.col("s_suppkey") % 50)).cast("double").alias("entropy"),
    )


def unit_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.col("l_returnflag")
    unit = F.when(flag == "A", "hartree").when(flag == "N", "KCAL/MOL").otherwise("eV")
    return read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").alias("quantity"), unit.alias("from_unit"),
        F.when(F.col("l_linestatus") == "O", "kilocalorie/mol").otherwise("cal/mol").alias("to_unit"),
    )


#: Pairs of unit names of every category; the last pair of each has a name that no unit has.
UNIT_PAIRS = {
    "energy": (("Hartree", "kcal/mol"), ("kilocalorie/mol", "eV"), ("ev", "J"), ("cal/mol", "rydberg")),
    "length": (("Angstrom", "bohr"), ("a0", "nm"), ("mile", "km"), ("ly", "furlong")),
    "time": (("fs", "au"), ("week", "hr"), ("month", "day"), ("fortnight", "s")),
    "density": (("amu/angstrom^3", "g/cm3"), ("kg/liter", "amu/a3"), ("g/cm^3", "kg/L"), ("g/cm^3", "lb/ft3")),
    "velocity": (("mph", "knot"), ("Angstrom/fs", "m/s"), ("c", "km/h"), ("warp", "m/s")),
}


def unit_pairs(spark: SparkSession, sf_dir: str, category: str) -> DataFrame:
    """A value for each line item, with units of a category in turn; some are unknown."""
    pairs = UNIT_PAIRS[category]
    turn = (F.col("l_orderkey") + F.col("l_linenumber")) % len(pairs)
    pick = lambda k: F.element_at(F.array(*[F.lit(p[k]) for p in pairs]), (turn + 1).cast("int"))
    return read(spark, sf_dir, "lineitem").select(
        F.lit(category).alias("category"), "l_orderkey", "l_linenumber", F.col("l_quantity").alias("quantity"),
        pick(0).alias("from_unit"), pick(1).alias("to_unit"),
    )


def box_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = (F.col("p_size") + 10).cast("double")
    return read(spark, sf_dir, "part").select(
        "p_partkey", side.alias("a"), (side + 1.0).alias("b"), (side + 2.0).alias("c"),
        (F.col("p_retailprice") / 1000.0).alias("density"), F.lit(180.156).alias("solute_mass"),
        F.lit(18.015).alias("molecule_mass"),
    )
