"""Bonds, angles and dihedrals found in one frame, and their statistics over all frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetrove.functions import geometry as G
from kinetrove.functions.constants import COVALENT_RADII, COVALENT_TOLERANCE
from kinetrove.operators.frames import is_packed, unpack_frames
from kinetrove.operators.neighbors import frame_pairs, neighbor_pairs
from kinetrove.plans.staging import attach, stage


def first_atoms(df: DataFrame, frame_id: int = 0) -> DataFrame:
    """Atoms of the frame that defines the topology; the frame filter reaches the scan."""
    first = df.where(F.col("frame_id") == frame_id)
    return unpack_frames(first) if is_packed(df) else first


def bonds(df: DataFrame, cutoff: float = 1.5, solute: Sequence[int] | None = None) -> DataFrame:
    """Pairs of first-frame atoms within ``cutoff``; ``solute`` limits both ends to listed labels."""
    if solute is not None and (not solute or len(set(solute)) != len(solute)):
        raise ValueError("solute labels must be given once each, at least one")
    if is_packed(df):
        pairs = frame_pairs(df.where(F.col("frame_id") == 0), cutoff)
    else:
        pairs = neighbor_pairs(first_atoms(df), cutoff, ["run_id"])
    if solute is not None:
        wanted = list(solute)
        pairs = pairs.where(F.col("i").isin(wanted) & F.col("j").isin(wanted))
    return pairs.select("run_id", "i", "j")


def _both_ways(edges: DataFrame) -> DataFrame:
    ends = F.explode(F.array(
        F.struct(F.col("i").alias("at"), F.col("j").alias("to")),
        F.struct(F.col("j").alias("at"), F.col("i").alias("to")),
    ))
    return edges.select("run_id", ends.alias("e")).select("run_id", "e.at", "e.to")


def angles(edges: DataFrame) -> DataFrame:
    """Triplets i-j-k (i < k) of atoms bonded to the same centre j."""
    e = _both_ways(edges)
    one = e.select("run_id", F.col("at").alias("j"), F.col("to").alias("i"))
    two = e.select("run_id", F.col("at").alias("j"), F.col("to").alias("k"))
    return one.join(two, ["run_id", "j"]).where(F.col("i") < F.col("k")).select("run_id", "i", "j", "k")


def dihedrals(edges: DataFrame, df: DataFrame) -> DataFrame:
    """Quadruplets i-j-k-l over each bond j-k, without those that are collinear in the first frame."""
    edges = stage(edges)  # used three times below, and found by a search that is dearer than its result
    points = first_atoms(df).select("run_id", "atom_id", G.vec(F.col("x"), F.col("y"), F.col("z")).alias("p"))
    e = _both_ways(edges)
    for end in ("at", "to"):
        e = e.join(points.select("run_id", F.col("atom_id").alias(end), F.col("p").alias(f"p_{end}")), ["run_id", end])

    def named(**names):
        return e.select("run_id", *[F.col(old).alias(new) for new, old in names.items()])

    middle = named(j="at", k="to", p_j="p_at", p_k="p_to").where(F.col("j") < F.col("k"))
    left, right = named(j="at", i="to", p_i="p_to"), named(k="at", l="to", p_l="p_to")
    quads = (
        middle.join(left, ["run_id", "j"])
        .where(F.col("i") != F.col("k"))
        .join(right, ["run_id", "k"])
        .where((F.col("l") != F.col("j")) & (F.col("l") != F.col("i")))
    )
    shaped = G.add_dihedral(quads, *[F.col(f"p_{c}") for c in ("i", "j", "k", "l")])
    return shaped.where(F.col("value").isNotNull()).select("run_id", "i", "j", "k", "l")


_KINDS = {"bond": ("i", "j"), "angle": ("i", "j", "k"), "dihedral": ("i", "j", "k", "l")}


def labels_of(kind: str) -> list[str]:
    """The label columns of a kind of internal coordinate."""
    return list(_KINDS[kind])


def internal_stats(frames: DataFrame, topology: DataFrame, kind: str) -> DataFrame:
    """Mean, population variance and deviation of every internal coordinate over all frames.

    Frames stay where they were read: the topology (staged, counted) comes to them, each match is
    reduced at once, and only partial moments are shuffled.
    """
    labels = list(_KINDS[kind])
    at = [G.atom(F.col("pos"), F.col(c)) for c in labels]
    add = {"bond": G.add_distance, "angle": G.add_angle, "dihedral": G.add_dihedral}[kind]
    rows = attach(frames.select("run_id", "frame_id", "pos"), topology, ["run_id"])
    # One struct per match, taken apart again: the generated code splits here, and both halves stay
    # short enough for the JIT compiler.
    flat = F.struct(*[p[c].alias(f"{c}{n}") for n, p in enumerate(at) for c in G.AXES])
    points = rows.select("run_id", *labels, F.inline(F.array(flat)))
    named = [G.vec(*[F.col(f"{c}{n}") for c in G.AXES]) for n in range(len(labels))]
    v = F.col("value")
    return (
        add(points, *named)
        .groupBy("run_id", *labels)
        .agg(
            F.count(v).alias("n"),
            (F.count(F.lit(1)) - F.count(v)).alias("degenerate"),
            F.avg(v).alias("mean"),
            F.var_pop(v).alias("variance"),
        )
        .withColumn("std_dev", F.sqrt("variance"))
    )


def dynamic_bonds(
    df: DataFrame,
    max_distance: float = 1.5,
    tolerance: float = COVALENT_TOLERANCE,
    radii: dict[str, float] | None = None,
) -> DataFrame:
    """Bonds of every frame: d <= min(max_distance, r_i + r_j + tolerance), or max_distance when a
    radius is unknown."""
    radii = COVALENT_RADII if radii is None else radii
    if is_packed(df):
        known = F.transform("elements", lambda e: G.lookup(radii, e))
        pairs = frame_pairs(df, max_distance, {"r": known})
    else:
        rated = df.withColumn("r", G.lookup(radii, F.col("element")))
        pairs = neighbor_pairs(rated, max_distance, ["run_id", "frame_id"], carry=["r"])
    limit = F.lit(float(max_distance))
    reach = F.least(limit, F.nanvl(F.coalesce(F.col("r_i") + F.col("r_j") + tolerance, limit), limit))
    return pairs.where(F.col("d2") <= reach * reach).select(
        "run_id", "frame_id", "i", "j", F.sqrt("d2").alias("distance")
    )


def static_bonds(
    frames: DataFrame, max_distance: float = 1.5, tolerance: float = COVALENT_TOLERANCE, radii: dict[str, float] | None = None
) -> DataFrame:
    """Bonds of the first frame of each run, with their distances in every packed frame."""
    first = dynamic_bonds(frames.where(F.col("frame_id") == 0), max_distance, tolerance, radii).select("run_id", "i", "j")
    rows = attach(frames.select("run_id", "frame_id", "pos"), first, ["run_id"])
    pos = F.col("pos")
    return G.add_distance(rows, G.atom(pos, F.col("i")), G.atom(pos, F.col("j")), "distance").select("run_id", "frame_id", "i", "j", "distance")
