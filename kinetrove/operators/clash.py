"""Molecules that come too close to each other."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetrove.functions import geometry as G
from kinetrove.functions.constants import DEFAULT_VDW_RADIUS, VDW_RADII
from kinetrove.operators.frames import is_packed
from kinetrove.operators.neighbors import frame_pairs, neighbor_pairs


def clash_pairs(
    df: DataFrame,
    molecule: Column,
    cell: Sequence[float],
    vdw_scale: float,
    extra: float = 0.0,
    periodic: bool = True,
    radii: dict[str, float] | None = None,
) -> DataFrame:
    """Pairs of molecules of one frame with atoms closer than vdw_scale * (r_i + r_j) + extra.

    ``molecule`` gives the molecule from ``atom_id``. One row per clashing pair with the number of
    atom contacts and the shortest distance.
    """
    radii = VDW_RADII if radii is None else radii
    reach = vdw_scale * 2.0 * max([*radii.values(), DEFAULT_VDW_RADIUS]) + extra
    box = cell if periodic else None
    if is_packed(df):
        sized = F.transform("elements", lambda e: G.lookup(radii, e, DEFAULT_VDW_RADIUS))
        pairs = frame_pairs(df, reach, {"r": sized}, box)
        for end in ("i", "j"):
            pairs = pairs.withColumn("atom_id", F.col(end)).withColumn(f"mol_{end}", molecule).drop("atom_id")
    else:
        rated = df.withColumn("mol", molecule).withColumn("r", G.lookup(radii, F.col("element"), DEFAULT_VDW_RADIUS))
        pairs = neighbor_pairs(rated, reach, ["run_id", "frame_id"], carry=["mol", "r"], cell=box)
    limit = F.lit(float(vdw_scale)) * (F.col("r_i") + F.col("r_j")) + F.lit(float(extra))
    return (
        pairs.where((F.col("mol_i") != F.col("mol_j")) & (F.col("d2") < limit * limit))
        .groupBy("run_id", "frame_id", F.least("mol_i", "mol_j").alias("mol_a"), F.greatest("mol_i", "mol_j").alias("mol_b"))
        .agg(F.count(F.lit(1)).alias("contacts"), F.sqrt(F.min("d2")).alias("min_distance"))
    )
