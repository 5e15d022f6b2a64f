"""Radial distribution function and coordination number around one atom of a periodic cell."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinetrove.functions import geometry as G
from kinetrove.operators.frames import composition
from kinetrove.operators.histogram import edge_bin


def shell_targets(frames: DataFrame, center: int, element: str, exclude: Sequence[int] = ()) -> DataFrame:
    """Atoms of one element in every frame with the displacement from the centre atom; narrow."""
    pos = F.col("pos")
    labels = [center, *exclude]
    return (
        frames.select("run_id", "frame_id", "elements", G.atom(pos, center).alias("c"), F.posexplode("pos").alias("_i", "p"))
        .where((F.col("elements")[F.col("_i")] == element) & ~(F.col("_i") + 1).isin(labels))
        .select(
            "run_id", "frame_id", (F.col("_i") + 1).alias("atom_id"),
            *[(F.col("p")[a] - F.col("c")[a]).alias(f"d{a}") for a in G.AXES],
        )
    )


def _times(length: float):
    return lambda k: k * F.lit(length)


def _image_distances(targets: DataFrame, radius: float, cell: Sequence[float]) -> DataFrame:
    """Distances to the periodic images that are within the radius, one axis at a time.

    Along an axis one cell to either side, or as many as the radius reaches for displacements below a
    cell length. An image too far along one axis is dropped before the next axis is expanded.
    """
    rows, reach = targets, F.lit(0.0)
    for axis, length in zip(G.AXES, cell):
        most = max(1, math.ceil(float(radius) / float(length)))
        shifts = F.transform(F.sequence(F.lit(-most), F.lit(most)), _times(float(length)))
        rows = rows.withColumn("_s", F.explode(shifts)).withColumn(f"d{axis}", F.col(f"d{axis}") + F.col("_s"))
        reach = reach + F.col(f"d{axis}") * F.col(f"d{axis}")
        rows = rows.where(F.sqrt(reach) <= float(radius))
    return rows.withColumn("d", F.sqrt(reach))


def rdf(
    frames: DataFrame,
    center: int,
    element: str,
    radius: float,
    bin_width: float,
    cell: Sequence[float],
    exclude: Sequence[int] = (),
) -> DataFrame:
    """g(r) and the running coordination number per run: columns r (left edge), g, coordination.

    The reference density counts every atom of the element in the first frame, the centre and the
    excluded ones too; frames without targets count in the average.
    """
    nbins = int(radius / bin_width)
    width = radius / nbins
    hits = _image_distances(shell_targets(frames, center, element, exclude), radius, cell)
    counts = (
        hits.select("run_id", edge_bin(F.col("d"), width, nbins).alias("bin"))
        .groupBy("run_id", "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    totals = frames.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_frames"))
    target = composition(frames).where(F.col("element") == element).select("run_id", "n_atoms")
    # All three tables are per run (times bins), far smaller than the frames.
    runs = totals.join(target, ["run_id"]).withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(nbins - 1))))
    filled = runs.join(counts, ["run_id", "bin"], "left")
    mean = F.coalesce(F.col("n"), F.lit(0)) / F.col("n_frames")
    low, high = F.col("bin") * F.lit(width), (F.col("bin") + 1) * F.lit(width)
    volume = F.lit(4.0 / 3.0 * math.pi) * (high * high * high - low * low * low)
    volume = F.when(volume < 1e-9, F.lit(1.0)).otherwise(volume)
    rho = F.col("n_atoms") / F.lit(float(cell[0]) * float(cell[1]) * float(cell[2]))
    upto = Window.partitionBy("run_id").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    return filled.withColumn("m", mean).select(
        "run_id", "bin", low.alias("r"), (F.col("m") / volume / rho).alias("g"),
        F.sum("m").over(upto).alias("coordination"),
    )
