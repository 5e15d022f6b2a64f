"""Packing, unpacking, counting and selecting frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetrove.functions import geometry as G
from kinetrove.plans.staging import attach

FRAME_KEY = ["run_id", "frame_id"]
_VECTOR_FIELDS = ("x", "y", "z", "vx", "vy", "vz", "fx", "fy", "fz")


def is_packed(df: DataFrame) -> bool:
    return "pos" in df.columns


def pack_frames(atoms: DataFrame) -> DataFrame:
    """Long atoms -> one row per frame, arrays ordered by atom label (one shuffle, best done at ingest)."""
    fields = [c for c in _VECTOR_FIELDS if c in atoms.columns]
    packed = atoms.groupBy(*FRAME_KEY).agg(
        F.array_sort(F.collect_list(F.struct("atom_id", "element", *fields))).alias("_a")
    )
    return packed.select(
        *FRAME_KEY,
        F.transform("_a", lambda a: a["element"]).alias("elements"),
        F.transform("_a", lambda a: F.struct(*[a[c].alias(c) for c in fields])).alias("pos"),
    )


def unpack_frames(frames: DataFrame) -> DataFrame:
    """Packed frames -> long atoms; a narrow step."""
    fields = frames.schema["pos"].dataType.elementType.names
    rows = frames.select(*FRAME_KEY, "elements", F.posexplode("pos").alias("_i", "_p"))
    return rows.select(
        *FRAME_KEY,
        (F.col("_i") + 1).alias("atom_id"),
        F.col("elements")[F.col("_i")].alias("element"),
        *[F.col("_p")[c].alias(c) for c in fields],
    )


def pick(df: DataFrame, labels: Sequence[int]) -> tuple[DataFrame, dict[int, Column]]:
    """Positions of labelled atoms, one row per frame.

    On packed frames this is a projection. On long atoms the label filter reaches the scan and one
    conditional aggregate per frame follows; its buffers are plain doubles, so it stays a hash
    aggregate.
    """
    if is_packed(df):
        flat = df.select(*FRAME_KEY, *[
            G.atom(F.col("pos"), i)[c].alias(f"_{c}{i}") for i in labels for c in G.AXES
        ])
        return flat, {i: G.vec(*[F.col(f"_{c}{i}") for c in G.AXES]) for i in labels}
    wanted = df.where(F.col("atom_id").isin(list(labels)))
    picked = wanted.groupBy(*FRAME_KEY).agg(*[
        F.max(F.when(F.col("atom_id") == i, F.col(c))).alias(f"_{c}{i}") for i in labels for c in G.AXES
    ])
    return picked, {i: G.vec(*[F.col(f"_{c}{i}") for c in G.AXES]) for i in labels}


def frame_stats(df: DataFrame) -> DataFrame:
    """Frames, atom rows and the smallest and largest frame per run."""
    if is_packed(df):
        sizes = df.select("run_id", F.size("pos").cast("bigint").alias("n"))
    else:
        sizes = df.groupBy(*FRAME_KEY).agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_frames"),
        F.sum("n").alias("n_atom_rows"),
        F.min("n").alias("min_atoms"),
        F.max("n").alias("max_atoms"),
    )


def composition(df: DataFrame, frame_id: int = 0) -> DataFrame:
    """Atoms per element in one frame (the first by default) of every run."""
    first = df.where(F.col("frame_id") == frame_id)
    if is_packed(df):
        first = first.select("run_id", F.explode("elements").alias("element"))
    return first.groupBy("run_id", "element").agg(F.count(F.lit(1)).alias("n_atoms"))


def changed_symbol_order(frames: DataFrame) -> DataFrame:
    """Runs in which the order of element symbols is not the same in every frame."""
    symbols = frames.select("run_id", F.concat_ws(" ", "elements").alias("symbols"))
    # The two extremes differ exactly when two frames differ.
    return (
        symbols.groupBy("run_id")
        .agg(F.min("symbols").alias("_lo"), F.max("symbols").alias("_hi"))
        .where(F.col("_lo") != F.col("_hi"))
        .select("run_id")
    )


def select_frames(df: DataFrame, start: int, stop: int, skip: int = 0) -> DataFrame:
    """Every (skip+1)-th frame of the closed 0-based interval [start, stop]."""
    f = F.col("frame_id")
    return df.where((f >= start) & (f <= stop) & ((f - start) % (skip + 1) == 0))


def select_frames_phase_space(
    df: DataFrame, start: int, stop: int, stride: int, overshoot: bool = False
) -> DataFrame:
    """Every ``stride``-th frame of the 1-based interval [start, stop].

    ``overshoot=True`` also keeps the one aligned frame past ``stop`` that follows a pick before it.
    """
    if stride < 1:
        raise ValueError("stride must be at least 1")
    f = F.col("frame_id") + 1
    inside = f <= stop
    if overshoot:
        inside = inside | ((f > start) & (f < stop + stride) & F.lit(start <= stop))
    return df.where((f >= start) & inside & ((f - start) % stride == 0))


def with_distance(df: DataFrame, i: int, j: int, cell=None) -> DataFrame:
    """Packed frames with the i-j distance as column ``distance``; narrow."""
    pos = F.col("pos")
    return df.withColumn("distance", G.distance(G.atom(pos, i), G.atom(pos, j), cell))


def select_range(frames: DataFrame, i: int, j: int, min_r: float, max_r: float) -> DataFrame:
    """Frames whose i-j distance lies in [min_r, max_r], with the distance."""
    return with_distance(frames, i, j).where(F.col("distance").between(min_r, max_r))


def range_summary(frames: DataFrame, i: int, j: int, min_r: float, max_r: float) -> DataFrame:
    """Per run: total and selected frames, mean and population deviation of the selected distances."""
    d = F.col("distance")
    kept = F.when(d.between(min_r, max_r), d)
    return (
        with_distance(frames, i, j)
        .groupBy("run_id")
        .agg(
            F.count(F.lit(1)).alias("total_frames"),
            F.count(kept).alias("selected_frames"),
            F.avg(kept).alias("mean_distance"),
            F.stddev_pop(kept).alias("std_distance"),
        )
    )


def closest_frame(frames: DataFrame, i: int, j: int, min_r: float, max_r: float) -> DataFrame:
    """The selected frame whose distance is nearest to the mean of the selected ones; the first wins."""
    chosen = select_range(frames, i, j, min_r, max_r).select(*FRAME_KEY, "distance")
    mean = chosen.groupBy("run_id").agg(F.avg("distance").alias("mean_distance"))
    gap = F.abs(F.col("distance") - F.col("mean_distance"))
    # Three doubles compared in order: the smallest gap, then the earliest frame.
    best = F.min(F.struct(gap.alias("gap"), F.col("frame_id"), F.col("distance"))).alias("b")
    return (
        attach(chosen, mean, ["run_id"])
        .groupBy("run_id", "mean_distance")
        .agg(best)
        .select("run_id", "b.frame_id", "b.distance", "mean_distance")
    )
