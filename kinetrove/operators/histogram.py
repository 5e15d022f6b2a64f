"""Distributions with the three bin conventions of the analyses, and free energies over them."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetrove.functions.constants import GAS_CONSTANT_KCAL, PROBABILITY_FLOOR

EDGES = ("open", "clamp", "closed")


def bin_count(vmax: float, width: float, edge: str) -> int:
    if edge == "closed":
        return max(0, math.ceil(vmax / width) - 1)
    return max(1, int(vmax / width))


def edge_bin(value: Column, width, nbins) -> Column:
    """Bin whose edges k*width enclose the value, the last bin closed on the right; NULL outside.

    The quotient can land one bin off where k*width rounds, so it is checked against the edges.
    """
    w, n = F.lit(width), F.lit(nbins)
    guess = F.floor(value / w)
    fixed = F.when(value < guess * w, guess - 1).when(value >= (guess + 1) * w, guess + 1).otherwise(guess)
    inside = F.when((fixed == n) & (value == n * w), n - 1).otherwise(fixed)
    return F.when((value >= 0.0) & (inside >= 0) & (inside < n), inside.cast("int"))


def quotient_bin(value: Column, width, nbins, clamp: bool) -> Column:
    """Quotient truncated towards zero; ``clamp`` puts the value at the upper limit into the last bin."""
    n = F.lit(nbins)
    idx = (value / F.lit(width)).cast("bigint")
    if clamp:
        idx = F.when(idx == n, n - 1).otherwise(idx)
    return F.when((idx >= 0) & (idx < n), idx.cast("int"))


def spread_bins(counts: DataFrame, keys: Sequence[str], nbins) -> DataFrame:
    """All bins of every key from its non-empty ones, with the total in range.

    One row per non-empty bin is shuffled to its key, never a value; the group is bounded by the
    number of bins. Values out of range come with a NULL bin and are left out here, after counting.
    """
    inside = F.col("bin").isNotNull()
    packed = counts.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.when(inside, F.struct("bin", "count")))).alias("_m"),
        F.sum(F.when(inside, F.col("count"))).alias("total"),
    )
    last = F.lit(nbins) - 1
    return packed.withColumn("bin", F.explode(F.sequence(F.lit(0), last))).select(
        *keys, "bin", F.coalesce(F.try_element_at("_m", F.col("bin")), F.lit(0)).alias("count"), "total"
    )


def histogram(
    series: DataFrame,
    vmax: float,
    bin_width: float,
    edge: str = "open",
    norm: str = "pct",
    keys: Sequence[str] = ("run_id",),
    value: str = "value",
) -> DataFrame:
    """Histogram of a series with empty bins kept.

    ``edge``: "open" drops a value in the bin past the end, "clamp" moves it into the last bin,
    "closed" uses edges 0, w, 2w, ... below vmax with the last bin right-closed.
    ``norm``: "pct" is the percentage of the values in range, "density" integrates to one.
    """
    if edge not in EDGES or norm not in ("pct", "density"):
        raise ValueError(f"unknown edge {edge!r} or norm {norm!r}")
    nbins, v = bin_count(vmax, bin_width, edge), F.col(value)
    which = edge_bin(v, bin_width, nbins) if edge == "closed" else quotient_bin(v, bin_width, nbins, edge == "clamp")
    counts = (
        series.select(*keys, which.alias("bin"))
        .groupBy(*keys, "bin")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    bins = spread_bins(counts, keys, nbins)
    return bins.select(*keys, "bin", center(F.col("bin"), bin_width, edge).alias("center"), "count",
                       normalised(F.col("count"), F.col("total"), bin_width, norm).alias(norm))


def full_range_histogram(series: DataFrame, bin_width: float, norm: str = "pct", keys: Sequence[str] = ("run_id",), value: str = "value") -> DataFrame:
    """Histogram of torsions in (-180, 180]; none is dropped, and centres keep their sign."""
    shifted = series.withColumn(value, F.col(value) + 180.0)
    return histogram(shifted, 360.0, bin_width, "clamp", norm, keys, value).withColumn("center", F.col("center") - 180.0)


def center(bin_: Column, width, edge: str) -> Column:
    w = F.lit(width)
    return (bin_ * w + (bin_ + 1) * w) / 2.0 if edge == "closed" else w * (bin_ + 0.5)


def normalised(count: Column, total: Column, width, norm: str) -> Column:
    return count / total * 100.0 if norm == "pct" else count / (F.lit(width) * total)


def hbond_density(
    hbonds: DataFrame, max_bond: float, bond_width: float, angle_width: float, keys: Sequence[str] = ("run_id",)
) -> DataFrame:
    """Densities of the three hydrogen-bond coordinates in one pass over the series."""
    axes = [("d_dh", max_bond, bond_width), ("d_ha", max_bond, bond_width), ("angle", 180.0, angle_width)]
    entries = F.array(*[
        F.struct(
            F.lit(name).alias("coord"), F.lit(float(w)).alias("w"), F.lit(bin_count(m, w, "closed")).alias("n"),
            F.col(name).alias("v"),
        )
        for name, m, w in axes
    ])
    long = hbonds.select(*keys, F.explode(entries).alias("e")).select(*keys, "e.coord", "e.w", "e.n", "e.v")
    counts = (
        long.withColumn("bin", edge_bin(F.col("v"), F.col("w"), F.col("n")))
        .groupBy(*keys, "coord", "w", "n", "bin")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    by = [*keys, "coord", "w", "n"]
    bins = spread_bins(counts, by, F.col("n"))
    return bins.select(
        *keys, "coord", "bin", center(F.col("bin"), F.col("w"), "closed").alias("center"), "count",
        normalised(F.col("count"), F.col("total"), F.col("w"), "density").alias("density"),
    )


def _energy(p: Column, temperature: float) -> Column:
    return -F.lit(GAS_CONSTANT_KCAL * temperature) * F.ln(p)


def smooth_edge_padded(profile: DataFrame, col: str, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Moving average over the rows of each profile in bin order, the ends repeated.

    The odd window grows with the number of rows n: max(5, min(11, n div 12)), none below five.
    A profile is bounded by its bin count, so it is smoothed as one array.
    """
    rest = [c for c in profile.columns if c not in (*keys, col, "bin")]
    packed = profile.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("bin", col, *rest))).alias("_a")
    ).withColumn("_n", F.size("_a"))
    n = F.col("_n")
    raw = F.greatest(F.lit(5), F.least(F.lit(11), F.expr("_n div 12").cast("int")))
    odd = F.when(raw % 2 == 0, raw + 1).otherwise(raw)
    window = F.when(n < 5, F.lit(1)).otherwise(F.least(odd, F.when(n % 2 == 1, n).otherwise(n - 1)))
    half = F.expr("_w div 2").cast("int")
    packed = packed.withColumn("_w", window).withColumn("_h", half)

    def around(i):
        total = F.aggregate(
            F.sequence(i - F.col("_h"), i + F.col("_h")),
            F.lit(0.0),
            lambda acc, k: acc + F.element_at(F.col("_a"), F.greatest(F.lit(1), F.least(n, k)))[col],
        )
        return total / F.col("_w")

    smoothed = F.transform(F.sequence(F.lit(1), n), around)
    rows = packed.select(*keys, F.explode(F.arrays_zip(F.col("_a").alias("a"), smoothed.alias("s"))).alias("_r"))
    return rows.select(
        *keys, F.col("_r.a.bin").alias("bin"), *[F.col(f"_r.a.{c}").alias(c) for c in rest], F.col("_r.s").alias(col)
    )


def free_energy(
    hist: DataFrame,
    temperature: float,
    jacobian: bool = False,
    smooth: bool = False,
    keys: Sequence[str] = ("run_id",),
) -> DataFrame:
    """-RT ln p over the non-empty bins, in kcal/mol.

    A percentage histogram gives p = pct/100, a density histogram is used as it is. ``jacobian``
    divides by sin(center) first; ``smooth`` averages p over neighbouring non-empty bins.
    """
    density = "density" in hist.columns
    weight = F.col("density") if density else F.col("pct") / 100.0
    p = hist.where(F.col("count") > 0).select(*keys, "bin", "center", weight.alias("p"))
    if jacobian:
        p = p.withColumn("p", F.col("p") / F.greatest(F.sin(F.radians("center")), F.lit(PROBABILITY_FLOOR)))
    if smooth:
        p = p.withColumn("p", F.greatest(F.col("p"), F.lit(PROBABILITY_FLOOR)))
        p = smooth_edge_padded(p, "p", keys)
        p = p.withColumn("p", F.greatest(F.col("p"), F.lit(PROBABILITY_FLOOR)))
    return p.select(*keys, "bin", "center", _energy(F.col("p"), temperature).alias("free_energy"))


def fe_minimum(fe: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """The first bin with the lowest free energy."""
    best = F.min(F.struct("free_energy", "bin", "center")).alias("b")
    return fe.groupBy(*keys).agg(best).select(*keys, "b.bin", "b.center", "b.free_energy")
