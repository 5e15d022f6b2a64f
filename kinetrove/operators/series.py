"""Scalar time series of internal coordinates: one narrow projection over packed frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetrove.functions import geometry as G
from kinetrove.operators.frames import FRAME_KEY, pick


def _series(valued: DataFrame, dt: float, sampling: int, origin: int = 0) -> DataFrame:
    # Exploding NULL drops a degenerate frame. A filter on the value would be pushed below the
    # projections and repeat the whole chain of vector expressions there.
    present = F.explode(F.when(F.col("value").isNotNull(), F.array("value")))
    return valued.select(
        *FRAME_KEY, G.time_ps(F.col("frame_id"), dt, sampling, origin).alias("time_ps"), present.alias("value")
    )


def distance_series(df, i: int, j: int, dt: float, sampling: int = 1, origin: int = 0, cell=None) -> DataFrame:
    picked, at = pick(df, [i, j])
    return _series(G.add_distance(picked, at[i], at[j], cell=cell), dt, sampling, origin)


def angle_series(
    df, i: int, j: int, k: int, max_angle: float = 180.0, dt: float = 1.0, sampling: int = 1
) -> DataFrame:
    """Angle at j, clamped to [0, max_angle]; frames with coinciding atoms are left out."""
    picked, at = pick(df, [i, j, k])
    series = _series(G.add_angle(picked, at[i], at[j], at[k]), dt, sampling)
    return series.withColumn("value", F.greatest(F.lit(0.0), F.least(F.lit(float(max_angle)), F.col("value"))))


def dihedral_series(
    df,
    i: int,
    j: int,
    k: int,
    l: int,
    dt: float = 1.0,
    sampling: int = 1,
    wrap_180: bool = False,
    convention: str = "trajectory",
) -> DataFrame:
    """Torsion i-j-k-l in [0, 360), or in (-180, 180] with ``wrap_180``."""
    picked, at = pick(df, [i, j, k, l])
    series = _series(G.add_dihedral(picked, at[i], at[j], at[k], at[l], convention=convention), dt, sampling)
    return series if wrap_180 else series.withColumn("value", G.wrap_360(F.col("value")))


def hbond_series(df, donor: int, hydrogen: int, acceptor: int, dt: float = 1.0, sampling: int = 1) -> DataFrame:
    """Donor-H and H-acceptor distances and the D-H-A angle; the first frame counts as number 1."""
    picked, at = pick(df, [donor, hydrogen, acceptor])
    d, h, a = at[donor], at[hydrogen], at[acceptor]
    both = G.add_distance(G.add_distance(picked, d, h, "d_dh"), h, a, "d_ha")
    return G.add_angle(both, d, h, a, "angle").select(
        *FRAME_KEY, G.time_ps(F.col("frame_id"), dt, sampling, origin=1).alias("time_ps"), "d_dh", "d_ha", "angle"
    )


def series_stats(series: DataFrame, keys=("run_id",), ddof: int = 1, value: str = "value") -> DataFrame:
    """Count, mean, extremes, variance and deviation (sample by default; 0 for a single value)."""
    var, std = (F.var_samp, F.stddev_samp) if ddof == 1 else (F.var_pop, F.stddev_pop)
    v = F.col(value)
    return series.groupBy(*keys).agg(
        F.count(v).alias("n"),
        F.avg(v).alias("mean"),
        F.min(v).alias("smallest"),
        F.max(v).alias("largest"),
        F.coalesce(var(v), F.lit(0.0)).alias("variance"),
        F.coalesce(std(v), F.lit(0.0)).alias("std_dev"),
    )


def circular_stats(series: DataFrame, keys=("run_id",), value: str = "value") -> DataFrame:
    """Count, mean direction in (-180, 180], resultant length R and circular deviation of angles in degrees.

    Angles that cancel out have no direction: mean and deviation are NULL there.
    """
    a = F.radians(F.col(value))
    sums = series.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(F.sin(a)).alias("_s"), F.avg(F.cos(a)).alias("_c"))
    r = F.least(F.lit(1.0), F.hypot("_s", "_c"))
    some = r > 1e-12
    return sums.select(
        *keys, "n", F.when(some, F.degrees(F.atan2("_s", "_c"))).alias("mean"), r.alias("resultant"),
        F.when(some, F.degrees(F.sqrt(-2.0 * F.ln(r)))).alias("std_dev"),
    )
