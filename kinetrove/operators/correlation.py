"""Intermittent residence correlation, position and velocity autocorrelation, power spectrum."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinetrove.functions import geometry as G
from kinetrove.functions.constants import ATOMIC_TIME_FS
from kinetrove.operators.fft import autocorrelation_counts, bounded_counts
from kinetrove.operators.residence import OBJECT_KEY, residence_events
from kinetrove.plans.prefix import CHUNK, explode_range, running
from kinetrove.plans.staging import attach, stage


def occupancy_shape(occ: DataFrame) -> DataFrame:
    """n_frames and the number of occupancy cells per run. Frames must be consecutive from 0."""
    per_object = occ.groupBy(*OBJECT_KEY).agg(F.min("frame_id").alias("_first"), F.max("frame_id").alias("_last"), F.count(F.lit(1)).alias("_n"))
    gap = (F.min("_first") != 0) | (F.min(F.col("_last") + 1 - F.col("_n")) != 0) | (F.max(F.col("_last") + 1 - F.col("_n")) != 0)
    gaps = F.raise_error(F.concat(F.lit("frames are not consecutive from 0 in run "), F.col("run_id"))).cast("bigint")
    return per_object.groupBy("run_id").agg(
        (F.max("_last") + 1).alias("n_frames"), F.sum("_n").alias("n_cells"), gap.alias("_gap")
    ).select("run_id", F.when(F.col("_gap"), gaps).otherwise(F.col("n_frames")).alias("n_frames"), "n_cells")


def _curve(events: DataFrame, shape: DataFrame, dt: float, max_lag: int | None) -> DataFrame:
    spans = events.withColumn("stop_frame", F.col("start_frame") + F.col("n_frames") - 1)
    ones = explode_range(spans, "start_frame", "stop_frame", "frame_id").select("run_id", "object_id", "frame_id")
    num = autocorrelation_counts(ones, shape) if max_lag is None else bounded_counts(ones, max_lag)
    # Valid origins of lag l are the frames up to n_frames - 1 - l: a running count of ones.
    axis = explode_range(
        shape.select("run_id", F.lit(0).cast("bigint").alias("_lo"), (F.col("n_frames") - 1).alias("_hi")),
        "_lo", "_hi", "frame_id",
    )
    tallies = (
        axis.select("run_id", "frame_id", F.lit(0).cast("bigint").alias("n"))
        .unionByName(ones.select("run_id", "frame_id", F.lit(1).cast("bigint").alias("n")))
        .groupBy("run_id", "frame_id")
        .agg(F.sum("n").alias("n"))
    )
    origins = running(tallies, ["run_id"], "frame_id", {"den": ("sum", F.col("n"))})
    total = events.groupBy("run_id").agg(F.sum("n_frames").alias("n_ones"))
    means = shape.join(total, ["run_id"], "left").select(
        "run_id", "n_frames", (F.coalesce(F.col("n_ones"), F.lit(0)) / F.col("n_cells")).alias("h_mean")
    )
    lags = attach(origins, means, ["run_id"]).select(
        "run_id", (F.col("n_frames") - 1 - F.col("frame_id")).alias("lag"), "den", "h_mean"
    )
    if max_lag is not None:
        lags = lags.where(F.col("lag") <= max_lag)
    c = F.when(F.col("den") > 0, F.coalesce(F.col("num"), F.lit(0)) / F.col("den")).otherwise(0.0)
    rest = 1.0 - F.col("h_mean")
    always = F.abs(rest) <= 1e-8 + 1e-5
    r = F.when(always, F.lit(1.0)).otherwise((F.col("c") - F.col("h_mean")) / rest)
    return (
        lags.join(num, ["run_id", "lag"], "left")
        .withColumn("c", c)
        .withColumn("r", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))
        .select("run_id", "lag", (F.col("lag") * F.lit(float(dt))).alias("t"),
                F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("c"))).alias("c"), "r")
    )


def intermittent(occ: DataFrame, dt: float = 1.0, max_lag: int | None = None) -> DataFrame:
    """C(lag) = sum h(t0) h(t0+lag) / sum h(t0) and its relaxation R, for every lag or up to ``max_lag``.

    Works from the residence events (start, length), which are staged once and much smaller than
    the occupancy they stand for.
    """
    return _curve(stage(residence_events(occ)), stage(occupancy_shape(occ)), dt, max_lag)


def mrt_summary(occ: DataFrame, dt: float = 1.0) -> DataFrame:
    """Mean occupancy, events and the three residence times per run."""
    events, shape = stage(residence_events(occ)), stage(occupancy_shape(occ))
    per = events.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_events"), F.sum("n_frames").alias("n_ones"), F.avg("n_frames").alias("mean_frames")
    )
    area = _curve(events, shape, dt, None).groupBy("run_id").agg((F.sum("r") * F.lit(float(dt))).alias("intermittent_mrt"))
    mean = F.col("mean_frames") * F.lit(float(dt))
    return (
        shape.join(per, ["run_id"], "left")
        .join(area, ["run_id"], "left")
        .select(
            "run_id", "n_frames",
            F.expr("n_cells div n_frames").alias("n_objects"),
            (F.coalesce("n_ones", F.lit(0)) / F.col("n_cells")).alias("occupancy_mean"),
            F.coalesce("n_events", F.lit(0)).alias("n_events"),
            F.coalesce(mean, F.lit(0.0)).alias("direct_mrt"),
            # S(0) = 1 and the other S(lag) sum to the mean length, hence one more dt.
            F.coalesce(mean + F.lit(float(dt)), F.lit(0.0)).alias("continuous_mrt"),
            F.coalesce("intermittent_mrt", F.lit(0.0)).alias("intermittent_mrt"),
        )
    )


def autocorrelation(frames: DataFrame, start: int, stop: int | None, block: int) -> DataFrame:
    """PAF and VAF at lags 1 .. block-1, averaged over blocks and atoms, scaled by the largest value.

    A curve that is zero throughout, as of a run at rest, is NULL.

    ``start`` is 1-based. A block of ``block`` frames is used while it starts no later than
    ``stop - block``; ``stop=None`` is the last frame of each run. Each block's first frame is joined to the frames of the block; the join key
    also carries a piece of the lag, so a very long block is spread over tasks.
    """
    if block < 2:
        raise ValueError("a block needs at least two frames")
    step = F.col("frame_id") - F.lit(start - 1)
    end = F.lit(stop)
    if stop is None:
        ends = frames.groupBy("run_id").agg((F.max("frame_id") + 1).alias("_stop"))
        frames, end = attach(frames.select("run_id", "frame_id", "pos"), ends, ["run_id"]), F.col("_stop")
    blocks = F.expr(f"(frame_id - {start - 1}) div {block}")
    used = frames.where((F.col("frame_id") >= start - 1) & (blocks * block + start <= end - block)).select(
        "run_id", "pos", blocks.alias("block"), (step % block).alias("lag")
    )
    last_piece = (block - 1) // CHUNK
    first = used.where(F.col("lag") == 0).select(
        "run_id", "block", F.explode(F.sequence(F.lit(0), F.lit(last_piece))).alias("piece"), F.col("pos").alias("ref")
    )
    later = used.where(F.col("lag") > 0).withColumn("piece", F.expr(f"lag div {CHUNK}").cast("int"))
    pairs = later.join(first, ["run_id", "block", "piece"]).select(
        "run_id", "lag", F.explode(F.arrays_zip("pos", "ref")).alias("e")
    )
    p = [F.col(f"e.pos.{c}") * F.col(f"e.ref.{c}") for c in G.AXES]
    v = [F.col(f"e.pos.v{c}") * F.col(f"e.ref.v{c}") for c in G.AXES]
    # Every frame has the same atoms, so the mean over rows is the mean over blocks and atoms.
    raw = pairs.groupBy("run_id", "lag").agg(
        F.avg(p[0] + p[1] + p[2]).alias("paf"), F.avg(v[0] + v[1] + v[2]).alias("vaf")
    )
    raw = stage(raw)
    peaks = raw.groupBy("run_id").agg(*[F.max(F.abs(F.col(c))).alias(f"_{c}") for c in ("paf", "vaf")])
    return attach(raw, peaks, ["run_id"], spread="lag").select(
        "run_id", "lag", *[F.try_divide(F.col(c), F.when(F.col(f"_{c}") > 0, F.col(f"_{c}"))).alias(c) for c in ("paf", "vaf")]
    )


def psd(curve: DataFrame, dt: float, sampling: int = 1, value: str = "vaf", decimals: int | None = None) -> DataFrame:
    """|FFT|^2 of a correlation curve and its frequencies in Hz; one short curve per run.

    ``decimals`` rounds the curve first, as happens when it passes through a printed file.
    """
    spacing = dt * ATOMIC_TIME_FS * sampling * 1e-15

    def spectrum(part: pd.DataFrame) -> pd.DataFrame:
        y = part.sort_values("lag")["y"].to_numpy()
        return pd.DataFrame({
            "run_id": part["run_id"].iloc[0],
            "k": np.arange(len(y)),
            "frequency": np.fft.fftfreq(len(y), d=spacing),
            "power": np.abs(np.fft.fft(y)) ** 2,
        })

    y = F.col(value) if decimals is None else F.round(F.col(value), decimals)
    return (
        curve.select("run_id", "lag", y.alias("y"))
        .groupBy("run_id")
        .applyInPandas(spectrum, "run_id string, k bigint, frequency double, power double")
    )
