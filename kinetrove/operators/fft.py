"""Autocorrelation counts of long 0/1 signals by Fourier transforms spread over the cluster.

A transform of length N = n1 * n2 is two rounds of short ones: n2 transforms of length n1, a phase
factor, n1 transforms of length n2. Spark groups and shuffles; a task holds one short vector of
about sqrt(N) numbers (a billion frames: some 45,000).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetrove.plans.staging import attach, stage

_SIZES = ["n1", "n2"]


def _columns(count: int, **values) -> pa.Table:
    """Arrow table from arrays and per-group constants."""
    return pa.table({
        k: v if isinstance(v, np.ndarray) else pa.array([v] * count) for k, v in values.items()
    })


def _inner(table: pa.Table, index: str) -> tuple[np.ndarray, int, int]:
    """Round one: transform the values at positions ``p``, then turn by the phase of row ``q``."""
    n1, n2, q = (table[c][0].as_py() for c in ("n1", "n2", "q"))
    x = np.zeros(n1)
    np.add.at(x, table["p"].to_numpy(), table[index].to_numpy())
    y = np.fft.fft(x) * np.exp(-2j * np.pi * q * np.arange(n1) / (n1 * n2))
    return y, n1, n2


def _outer(table: pa.Table) -> tuple[np.ndarray, int, int, int]:
    """Round two: gather one output row of every first transform and transform across them."""
    n1, n2, k = (table[c][0].as_py() for c in ("n1", "n2", "k1"))
    x = np.zeros(n2, dtype=complex)
    x[table["q"].to_numpy()] = table["re"].to_numpy() + 1j * table["im"].to_numpy()
    return np.fft.fft(x), n1, n2, k


def _grouped(df: DataFrame, *keys: str):
    """Group for a Python step. The partition count is fixed, because small rows that cost much CPU
    would otherwise be merged into one task by their size."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys).groupBy(*keys)


def _round_one(df: DataFrame, keys: list[str], key_types: str) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        y, n1, n2 = _inner(table, "v")
        same = {k: table[k][0].as_py() for k in [*keys, "q"]}
        return _columns(n1, **same, k1=np.arange(n1, dtype=np.int64), re=y.real, im=y.imag, n1=n1, n2=n2)

    schema = f"{key_types}, q bigint, k1 bigint, re double, im double, n1 bigint, n2 bigint"
    return _grouped(df, *keys, "q").applyInArrow(run, schema)


def autocorrelation_counts(ones: DataFrame, shape: DataFrame) -> DataFrame:
    """sum over objects and t of h(t) h(t+lag) for every lag: columns run_id, lag, num.

    ``ones`` holds (run_id, object_id, frame_id) of the ones, ``shape`` (run_id, n_frames). Power
    spectra are added over objects before the one inverse transform per run. Counts are rounded to
    integers: they are exact while the rounding error of the transform, about 1e-16 * log2(N) * the largest
    count, stays below one half (a largest count of 10**12 leaves a margin of more than a hundred).
    A value more than a quarter away from an integer is an error.
    """
    bits = F.ceil(F.log2(F.col("n_frames") * 2)).cast("int")
    half = F.expr("_b div 2").cast("int")
    sizes = shape.select("run_id", "n_frames", bits.alias("_b")).select(
        "run_id", F.pow(F.lit(2.0), half).cast("bigint").alias("n1"),
        F.pow(F.lit(2.0), F.col("_b") - half).cast("bigint").alias("n2"), "n_frames",
    )
    sizes = stage(sizes)
    signal = attach(ones, sizes.select("run_id", *_SIZES), ["run_id"], staged=True).select(
        "run_id", F.col("object_id").cast("bigint").alias("object_id"), *_SIZES,
        F.expr("frame_id % n2").alias("q"), F.expr("frame_id div n2").alias("p"), F.lit(1.0).alias("v"),
    )
    turned = _round_one(signal, ["run_id", "object_id"], "run_id string, object_id bigint")

    def power(table: pa.Table) -> pa.Table:
        x, n1, n2, k = _outer(table)
        return _columns(n2, run_id=table["run_id"][0].as_py(), k=k + n1 * np.arange(n2, dtype=np.int64),
                        v=x.real**2 + x.imag**2, n1=n1, n2=n2)

    spectrum = (
        _grouped(turned, "run_id", "object_id", "k1")
        .applyInArrow(power, "run_id string, k bigint, v double, n1 bigint, n2 bigint")
        .groupBy("run_id", "k", *_SIZES)
        .agg(F.sum("v").alias("v"))
    )
    back = spectrum.select("run_id", *_SIZES, F.expr("k % n2").alias("q"), F.expr("k div n2").alias("p"), "v")

    def counts(table: pa.Table) -> pa.Table:
        x, n1, n2, k = _outer(table)
        exact = x.real / (n1 * n2)
        num = np.rint(exact).astype(np.int64)
        if np.abs(exact - num).max() > 0.25:
            raise ArithmeticError(f"counts of {table['run_id'][0].as_py()} are too large for double precision; bound the lag")
        return _columns(n2, run_id=table["run_id"][0].as_py(), lag=k + n1 * np.arange(n2, dtype=np.int64), num=num)

    lags = _grouped(_round_one(back, ["run_id"], "run_id string"), "run_id", "k1").applyInArrow(
        counts, "run_id string, lag bigint, num bigint"
    )
    lengths = sizes.select("run_id", "n_frames")
    found = attach(lags.where(F.col("num") > 0), lengths, ["run_id"], spread="lag", staged=True)
    return found.where(F.col("lag") < F.col("n_frames")).select("run_id", "lag", "num")


def bounded_counts(ones: DataFrame, max_lag: int, block: int = 4096) -> DataFrame:
    """The same sums for lags up to ``max_lag``: each block of frames with the lags that follow it.

    One shuffle; a task holds one block of one object. ``num`` is the exact count.
    """
    span = max(block, max_lag + 1)
    own = F.expr(f"frame_id div {span}")
    tail = F.when((F.col("frame_id") - own * span < max_lag) & (own > 0), own - 1)
    rows = ones.select(
        "run_id", "object_id", "frame_id", F.explode(F.array(own, tail)).alias("b")
    ).where(F.col("b").isNotNull())

    def correlate(table: pa.Table) -> pa.Table:
        at = table["frame_id"].to_numpy() - table["b"][0].as_py() * span
        size = 1 << int(2 * span - 1).bit_length()
        y = np.zeros(size)
        y[at] = 1.0
        x = y.copy()
        x[span:] = 0.0
        num = np.rint(np.fft.irfft(np.conj(np.fft.rfft(x)) * np.fft.rfft(y), size)[: max_lag + 1]).astype(np.int64)
        return _columns(max_lag + 1, run_id=table["run_id"][0].as_py(),
                        lag=np.arange(max_lag + 1, dtype=np.int64), num=num)

    return (
        _grouped(rows, "run_id", "object_id", "b")
        .applyInArrow(correlate, "run_id string, lag bigint, num bigint")
        .groupBy("run_id", "lag")
        .agg(F.sum("num").alias("num"))
    )
