"""Embedding whitening by Chebyshev-filtered subspace iteration.

Entries become whole numbers x (64ths, rounded down), so counts, sums and squares are exact. Each distinct vector is
kept once, packed in blocks; every pass reads the blocks where they lie, centres them exactly and adds up
X'(X Q) / n for a narrow Q. Only a matrix of ``block`` columns travels.

1. A block of random directions, wider than the number of components, is multiplied; a Lanczos vector rides along and
   gives bounds of the spectrum.
2. A Chebyshev polynomial in the covariance, small on the unwanted part of the spectrum and steep above it, is applied
   by its three-term recurrence, one pass a degree; then QR and Rayleigh-Ritz, which need one pass more.
3. That is repeated until certified: each wanted pair (e, u) has a residual |Vu - eu| below ``tolerance`` times the
   largest eigenvalue, or below 1e-12 times it when rounding lets it fall no further, and Lanczos steps from a new
   random vector, orthogonal to the wanted ones, meet no larger eigenvalue than the smallest wanted one.
4. A last pass measures how far the whitened covariance is from the identity, and every row is projected.

Rows whose vector is null or holds null or non-finite entries are left out, and so are vectors of another length than
the most frequent one (of equally frequent ones the longest) and empty ones. Rows with a null id or repeated rows are
projected one by one. Components without variance (up to rounding) are left out, so one distinct vector, or an
empty table, gives no rows. Other columns are ignored. Entries must be small enough for n * x to fit 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetrove.llm.common import stage

SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
#: Partial sums that the driver takes; above it they are added up in tasks first.
DIRECT = 64
PACK = 1024


def whole_numbers(embedding: Column) -> Column:
    """64ths, rounded down; null if the vector or one of its entries is not a finite number."""
    finite = F.forall(embedding, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    return F.when(embedding.isNotNull() & finite, F.transform(embedding, lambda c: F.floor(c.cast("double") * 64)))


@dataclass
class Fit:
    """The distinct vectors: packed blocks, their number, exact sums and squares of each dimension."""

    blocks: DataFrame
    n: int
    sums: np.ndarray
    trace: float

    @property
    def d(self) -> int:
        return len(self.sums)


def _unpack(batch: pa.RecordBatch, d: int) -> Iterator[np.ndarray]:
    for width, data in zip(batch["width"].to_pylist(), batch["data"]):
        yield np.frombuffer(data.as_buffer(), f"<i{width}").reshape(-1, d).astype(np.int64)


def distinct_blocks(vectors: DataFrame) -> Fit | None:
    """Each distinct vector of the column ``x`` once, in blocks."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = len(batch["x"][0]) if batch.num_rows else 1
            y = batch["x"].flatten().to_numpy().reshape(-1, d)
            for at in range(0, len(y), PACK):
                part = y[at : at + PACK]
                most = int(np.abs(part).max())
                width = 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8
                # Squares as 32-bit halves of their sums: exact for entries below 2^31, else added as Python integers.
                squares = (part**2).sum(axis=0) if most < 1 << 26 else (part.astype(object) ** 2).sum(axis=0)
                row = [[len(part)], [width], [part.astype(f"<i{width}").tobytes()], [part.sum(axis=0).tolist()], [[str(q) for q in squares.tolist()]], [most]]
                kinds = [pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.int64()]
                yield pa.record_batch([pa.array(x, t) for x, t in zip(row, kinds)], ["n", "width", "data", "sums", "squares", "most"])

    schema = "n long, width int, data binary, sums array<long>, squares array<string>, most long"
    blocks = stage(vectors.groupBy("x").agg(F.lit(1)).select("x").mapInArrow(pack, schema), "vector-blocks")
    both = blocks.select(F.posexplode(F.arrays_zip("sums", "squares")).alias("k", "s"))
    totals = both.groupBy("k").agg(F.sum(F.col("s.sums").cast("decimal(38,0)")).alias("s"), F.sum(F.col("s.squares").cast("decimal(38,0)")).alias("q")).orderBy("k").collect()
    if not totals:
        return None
    counts = blocks.agg(F.sum("n").alias("n"), F.max("most").alias("most")).first()
    n = counts["n"]
    if 2 * n * max(1, counts["most"]) >= 1 << 63:
        raise ValueError(f"entries of up to {counts['most'] // 64} among {n} distinct vectors are too large for exact sums")
    sums = np.array([int(r["s"]) for r in totals], np.int64)
    trace = sum(n * int(r["q"]) - int(r["s"]) ** 2 for r in totals) / n**2
    return Fit(blocks.select("width", "data"), n, sums, trace)


def summed(fit: Fit, compute, shape: tuple[int, int], direct: int = DIRECT) -> np.ndarray:
    """The sum of ``compute`` (centred rows -> matrix) over all blocks.

    Each task gives one matrix; those of more than ``direct`` tasks are added up by tasks first.
    """
    n, d, sums = fit.n, fit.d, fit.sums

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = None
        for batch in batches:
            for y in _unpack(batch, d):
                part = compute((n * y - sums) / n)  # whole numbers up to the division
                total = part if total is None else total + part
        if total is not None:
            yield pa.record_batch([pa.array([TaskContext.get().partitionId()]), pa.array([total.astype("<f8").tobytes()])], ["task", "data"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first = 0.0, None
        for batch in batches:
            for task, data in zip(batch["task"].to_pylist(), batch["data"]):
                total, first = total + np.frombuffer(data.as_buffer(), "<f8"), task if first is None else first
        if first is not None:
            yield pa.record_batch([pa.array([first]), pa.array([total.tobytes()])], ["task", "data"])

    parts = fit.blocks.mapInArrow(run, "task long, data binary")
    tasks = fit.blocks.rdd.getNumPartitions()
    while tasks > direct:
        tasks = -(-tasks // direct)
        parts = parts.repartition(tasks, F.col("task") % tasks).sortWithinPartitions("task").mapInArrow(add, "task long, data binary")
    found = sorted((r["task"], bytes(r["data"])) for r in parts.collect())
    return sum((np.frombuffer(data, "<f8").reshape(shape) for _, data in found), np.zeros(shape))


@dataclass
class Lanczos:
    """Bounds of a symmetric matrix's spectrum from products with one vector."""

    basis: list[np.ndarray]
    alpha: list[float]
    beta: list[float]

    @classmethod
    def start(cls, vector: np.ndarray) -> Lanczos:
        return cls([vector / np.linalg.norm(vector)], [], [])

    def step(self, product: np.ndarray) -> None:
        """``product``: the matrix times the last vector of the basis."""
        q = np.stack(self.basis, axis=1)
        self.alpha.append(float(self.basis[-1] @ product))
        rest = product - q @ (q.T @ product)
        rest -= q @ (q.T @ rest)
        self.beta.append(float(np.linalg.norm(rest)))
        if self.beta[-1] > 0:
            self.basis.append(rest / self.beta[-1])

    @property
    def ended(self) -> bool:
        return len(self.basis) == len(self.alpha)

    def values(self) -> np.ndarray:
        return np.linalg.eigvalsh(np.diag(self.alpha) + np.diag(self.beta[:-1], 1) + np.diag(self.beta[:-1], -1))

    def bounds(self) -> tuple[float, float]:
        values = self.values()
        return max(0.0, values[0] - self.beta[-1]), values[-1] + self.beta[-1]


def chebyshev(apply, q: np.ndarray, low: float, high: float, top: float, degree: int) -> np.ndarray:
    """The polynomial of this degree that stays within 1 on [low, high], scaled to 1 at ``top``, applied to ``q``."""
    centre, half = (high + low) / 2, max((high - low) / 2, 1e-300)
    sigma = first = half / (top - centre)
    before, now = q, (apply(q) - centre * q) * (first / half)
    for _ in range(degree - 1):
        after = 1 / (2 / first - sigma)
        before, now = now, 2 * (apply(now) - centre * now) * (after / half) - sigma * after * before
        sigma = after
    return now


def degree_for(low: float, high: float, least: float, top: float, gain: float, most: int) -> int:
    """The degree that damps the unwanted part by ``gain`` against the ``least`` wanted value.

    At most so many that ``top`` does not outgrow ``least`` by more than 1e6, which would cost the latter its digits.
    """
    centre, half = (high + low) / 2, max((high - low) / 2, 1e-300)
    slow, fast = (float(np.arccosh(max(1.0, (x - centre) / half))) for x in (least, top))
    wanted = np.ceil(np.log(2 * max(gain, 1.0)) / max(slow, 1e-3))
    return int(max(1, min(most, wanted, np.floor(np.log(1e6) / max(fast - slow, 1e-3)))))


@dataclass
class Components:
    values: np.ndarray
    vectors: np.ndarray
    residuals: np.ndarray
    passes: int


def leading(apply, d: int, wanted: int, *, extra: int = 32, degree: int = 20, rounds: int = 60, tolerance: float = 1e-14, lanczos: int = 16, probe: int = 8, seed: int = 1) -> Components:
    """The ``wanted`` largest eigenpairs of a covariance of which only ``apply`` (its product with a matrix) is known."""
    rng = np.random.default_rng(seed)
    passes = 0

    def multiply(q: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1
        return apply(q)

    width = min(d, wanted + extra)
    q = np.linalg.qr(rng.standard_normal((d, width)))[0]
    riding, best = Lanczos.start(rng.standard_normal(d)), np.inf

    def beside(block: np.ndarray) -> np.ndarray:
        """One pass for the block and, while the bounds are not known well, for the Lanczos vector."""
        if len(riding.alpha) >= lanczos or riding.ended:
            return multiply(block)
        both = multiply(np.concatenate([block, riding.basis[-1][:, None]], axis=1))
        riding.step(both[:, -1])
        return both[:, :-1]

    for _ in range(rounds):
        product = beside(q)
        small = q.T @ product
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, product = q @ turn, product @ turn
        residuals = np.linalg.norm(product[:, :wanted] - q[:, :wanted] * values[:wanted], axis=0)
        worst, scale = residuals.max(), max(values[0], 1e-300)
        # Rounding bounds what can be reached: well below 1e-12 and no longer falling is as good as it gets.
        if worst <= tolerance * scale or best <= 1e-12 * scale and worst > best / 4:
            if width == d or not _larger(multiply, q[:, :wanted], values[wanted - 1], probe, rng, scale):
                return Components(values[:wanted], q[:, :wanted], residuals, passes)
            best = np.inf
            q = np.linalg.qr(np.concatenate([q[:, :-1], rng.standard_normal((d, 1))], axis=1))[0]
            continue
        best = min(best, worst)
        if width == d:  # nothing is unwanted: Rayleigh-Ritz alone is exact up to rounding
            q = np.linalg.qr(product)[0]
            continue
        low, high = min(riding.bounds()[0], values[-1]), values[-1]
        if high - low <= 1e-14 * scale:
            low = 0.0
        steps = degree_for(low, high, values[wanted - 1], scale, worst / (tolerance * scale), degree)
        q = np.linalg.qr(chebyshev(beside, q, low, high, scale, steps))[0]
    raise RuntimeError(f"not certified within {rounds} rounds: residual {worst:.3g} of {scale:.3g}")


def _larger(multiply, found: np.ndarray, least: float, steps: int, rng, scale: float) -> bool:
    """Whether Lanczos steps among the vectors orthogonal to ``found`` meet an eigenvalue above ``least``."""
    project = lambda x: x - found @ (found.T @ x)
    start = project(project(rng.standard_normal(len(found))))
    if np.linalg.norm(start) < 1e-8:
        return False
    probe = Lanczos.start(start)
    for _ in range(min(steps, len(found) - found.shape[1])):
        probe.step(project(multiply(probe.basis[-1][:, None])[:, 0]))
        if probe.ended or probe.beta[-1] <= 1e-13 * scale:
            break
    return bool(probe.values()[-1] > least * (1 + 1e-9) + 1e-13 * scale)


def components_of(fit: Fit, most: int, **options) -> Components:
    """Components with variance, at most ``most``."""
    d, n = fit.d, fit.n

    def apply(q: np.ndarray) -> np.ndarray:
        return summed(fit, lambda c: c.T @ (c @ q), q.shape) / n

    found = leading(apply, d, min(most, d), **options)
    keep = found.values > 1e-12 * fit.trace
    return Components(found.values[keep], found.vectors[:, keep], found.residuals[keep], found.passes)


def deviations(centred_n: np.ndarray) -> list[int]:
    """Sums of squares of rows of whole numbers, exact."""
    if len(centred_n) and int(np.abs(centred_n).max()) ** 2 * centred_n.shape[1] >= 1 << 63:
        found = (centred_n.astype(object) ** 2).sum(axis=1).tolist()
        if max(found) >= 1 << 63:
            raise OverflowError("a deviation exceeds 64 bits")
        return found
    return (centred_n**2).sum(axis=1).tolist()


def whiten(embeddings: DataFrame, *, most: int = 16, **options) -> DataFrame:
    """The whitened components of every usable row of ``embeddings`` (vec_id, embedding); see ``SCHEMA``."""
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), whole_numbers(F.col("embedding")).alias("x")).where("x IS NOT NULL AND size(x) > 0")
    sizes = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    fit = distinct_blocks(rows.where(F.size("x") == sizes["d"]).select("x")) if sizes else None
    if fit is None or fit.trace <= 0:
        return spark.createDataFrame([], SCHEMA)
    found = components_of(fit, most, **options)
    n, d, sums = fit.n, fit.d, fit.sums
    to_white = found.vectors / np.sqrt(found.values)
    k = to_white.shape[1]
    identity_error = float(np.abs(summed(fit, lambda c: (c @ to_white).T @ (c @ to_white), (k, k)) / n - np.eye(k)).max())
    explained = found.values / fit.trace
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            exact = n * batch["x"].flatten().to_numpy().reshape(m, d) - sums
            white = (exact / n) @ to_white
            vec_id = batch["vec_id"].take(pa.array(np.repeat(np.arange(m), k)))
            columns = [
                vec_id, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), pa.array(np.repeat(np.array(deviations(exact), np.int64), k)),
                pa.array(white.reshape(-1)), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, identity_error)),
            ]
            yield pa.record_batch(columns, names)

    return rows.where(F.size("x") == d).mapInArrow(project, SCHEMA)
