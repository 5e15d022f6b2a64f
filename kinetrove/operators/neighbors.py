"""All pairs of points closer than a radius, by grid cells.

No frame is ever crossed with itself: a point meets only the points of its own and adjacent cells.
``neighbor_pairs`` is an equi-join for long tables; its keys contain the frame, so a run holding most
of the data is spread over its frames. ``frame_pairs`` works on packed frames where they lie: only
the pairs found leave the task, where the join would shuffle fifteen copies of every atom.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetrove.functions import geometry as G
from kinetrove.operators.batches import Flat, flat_frames, list_values
from kinetrove.operators.frames import FRAME_KEY

#: cells are a little wider than the radius, so rounding cannot put a pair two cells apart
_SLACK = 1.000001
#: candidate pairs that are made at once
CANDIDATES = 2_000_000
_HALF_SHELL = [o for o in itertools.product((-1, 0, 1), repeat=3) if o >= (0, 0, 0)]
_FULL_SHELL = list(itertools.product((-1, 0, 1), repeat=3))


def neighbor_pairs(
    points: DataFrame,
    radius: float,
    keys: Sequence[str],
    ident: str = "atom_id",
    carry: Sequence[str] = (),
    cell: Sequence[float] | None = None,
) -> DataFrame:
    """Pairs ``i < j`` (by ``ident``) within ``radius``: keys, i, j, d2 and ``carry`` columns as c_i, c_j.

    With ``cell`` distances follow the minimum image and cells wrap around. A frame's copies meet by
    an equi-join on (keys, cell number).
    """
    cols, edge = ["x", "y", "z"], float(radius) * _SLACK
    if cell is None:
        counts = [None] * 3
        index = [F.floor(F.col(c) / F.lit(edge)) for c in cols]
    else:
        counts = [max(1, int(length // edge)) for length in cell]
        index = [
            F.pmod(F.floor(F.col(c) * n / F.lit(float(length))), F.lit(n)) for c, n, length in zip(cols, counts, cell)
        ]
    # With three or more cells along every axis half of the shell meets each pair of cells once.
    # In a smaller periodic cell offsets coincide: all of them are used, each cell once.
    half = all(n is None or n >= 3 for n in counts)
    shell = _HALF_SHELL if half else _FULL_SHELL
    side = points.select(*keys, ident, *cols, *carry, *[i.alias(f"_c{n}") for n, i in enumerate(index)])

    def key_of(offset) -> Column:
        moved = [F.col(f"_c{n}") + o for n, o in enumerate(offset)]
        moved = [m if n is None else F.pmod(m, F.lit(n)) for m, n in zip(moved, counts)]
        # One number per cell. Far cells may share a number; the distance test tells them apart.
        return moved[0] * F.lit(1 << 42) + moved[1] * F.lit(1 << 21) + moved[2]

    def named(df, tag):
        return df.select(*keys, "_k", *[F.col(c).alias(f"{c}_{tag}") for c in (ident, *cols, *carry)], *extra[tag])

    extra = {1: [key_of((0, 0, 0)).alias("_own")] if half else [], 2: []}
    targets = F.array(*[key_of(o) for o in shell])
    left = named(side.withColumn("_k", F.explode(targets if half else F.array_distinct(targets))), 1)
    right = named(side.withColumn("_k", key_of((0, 0, 0))), 2)
    once = F.col(f"{ident}_1") < F.col(f"{ident}_2")
    if half:
        once = once | (F.col("_own") != F.col("_k"))
    delta = [F.col(f"{c}_1") - F.col(f"{c}_2") for c in cols]
    if cell is not None:
        delta = [G.min_image(d, length) for d, length in zip(delta, cell)]
    pairs = (
        left.join(right, [*keys, "_k"])
        .where(once)
        .withColumn("d2", G.dot(delta, delta))
        .where(F.col("d2") <= F.lit(float(radius) * float(radius)))
    )
    first = F.col(f"{ident}_1") < F.col(f"{ident}_2")

    def ordered(c, low):
        a, b = F.col(f"{c}_1"), F.col(f"{c}_2")
        return F.when(first, a if low else b).otherwise(b if low else a)

    return pairs.select(
        *keys,
        ordered(ident, True).alias("i"),
        ordered(ident, False).alias("j"),
        "d2",
        *[ordered(c, True).alias(f"{c}_i") for c in carry],
        *[ordered(c, False).alias(f"{c}_j") for c in carry],
    )


def _slices(count: np.ndarray) -> Iterator[slice]:
    """Ranges of atoms with about ``CANDIDATES`` candidate pairs together."""
    upto = np.cumsum(count)
    start = 0
    while start < len(count):
        done = upto[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(upto, done + CANDIDATES, "right")))
        yield slice(start, stop)
        start = stop


def _close(flat: Flat, radius: float, cell: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Positions a, b of close atoms of one frame in the flat arrays, each pair once, and d^2.

    Candidates are made and checked in slices, so a crowded cell costs time but no memory.
    """
    q, edge = flat.points, radius * _SLACK
    if cell is None:
        index = np.floor(q / edge).astype(np.int64)
        index -= index.min(axis=0) - 1
        span, wrap = index.max(axis=0) + 2, None
    else:
        wrap = span = np.maximum(1, np.floor(cell / edge)).astype(np.int64)
        index = np.floor(q * wrap / cell).astype(np.int64) % wrap
    half = wrap is None or bool((wrap >= 3).all())
    # A number that wraps around the integer range only adds candidates, and those are checked.
    number = lambda k: ((flat.frame * span[0] + k[:, 0]) * span[1] + k[:, 1]) * span[2] + k[:, 2]
    own = number(index)
    order = np.argsort(own, kind="stable")
    ranked = own[order]
    shell = _HALF_SHELL if half else sorted({tuple(int(v) for v in np.mod(o, wrap)) for o in _FULL_SHELL})
    for offset in shell:
        moved = index + np.array(offset)
        target = number(moved if wrap is None else moved % wrap)
        low = np.searchsorted(ranked, target, "left")
        count = np.searchsorted(ranked, target, "right") - low
        for part in _slices(count):
            n, first = count[part], low[part]
            a = np.repeat(np.arange(part.start, part.stop), n)
            b = order[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            keep = flat.frame[a] == flat.frame[b]
            if not half or not any(offset):
                keep &= a < b
            a, b = a[keep], b[keep]
            d = q[a] - q[b]
            if cell is not None:
                d = d - cell * np.rint(d / cell)
            d2 = d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2]
            near = d2 <= radius * radius
            if near.any():
                yield a[near], b[near], d2[near]


def frame_pairs(
    frames: DataFrame, radius: float, carry: dict[str, Column] | None = None, cell: Sequence[float] | None = None
) -> DataFrame:
    """Like ``neighbor_pairs`` for packed frames: run_id, frame_id, i, j, d2 and carried values.

    ``carry`` gives ARRAY<DOUBLE> columns with one value per atom, returned as name_i and name_j; a
    missing value comes back as NaN. A narrow step over Arrow batches of frames.
    """
    carry = carry or {}
    names = list(carry)  # the search runs on executors and takes plain values only
    box = None if cell is None else np.array(cell, dtype=float)
    reach = float(radius)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for flat in flat_frames(batches):
            for a, b, d2 in _close(flat, reach, box):
                a, b = np.minimum(a, b), np.maximum(a, b)
                rows = pa.array(flat.frame[a])
                label = lambda k: (k - flat.starts[flat.frame[k]] + 1).astype(np.int32)
                out = {c: flat.batch.column(c).take(rows) for c in FRAME_KEY}
                out |= {"i": label(a), "j": label(b), "d2": d2}
                for name in names:
                    values = list_values(flat.batch.column(name)).astype(float)
                    out |= {f"{name}_i": values[a], f"{name}_j": values[b]}
                yield pa.RecordBatch.from_pydict(out)

    points = F.transform("pos", lambda p: F.struct(*[p[c].alias(c) for c in G.AXES]))
    ready = frames.where(F.size("pos") > 0).select(
        *FRAME_KEY, points.alias("pos"), *[v.alias(n) for n, v in carry.items()]
    )
    extra = "".join(f", {n}_i double, {n}_j double" for n in carry)
    return ready.mapInArrow(search, f"run_id string, frame_id bigint, i int, j int, d2 double{extra}")
