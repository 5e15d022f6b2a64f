"""Close pairs in frames of any number of atoms: a frame is cut into tiles, and no task holds more than some of them.

Every atom goes to the tile that it lies in, and as a copy to each tile that it is within the radius of. A pair belongs
to the tile of its lower label, which has the other atom or a copy of it, so each pair is found in one place. Copies
that reach a tile around a periodic cell carry their shifted position; distances follow the minimum image of the given
positions, as in :func:`kinetrove.operators.neighbors.neighbor_pairs`.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetrove.operators.batches import Flat
from kinetrove.operators.neighbors import _close

_KEY = ["run_id", "frame_id", "_t0", "_t1", "_t2"]
_AXES = ("x", "y", "z")


def _dealt(atoms: DataFrame, radius: float, edge: float, cell: Sequence[float] | None, carry: Sequence[str]) -> DataFrame:
    """One row for each atom and tile: the tile, the position there (s0, s1, s2) and whether the atom lies in it."""
    rows, own = atoms.select("run_id", "frame_id", F.col("atom_id").cast("long").alias("atom_id"), *[F.col(c).cast("double").alias(c) for c in (*_AXES, *carry)]), F.lit(True)
    for n, axis in enumerate(_AXES):
        length = None if cell is None else float(cell[n])
        count = None if length is None else max(1, int(length // edge))
        width = edge if length is None else length / count
        at = F.col(axis) if length is None else F.col(axis) - F.lit(length) * F.floor(F.col(axis) / length)
        rows = rows.withColumn(f"_w{n}", at)
        reach = F.sequence(F.floor((F.col(f"_w{n}") - radius) / width), F.floor((F.col(f"_w{n}") + radius) / width))
        rows = rows.withColumn(f"_k{n}", F.explode(reach))
        own = own & (F.col(f"_k{n}") == F.floor(F.col(f"_w{n}") / width))
        k = F.col(f"_k{n}")
        image = F.lit(0).cast("long") if length is None else F.floor(k / count)
        tile = k if length is None else k - image * count
        rows = rows.withColumns({f"_t{n}": tile.cast("long"), f"s{n}": F.col(f"_w{n}") - (0.0 if length is None else length) * image})
    # An atom on the upper edge of its cell may round into the tile behind it, which is the first one again.
    return rows.select(*_KEY, "atom_id", *_AXES, "s0", "s1", "s2", own.alias("own"), *carry)


def tile_pairs(
    atoms: DataFrame, radius: float, edge: float | None = None, cell: Sequence[float] | None = None, carry: Sequence[str] = ()
) -> DataFrame:
    """Pairs ``i < j`` within ``radius``: run_id, frame_id, i, j, d2 and the numeric ``carry`` columns as c_i, c_j.

    ``atoms``: run_id, frame_id, atom_id, x, y, z. ``edge`` is the width of a tile, eight radii by default; a narrower
    one needs less memory and more copies.
    """
    if radius <= 0:
        raise ValueError("radius must be positive")
    reach, box, extra = float(radius), None if cell is None else np.array(cell, float), list(carry)
    names = [*_KEY, "atom_id", *_AXES, "s0", "s1", "s2", "own", *extra]

    def found(table: pa.Table) -> pa.RecordBatch | None:
        """All pairs of whole tiles."""
        column = lambda c: table[c].to_numpy()
        keys = np.stack([column(c).astype(np.int64) for c in _KEY[1:]] + [_changes(table["run_id"])])
        change = (keys[:, 1:] != keys[:, :-1]).any(axis=0)
        tile = np.concatenate([[0], np.cumsum(change)])
        shifted = np.stack([column(f"s{n}") for n in range(3)], axis=1)
        # Places in tiles are searched; a little wider, as shifting rounds. Distances come from the given positions.
        flat = Flat(None, shifted, None, None, tile)
        pairs = [p[:2] for p in _close(flat, reach * (1 + 1e-9) + 1e-12, None)]
        if not pairs:
            return None
        a, b = (np.concatenate(x) for x in zip(*pairs))
        label, own, given = column("atom_id"), table["own"].to_numpy(), np.stack([column(c) for c in _AXES], axis=1)
        a, b = np.where(label[a] < label[b], a, b), np.where(label[a] < label[b], b, a)
        keep = own[a] & (label[a] != label[b])
        a, b = a[keep], b[keep]
        d = given[a] - given[b]
        if box is not None:
            d = d - box * np.rint(d / box)
        d2 = d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2]
        near = d2 <= reach * reach
        a, b, d2 = a[near], b[near], d2[near]
        # Several images of an atom may come close in a small cell: one pair all the same.
        once = np.unique(np.stack([tile[a], label[a], label[b]]), axis=1, return_index=True)[1]
        a, b, d2 = a[once], b[once], d2[once]
        out = {"run_id": table["run_id"].combine_chunks().take(pa.array(a)), "frame_id": column("frame_id")[a], "i": label[a], "j": label[b], "d2": d2}
        for c in extra:
            out |= {f"{c}_i": column(c)[a], f"{c}_j": column(c)[b]}
        return pa.RecordBatch.from_pydict(out)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            # Rows from the last tile of a batch wait for the next one.
            cut = _last_tile(batch)
            if cut == 0 and held and _same_tile(held[-1], batch):
                held.append(batch)
                continue
            if held:
                first = batch.slice(0, cut) if cut else batch.slice(0, 0)
                if (out := found(pa.Table.from_batches([*held, first]))) is not None:
                    yield out
                held = [batch.slice(cut)]
            else:
                if cut and (out := found(pa.Table.from_batches([batch.slice(0, cut)]))) is not None:
                    yield out
                held = [batch.slice(cut)]
        if held and (out := found(pa.Table.from_batches(held))) is not None:
            yield out

    dealt = _dealt(atoms, reach, 8 * reach if edge is None else float(edge), cell, extra)
    ordered = dealt.repartition(*_KEY).sortWithinPartitions(*_KEY).select(*names)
    schema = "run_id string, frame_id long, i long, j long, d2 double" + "".join(f", {c}_i double, {c}_j double" for c in extra)
    return ordered.mapInArrow(search, schema)


def _changes(runs: pa.ChunkedArray) -> np.ndarray:
    """A number for each value of a string column."""
    return runs.combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _tile(batch: pa.RecordBatch, row: int) -> tuple:
    return tuple(batch[c][row].as_py() for c in _KEY)


def _same_tile(a: pa.RecordBatch, b: pa.RecordBatch) -> bool:
    return _tile(a, a.num_rows - 1) == _tile(b, 0)


def _last_tile(batch: pa.RecordBatch) -> int:
    """The first row of the last tile of a batch that is ordered by tile."""
    last, low, high = _tile(batch, batch.num_rows - 1), 0, batch.num_rows - 1
    while low < high:
        middle = (low + high) // 2
        if _tile(batch, middle) == last:
            high = middle
        else:
            low = middle + 1
    return low
