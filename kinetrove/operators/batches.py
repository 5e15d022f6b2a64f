"""Packed frames of an Arrow batch as flat NumPy arrays."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: atoms handled at once inside a batch
ATOMS_AT_ONCE = 200_000


class Flat(NamedTuple):
    batch: pa.RecordBatch
    points: np.ndarray  # all atoms of the piece, x y z
    sizes: np.ndarray  # atoms per frame
    starts: np.ndarray  # first atom of each frame
    frame: np.ndarray  # frame of each atom


def list_values(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def flat_frames(batches: Iterator[pa.RecordBatch]) -> Iterator[Flat]:
    """Frames in pieces of whole frames; frames without atoms are left out by the caller."""
    for batch in batches:
        lengths = pc.list_value_length(batch.column("pos")).to_numpy(zero_copy_only=False).astype(np.int64)
        piece = (np.cumsum(lengths) - 1) // ATOMS_AT_ONCE
        for p in np.unique(piece):
            rows = np.flatnonzero(piece == p)
            part, sizes = batch.slice(rows[0], len(rows)), lengths[rows]
            flat = part.column("pos").flatten()
            points = np.stack([pc.struct_field(flat, c).to_numpy(zero_copy_only=False) for c in "xyz"], axis=1)
            yield Flat(part, points, sizes, np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes))
