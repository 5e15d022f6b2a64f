"""Sum-of-squares packing of token sequences.

Whole windows are cut from long documents first. Every remainder is then placed online: ``open[h]`` counts the
partially filled windows with h tokens (the level array), and of all levels where the piece fits, and a new window,
that one is taken which makes the sum of squares of these counts smallest; ties go to the fullest level. At most
``most_open`` windows stay open in a task. When that bound is reached, and at the end, open windows are settled:
pieces of the emptiest ones are cut to fill the fullest ones, which leaves one partial window. At the end that one is
cut into sequences with power-of-two lengths, which need no padding.

A task packs the documents of one input split, in its order, so nothing is shuffled and a repeated attempt gives the
same rows. Memory: the open windows (``most_open`` x ``length`` ids) and one Arrow batch.

Null and empty texts are the end id alone. Null and repeated doc_ids are kept as they are. An empty table gives no
rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kinetrove.llm.common import small_batches
from kinetrove.llm.tokens import encoder

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long"
NAMES = [f.split()[0] for f in SCHEMA.split(", ")]
#: Sequence numbers of one task lie below this; a task's own number stands above it.
PER_TASK = 1 << 36


class Packer:
    """Pieces are (doc_id, start, ids, doc_tokens); ``take()`` gives the rows of closed sequences."""

    def __init__(self, length: int = 2048, most_open: int = 2048, first_sequence: int = 0):
        self.length, self.most_open, self.next = length, most_open, first_sequence
        self.open = np.zeros(length + 1, np.int64)
        self.windows: list[list] = [[] for _ in range(length + 1)]
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        full = len(ids) // self.length * self.length
        for at in range(0, full, self.length):
            self._close([(doc_id, at, ids[at : at + self.length], len(ids))])
        if full < len(ids):
            self._place((doc_id, full, ids[full:].copy(), len(ids)))

    def level(self, size: int) -> int:
        """The level to place a piece of this size at; 0 is a new window."""
        counts, room = self.open, self.length - size
        # Change of the sum of squares, halved: (N[h+s] - N[h] + 1); a closed window leaves no count behind.
        change = counts[size : self.length + 1] - counts[: room + 1] + 1.0
        change[0] = counts[size] + 0.5 if room else 0.0
        if room:
            change[room] = 0.5 - counts[room]
        change[1:][counts[1 : room + 1] == 0] = np.inf
        return room - int(np.argmin(change[::-1]))

    def _place(self, piece: tuple) -> None:
        size = len(piece[2])
        at = self.level(size)
        pieces = []
        if at:
            pieces = self.windows[at].pop()
            self.open[at] -= 1
        pieces.append(piece)
        self._put(at + size, pieces)
        if self.open.sum() > self.most_open:
            self.settle()

    def _put(self, level: int, pieces: list) -> None:
        if level == self.length:
            self._close(pieces)
        else:
            self.windows[level].append(pieces)
            self.open[level] += 1

    def settle(self) -> None:
        """Fill the fullest open windows with what the emptiest hold; at most one partial window stays."""
        queue = [(h, w) for h in range(self.length) for w in self.windows[h]]
        self.windows = [[] for _ in range(self.length + 1)]
        self.open[:] = 0
        low, high, spare = 0, len(queue) - 1, []
        while low <= high:
            level, pieces = queue[high]
            high -= 1
            while level < self.length:
                if not spare:
                    if low > high:
                        break
                    spare = queue[low][1]
                    low += 1
                doc_id, start, ids, total = spare.pop()
                room = self.length - level
                if len(ids) > room:
                    spare.append((doc_id, start + room, ids[room:], total))
                    ids = ids[:room]
                pieces.append((doc_id, start, ids, total))
                level += len(ids)
            self._put(level, pieces)
        if spare:
            self._put(sum(len(p[2]) for p in spare), spare)

    def finish(self) -> None:
        self.settle()
        for level in np.flatnonzero(self.open):
            for pieces in self.windows[level]:
                left, part = int(level), []
                size = room = 1 << (left.bit_length() - 1)
                for doc_id, start, ids, total in pieces:
                    while len(ids):
                        cut = ids[:room]
                        part.append((doc_id, start, cut, total))
                        start, ids, room = start + len(cut), ids[len(cut) :], room - len(cut)
                        if not room:
                            self._close(part)
                            left, part = left - size, []
                            size = room = 1 << (left.bit_length() - 1) if left else 0
        self.windows = [[] for _ in range(self.length + 1)]
        self.open[:] = 0

    def _close(self, pieces: list) -> None:
        offset, length = 0, sum(len(p[2]) for p in pieces)
        for doc_id, start, ids, total in pieces:
            crc = zlib.crc32(np.ascontiguousarray(ids, "<u4"))
            self.rows.append((doc_id, start, len(ids), crc, total, self.next, offset, length))
            offset += len(ids)
        self.next += 1

    def take(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def pack(docs: DataFrame, vocabulary: str, *, end_id: int = 1, length: int = 2048, most_open: int = 2048) -> DataFrame:
    """One row per piece of each document of ``docs`` (doc_id, text); see ``SCHEMA``."""

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(x, pa.int64()) for x in zip(*rows)], NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, end = encoder(vocabulary), np.uint32(end_id)
        packer = Packer(length, most_open, TaskContext.get().partitionId() * PER_TASK)
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                packer.add(doc_id.as_py(), np.append(np.frombuffer(encode(text.as_py()), "<u4"), end))
                if len(packer.rows) >= 5000:
                    yield batch_of(packer.take())
        packer.finish()
        if packer.rows:
            yield batch_of(packer.take())

    return small_batches(docs).select("doc_id", "text").mapInArrow(run, SCHEMA)
