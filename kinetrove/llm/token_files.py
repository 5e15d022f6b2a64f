"""Token ids as Arrow stream files of fixed-size lists: equal-length sequences and masks with random access.

A shard is one Arrow IPC stream file. Every record batch holds the same number of rows, every row one sequence of
``length`` ids and two bit masks of the same length, so all batch messages have one size and sequence k lies at a
computed offset: ``Shard.sequence(k)`` maps the file and copies nothing. A second stream file beside it holds the
shard's document ids in order. Documents follow each other in the shard's token stream, each closed by ``end_id``;
the last sequence is filled up with zeros and the last batch with empty sequences.

* ``ids``: fixed_size_list<uint16 or uint32>[length], the width from the size of the vocabulary
* ``mask``: fixed_size_list<bool>[length], true for ids, false for filling
* ``ends``: fixed_size_list<bool>[length], true at the last id of a document

Documents are dealt by ranges of (doc_id, hash of the text), so a repeated id cannot fill one task, and one task
writes one shard. Files get a new name in every attempt; only those named in the committed list of shards count,
so a lost executor or a second attempt leaves at most an unused file.

Null and empty texts give the end id alone. A null doc_id sorts first. Rows that are equal in every column are kept
as often as they occur. An empty table gives no shard. Other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinetrove.llm.common import open_input, open_output, scratch, small_batches, stage
from kinetrove.llm.tokens import encoder

SHARD_SCHEMA = "shard int, path string, docs_path string, n_docs long, n_tokens long, n_sequences long"
READ_SCHEMA = "shard int, doc_id long, start long, n_tokens long, ids_crc32 long"


class ShardWriter:
    """One shard: documents in, batches of ``rows`` sequences of ``length`` ids out. Holds one batch at most."""

    def __init__(self, path: str, length: int, rows: int, wide: bool):
        if length % 8:
            raise ValueError("length must be a multiple of 8, so that every row of a mask starts at a byte")
        self.length, self.size, self.dtype = length, length * rows, np.dtype("<u4" if wide else "<u2")
        item = pa.uint32() if wide else pa.uint16()
        self.schema = pa.schema([("ids", pa.list_(item, length)), ("mask", pa.list_(pa.bool_(), length)), ("ends", pa.list_(pa.bool_(), length))])
        self.file = open_output(path)
        self.stream = pa.ipc.new_stream(self.file, self.schema)
        self.ids, self.ends = np.zeros(self.size, self.dtype), np.zeros(self.size, bool)
        self.at = self.n_tokens = 0

    def add(self, ids: np.ndarray) -> None:
        self.n_tokens += len(ids)
        left = ids
        while len(left):
            n = min(len(left), self.size - self.at)
            self.ids[self.at : self.at + n] = left[:n]
            left, self.at = left[n:], self.at + n
            if not len(left):
                self.ends[self.at - 1] = True
            if self.at == self.size:
                self._write()

    def _write(self) -> None:
        lists = [pa.array(self.ids), pa.array(np.arange(self.size) < self.at), pa.array(self.ends)]
        arrays = [pa.FixedSizeListArray.from_arrays(x, self.length) for x in lists]
        self.stream.write_batch(pa.record_batch(arrays, schema=self.schema))
        self.ids[:], self.ends[:], self.at = 0, False, 0

    def close(self) -> None:
        if self.at:
            self._write()
        self.stream.close()
        self.file.close()


class Shard:
    """Reads a shard file. Sequence k is found by arithmetic, without a footer and without reading others."""

    def __init__(self, path: str):
        self.file = open_input(path)
        self.schema = pa.ipc.read_schema(pa.ipc.read_message(self.file))
        self.first = self.file.tell()
        self.step = None
        total = self.file.size()
        if total - self.first > 8:
            message = pa.ipc.read_message(self.file)
            self.step = self.file.tell() - self.first
            self.rows = pa.ipc.read_record_batch(message, self.schema).num_rows
        self.n_batches = (total - self.first) // self.step if self.step else 0

    def batch(self, k: int) -> pa.RecordBatch:
        if not 0 <= k < self.n_batches:
            raise IndexError(k)
        self.file.seek(self.first + k * self.step)
        return pa.ipc.read_record_batch(pa.ipc.read_message(self.file), self.schema)

    def sequence(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, mask) of a sequence; ids are a view of the mapped file."""
        batch = self.batch(k // self.rows).slice(k % self.rows, 1)
        return batch["ids"].flatten().to_numpy(), batch["mask"].flatten().to_numpy(zero_copy_only=False)

    def close(self) -> None:
        self.file.close()


def write_tokens(docs: DataFrame, folder: str, vocabulary: str, *, end_id: int = 2, length: int = 2048, rows: int = 64) -> DataFrame:
    """Write ``docs`` (doc_id, text) in ascending doc_id order; returns the committed list of shards."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, shard = encoder(vocabulary), TaskContext.get().partitionId()
        wide = max(encode.vocabulary, end_id + 1) > 1 << 16
        end, out, n_docs = np.uint32(end_id), None, 0
        for batch in batches:
            if out is None and batch.num_rows:
                path = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}"
                out = ShardWriter(f"{path}.arrows", length, rows, wide)
                docs_file = open_output(f"{path}.docs.arrows")
                docs_stream = pa.ipc.new_stream(docs_file, pa.schema([("doc_id", pa.int64())]))
            for text in batch["text"]:
                out.add(np.append(np.frombuffer(encode(text.as_py()), "<u4"), end))
            if batch.num_rows:
                docs_stream.write_batch(pa.record_batch([batch["doc_id"].cast(pa.int64())], ["doc_id"]))
                n_docs += batch.num_rows
        if out is not None:
            out.close()
            docs_stream.close()
            docs_file.close()
            row = [shard, f"{path}.arrows", f"{path}.docs.arrows", n_docs, out.n_tokens, -(-out.n_tokens // length)]
            kinds = [pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            names = [f.split()[0] for f in SHARD_SCHEMA.split(", ")]
            yield pa.record_batch([pa.array([x], t) for x, t in zip(row, kinds)], names)

    ordered = (
        small_batches(docs).select("doc_id", "text", F.xxhash64("text").alias("_h"))
        .repartitionByRange("doc_id", "_h")
        .sortWithinPartitions("doc_id", "_h", "text")
        .select("doc_id", "text")
    )
    return stage(ordered.mapInArrow(write, SHARD_SCHEMA), "token-shards")


def read_tokens(shards: DataFrame) -> DataFrame:
    """One row per document of the listed files: start (ids before it), n_tokens and the checksum of its ids."""
    # One row per shard goes through this window, not one per document.
    before = F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    listed = shards.withColumn("base", F.coalesce(before, F.lit(0)))
    names = [f.split()[0] for f in READ_SCHEMA.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from _documents(row)

    def _documents(row: dict) -> Iterator[pa.RecordBatch]:
        with open_input(row["docs_path"]) as file:
            doc_ids = pa.ipc.open_stream(file).read_all()["doc_id"].combine_chunks()
        shard = Shard(row["path"])
        done, start, crc, count = 0, row["base"], 0, 0
        for k in range(shard.n_batches):
            batch = shard.batch(k)
            used = int(np.count_nonzero(batch["mask"].flatten().to_numpy(zero_copy_only=False)))
            ids = batch["ids"].flatten().to_numpy()[:used].astype("<u4")
            stops = np.flatnonzero(batch["ends"].flatten().to_numpy(zero_copy_only=False)[:used]) + 1
            rows, at = [], 0
            for stop in stops:
                crc = zlib.crc32(ids[at:stop], crc)
                n = count + int(stop) - at
                rows.append((start, n, crc))
                start, at, crc, count = start + n, int(stop), 0, 0
            crc, count = zlib.crc32(ids[at:], crc), count + used - at
            if rows:
                columns = [pa.array([row["shard"]] * len(rows), pa.int32()), doc_ids.slice(done, len(rows))]
                columns += [pa.array(x, pa.int64()) for x in zip(*rows)]
                done += len(rows)
                yield pa.record_batch(columns, names)
        shard.close()
        if done != row["n_docs"] or start != row["base"] + row["n_tokens"] or count:
            raise ValueError(f"{row['path']} holds {done} documents up to id {start}, not {row['n_docs']}")

    spread = int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return listed.repartition(spread).mapInArrow(read, READ_SCHEMA)


def token_files(docs: DataFrame, vocabulary: str, **options) -> DataFrame:
    """Encode, write, read back: doc_id, start, n_tokens, ids_crc32."""
    folder = scratch(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, folder, vocabulary, **options)).drop("shard")
