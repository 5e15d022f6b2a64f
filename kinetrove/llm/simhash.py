"""Near duplicates by SimHash, found through Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into four segments of 16 bits. If two fingerprints differ in at most three bits, one
segment is free of errors, and of the two halves of the other 48 bits one has at most one. So the exact segment
with the Golay keys of a half (23 of its 24 bits) makes eight kinds of keys: one side gives a word's own index, the other
all its keys, one or six. Fingerprints that meet in a key are compared; no pair within three bits is lost.

``unique_texts`` asks for more: sets of five-word shingles at a Jaccard similarity of 0.8 or more. There one bit in
seven differs, so no number of errors can be guaranteed. Fingerprints of 512 bits are cut into ``BANDS`` draws of 23 and
14 bits: all Golay keys of the 23 bits (one or six, so that words with many errors still meet), the 14 exact bits and
the size of the set within a factor of two make a key. Fingerprints that meet are compared, and every link is confirmed on the
full sets, by the steps of ``minhash.linked_sets``, which form no pairs within a bucket.

Equal fingerprints are one node, so copies are never paired. Links are joined to components by star steps, written
to the shared folder round by round. Nothing is collected.

Letters A-Z are lower-cased; words are runs of other than ASCII white space; fewer words than a shingle are one
shingle, none (null and empty texts) give fingerprint 0, linked like any other. Ties at exactly half of the hashes
give bit 0. Null doc_ids take part, but are component ids only where nothing else is (they come last). Repeated
rows are reported one by one. An empty table gives no rows; extra columns go along in ``unique``.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, log, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetrove.llm import golay, minhash
from kinetrove.llm.common import small_batches, stage, text_bytes
from kinetrove.llm.components import components

SEED = 42
SEGMENT = 16
#: Bytes of hashes whose bits are counted at once.
AT_ONCE = 1 << 16
#: The wide fingerprint: its bits, the draws made from it, and the bits of a draw that must be equal.
WIDE, BANDS, EXACT = 512, 32, 14
#: Sizes of sets are told apart by this factor, from another start in every draw.
SIZES = 2.0
_RNG = np.random.default_rng(7)
_ODD = _RNG.integers(0, 1 << 63, WIDE // 64, np.uint64) * np.uint64(2) + np.uint64(1)
_DRAWS = np.array([_RNG.permutation(WIDE)[: golay.BITS + EXACT] for _ in range(BANDS)])
_STARTS = _RNG.random(BANDS)


def fingerprint(text: bytes, shingle: int) -> int:
    import xxhash

    words = text.lower().split()  # bytes: only A-Z are lower-cased, only ASCII white space separates
    if not words:
        return 0
    h64 = xxhash.xxh64_intdigest
    parts = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    hashes = np.array([h64(s, SEED) for s in parts], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), AT_ONCE // 8):
        bits = np.unpackbits(hashes[at : at + AT_ONCE // 8].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << int(b) for b in np.flatnonzero(2 * ones > len(hashes)))


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """row, doc_id and the fingerprint as a signed long, written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_buffer().to_pybytes(), shingle) for t in batch["text"]], np.uint64)
            yield pa.record_batch([batch["row"], batch["doc_id"], pa.array(found.view(np.int64))], ["row", "doc_id", "print"])

    rows = small_batches(docs).select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_bytes("text").alias("text"))
    return stage(rows.mapInArrow(run, "row long, doc_id long, print long"), "fingerprints")


def fuzzy_keys(prints: DataFrame, every: bool) -> DataFrame:
    """(key, print): with ``every`` all Golay keys of a fingerprint, else only the own index of each of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                values = batch["print"].slice(at, 4096).to_numpy()
                word = values.view(np.uint64)
                for exact in range(64 // SEGMENT):
                    segment = (word >> np.uint64(SEGMENT * exact)).astype(np.int64) & 0xFFFF
                    below = word & np.uint64((1 << SEGMENT * exact) - 1)
                    above = word >> np.uint64(SEGMENT * (exact + 1)) if exact < 3 else np.zeros_like(word)
                    others = above << np.uint64(SEGMENT * exact) | below
                    for half in (0, 1):
                        w = (others >> np.uint64(24 * half)).astype(np.int64) & ((1 << golay.BITS) - 1)
                        rows, index = golay.keys(w) if every else (np.arange(len(w)), golay.indices(w))
                        key = (exact * 2 + half) << 28 | segment[rows] << 12 | index
                        yield pa.record_batch([pa.array(key), pa.array(values[rows])], ["key", "print"])

    return prints.select("print").mapInArrow(run, "key long, print long")


def links(prints: DataFrame, bits: int = 3) -> DataFrame:
    """(u, v), u < v: distinct fingerprints that differ in at most ``bits`` (three at most) bits. May repeat a pair."""
    if not 0 <= bits <= 3:
        raise ValueError("the keys find pairs within three bits")
    one, all_ = fuzzy_keys(prints, every=False), fuzzy_keys(prints, every=True)
    # Spark takes the keys, many for each fingerprint, to be as small as the fingerprints, and would broadcast them.
    pairs = one.withColumnRenamed("print", "u").join(all_.withColumnRenamed("print", "v").hint("merge"), "key")
    near = pairs.where((F.col("u") != F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= bits))
    return near.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))


def classes(docs: DataFrame, *, shingle: int = 3, bits: int = 3) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, print) of every row, and (print, component_id) of every distinct fingerprint."""
    rows = fingerprints(docs, shingle)
    prints = stage(rows.groupBy("print").agg(F.min("doc_id").alias("least")), "prints")
    nodes = components(stage(links(prints, bits), "near-prints"))
    joined = prints.join(nodes.withColumnRenamed("node", "print"), "print", "left").withColumn("component", F.coalesce("component", "print"))
    named = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    return rows, stage(joined.select("print", "component").join(named, "component").select("print", "component_id"), "print-classes")


def near_duplicates(docs: DataFrame, *, shingle: int = 3, bits: int = 3) -> DataFrame:
    """doc_id, fingerprint (hexadecimal), component_id (smallest doc_id that can be reached) of every row."""
    rows, named = classes(docs, shingle=shingle, bits=bits)
    return rows.join(named, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def without_copies(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """``docs`` without the ids of ``marked`` (doc_id, stays) that have no row that stays. Only such ids meet the texts."""
    # An id with several texts goes only if none of them stays.
    gone = stage(marked.groupBy("doc_id").agg(F.max("stays").alias("stays")).where("NOT stays").select(F.col("doc_id").alias("_gone")), "near-dropped")
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def unique(docs: DataFrame, *, shingle: int = 3, bits: int = 3) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its component, with all columns.

    Rows that share it all stay, and so do rows without an id.
    """
    rows, named = classes(docs, shingle=shingle, bits=bits)
    return without_copies(docs, rows.join(named, "print").where("doc_id IS NOT NULL").select("doc_id", (F.col("doc_id") == F.col("component_id")).alias("stays")))


def wide_fingerprint(hashes: np.ndarray) -> bytes:
    """``WIDE`` bits of a set of shingle hashes; a bit is 1 if set in over half of them."""
    ones = np.zeros(WIDE, np.int64)
    for at in range(0, len(hashes), 1024):
        words = minhash.spread(hashes[at : at + 1024, None] * _ODD)
        ones += np.unpackbits(words.view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes)).tobytes()


def wide_signatures(docs: DataFrame, size: int) -> DataFrame:
    """row, doc_id, text_hash, n, digest of the set and wide fingerprint (``sketch``) of every row, written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            n, digest, sketch = [], [], []
            for text in batch["text"]:
                hashes = minhash.shingles(text.as_buffer().to_pybytes(), size)
                n.append(len(hashes))
                digest.append(xxhash.xxh3_128_digest(hashes.tobytes()))
                sketch.append(np.frombuffer(wide_fingerprint(hashes), np.int64))
            columns = [pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sketch, pa.list_(pa.int64()))]
            yield pa.record_batch([batch["row"], batch["doc_id"], batch["text_hash"], *columns], ["row", "doc_id", "text_hash", "n", "digest", "sketch"])

    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_bytes("text").alias("text"), F.xxhash64(text_bytes("text")).alias("text_hash")
    )
    return stage(rows.mapInArrow(run, "row long, doc_id long, text_hash long, n long, digest binary, sketch array<long>"), "wide-prints")


def wide_keys(sets: DataFrame) -> DataFrame:
    """(class, part): one or six keys for every draw from the fingerprint of a set. ``sets``: class, n, sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                words = part["sketch"].flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, WIDE // 64)
                bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1)
                size = np.log(part["n"].to_numpy()) / log(SIZES)
                names = part["class"].to_numpy()
                for band in range(BANDS):
                    drawn = bits[:, _DRAWS[band]].astype(np.int64)
                    rows, index = golay.keys(drawn[:, : golay.BITS] @ (1 << np.arange(golay.BITS)))
                    rest = (np.floor(size + _STARTS[band]).astype(np.int64) * BANDS + band) << EXACT | drawn[:, golay.BITS :] @ (1 << np.arange(EXACT))
                    yield pa.record_batch([pa.array(names[rows]), pa.array(rest[rows] << golay.INFO | index)], ["class", "part"])

    return sets.select("class", "n", "sketch").mapInArrow(run, "class long, part long")


def most_wide(percent: int, deviations: float = 5.5) -> int:
    """Bits in which the wide fingerprints of sets this similar may differ; 0.04 more for ties in very small sets."""
    j = percent / 100
    odds = acos(2 * j / (1 + j)) / pi + 0.04
    return ceil(WIDE * odds + deviations * sqrt(WIDE * odds * (1 - odds)))


def unique_texts(docs: DataFrame, *, shingle: int = 5, percent: int = 80, block: int = 256) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest among those linked by the similarity of their shingle sets.

    Rows that share that id all stay, and so do rows without an id or a word. A pair at exactly 0.8 meets in a key with
    odds of about 0.85, at 0.9 of 0.99; what meets is decided on full sets, so nothing less similar is linked.
    """
    rows = wide_signatures(docs, shingle)
    named = minhash.linked_sets(docs, rows, wide_keys, most_wide(percent), shingle=shingle, percent=percent, block=block)
    marked = rows.where("doc_id IS NOT NULL").select("doc_id", "n", "digest").join(named, "digest", "left")
    return without_copies(docs, marked.select("doc_id", (F.col("n").eqNullSafe(0) | (F.col("doc_id") == F.col("component_id"))).alias("stays")))
