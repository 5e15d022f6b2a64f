"""Exact duplicates by two passes over a Bloom filter.

Texts are equal when they are the same after all ASCII white space is deleted. The first pass fills, from hashes
alone, a blocked Bloom filter that tells bits hit once from bits hit more often; filters of different tasks are joined
block by block. The second pass looks every row up: a row with a bit that was hit only once has no equal, and passes
straight through. The others, few false ones among them, are shuffled and grouped by their digest.

The filter takes ``bits_per_row`` bits a row up to ``most_blocks`` blocks of 512 bytes: that bounds what is
broadcast (32 MB by default, enough for 16 million rows at 16 bits). Beyond it more rows are shuffled; the result
stays the same. Pass one merges one filter for every ``rows_per_task`` rows.

Of equal texts the row with the most code points stays, then the smallest doc_id (null last), then the first row.
Null counts as empty. Large groups: digests are pre-aggregated before their shuffle, and the join of members with the
written groups is one that Spark splits. An empty table gives no rows. Extra columns go along in ``unique``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetrove.llm.common import WHITE, stage

WORDS = 64
HITS = 5


def digest(text: Column) -> Column:
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, "").cast("binary"), 256)


def _places(digests: Column, blocks: int) -> tuple[Column, list[Column]]:
    """The block of a digest, and its bits there."""
    bits = F.xxhash64(F.lit("bits"), digests)
    return F.pmod(F.xxhash64(digests), F.lit(blocks)).cast("int"), [F.shiftright(bits, 12 * i).bitwiseAND(WORDS * 64 - 1).cast("int") for i in range(HITS)]


def repeated_filter(digests: DataFrame, *, bits_per_row: int = 16, most_blocks: int = 1 << 16, rows_per_task: int = 2_000_000) -> tuple[DataFrame, int]:
    """(block, words) of the bits hit more than once by the column ``sha``, and the number of blocks."""
    n = digests.count()
    blocks = max(1, min(most_blocks, -(-n * bits_per_row // (WORDS * 64))))
    block, bits = _places(F.col("sha"), blocks)
    schema = "block int, once array<long>, twice array<long>"

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(blocks * WORDS, np.uint64), np.zeros(blocks * WORDS, np.uint64)
        for batch in batches:
            at = batch["block"].to_numpy().astype(np.int64) * WORDS * 64
            for hit in np.stack([batch[f"b{i}"].to_numpy() for i in range(HITS)]):
                hits, counts = np.unique(at + hit, return_counts=True)
                word, bit = hits >> 6, np.uint64(1) << (hits & 63).astype(np.uint64)
                again = (counts > 1) | (once[word] & bit != 0)
                np.bitwise_or.at(twice, word[again], bit[again])
                np.bitwise_or.at(once, word, bit)
        used = np.flatnonzero(once.reshape(blocks, WORDS).any(axis=1))
        for i in range(0, len(used), 4096):
            yield _blocks(used[i : i + 4096], once.reshape(blocks, WORDS), twice.reshape(blocks, WORDS))

    def _blocks(used: np.ndarray, once: np.ndarray, twice: np.ndarray) -> pa.RecordBatch:
        offsets = pa.array(np.arange(0, len(used) * WORDS + 1, WORDS, dtype=np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x[used].reshape(-1).view(np.int64))) for x in (once, twice)]
        return pa.record_batch([pa.array(used.astype(np.int32)), *lists], ["block", "once", "twice"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, once, twice = None, None, None
        for batch in batches:
            rows = zip(batch["block"].to_numpy(), *(batch[c].flatten().to_numpy().reshape(-1, WORDS) for c in ("once", "twice")))
            for k, a, b in rows:
                if k != now:
                    if now is not None:
                        yield pa.record_batch([pa.array([now], pa.int32()), pa.array([twice.tolist()], pa.list_(pa.int64()))], ["block", "words"])
                    now, once, twice = k, np.zeros_like(a), np.zeros_like(b)
                twice = twice | b | once & a
                once = once | a
        if now is not None:
            yield pa.record_batch([pa.array([now], pa.int32()), pa.array([twice.tolist()], pa.list_(pa.int64()))], ["block", "words"])

    hits = digests.select(block.alias("block"), *[b.alias(f"b{i}") for i, b in enumerate(bits)])
    filled = hits.coalesce(max(1, -(-n // rows_per_task))).mapInArrow(fill, schema)
    merged = filled.repartition("block").sortWithinPartitions("block").mapInArrow(merge, "block int, words array<long>")
    return stage(merged, "bloom"), blocks


def maybe_repeated(rows: DataFrame, repeated: DataFrame, blocks: int) -> DataFrame:
    """Adds ``maybe``: false where no other row has the same ``sha``. Nothing is shuffled."""
    block, bits = _places(F.col("sha"), blocks)
    hit = None
    for b in bits:
        one = F.getbit(F.get("_words", F.shiftright(b, 6)), b.bitwiseAND(63)) == 1
        hit = one if hit is None else hit & one
    found = rows.withColumn("_block", block).join(F.broadcast(repeated.select(F.col("block").alias("_block"), F.col("words").alias("_words"))), "_block", "left")
    return found.withColumn("maybe", F.coalesce(hit, F.lit(False))).drop("_block", "_words")


def _best() -> Column:
    return F.min(F.struct((-F.col("n_points")).alias("less"), F.col("doc_id").isNull().alias("none"), "doc_id", "row"))


def _listed(docs: DataFrame) -> tuple[DataFrame, DataFrame, int, DataFrame]:
    """Slim rows, the filter, and the groups of more than one row, each read from the shared folder."""
    slim = docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_points"), digest(F.col("text")).alias("sha")
    )
    slim = stage(slim, "digests")
    repeated, blocks = repeated_filter(slim)
    groups = maybe_repeated(slim, repeated, blocks).where("maybe").groupBy("sha").agg(F.count("*").alias("group_size"), _best().alias("best")).where("group_size > 1")
    groups = groups.select("sha", "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"), (-F.col("best.less")).alias("keep_points"))
    return slim, repeated, blocks, stage(groups, "equal-groups")


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs`` (doc_id, text)."""
    slim, repeated, blocks, found = _listed(docs)
    marked = maybe_repeated(slim, repeated, blocks)
    alone = marked.where(~F.col("maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"))
    single = F.col("group_size").isNull()
    shared = marked.where("maybe").join(found, "sha", "left").select(
        "doc_id", F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"),
        (single | (F.col("row") == F.col("keep_row"))).alias("kept"), F.col("sha").alias("text_sha256"),
    )
    return alone.unionByName(shared)


def unique(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. Only rows that the filter holds for repeated are shuffled."""
    slim, repeated, blocks, found = _listed(docs)
    key = [F.col("sha"), F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_none"), F.col("n_points").alias("_points")]
    stay = found.select("sha", F.coalesce("keep_id", F.lit(0)).alias("_id"), F.col("keep_id").isNull().alias("_none"), F.col("keep_points").alias("_points"))
    sizes = found.select("sha")
    # Digest, id and length tell the copies of a large group apart, so none of these joins has a hot key but the
    # slim semi join, which Spark splits.
    gone = maybe_repeated(slim, repeated, blocks).where("maybe").join(sizes, "sha", "left_semi").select(*key).join(stay, ["sha", "_id", "_none", "_points"], "left_anti").distinct()
    gone = stage(gone, "equal-dropped")
    rows = docs.select(F.struct("*").alias("_doc"), F.col("doc_id").alias("doc_id"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_points"), digest(F.col("text")).alias("sha"))
    rows = maybe_repeated(rows, repeated, blocks)
    alone = rows.where(~F.col("maybe")).select("_doc.*")
    kept = rows.where("maybe").select("_doc", *key).join(gone, ["sha", "_id", "_none", "_points"], "left_anti")
    return alone.unionByName(kept.dropDuplicates(["sha", "_id", "_none", "_points"]).select("_doc.*"))
