"""Near duplicates by MinHash bands, odd sketches and full sets.

A document's set holds the hashes of its distinct word shingles. Of ``SAMPLES`` MinHash samples ``BANDS`` bands of
``ROWS`` give the buckets in which similar sets meet: a pair at similarity 0.85 misses all of them with odds of about
2e-9. All samples are folded into an odd sketch, a parity bitmap of ``BITS`` bits: two sketches differ in about as
many bits as there are unshared samples, so the population count of their XOR estimates a high similarity closely.
A pair whose estimate lies 5.5 deviations below the wanted similarity is left out; every other link is confirmed on
the full sets.

Equal sets are one class, so copies are never paired. No bucket gives all its pairs:

1. stars: each class is held against the smallest ones of its buckets, by sketch and then by full set, and what links
   is joined to components. Of the many smallest ones that a near copy meets, the ``TRIES`` it shares most buckets with
   are taken, so a group of near copies costs that many candidates each. Buckets of two end here, so all their pairs are taken.
2. rest: where a bucket still has several components, tasks compare the sketches of blocks of its members, those
   outside of its largest component against all, and give a spanning forest of what may link.
3. groups of what may link are compared on full sets, again in blocks, and give a spanning forest of what does link.

What stars leave out, step 2 compares: no link between different components is lost. Tasks hold two blocks at most. Work grows with the square of a
group only for members that resemble each other without being linked to its largest component.

A-Z are lower-cased; words are runs of other than ASCII white space; fewer words than a shingle are one shingle. Null
and empty texts have an empty set and are linked with nothing. Repeated rows are reported one by one. Rows without an
id take part, but name a component only where no other row does. An empty table gives no rows; other columns are
ignored. Sets hold 64-bit hashes; classes are told apart by 128 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil, exp, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinetrove.llm.common import stage, text_bytes
from kinetrove.llm.components import components
from kinetrove.plans.staging import BROADCAST_BYTES, stored_bytes

SAMPLES, BANDS, ROWS, BITS = 256, 42, 6, 1024
#: Leaders of buckets of three and more that a class is held against.
TRIES = 4
_RNG = np.random.default_rng(20)
_SCALE = _RNG.integers(0, 1 << 63, SAMPLES, np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _RNG.integers(0, 1 << 63, SAMPLES, np.uint64)
_MIX = _RNG.integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


def spread(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers after which every bit depends on all."""
    x = (x ^ (x >> np.uint64(32))) * _MIX[0]
    x = (x ^ (x >> np.uint64(29))) * _MIX[1]
    return x ^ (x >> np.uint64(32))


def shingles(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    import xxhash

    words = text.lower().split()  # bytes: only A-Z are lower-cased, only ASCII white space separates
    if not words:
        return np.zeros(0, np.uint64)
    hashed = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = min(size, len(words))
    found = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        found = found * _MIX[2] + hashed[k : len(words) - n + 1 + k]
    return np.unique(spread(found))


def samples(hashes: np.ndarray) -> np.ndarray:
    """The smallest value of a set under each of ``SAMPLES`` permutations."""
    least = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 512):
        np.minimum(least, (_SCALE[:, None] * hashes[None, at : at + 512] + _SHIFT[:, None]).min(axis=1), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of samples."""
    bands = least[: BANDS * ROWS].reshape(BANDS, ROWS)
    keys = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        keys = spread(keys * _MIX[3] + bands[:, k])
    return keys


def odd_sketch(least: np.ndarray) -> np.ndarray:
    """Parity bitmap of the samples as 64-bit words: bit k is set if an odd number of them falls on k."""
    at = spread(least + np.arange(SAMPLES, dtype=np.uint64) * _MIX[4]) & np.uint64(BITS - 1)
    odd = np.bincount(at.astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def most_odd(percent: int, deviations: float = 5.5) -> int:
    """Bits in which two sketches may differ if their sets are similar enough, up to this many deviations."""
    j = percent / 100
    unshared = 2 * (SAMPLES * (1 - j) + deviations * sqrt(SAMPLES * j * (1 - j)))
    return ceil(BITS / 2 * (1 - exp(-2 * unshared / BITS)) + deviations * unshared / sqrt(2 * BITS))


def _odd_bits(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """row, doc_id, text_hash, n, digest of the set, band keys and odd sketch of every row, written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        none = np.zeros(0, np.uint64)
        for batch in batches:
            found = []
            for text in batch["text"]:
                hashes = shingles(text.as_buffer().to_pybytes(), size)
                least = samples(hashes) if len(hashes) else none
                keys, sketch = (band_keys(least), odd_sketch(least)) if len(hashes) else (none, none)
                found.append((len(hashes), xxhash.xxh3_128_digest(hashes.tobytes()), keys.view(np.int64), sketch.view(np.int64)))
            n, digest, keys, sketch = zip(*found) if found else ((), (), (), ())
            columns = [pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketch, pa.list_(pa.int64()))]
            yield pa.record_batch([batch["row"], batch["doc_id"], batch["text_hash"], *columns], ["row", "doc_id", "text_hash", "n", "digest", "keys", "sketch"])

    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_bytes("text").alias("text"), F.xxhash64(text_bytes("text")).alias("text_hash")
    )
    return stage(rows.mapInArrow(run, "row long, doc_id long, text_hash long, n long, digest binary, keys array<long>, sketch array<long>"), "signatures")


def _sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(class, set) of the wanted classes (class, doc_id, text_hash), from the texts of their first rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t.as_buffer().to_pybytes(), size).tobytes() for t in batch["text"]]
            yield pa.record_batch([batch["class"], pa.array(found, pa.binary())], ["class", "set"])

    key = [F.coalesce("doc_id", F.lit(0).cast("long")).alias("_id"), F.col("doc_id").isNull().alias("_none")]
    wanted = stage(wanted.select("class", *key, F.col("text_hash").alias("_hash")), "wanted-sets")
    wanted = F.broadcast(wanted) if stored_bytes(wanted) <= BROADCAST_BYTES else wanted
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes("text").alias("text")).select(*key, F.xxhash64("text").alias("_hash"), "text")
    # Several rows may have the id and text of a class; all of them give its set.
    return stage(texts.join(wanted, ["_id", "_none", "_hash"]).select("class", "text").mapInArrow(run, "class long, set binary").dropDuplicates(["class"]), "sets")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (u, v) whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch["a"], batch["b"]):
                a, b = (np.frombuffer(x.as_buffer(), np.uint64) for x in (a, b))
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            yield pa.record_batch([batch["u"], batch["v"]], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(sets.select(F.col("class").alias("u"), F.col("set").alias("a")), "u").join(sets.select(F.col("class").alias("v"), F.col("set").alias("b")), "v")
    return both.select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


#: Blocks in which a member takes part.
_AT = "array<struct<i:int,j:int,side:int>>"


class Forest:
    """Union-find over labels; ``join`` tells whether two were apart."""

    def __init__(self):
        self.up: dict = {}

    def find(self, x):
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def sketches_meet(most: int) -> Callable:
    """Yields, for every left payload, which right ones differ in at most ``most`` bits."""

    def compare(left: list[bytes], right: list[bytes]) -> Iterator[np.ndarray]:
        other = np.frombuffer(b"".join(right), np.uint64).reshape(len(right), -1)
        for one in left:
            yield np.bitwise_count(other ^ np.frombuffer(one, np.uint64)).sum(axis=1, dtype=np.int64) <= most

    return compare


def sets_meet(percent: int) -> Callable:
    """Yields, for every left payload, which right sets are similar enough."""

    def compare(left: list[bytes], right: list[bytes]) -> Iterator[np.ndarray]:
        own = [np.frombuffer(x, np.uint64) for x in left]
        all_ = np.frombuffer(b"".join(right), np.uint64)
        sizes = np.array([len(x) // 8 for x in right])
        starts = np.cumsum(sizes) - sizes
        known = np.unique(np.concatenate(own))
        place = np.minimum(np.searchsorted(known, all_), len(known) - 1)
        place[known[place] != all_] = len(known)  # a hash that no left set has
        mark = np.zeros(len(known) + 1, np.int32)
        for one in own:
            at = np.searchsorted(known, one)
            mark[at] = 1
            both = np.add.reduceat(mark[place], starts)
            mark[at] = 0
            yield 100 * both >= percent * (sizes + len(one) - both)

    return compare


def joined_in_blocks(rows: DataFrame, compare: Callable, block: int) -> DataFrame:
    """(u, v): for every ``part`` a spanning forest of the links between its components.

    ``rows``: part, id, comp, payload. Members outside of a part's largest component are dealt into blocks by a hash
    of their id and meet blocks of all members; a task holds one block of each.
    """
    counts = stage(rows.groupBy("part", "comp").agg(F.count("*").alias("n")), "part-sizes")
    parts = counts.groupBy("part").agg(F.sum("n").alias("n"), F.max(F.struct("n", "comp")).alias("top")).where("n > top.n")
    parts = parts.select("part", F.col("top.comp").alias("_top"), F.ceil((F.col("n") - F.col("top.n")) / block).cast("int").alias("_few"), F.ceil(F.col("n") / block).cast("int").alias("_many"))
    dealt = rows.join(stage(parts, "parts"), "part")
    place = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    at = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), F.lit(side).alias("side"))
    each = lambda n, one: F.transform(F.sequence(F.lit(0), n - 1), one)
    few, many = F.col("_few"), F.col("_many")
    left = F.when(F.col("comp") != F.col("_top"), each(many, lambda j: at(place(few), j, 0)))
    right = each(few, lambda i: at(i, place(many), 1))
    names = ["part", "i", "j", "side", "id", "comp", "payload"]
    # Both sides of a row at once, so that members meet their parts in one join.
    placed = dealt.withColumn("_at", F.explode(F.concat(F.coalesce(left, F.array().cast(_AT)), right)))
    meeting = placed.select("part", "_at.*", "id", "comp", "payload").select(*names).repartition("part", "i", "j").sortWithinPartitions("part", "i", "j", "side")

    def links(held: list[list[tuple]]) -> Iterator[tuple[int, int]]:
        forest = Forest()
        if not held[0] or not held[1]:
            return
        comps = np.array([c for _, c, _ in held[1]])
        for (u, c, _), near in zip(held[0], compare([p for *_, p in held[0]], [p for *_, p in held[1]])):
            for k in np.flatnonzero(near & (comps != c)):
                if forest.join(c, int(comps[k])):
                    yield u, held[1][k][0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, [[], []]
        for batch in batches:
            found = []
            for part, i, j, side, id_, comp, payload in zip(*(batch[c].to_pylist() for c in names)):
                if (part, i, j) != now:
                    found += links(held)
                    now, held = (part, i, j), [[], []]
                held[side].append((id_, comp, payload))
            if found:
                yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*found)], ["u", "v"])
        if found := list(links(held)):
            yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*found)], ["u", "v"])

    return meeting.mapInArrow(run, "u long, v long")


def classes(docs: DataFrame, *, shingle: int = 5, percent: int = 85, block: int = 256) -> tuple[DataFrame, DataFrame]:
    """The signature of every row, and (digest, component_id) of every distinct set."""
    if percent < 80:
        raise ValueError("the bands are made for similarities of 0.8 and more")
    rows = signatures(docs, shingle)
    return rows, linked_sets(docs, rows, lambda distinct: distinct.select("class", F.explode("keys").alias("part")), most_odd(percent), shingle=shingle, percent=percent, block=block)


def stars(buckets: DataFrame) -> DataFrame:
    """(u, v): what to hold the class v against; ``buckets``: part, class, leader, n. A class has as many pairs as keys otherwise."""
    pairs = buckets.where("class <> leader").groupBy(F.col("leader").alias("u"), F.col("class").alias("v")).agg(F.count("*").alias("shared"), F.min("n").alias("least"))
    nth = F.row_number().over(Window.partitionBy("v").orderBy(F.desc("shared"), "u"))
    return pairs.withColumn("nth", nth).where((F.col("nth") <= TRIES) | (F.col("least") == 2)).select("u", "v")


def linked_sets(docs: DataFrame, rows: DataFrame, banded: Callable, most: int, *, shingle: int, percent: int, block: int) -> DataFrame:
    """(digest, component_id) of every distinct set: links between sets that meet in a bucket, confirmed on full sets.

    ``rows``: row, doc_id, text_hash, n, digest, sketch of every row, and what ``banded`` turns into (class, part), the
    buckets of a set. Sets whose sketches differ in more than ``most`` bits are not compared.
    """
    first = F.min_by(F.struct("doc_id", "text_hash", *(c for c in ("n", "keys", "sketch") if c in rows.columns)), "row").alias("first")
    distinct = stage(rows.where("n > 0").groupBy("digest").agg(F.min("row").alias("class"), F.min("doc_id").alias("least"), first).select("digest", "class", "least", "first.*"), "classes")
    banded = banded(distinct)
    shared = banded.groupBy("part").agg(F.min("class").alias("leader"), F.count("*").alias("n")).where("n > 1")
    # Spark takes the keys, many for each set, to be as small as the sets, and would broadcast them.
    buckets = stage(banded.join(shared.hint("merge"), "part"), "buckets")
    sketches = stage(distinct.join(buckets.select("class").distinct(), "class", "left_semi").select("class", "sketch", "doc_id", "text_hash"), "sketches")
    # 1. stars
    pairs = stars(buckets)
    side = lambda c, name: sketches.select(F.col("class").alias(c), F.col("sketch").alias(name))
    pairs = pairs.join(side("u", "_a"), "u").join(side("v", "_b"), "v").where(_odd_bits(F.col("_a"), F.col("_b")) <= most)
    pairs = stage(pairs.select("u", "v"), "star-pairs")
    larger = buckets.where("n > 2").select("class")
    wanted = pairs.select(F.explode(F.array("u", "v")).alias("class")).unionByName(larger).distinct()
    sets = _sets(docs, sketches.join(wanted, "class", "left_semi").select("class", "doc_id", "text_hash"), shingle)
    links = stage(confirmed(pairs, sets, percent), "star-links")
    joined = stage(components(links).select(F.col("node").alias("class"), "component"), "star-classes")
    # 2. what may link in buckets of several components
    comp = F.coalesce("component", "class").alias("comp")
    members = buckets.where("n > 2").hint("merge").join(sketches.select("class", "sketch"), "class").join(joined, "class", "left")
    # Read twice: counted, and dealt to blocks.
    members = stage(members.select("part", F.col("class").alias("id"), comp, _packed(F.col("sketch")).alias("payload")), "members")
    may = stage(joined_in_blocks(members, sketches_meet(most), block), "may-link")
    # 3. groups of what may link, on full sets
    label = joined.select("class", "component")
    ends = may.join(label.withColumnRenamed("class", "u").withColumnRenamed("component", "_cu"), "u", "left").join(label.withColumnRenamed("class", "v").withColumnRenamed("component", "_cv"), "v", "left")
    ends = ends.select(F.coalesce("_cu", "u").alias("u"), F.coalesce("_cv", "v").alias("v")).distinct()  # the same in many buckets
    groups = stage(components(ends).select(F.col("node").alias("comp"), F.col("component").alias("part")), "may-groups")
    full = sets.join(joined, "class", "left").select(F.col("class").alias("id"), comp, F.col("set").alias("payload")).join(groups, "comp")
    more = stage(joined_in_blocks(full.select("part", "id", "comp", "payload"), sets_meet(percent), block), "more-links")
    nodes = joined
    if not more.isEmpty():
        ends = joined.select(F.col("class").alias("u"), F.col("component").alias("v")).unionByName(more)
        nodes = components(ends).select(F.col("node").alias("class"), "component")
    named = distinct.select("digest", "class", "least").join(nodes, "class", "left").withColumn("component", F.coalesce("component", "class"))
    # Written first, so that the rows of a large component can be split among tasks.
    best = stage(named.groupBy("component").agg(F.min("least").alias("component_id")), "component-ids")
    return stage(named.select("digest", "component").join(best, "component").select("digest", "component_id"), "set-classes")


def _packed(words: Column) -> Column:
    """An array of longs as bytes, in a fixed order."""
    return F.unhex(F.array_join(F.transform(words, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def near_duplicates(docs: DataFrame, *, shingle: int = 5, percent: int = 85, block: int = 256) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id that can be reached), kept for every row of ``docs``."""
    rows, named = classes(docs, shingle=shingle, percent=percent, block=block)
    least = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    found = rows.select("doc_id", "n", "digest").join(named, "digest", "left").select("doc_id", F.col("n").alias("n_shingles"), least)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
