"""The prefix trie of conversations, from padded matrices of turn ids.

A conversation is a sequence of turns; each distinct sequence of first d turns is a node. Turn ids are 96 bits of the
SHA-256 of role and text, so a conversation becomes a short string, and strings in order walk the trie depth first.
Conversations are dealt by ranges of (string, conv_id): copies of one conversation spread over shards like others.

A shard is cut into batches. Each is a padded matrix of turn ids, put in order by ``numpy.lexsort``; where a row differs
from the one above, a mask accumulated by OR along the row marks the nodes that start there, and ``reduceat``
aggregates every depth at once, deepest first. A node that neither the first nor the last row of a batch passes through
is complete. The others, two paths for each batch, are kept open on a ``Spine`` and recombined with the next batch; what
is still open at the borders of a shard is one small row, and one task walks these rows in order and closes the rest.
Parents that were still open are named by (shard, number) and looked up at the end. ``ends_sha256`` of a node that
crosses borders is computed over its sorted chunks of ids, streamed.

Memory of a task: a matrix of ``cells`` turn ids, and the two paths. A conversation is one row: 20 bytes a turn.

Turns are ordered by turn (null first), then by id; null roles and texts are empty. Rows without a conv_id belong to no
conversation and are left out; repeated rows are turns of their own. An empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetrove.llm.common import stage

#: Characters of a turn's id.
ID = 16
NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
TRIE_SCHEMA = ", ".join(f"{c} long" for c in NODE) + ", ends_sha256 string"
PARTS_SCHEMA = "kind string, shard int, number long, " + TRIE_SCHEMA + ", chunk long, data binary"
_ARROW = pa.schema(
    [("kind", pa.string()), ("shard", pa.int32()), ("number", pa.int64()), *((c, pa.int64()) for c in NODE), ("ends_sha256", pa.string()), ("chunk", pa.int64()), ("data", pa.binary())]
)
NO_ENDS = hashlib.sha256(b"").hexdigest()
#: Ids in a chunk of the ends of a node that crosses borders.
CHUNK = 1 << 16


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id and its turns in order, as (turn, id, size): size is the number of code points of the text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")
    key = F.base64(F.substring(F.unhex(F.sha2(whole, 256)), 1, ID * 3 // 4))
    rows = turns.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), key.alias("id"), F.length(text).alias("size"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "id", "size"))).alias("turns"))


def rebuilt(turns: DataFrame, base: int = 100, heads: int = 6) -> DataFrame:
    """Every conversation with its first h turns from its base conversation: conv_id, seq, sizes, written once.

    The base of c is c - c % ``base``, h is crc32(c) % ``heads``.
    """
    whole = stage(conversations(turns), "conversations")
    head = whole.where(F.col("conv_id") % base == 0).select(F.col("conv_id").alias("_base"), F.slice("turns", 1, heads - 1).alias("_head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    own = whole.withColumn("_base", F.col("conv_id") - F.col("conv_id") % base).withColumn("_h", h).join(head, "_base", "left")
    first = F.when(F.col("_head").isNull(), F.slice("turns", 1, 0)).otherwise(F.slice("_head", F.lit(1), F.col("_h")))
    rest = F.slice("turns", F.col("_h") + 1, F.greatest(F.size("turns") - F.col("_h"), F.lit(0)))
    joined = own.select("conv_id", F.concat(first, rest).alias("turns"))
    return stage(joined.select("conv_id", F.array_join(F.transform("turns", lambda t: t["id"]), "").alias("seq"), F.transform("turns", lambda t: t["size"]).alias("sizes")), "rebuilt")


def common_turns(a: bytes, b: bytes) -> int:
    """Turns that two sequences have in common at their beginning."""
    n = min(len(a), len(b)) // ID
    x, y = (np.frombuffer(s[: n * ID], np.uint64).reshape(n, 2) for s in (a, b))
    apart = np.flatnonzero((x != y).any(axis=1))
    return int(apart[0]) if len(apart) else n


class Node:
    """A node that is not complete yet; kids, leaves and saved count its complete children only."""

    __slots__ = ("depth", "size", "n", "least", "kids", "leaves", "saved", "names")

    def __init__(self, depth, size, n, least, kids, leaves, saved, names):
        self.depth, self.size, self.n, self.least, self.kids, self.leaves, self.saved = (int(x) for x in (depth, size, n, least, kids, leaves, saved))
        self.names = [tuple(x) for x in names]

    def merge(self, other: Node) -> None:
        self.n, self.least = self.n + other.n, min(self.least, other.least)
        self.kids, self.leaves, self.saved = self.kids + other.kids, self.leaves + other.leaves, self.saved + other.saved
        self.names += other.names

    def values(self) -> list:
        return [getattr(self, k) for k in self.__slots__]


class Spine:
    """The open nodes on the path to the last row so far. Pieces are added in the order of their rows.

    ``open_left``: the piece before the first one is not known, so nodes on the first row's path stay open too.
    """

    def __init__(self, root_id: int, open_left: bool):
        self.root_id, self.open_left = root_id, open_left
        self.stack: list[Node] = []
        self.left: list[Node] = []
        self.first = self.path = b""
        self.edge = 0
        self.rows: list[dict] = []

    def add(self, first: bytes, nodes: list[Node], last: bytes, tail: list[Node], shared: int) -> None:
        """``nodes`` lie on the path to ``first``, ``tail`` on that to ``last`` below the ``shared`` ones."""
        if self.stack:
            common = common_turns(self.path, first)
            self._close(common)
            for mine, node in zip(self.stack, nodes):
                mine.merge(node)
            self.stack += nodes[common + 1 :]
        else:
            self.first, self.stack, self.edge = first, list(nodes), len(nodes) - 1
        self.path = first
        self._close(shared)
        self.stack += tail
        self.path = last

    def _close(self, depth: int) -> None:
        """Nothing below ``depth`` on the path can get more rows."""
        while len(self.stack) > depth + 1:
            node = self.stack.pop()
            if self.open_left and node.depth <= self.edge:
                self.left.append(node)
            else:
                self._finish(node, self.stack[-1] if self.stack else None)
        self.edge = min(self.edge, depth)

    def _finish(self, node: Node, parent: Node | None) -> None:
        leaves, saved = node.leaves if node.kids else 1, node.saved + (node.n - 1) * node.size
        row = {"kind": "node", "conv_id": node.least, "depth": node.depth, "n_convs": node.n, "n_children": node.kids, "n_leaves": leaves, "saved_tokens": saved}
        if parent is not None:
            parent.kids, parent.leaves, parent.saved = parent.kids + 1, parent.leaves + leaves, parent.saved + saved
            if parent.depth:
                row["shard"], row["number"] = parent.names[0]
            else:
                row["parent_conv_id"] = self.root_id
        self.rows.append(row)
        self.rows += [{"kind": "name", "shard": s, "number": k, "conv_id": node.least} for s, k in node.names]

    def border(self) -> dict:
        """What stays open at the borders of all pieces so far."""
        nodes = self.stack[: self.edge + 1] + self.left[::-1]
        return {
            "first": self.first.decode(), "last": self.path.decode(), "shared": self.edge,
            "nodes": [n.values() for n in nodes], "tail": [n.values() for n in self.stack[self.edge + 1 :]],
        }

    def add_border(self, border: dict) -> None:
        self.add(border["first"].encode(), [Node(*x) for x in border["nodes"]], border["last"].encode(), [Node(*x) for x in border["tail"]], border["shared"])

    def finish(self) -> None:
        self._close(-1)

    def take(self) -> list[dict]:
        rows, self.rows = self.rows, []
        return rows


def _sha(ids: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, ids.tolist())).encode()).hexdigest()


class Shard:
    """Batches of one shard: complete nodes go out, the others to the spine."""

    def __init__(self, shard: int, root_id: int):
        self.shard, self.root_id, self.numbers, self.chunks = shard, root_id, 0, 0
        self.spine = Spine(root_id, open_left=True)

    def _node(self, *values) -> Node:
        self.numbers += 1
        return Node(*values, [(self.shard, self.numbers)])

    def _ends(self, node: Node, ids: np.ndarray) -> None:
        for at in range(0, len(ids), CHUNK):
            self.chunks += 1
            (shard, number) = node.names[0]
            self.spine.rows.append({"kind": "ends", "shard": shard, "number": number, "depth": node.depth, "chunk": self.chunks, "data": ids[at : at + CHUNK].tobytes()})

    def add(self, conv: np.ndarray, seqs: list[bytes], sizes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        length = np.array([len(s) // ID for s in seqs])
        depth, n_rows = int(length.max()), len(seqs)
        ids = np.array(seqs, f"S{ID * depth}").view(">u8").astype(np.uint64).reshape(n_rows, 2 * depth) if depth else np.zeros((n_rows, 0), np.uint64)
        used = np.arange(depth) < length[:, None]
        points = np.zeros((n_rows, depth), np.int64)
        points[used] = np.concatenate(sizes)
        order = np.lexsort((conv, *ids[:, ::-1].T))
        conv, ids, points, used, length = conv[order], ids[order], points[order], used[order], length[order]
        differs = np.ones((n_rows, depth), bool)
        differs[1:] = (ids[1:] != ids[:-1]).reshape(n_rows - 1, depth, 2).any(axis=2)
        starts = np.logical_or.accumulate(differs, axis=1) & used
        path = lambda r: ids[r].astype(">u8").tobytes()[: ID * length[r]]
        first, last = path(0), path(-1)
        shared = common_turns(first, last)
        head: list[Node | None] = [None] * (len(first) // ID + 1)
        tail: list[Node | None] = [None] * (len(last) // ID + 1)
        below, levels = None, []
        for d in range(depth - 1, -2, -1):
            at = np.flatnonzero(used[:, d]) if d >= 0 else np.arange(n_rows)
            begins = starts[at, d] if d >= 0 else at == 0
            pos = np.flatnonzero(begins)
            rows, n = at[pos], np.diff(np.append(pos, len(at)))
            least, size = np.minimum.reduceat(conv[at], pos), points[at[pos], d] if d >= 0 else np.zeros(1, np.int64)
            place = np.full(n_rows, -1)
            place[at] = np.cumsum(begins) - 1
            kids, leaves, saved = (np.zeros(len(pos), np.int64) for _ in range(3))
            if below is not None:
                parent = place[below["rows"][below["whole"]]]
                np.add.at(kids, parent, 1)
                np.add.at(leaves, parent, below["leaves"][below["whole"]])
                np.add.at(saved, parent, below["saved"][below["whole"]])
                below["parent"] = place[below["rows"]]
            whole = np.ones(len(pos), bool)
            ending = np.flatnonzero(length == d + 1)
            at_node = place[ending]
            for k, path_nodes in ((0, head), (len(pos) - 1, tail)):
                if d + 1 < len(path_nodes):
                    if whole[k]:
                        node = self._node(d + 1, size[k], n[k], least[k], kids[k], leaves[k], saved[k])
                        self._ends(node, conv[ending[at_node == k]])
                        whole[k] = False
                    path_nodes[d + 1] = node
            leaves = np.where(whole & (kids == 0), 1, leaves)
            saved = np.where(whole, saved + (n - 1) * size, saved)
            below = {"d": d, "rows": rows, "n": n, "least": least, "kids": kids, "leaves": leaves, "saved": saved, "whole": whole, "ending": ending, "at_node": at_node}
            levels.append(below)
        for child, parent in zip(levels, levels[1:]):
            yield from self._complete(child, parent, head, tail, conv)
        self.spine.add(first, head, last, tail[shared + 1 :], shared)
        yield from batches_of(self.spine.take())

    def _complete(self, level: dict, above: dict, head: list[Node], tail: list[Node], conv: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Rows of the complete nodes of one depth."""
        keep = np.flatnonzero(level["whole"])
        if not len(keep):
            return
        depth, parent = level["d"] + 1, level["parent"][keep]
        known = above["whole"][parent] | (depth == 1)
        parent_id = np.full(len(keep), self.root_id) if depth == 1 else above["least"][parent]
        # An open parent lies on the path to the last row if it is the last of its depth, else on that to the first.
        numbers = np.zeros(len(keep), np.int64)
        for k in np.unique(parent[~known]):
            on_tail = k == len(above["rows"]) - 1 and depth - 1 < len(tail)
            numbers[parent == k] = (tail if on_tail else head)[depth - 1].names[0][1]
        at = level["at_node"]
        borders = np.searchsorted(at, np.append(keep, len(level["rows"])))
        stops = np.searchsorted(at, keep, "right")
        ends = [_sha(conv[level["ending"][a:b]]) if a < b else NO_ENDS for a, b in zip(borders, stops)]
        none = ~known
        columns = {
            "kind": pa.array(["node"] * len(keep)), "shard": pa.array(np.full(len(keep), self.shard, np.int32), mask=known), "number": pa.array(numbers, mask=known),
            "conv_id": pa.array(level["least"][keep]), "depth": pa.array(np.full(len(keep), depth)), "parent_conv_id": pa.array(parent_id, mask=none),
            "n_convs": pa.array(level["n"][keep]), "n_children": pa.array(level["kids"][keep]), "n_leaves": pa.array(level["leaves"][keep]), "saved_tokens": pa.array(level["saved"][keep]),
            "ends_sha256": pa.array(ends), "chunk": pa.nulls(len(keep), pa.int64()), "data": pa.nulls(len(keep), pa.binary()),
        }
        yield pa.record_batch([columns[f.name].cast(f.type) for f in _ARROW], schema=_ARROW)


def batches_of(rows: list[dict]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(rows), 10_000):
        yield pa.RecordBatch.from_pylist(rows[at : at + 10_000], schema=_ARROW)


def _hashed(ends: DataFrame) -> DataFrame:
    """conv_id, depth, sha of the ids in a node's chunks, read in order."""
    names = ["conv_id", "depth", "shard", "chunk", "data"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha, done = None, None, []
        for batch in batches:
            for conv_id, depth, _, _, data in zip(*(batch[c].to_pylist() for c in names)):
                text = ",".join(map(str, np.frombuffer(data, np.int64).tolist())).encode()
                if (conv_id, depth) == now:
                    sha.update(b"," + text)
                    continue
                if now is not None:
                    done.append((*now, sha.hexdigest()))
                now, sha = (conv_id, depth), hashlib.sha256(text)
            if done:
                yield pa.record_batch([pa.array(x) for x in zip(*done)], ["conv_id", "depth", "ends"])
                done = []
        if now is not None:
            yield pa.record_batch([pa.array([x]) for x in (*now, sha.hexdigest())], ["conv_id", "depth", "ends"])

    ordered = ends.select(*names).repartition("conv_id", "depth").sortWithinPartitions(*names[:4])
    return ordered.mapInArrow(run, "conv_id long, depth long, ends string")


def trie(rows: DataFrame, *, cells: int = 1 << 21, shard_turns: int = 1 << 20) -> DataFrame:
    """The nodes of the trie of ``rows`` (conv_id, seq, sizes; each conv_id once); see ``TRIE_SCHEMA``."""
    spark = rows.sparkSession
    total = rows.agg(F.count("*").alias("n"), F.sum(F.size("sizes")).alias("turns"), F.min("conv_id").alias("least")).first()
    if not total["n"]:
        return spark.createDataFrame([], TRIE_SCHEMA)
    root_id = total["least"]
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(total["turns"] / shard_turns))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, held, wide, seen = Shard(TaskContext.get().partitionId(), root_id), [], 1, False

        def matrix() -> Iterator[pa.RecordBatch]:
            conv, seqs, sizes = zip(*held)
            yield from shard.add(np.array(conv, np.int64), list(seqs), [np.array(s, np.int64) for s in sizes])

        for batch in batches:
            for conv_id, seq, sizes in zip(batch["conv_id"].to_pylist(), batch["seq"].to_pylist(), batch["sizes"].to_pylist()):
                wide = max(wide, len(sizes))
                if held and (len(held) + 1) * wide > cells:
                    yield from matrix()
                    held, wide = [], max(1, len(sizes))
                held.append((conv_id, seq.encode(), sizes))
                seen = True
        if held:
            yield from matrix()
        if seen:
            yield from batches_of([{"kind": "border", "shard": shard.shard, "data": json.dumps(shard.spine.border()).encode()}])

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spine = Spine(root_id, open_left=False)
        for batch in batches:
            for data in batch["data"]:
                spine.add_border(json.loads(data.as_py()))
                yield from batches_of(spine.take())
        spine.finish()
        yield from batches_of(spine.take())

    ordered = rows.repartitionByRange(shards, "seq", "conv_id").sortWithinPartitions("seq", "conv_id")
    parts = stage(ordered.select("conv_id", "seq", "sizes").mapInArrow(walk, PARTS_SCHEMA), "trie-parts")
    # One row for each shard passes through this task.
    borders = parts.where("kind = 'border'").repartition(1).sortWithinPartitions("shard").select("shard", "data")
    closed = stage(borders.mapInArrow(close, PARTS_SCHEMA), "trie-borders")
    both = parts.unionByName(closed)
    names = both.where("kind = 'name'").select("shard", "number", F.col("conv_id").alias("_real"))
    ends = parts.where("kind = 'ends'").join(names, ["shard", "number"]).select(F.col("_real").alias("conv_id"), "depth", "shard", "chunk", "data")
    done = F.col("number").isNull() & F.col("ends_sha256").isNotNull()
    out = [*NODE, "ends_sha256"]
    late = both.where((F.col("kind") == "node") & ~done).join(names, ["shard", "number"], "left").join(_hashed(ends), ["conv_id", "depth"], "left")
    late = late.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_real")).withColumn("ends_sha256", F.coalesce("ends_sha256", "ends", F.lit(NO_ENDS)))
    return parts.where((F.col("kind") == "node") & done).select(*out).unionByName(late.select(*out))


def prefix_trie(turns: DataFrame, *, base: int = 100, heads: int = 6, **options) -> DataFrame:
    """The trie of all rebuilt conversations of ``turns`` (conv_id, turn, role, text)."""
    return trie(rebuilt(turns, base, heads), **options)
