"""Approximate nearest neighbours by learned partitions.

On a bounded sample of vectors the nearest-neighbour graph is cut into ``parts`` balanced parts: starting from halves
along principal directions, vectors move to the part of most of their neighbours while there is room. A small network
learns the part from the vector, with the parts of a vector's neighbours as soft targets. It then deals every vector of
the table to its most probable part, and a query goes to the ``probes`` most probable ones. How many that takes for the
wanted recall is measured among sample vectors that were kept out of the learning.

Search: the rows of a part are dealt to blocks of about ``block`` rows and the queries that visit it to blocks of
``query_block``; every pair of blocks is one group, so a part of any size, copies of one vector included, is spread and
a task holds two blocks. A group returns its ``k`` best rows per query by exact Euclidean distances in double
precision; ties go to the smaller vec_id. Nothing but the sample, the counts of the parts and the small network reaches
the driver.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows with a null vec_id or
with another length than most vectors have. Repeated rows count once. An empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinetrove.llm.common import stage


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a**2).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b**2).sum(axis=1)[None, :]


def neighbour_graph(x: np.ndarray, degree: int) -> np.ndarray:
    """The nearest others of each row, in slices of rows."""
    out = np.zeros((len(x), min(degree, max(len(x) - 1, 0))), np.int64)
    for at in range(0, len(x), 512):
        d = squared(x[at : at + 512], x)
        d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
        if out.shape[1]:
            out[at : at + 512] = np.argpartition(d, out.shape[1] - 1, axis=1)[:, : out.shape[1]]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, slack: float = 0.1, rounds: int = 20) -> np.ndarray:
    """A part for each row, none larger than its share and the slack."""
    part = np.zeros(len(x), np.int64)

    def halve(rows: np.ndarray, first: int, n: int) -> None:
        if n == 1 or len(rows) < 2:
            part[rows] = first
            return
        y = x[rows] - x[rows].mean(axis=0)
        along = y @ np.linalg.eigh(y.T @ y)[1][:, -1]
        order, left = np.argsort(along, kind="stable"), n // 2
        cut = len(rows) * left // n
        halve(rows[order[:cut]], first, left)
        halve(rows[order[cut:]], first + left, n - left)

    halve(np.arange(len(x)), 0, parts)
    most = int(np.ceil(len(x) / parts * (1 + slack)))
    sizes = np.bincount(part, minlength=parts)
    for _ in range(rounds):
        votes = np.zeros((len(x), parts))
        np.add.at(votes, (np.repeat(np.arange(len(x)), graph.shape[1]), part[graph].reshape(-1)), 1)
        best = votes.argmax(axis=1)
        gain = votes[np.arange(len(x)), best] - votes[np.arange(len(x)), part]
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if sizes[best[i]] < most:
                sizes[part[i]] -= 1
                sizes[best[i]] += 1
                part[i] = best[i]
                moved += 1
        if not moved:
            break
    return part


@dataclass
class Router:
    """One hidden layer; ``rank`` orders the parts of each vector, the most probable first."""

    middle: np.ndarray
    p: dict[str, np.ndarray]
    probes: int

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.middle) @ self.p["W"] + self.p["c"]) @ self.p["V"] + self.p["d"]

    def rank(self, x: np.ndarray) -> np.ndarray:
        return np.argsort(-self.logits(x), axis=1, kind="stable")


def learn(x: np.ndarray, target: np.ndarray, *, hidden: int = 64, epochs: int = 60, batch: int = 256, rate: float = 0.005) -> Router:
    rng = np.random.default_rng(5)
    d, parts = x.shape[1], target.shape[1]
    middle, scale = x.mean(axis=0), 1 / max(float(np.sqrt(((x - x.mean(axis=0)) ** 2).mean())), 1e-12)
    p = {"W": rng.normal(0, scale * d**-0.5, (d, hidden)), "c": np.zeros(hidden), "V": rng.normal(0, hidden**-0.5, (hidden, parts)), "d": np.zeros(parts)}
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    y, step = x - middle, 0
    pace = {"W": rate * scale, "c": rate, "V": rate, "d": rate}
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            rows = order[at : at + batch]
            h = np.tanh(y[rows] @ p["W"] + p["c"])
            logit = h @ p["V"] + p["d"]
            q = np.exp(logit - logit.max(axis=1, keepdims=True))
            error = (q / q.sum(axis=1, keepdims=True) - target[rows]) / len(rows)
            back = (error @ p["V"].T) * (1 - h * h)
            step += 1
            for k, grad in (("W", y[rows].T @ back), ("c", back.sum(axis=0)), ("V", h.T @ error), ("d", error.sum(axis=0))):
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad**2
                p[k] -= pace[k] * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-9)
    return Router(middle, p, parts)


def train(x: np.ndarray, *, parts: int, degree: int, k: int, recall: float) -> Router:
    """A router whose probes reach the recall on every fifth row, among those rows: none takes part in the learning.

    Most rows of a large table are unseen like them. With too few of them all parts are visited.
    """
    kept = np.arange(len(x)) % 5 != 4
    known = x[kept]
    graph = neighbour_graph(known, degree)
    part = balanced_parts(known, graph, parts)
    target = np.zeros((len(known), parts))
    np.add.at(target, (np.repeat(np.arange(len(known)), graph.shape[1]), part[graph].reshape(-1)), 1.0)
    target[np.arange(len(known)), part] += max(1, graph.shape[1]) / 4
    router = learn(known, target / target.sum(axis=1, keepdims=True))
    asked = np.flatnonzero(~kept)
    if len(asked) > k:
        d = squared(x[asked], x[asked])
        np.fill_diagonal(d, np.inf)
        near = np.argpartition(d, k - 1, axis=1)[:, :k]
        rank = router.rank(x[asked])
        needed = np.take_along_axis(np.argsort(rank, axis=1), rank[:, 0][near], axis=1)
        found = [(needed < m).mean() for m in range(1, parts + 1)]
        router.probes = next(m for m in range(1, parts + 1) if found[m - 1] >= min(recall, found[-1]))
    return router


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, vector as doubles) of the rows that take part."""
    rows = vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = rows.where(finite & F.exists("vector", lambda v: v != 0))
    length = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("vector") == (length["n"] if length else 0))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy().reshape(len(flat), -1)


def best_of(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query_id, vec_id, distance) of up to k nearest ids per query, by exact distances, in slices of queries.

    An id counts once, by its nearest row, and takes one of the k places only.
    """
    out: tuple[list, list, list] = ([], [], [])
    by_id = np.argsort(ids, kind="stable")
    rows, ids = rows[by_id], ids[by_id]
    starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    for at in range(0, len(queries), 128):
        q = queries[at : at + 128]
        rough = squared(q, rows)
        rough[query_ids[at : at + 128, None] == ids[None, :]] = np.inf
        n = min(k, len(starts))
        nearest = rough if len(starts) == len(ids) else np.minimum.reduceat(rough, starts, axis=1)
        limit = np.partition(nearest, n - 1, axis=1)[:, n - 1]
        # More than the error of the rough form, so that no row that could be among the best is missed.
        margin = 1e-9 * ((q**2).sum(axis=1) + (rows**2).sum(axis=1).max())
        for i in range(len(q)):
            near = np.flatnonzero((rough[i] <= limit[i] + margin[i]) & np.isfinite(rough[i]))
            exact = np.sqrt(((rows[near] - q[i]) ** 2).sum(axis=1))
            order = np.lexsort((ids[near], exact))
            _, once = np.unique(ids[near][order], return_index=True)
            order = order[np.sort(once)][:k]
            out[0].append(np.full(len(order), query_ids[at + i]))
            out[1].append(ids[near][order])
            out[2].append(exact[order])
    return tuple(np.concatenate(x) for x in out)


def search(vectors: DataFrame, *, every: int = 100, k: int = 10, sample: int = 5000, parts: int = 32, degree: int = 10, recall: float = 0.97, block: int = 16384, query_block: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` nearest rows found for each row whose vec_id is divisible by ``every``."""
    rows = usable(vectors)
    # Ids are drawn first, so that repeated rows do not fill the sample.
    order = [F.xxhash64(F.lit("ann"), "vec_id"), F.col("vec_id")]
    chosen = rows.select("vec_id").distinct().orderBy(*order).limit(sample)
    drawn = rows.join(F.broadcast(chosen), "vec_id").groupBy("vec_id").agg(F.min("vector").alias("vector")).orderBy(*order).toArrow()
    out = "query_id long, rank int, vec_id long, score double"
    if not drawn.num_rows:
        return vectors.sparkSession.createDataFrame([], out)
    router = train(_matrix(drawn["vector"]), parts=min(parts, max(1, drawn.num_rows // 8)), degree=degree, k=k, recall=recall)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                order = router.rank(_matrix(batch["vector"]))[:, : router.probes].astype(np.int32)
                yield pa.record_batch([batch["vec_id"], batch["vector"], pa.array(list(order), pa.list_(pa.int32()))], ["vec_id", "vector", "parts"])

    index = stage(rows.mapInArrow(deal, "vec_id long, vector array<double>, parts array<int>"), "ann-index")
    asked = index.where(F.col("vec_id") % every == 0)
    n_parts = len(router.p["d"])

    def counts(part: DataFrame, size: int) -> Column:
        """Blocks needed by each part; one row per part reaches the driver."""
        found = dict(part.groupBy("part").count().collect())
        return F.array(*[F.lit(max(1, -(-found.get(i, 0) // size))) for i in range(n_parts)])

    visits = asked.select("vec_id", "vector", F.explode("parts").alias("part"))
    homes = index.select("vec_id", "vector", F.get("parts", F.lit(0)).alias("part"))
    row_blocks, query_blocks = counts(homes.select("part"), block), counts(visits.select("part"), query_block)
    own = lambda blocks, salt: F.pmod(F.xxhash64(F.lit(salt), "vec_id"), F.get(blocks, F.col("part"))).cast("int")
    other = lambda blocks: F.explode(F.sequence(F.lit(0), F.get(blocks, F.col("part")) - 1))
    left = visits.select("vec_id", "vector", "part", own(query_blocks, "q").alias("qb"), other(row_blocks).alias("rb"))
    right = homes.select("vec_id", "vector", "part", other(query_blocks).alias("qb"), own(row_blocks, "r").alias("rb"))

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not a.num_rows or not b.num_rows:
            return schema.empty_table()
        found = best_of(_matrix(a["vector"]), a["vec_id"].to_numpy(), _matrix(b["vector"]), b["vec_id"].to_numpy(), k)
        return pa.table([pa.array(x) for x in found], schema=schema)

    keys = ["part", "qb", "rb"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, "query_id long, vec_id long, score double")
    # Repeated rows of a query or a candidate meet here.
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
