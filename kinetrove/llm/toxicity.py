"""Toxicity by a factorization machine over hashed terms.

Terms are the words of a text, in small letters, and the first four and five letters of longer ones (inflected and
compounded insults share a stem); each counts once a text. A term's number is its CRC-32 modulo ``buckets``. The score is
sigmoid(b + sum w_i + sum over pairs <v_i, v_j>): the pair terms weigh two words together that say little alone, such
as an insult and the mention of a group.

Labels are learnt from at most ``rows`` labelled rows (half toxic where there are as many) outside the held-out
quarter; each counts by its label's share among all. Of the buckets in that sample those take part, at most
``features`` of them, that tell the labels apart by themselves (G statistic of at least ``least_g``) or in a pair: the
four cells of two buckets must tell at least ``least_pair_g`` more than either alone. Pairs are sought among the
``pair_terms`` buckets whose presence varies most. So terms that say nothing alone, as in an exclusive or, are learnt as
well. The learning is small and runs on the driver; every whole text is scored where it lies, without a shuffle.

Null and empty texts get the score of a text without known terms. Without labels of both kinds every score is the share
of toxic ones, or 0. Repeated rows and null ids are scored one by one. An empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetrove.llm.common import Memory, held_out, labelled_sample, small_batches

WORDS = re.compile(r"[^\W\d_]+")
STEMS = (4, 5)
REMEMBERED = 150_000
#: Rows that the learning holds as numbers at once.
AT_ONCE = 512


def terms(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in STEMS if len(word) > n)]


def bucket(term: str, buckets: int) -> int:
    return zlib.crc32(term.encode("utf-8", "surrogatepass")) % buckets


@dataclass
class Machine:
    """``place`` of a bucket among the features, and their weights."""

    place: dict[int, int]
    buckets: int
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def logit(self, features: np.ndarray) -> float:
        v = self.factors[features]
        return float(self.bias + self.weights[features].sum() + 0.5 * ((v.sum(axis=0) ** 2).sum() - (v**2).sum()))

    def of_word(self, word: str) -> tuple[int, ...]:
        found = (self.place.get(bucket(t, self.buckets)) for t in terms(word))
        return tuple(f for f in found if f is not None)


def count(bags: list[np.ndarray], size: int) -> np.ndarray:
    """How often each of the buckets below ``size`` occurs."""
    found = np.zeros(size, np.int64)
    for at in range(0, len(bags), AT_ONCE):
        found += np.bincount(np.concatenate(bags[at : at + AT_ONCE]), minlength=size)
    return found


def beyond(bags: list[np.ndarray]) -> int:
    """The first bucket number that is larger than all."""
    return max((int(b.max()) + 1 for b in bags if len(b)), default=0)


def lookup(chosen: np.ndarray, size: int) -> np.ndarray:
    """Place among ``chosen`` of every bucket below ``size``, -1 for others."""
    place = np.full(size, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    return place


def select(bags: list[np.ndarray], labels: np.ndarray, least_g: float, features: int) -> np.ndarray:
    """Buckets by their G statistic, the largest first."""
    size = beyond(bags)
    counts = np.stack([count([b for b, label in zip(bags, labels) if label == k], size) for k in (0, 1)])
    ids = np.flatnonzero(counts.any(axis=0))
    n = np.array([(labels == 0).sum(), (labels == 1).sum()], float)
    counts = counts[:, ids].astype(float)
    total, seen = n.sum(), counts.sum(axis=0)

    def part(observed: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return observed * np.log(np.maximum(observed, 1e-12) / np.maximum(expected, 1e-12))

    g = 2 * sum(part(counts[k], n[k] * seen / total) + part(n[k] - counts[k], n[k] * (total - seen) / total) for k in (0, 1))
    best = np.lexsort((ids, -g))[:features]
    return ids[best[g[best] >= least_g]]


def select_pairs(bags: list[np.ndarray], labels: np.ndarray, least_g: float, terms: int) -> np.ndarray:
    """Buckets of pairs whose four cells tell the labels apart by ``least_g`` more than either bucket does, best first."""
    seen = count(bags, beyond(bags))
    ids = np.flatnonzero(seen)
    seen = seen[ids]
    varied = np.lexsort((ids, -np.minimum(seen, len(bags) - seen)))[:terms]
    column = lookup(ids[varied], beyond(bags))
    n = [int((labels == k).sum()) for k in (0, 1)]
    parts = [np.zeros((n[k], len(varied)), np.float32) for k in (0, 1)]
    for k in (0, 1):
        for row, i in zip(parts[k], np.flatnonzero(labels == k)):
            at = column[bags[i]]
            row[at[at >= 0]] = 1
    alone = [p.sum(axis=0, dtype=np.float64) for p in parts]

    def told(cells: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """G statistic of cells, each given as its count among either label."""
        total, found = n[0] + n[1], 0.0
        for both in cells:
            for k in (0, 1):
                expected = (both[0] + both[1]) * n[k] / total
                found = found + 2 * both[k] * np.log(np.maximum(both[k], 1e-12) / np.maximum(expected, 1e-12))
        return found

    single = told([(alone[0], alone[1]), (n[0] - alone[0], n[1] - alone[1])])
    best = np.zeros(len(varied))
    for begin in range(0, len(varied), 128):
        own = slice(begin, begin + 128)
        both = [(p[:, own].T @ p).astype(np.float64) for p in parts]
        a, b = [s[own, None] for s in alone], alone
        cells = [tuple(both), tuple(a[k] - both[k] for k in (0, 1)), tuple(b[k] - both[k] for k in (0, 1)), tuple(n[k] - a[k] - b[k] + both[k] for k in (0, 1))]
        best[own] = np.maximum(best[own], (told(cells) - np.maximum(single[own, None], single[None, :])).max(axis=1))
    order = np.lexsort((ids[varied], -best))
    return ids[varied][order[best[order] >= least_g]]


def fit(bags: list[np.ndarray], labels: np.ndarray, weight: np.ndarray, *, buckets: int, least_g: float, features: int, factors: int, steps: int, rate: float, decay: float, least_pair_g: float = 100.0, pair_terms: int = 1024) -> Machine:
    """Adam on the weighted log loss; a step's gradient is added up over blocks of rows, so that memory stays small."""
    alone, paired = select(bags, labels, least_g, features), select_pairs(bags, labels, least_pair_g, pair_terms)
    chosen = np.concatenate([alone, paired[~np.isin(paired, alone)]])[:features]
    place = {int(b): i for i, b in enumerate(chosen)}
    column = lookup(chosen, beyond(bags))
    known = [at[at >= 0] for at in (column[bag] for bag in bags)]
    m = len(chosen)
    blocks = []
    for at in range(0, len(bags), AT_ONCE):
        part = known[at : at + AT_ONCE]
        blocks.append((slice(at, at + len(part)), np.repeat(np.arange(len(part), dtype=np.int32), [len(b) for b in part]), np.concatenate(part)))
    rng = np.random.default_rng(7)
    share = np.average(labels, weights=weight)
    theta = {"b": np.array([np.log(share / (1 - share))]), "w": np.zeros(m), "v": rng.normal(0, 0.05, (m, factors))}
    first, second = ({k: np.zeros_like(x) for k, x in theta.items()} for _ in range(2))
    scale = weight / weight.sum()

    def by_row(rows: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
        return np.stack([np.bincount(rows, x[:, f], n) for f in range(x.shape[1])], axis=1)

    for step in range(1, steps + 1):
        grad = {"b": np.zeros(1), "w": decay * theta["w"], "v": decay * theta["v"]}
        for own, rows, cols in blocks:
            n = own.stop - own.start
            v = theta["v"][cols]
            sums = by_row(rows, v, n)
            logit = theta["b"][0] + np.bincount(rows, theta["w"][cols], n) + 0.5 * ((sums**2).sum(axis=1) - np.bincount(rows, (v**2).sum(axis=1), n))
            error = scale[own] * (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels[own])
            grad["b"] += error.sum()
            grad["w"] += np.bincount(cols, error[rows], m)
            grad["v"] += by_row(cols, error[rows, None] * (sums[rows] - v), m)
        for k in theta:
            first[k] = 0.9 * first[k] + 0.1 * grad[k]
            second[k] = 0.999 * second[k] + 0.001 * grad[k] ** 2
            theta[k] = theta[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Machine(place, buckets, float(theta["b"][0]), theta["w"], theta["v"])


def train(docs: DataFrame, labels: DataFrame, *, rows: int = 6000, buckets: int = 1 << 20, least_g: float = 12.0, features: int = 1 << 14, factors: int = 8, steps: int = 300, rate: float = 0.05, decay: float = 1e-4) -> Machine:
    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted({bucket(t, buckets) for w in set(WORDS.findall(x.as_py().lower())) for t in terms(w)}) for x in batch["text"]]
            yield pa.record_batch([batch["doc_id"], batch["label"], pa.array(found, pa.list_(pa.int32()))], ["doc_id", "label", "bag"])

    sample = labelled_sample(small_batches(docs), labels, "toxic", rows, "toxicity")
    got = sample.select("doc_id", "label", "text").mapInArrow(bags, "doc_id long, label int, bag array<int>").toArrow().sort_by("doc_id")
    y = got["label"].to_numpy()
    empty = Machine({}, buckets, -30.0, np.zeros(0), np.zeros((0, factors)))
    if not len(y):
        return empty
    counts = dict(labels.where(~held_out("doc_id")).groupBy("toxic").count().collect())
    if len(np.unique(y)) < 2:
        return Machine({}, buckets, 30.0 if y[0] else -30.0, np.zeros(0), np.zeros((0, factors)))
    weight = np.where(y == 1, counts[1] / (y == 1).sum(), counts[0] / (y == 0).sum()).astype(float)
    bag = got["bag"].combine_chunks()
    bags = np.split(bag.flatten().to_numpy(), np.cumsum(bag.value_lengths().to_numpy())[:-1])  # views of one array
    return fit(bags, y, weight, buckets=buckets, least_g=least_g, features=features, factors=factors, steps=steps, rate=rate, decay=decay)


def score(docs: DataFrame, machine: Machine, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Memory(machine.of_word, REMEMBERED)
        for batch in batches:
            logits = []
            for text in batch["text"]:
                features = set()
                for word in set(WORDS.findall((text.as_py() or "").lower())):
                    if found := known[word]:
                        features.update(found)
                logits.append(machine.logit(np.array(sorted(features), np.int64)))
            values = 1 / (1 + np.exp(-np.clip(np.array(logits, float), -30, 30)))
            yield pa.record_batch([batch["doc_id"], batch["held_out"], pa.array(values), pa.array((values >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id").alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    return score(docs, train(docs, labels, **options), threshold)


def clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """The rows of ``docs`` whose text scores below the threshold, with all columns; nothing is shuffled."""
    machine = train(docs, labels, **options)

    @F.pandas_udf("double")
    def rate(texts):
        import pandas as pd

        known = _memory(machine)
        found = []
        for text in texts:
            features = {f for word in set(WORDS.findall((text or "").lower())) for f in known[word]}
            found.append(machine.logit(np.array(sorted(features), np.int64)))
        return pd.Series(1 / (1 + np.exp(-np.clip(np.array(found, float), -30, 30))))

    return small_batches(docs).select(F.struct("*").alias("_doc")).where(rate(F.col("_doc.text")) < threshold).select("_doc.*")


def _memory(machine: Machine) -> Memory:
    """One per worker process and model."""
    if getattr(machine, "_known", None) is None:
        machine._known = Memory(machine.of_word, REMEMBERED)
    return machine._known
