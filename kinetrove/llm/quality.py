"""Quality by attention-based multiple-instance learning: a document is a bag of passages.

A passage is ``passage`` words. It is encoded from its text alone, whatever the language: shares of pairs of
neighbouring byte classes (small and capital letters, digits, blank, line end, punctuation, symbols, other bytes),
word length, and how often its words repeat each other. A learnt layer turns that into an embedding h; gated attention
w . (tanh(V h) * sigmoid(U h)), normalised over the document, says how much each passage counts, and the document's
score is the logistic of its weighted embedding. Labels are known for documents only.

Labels are learnt from at most ``rows`` labelled rows outside the held-out quarter, each weighed by its label's share
among all, and from at most ``bag`` passages of each, evenly spread (both bounds hold for learning only). Every
whole text is scored where it lies, all passages, without a shuffle; memory is one text's passages.

Null and empty texts are one passage without words. Without labels of both kinds every score is 1, 0, or 0.5 where
there are none. Repeated rows and null ids are scored one by one. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetrove.llm.common import held_out, labelled_sample, small_batches, text_bytes

CLASSES = 8
FEATURES = CLASSES * CLASSES + 6


def _byte_classes() -> np.ndarray:
    kinds = np.full(256, 6, np.uint8)  # symbols and controls
    for i in range(128):
        c = chr(i)
        if c.islower():
            kinds[i] = 0
        elif c.isupper():
            kinds[i] = 1
        elif c.isdigit():
            kinds[i] = 2
    kinds[[9, 32]] = 3
    kinds[[10, 11, 12, 13]] = 4
    for c in ".,;:'\"-()?":
        kinds[ord(c)] = 5
    kinds[128:] = 7
    return kinds


KIND = _byte_classes()


def encode(text: bytes, passage: int) -> np.ndarray:
    """One row per passage of a text."""
    words = text.split()
    n = max(1, -(-len(words) // passage))
    out = np.zeros((n, FEATURES), np.float32)
    if not words:
        return out
    kinds = KIND[np.frombuffer(text, np.uint8)]
    blank = (kinds == 3) | (kinds == 4)
    starts = np.flatnonzero(~blank & np.append(True, blank[:-1]))
    # Bytes that bytes.split() takes for white space are those of the two blank classes.
    edges = starts[passage::passage]
    which = np.zeros(len(kinds), np.int64)
    which[edges] = 1
    which = np.cumsum(which)
    pairs = which[1:] * (CLASSES * CLASSES) + kinds[:-1].astype(np.int64) * CLASSES + kinds[1:]
    counts = np.bincount(pairs, minlength=n * CLASSES * CLASSES).reshape(n, -1)
    out[:, : CLASSES * CLASSES] = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    seen: set[bytes] = set()
    for i in range(n):
        part = words[i * passage : (i + 1) * passage]
        own = set(part)
        size = len(part)
        out[i, CLASSES * CLASSES :] = (
            np.log1p(size) / 5, len(own) / size, sum(map(eq, part, part[1:])) / size, lengths[i * passage : (i + 1) * passage].mean() / 10,
            sum(w in seen for w in own) / len(own) if seen else 0.5, len({w[-3:] for w in own}) / len(own),
        )
        seen = own
    return out


class Attention:
    """The model: ``middle`` and ``spread`` standardise features, ``p`` holds the learnt arrays."""

    def __init__(self, middle: np.ndarray, spread: np.ndarray, p: dict[str, np.ndarray]):
        self.middle, self.spread, self.p = middle, spread, p

    def forward(self, x: np.ndarray, first: np.ndarray, bag: np.ndarray) -> dict[str, np.ndarray]:
        """``x``: standardised passages of bags that begin at ``first``; ``bag``: the bag of each passage."""
        p = self.p
        e = np.tanh(x @ p["W"] + p["c"])
        t, g = np.tanh(e @ p["V"]), 1 / (1 + np.exp(-(e @ p["U"])))
        s = (t * g) @ p["w"]
        a = np.exp(s - np.maximum.reduceat(s, first)[bag])
        a /= np.add.reduceat(a, first)[bag]
        z = np.add.reduceat(a[:, None] * e, first)
        return {"e": e, "t": t, "g": g, "a": a, "z": z, "y": 1 / (1 + np.exp(-np.clip(z @ p["u"] + p["b"][0], -30, 30)))}

    def gradients(self, x: np.ndarray, first: np.ndarray, bag: np.ndarray, error: np.ndarray, f: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        p, e, t, g, a = self.p, f["e"], f["t"], f["g"], f["a"]
        dz = error[:, None] * p["u"]
        da = (e * dz[bag]).sum(axis=1)
        ds = a * (da - np.add.reduceat(a * da, first)[bag])
        gate = ds[:, None] * p["w"]
        dt, dg = gate * g * (1 - t * t), gate * t * g * (1 - g)
        de = a[:, None] * dz[bag] + dt @ p["V"].T + dg @ p["U"].T
        dx = de * (1 - e * e)
        return {"W": x.T @ dx, "c": dx.sum(axis=0), "V": e.T @ dt, "U": e.T @ dg, "w": (t * g).T @ ds, "u": f["z"].T @ error, "b": np.array([error.sum()])}

    def score(self, passages: np.ndarray) -> float:
        x = np.clip((passages - self.middle) / self.spread, -8, 8)
        return float(self.forward(x, np.zeros(1, np.int64), np.zeros(len(x), np.int64))["y"][0])


def constant(share: float, width: int = 1) -> Attention:
    """Scores every text alike."""
    p = {k: np.zeros(s) for k, s in {"W": (FEATURES, width), "c": width, "V": (width, width), "U": (width, width), "w": width, "u": width}.items()}
    return Attention(np.zeros(FEATURES), np.ones(FEATURES), p | {"b": np.array([np.log(max(share, 1e-12) / max(1 - share, 1e-12))])})


def fit(bags: list[np.ndarray], labels: np.ndarray, weight: np.ndarray, *, width: int, gates: int, epochs: int, batch: int, rate: float, decay: float) -> Attention:
    every = np.concatenate(bags)
    middle, spread = every.mean(axis=0), every.std(axis=0) + 1e-3
    bags = [np.clip((b - middle) / spread, -8, 8).astype(np.float64) for b in bags]
    rng = np.random.default_rng(11)
    p = {
        "W": rng.normal(0, FEATURES**-0.5, (FEATURES, width)), "c": np.zeros(width), "V": rng.normal(0, width**-0.5, (width, gates)), "U": rng.normal(0, width**-0.5, (width, gates)),
        "w": rng.normal(0, gates**-0.5, gates), "u": rng.normal(0, width**-0.5, width), "b": np.zeros(1),
    }
    model = Attention(middle, spread, p)
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), batch):
            chosen = order[at : at + batch]
            sizes = np.array([len(bags[i]) for i in chosen])
            x, bag = np.concatenate([bags[i] for i in chosen]), np.repeat(np.arange(len(chosen)), sizes)
            starts = np.cumsum(sizes) - sizes
            f = model.forward(x, starts, bag)
            error = weight[chosen] * (f["y"] - labels[chosen]) / weight[chosen].sum()
            step += 1
            for k, grad in model.gradients(x, starts, bag, error, f).items():
                grad = grad + decay * p[k]
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad**2
                p[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


def train(docs: DataFrame, labels: DataFrame, *, rows: int = 4000, passage: int = 50, bag: int = 32, width: int = 16, gates: int = 8, epochs: int = 12, batch: int = 64, rate: float = 0.01, decay: float = 1e-4) -> Attention:
    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for text in b["text"]:
                x = encode(text.as_py().encode(), passage)
                x = x[np.unique(np.linspace(0, len(x) - 1, bag).astype(int))]
                found.append(x.reshape(-1))
            yield pa.record_batch([b["doc_id"], b["label"], pa.array(found, pa.list_(pa.float32()))], ["doc_id", "label", "bag"])

    sample = labelled_sample(small_batches(docs), labels, "quality", rows, "quality")
    got = sample.select("doc_id", "label", "text").mapInArrow(bags, "doc_id long, label int, bag array<float>").toArrow().sort_by("doc_id")
    y = got["label"].to_numpy()
    if len(np.unique(y)) < 2:
        return constant(float(y[0]) if len(y) else 0.5)
    counts = dict(labels.where(~held_out("doc_id")).groupBy("quality").count().collect())
    weight = np.where(y == 1, counts[1] / (y == 1).sum(), counts[0] / (y == 0).sum()).astype(float)
    passages = [b.values.to_numpy().reshape(-1, FEATURES) for b in got["bag"]]
    return fit(passages, y, weight / weight.mean(), width=width, gates=gates, epochs=epochs, batch=batch, rate=rate, decay=decay)


def score(docs: DataFrame, model: Attention, threshold: float = 0.7, passage: int = 50) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([model.score(encode(t.as_buffer().to_pybytes(), passage)) for t in batch["text"]], float)
            yield pa.record_batch([batch["doc_id"], batch["held_out"], pa.array(values), pa.array((values >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id").alias("held_out"), text_bytes("text").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, passage: int = 50, **options) -> DataFrame:
    return score(docs, train(docs, labels, passage=passage, **options), threshold, passage)
