import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetrove.llm import neighbours, quality, toxicity
from kinetrove.llm.common import held_out

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_held_out_accuracy(labelled):
    docs, labels = labelled
    for scored, label in ((toxicity.toxicity(docs, labels), "toxic"), (quality.quality(docs, labels), "quality")):
        rows = scored.join(labels, "doc_id").where("held_out").select("predicted", label).toPandas()
        assert len(rows) > 50 and (rows.predicted == rows[label]).mean() > 0.9, label


def test_scores_do_not_see_held_out_labels(labelled):
    docs, labels = labelled
    other = labels.withColumn("toxic", F.when(held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic"))).withColumn("quality", F.when(held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    for f in (toxicity.toxicity, quality.quality):
        a, b = (dict(f(docs, x).select("doc_id", "score").collect()) for x in (labels, other))
        assert a == b


def test_odd_rows_and_empty_tables(odd, empty, labelled):
    labels = labelled[1]
    for f in (toxicity.toxicity, quality.quality):
        rows = f(odd, labels).collect()
        assert len(rows) == 12 and all(0 <= r.score <= 1 for r in rows)
        assert f(empty, labels).count() == 0
        assert len({r.score for r in f(odd, labels.where("false")).collect()}) == 1
    assert toxicity.clean(odd, labels.where("false")).columns == odd.columns
    assert toxicity.clean(odd, labels.where("false")).count() == 12


def test_clean_agrees_with_scores(labelled):
    docs, labels = labelled
    kept = {r.doc_id for r in toxicity.clean(docs, labels).select("doc_id").collect()}
    assert kept == {r.doc_id for r in toxicity.toxicity(docs, labels).where("predicted = 0").collect()}


def test_machine_learns_a_pair_that_single_terms_cannot_tell():
    rng = np.random.default_rng(0)
    bags, y = [], []
    for _ in range(800):
        a, b = rng.random(2) < 0.5
        bags.append(np.array(sorted([1] * int(a) + [2] * int(b) + [int(x) for x in rng.integers(10, 30, 3)])))
        y.append(int(a and b))
    y = np.array(y)
    m = toxicity.fit(bags, y, np.ones(len(y)), buckets=64, least_g=5.0, features=100, factors=4, steps=400, rate=0.05, decay=1e-6)
    f = lambda *t: m.logit(np.array([m.place[k] for k in t]))
    assert f(1, 2) > 0 > max(f(1), f(2))
    v = m.factors[[m.place[1], m.place[2]]]
    assert v[0] @ v[1] != 0


def production(name):
    """Settings that training uses where none are given."""
    import inspect

    return {k: p.default for k, p in inspect.signature(toxicity.train).parameters.items() if k in name and p.default is not p.empty}


@pytest.mark.parametrize("noise", [0, 20])
def test_machine_learns_an_exclusive_or_with_production_settings(noise):
    rng = np.random.default_rng(2)
    a, b = rng.random((2, 4000)) < 0.5
    bags = [np.array(sorted({*([1] * int(p)), *([2] * int(q)), *(int(x) for x in rng.integers(10, 400, noise)), 5})) for p, q in zip(a, b)]
    y = (a ^ b).astype(int)
    m = toxicity.fit(bags[:3000], y[:3000], np.ones(3000), **production(("buckets", "least_g", "features", "factors", "steps", "rate", "decay")))
    assert {1, 2} <= set(m.place) and len(m.place) < 12
    p = [m.logit(np.array([m.place[int(t)] for t in bag if int(t) in m.place], np.int64)) > 0 for bag in bags[3000:]]
    assert (np.array(p) == y[3000:]).mean() > 0.99


def test_no_pairs_are_found_in_noise():
    rng = np.random.default_rng(4)
    bags = [np.unique(rng.integers(0, 300, 40)) for _ in range(2000)]
    assert len(toxicity.select_pairs(bags, (rng.random(2000) < 0.2).astype(int), 40.0, 1024)) == 0


def test_score_equals_the_sum_over_all_pairs(labelled):
    docs, labels = labelled
    machine = toxicity.train(docs, labels)
    scored = dict(toxicity.score(docs, machine).select("doc_id", "score").collect())
    for r in docs.orderBy("doc_id").limit(60).collect():
        found = {machine.place.get(toxicity.bucket(t, machine.buckets)) for w in set(toxicity.WORDS.findall((r.text or "").lower())) for t in toxicity.terms(w)}
        found = sorted(f for f in found if f is not None)
        z = machine.bias + sum(machine.weights[f] for f in found)
        z += sum(float(machine.factors[f] @ machine.factors[g]) for n, f in enumerate(found) for g in found[:n])
        assert abs(scored[r.doc_id] - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) < 1e-9


def test_held_out_recall_and_order(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out").select("score", "predicted", "toxic").toPandas()
    order = rows.score.rank()
    n, m = (rows.toxic == 1).sum(), (rows.toxic == 0).sum()
    assert (order[rows.toxic == 1].sum() - n * (n + 1) / 2) / (n * m) > 0.97
    # One toxic label in ten stands at a text without any insult.
    assert rows.predicted[rows.toxic == 1].mean() >= 0.85 and rows.predicted[rows.toxic == 0].mean() < 0.01


def test_quality_score_equals_plain_attention(labelled):
    docs, labels = labelled
    model = quality.train(docs, labels)
    scored = dict(quality.score(docs, model).select("doc_id", "score").collect())
    p, sigmoid = model.p, lambda x: 1 / (1 + np.exp(-x))
    for r in docs.orderBy("doc_id").limit(60).collect():
        weights, passages = [], []
        for row in quality.encode((r.text or "").encode(), 50):
            e = np.tanh(np.clip((row - model.middle) / model.spread, -8, 8) @ p["W"] + p["c"])
            weights.append(np.exp(float((np.tanh(e @ p["V"]) * sigmoid(e @ p["U"])) @ p["w"])))
            passages.append(e)
        z = sum(w * e for w, e in zip(weights, passages)) / sum(weights)
        assert abs(scored[r.doc_id] - sigmoid(float(z @ p["u"] + p["b"][0]))) < 1e-9


def test_held_out_order_of_quality(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.quality(docs, labels).join(labels, "doc_id").where("held_out").select("score", "quality").toPandas()
    order = rows.score.rank()
    n, m = (rows.quality == 1).sum(), (rows.quality == 0).sum()
    assert (order[rows.quality == 1].sum() - n * (n + 1) / 2) / (n * m) > 0.98


def test_attention_gradients():
    rng = np.random.default_rng(1)
    bags = [rng.normal(size=(n, quality.FEATURES)) for n in (1, 3, 5)]
    x, bag, first = np.concatenate(bags), np.repeat([0, 1, 2], [1, 3, 5]), np.array([0, 1, 4])
    y = np.array([0.0, 1.0, 1.0])
    model = quality.fit([b.astype(np.float32) for b in bags], y.astype(int), np.ones(3), width=3, gates=2, epochs=1, batch=3, rate=0.01, decay=0.0)

    def loss():
        p = model.forward(x, first, bag)["y"]
        return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).sum())

    f = model.forward(x, first, bag)
    for k, g in model.gradients(x, first, bag, f["y"] - y, f).items():
        at = tuple(0 for _ in model.p[k].shape)
        old = model.p[k][at]
        model.p[k][at] = old + 1e-6
        up = loss()
        model.p[k][at] = old - 1e-6
        down = loss()
        model.p[k][at] = old
        assert abs((up - down) / 2e-6 - g[at]) < 1e-4, k


def test_attention_weighs_the_telling_passage():
    good, bad = b"the cat sat on the mat and looked at a dog. " * 12, b"BUY!! NOW!! CHEAP!! GOLD!! " * 13
    bags = [quality.encode(good + good, 50) for _ in range(30)] + [quality.encode(good + bad, 50) for _ in range(30)]
    y = np.array([1] * 30 + [0] * 30)
    model = quality.fit(bags, y, np.ones(60), width=8, gates=4, epochs=60, batch=16, rate=0.02, decay=1e-4)
    mixed = quality.encode(good + bad, 50)
    assert model.score(mixed) < 0.3 < 0.7 < model.score(quality.encode(good, 50))


def brute(rows, every, k):
    x = {i: np.array(v, float) for i, v in rows if i is not None and v is not None and len(v) == 4 and all(c is not None and np.isfinite(c) for c in v) and any(v)}
    out = {}
    for q in x:
        if q % every == 0:
            out[q] = sorted((float(np.sqrt(((x[q] - x[i]) ** 2).sum())), i) for i in x if i != q)[:k]
    return out


def test_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in rng.normal(size=4)]) for i in range(300)]
    rows += [(300 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(60)]  # copies: ties go to the smaller id
    rows += [(400, None), (500, [0.0] * 4), (600, [1.0, None, 2.0, 3.0]), (700, [float("nan")] * 4), (800, [float("inf")] * 4), (None, [1.0] * 4), (900, [1.0, 2.0])]
    rows += rows[100:103] + [rows[0]]
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, rank int, part int")
    got = {}
    for r in neighbours.search(table, recall=1.1, block=50, query_block=2).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    want = brute(rows, 100, 10)
    assert set(got) == set(want)
    for q in want:
        assert [i for _, i in got[q]] == [i for _, i in want[q]] and np.allclose([s for s, _ in got[q]], [s for s, _ in want[q]], rtol=0, atol=1e-12)
    few = spark.createDataFrame(rows[:4], "vec_id long, embedding array<double>")
    assert neighbours.search(few).count() == 3
    assert neighbours.search(table.where("false")).count() == 0


def test_repeated_rows_take_one_place(spark):
    rng = np.random.default_rng(6)
    x = {i: rng.normal(size=4) for i in range(1, 200)}
    x[0] = x[7] + 0.01
    rows = [(i, [float(c) for c in v]) for i, v in x.items()] + [(7, [float(c) for c in x[7]])] * 20
    want = brute(rows, 100, 10)
    ids, vectors = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    for k in (1, 3, 10):
        _, found, exact = neighbours.best_of(x[0][None, :], np.array([0]), vectors, ids, k)
        assert found.tolist() == [i for _, i in want[0][:k]] and np.allclose(exact, [s for s, _ in want[0][:k]], rtol=0, atol=1e-12)
    # An id with several vectors counts by its nearest one, whatever their order.
    for order in (slice(None), slice(None, None, -1)):
        two = np.array([[3.0, 0], [1, 0], [2, 0]])[order]
        _, found, exact = neighbours.best_of(np.zeros((1, 2)), np.array([9]), two, np.array([5, 5, 6])[order], 2)
        assert found.tolist() == [5, 6] and exact.tolist() == [1, 2]
    got = {}
    # The sample is smaller than the copies of one row.
    for r in neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), sample=15, recall=1.1).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got[0] == [i for _, i in want[0]]


def test_recall_on_the_given_vectors(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = table.select("vec_id", "embedding").toPandas()
    ids, x = rows.vec_id.to_numpy(), np.stack(rows.embedding).astype(float)
    got = neighbours.search(table).toPandas().groupby("query_id").vec_id.apply(set)
    hits = total = 0
    for q, found in got.items():
        d = ((x - x[ids == q]) ** 2).sum(axis=1)
        d[ids == q] = np.inf
        near = set(ids[np.argsort(d)[:10]])
        hits, total = hits + len(near & found), total + 10
    assert len(got) == (ids % 100 == 0).sum() and hits / total >= 0.9


def test_probes_reach_the_recall_among_unseen_rows(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").limit(1000).toPandas()
    x = np.stack(rows.embedding).astype(float)
    router = neighbours.train(x, parts=32, degree=10, k=10, recall=0.97)
    y = x[np.arange(len(x)) % 5 == 4]
    d = ((y[:, None, :] - y[None, :, :]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    near, visited = np.argsort(d, axis=1)[:, :10], router.rank(y)[:, : router.probes]
    home = router.rank(y)[:, 0]
    assert np.mean([np.isin(home[n], v).mean() for n, v in zip(near, visited)]) >= 0.97


def test_parts_are_balanced():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 0.1, (n, 8)) for c, n in ((0, 700), (3, 200), (-3, 100))])
    part = neighbours.balanced_parts(x, neighbours.neighbour_graph(x, 8), 8)
    assert np.bincount(part, minlength=8).max() <= np.ceil(1000 / 8 * 1.1)


def test_learning_holds_few_rows_at_once():
    """The driver has to hold what the learning takes. In one piece this took 90 MB."""
    import tracemalloc

    rng = np.random.default_rng(6)
    bags = [np.unique(rng.integers(0, 1 << 12, 300)).astype(np.int32) for _ in range(4000)]
    y = (rng.random(4000) < 0.5).astype(int)
    bags = [np.union1d(bag, rng.choice(2000, 80) + (1 << 13 if label else 1 << 14)).astype(np.int32) for bag, label in zip(bags, y)]
    tracemalloc.start()
    toxicity.fit(bags, y, np.ones(4000), **production(("buckets", "least_g", "features", "factors", "rate", "decay")), steps=3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6
