import numpy as np
import pytest

from kinetrove.llm import whitening
from kinetrove.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute(rows, most=16):
    """(values, vectors, n, sums) by an eigendecomposition of the covariance of the distinct vectors."""
    x = np.unique(np.floor(np.array(rows, np.float64) * 64).astype(np.int64) + 1_000_000, axis=0)
    n, sums = len(x), x.sum(axis=0)
    centred = (n * x - sums) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    return values[::-1][:most], vectors[:, ::-1][:, :most], n, sums, values.sum()


def table(df):
    rows = sorted(df.collect(), key=lambda r: (r.vec_id, r.component))
    ids = sorted({r.vec_id for r in rows})
    return rows, ids, np.array([r.whitened for r in rows]).reshape(len(ids), -1)


def test_given_table(spark):
    given = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    values, vectors, n, sums, trace = brute([r.embedding for r in given])
    rows, ids, white = table(QUERIES["op11_whitening"](spark, SF))
    assert ids == [r.vec_id for r in given] and white.shape[1] == 16
    x = np.floor(np.array([r.embedding for r in given], np.float64) * 64).astype(np.int64) + 1_000_000
    exact = n * x - sums
    assert [r.deviation for r in rows[::16]] == (exact**2).sum(axis=1).tolist()
    assert {r.n for r in rows} == {n} and max(r.identity_error for r in rows) < 1e-10
    assert np.allclose([r.explained for r in rows[:16]], values / trace, rtol=1e-10)
    want = (exact / n) @ vectors / np.sqrt(values)
    signs = np.sign((want * white).sum(axis=0))
    assert np.abs(white * signs - want).max() < 1e-8


@pytest.mark.parametrize("d,wanted,spectrum", [(80, 16, "flat"), (80, 16, "steep"), (60, 8, "gap"), (10, 10, "steep"), (40, 16, "low")])
def test_leading_pairs(d, wanted, spectrum):
    rng = np.random.default_rng(3)
    values = {"flat": 1 + 0.002 * np.arange(d)[::-1], "steep": 2.0 ** -np.arange(d), "gap": np.where(np.arange(d) < 8, 5 + np.arange(d)[::-1], 1.0), "low": np.where(np.arange(d) < 5, 1.0 + np.arange(d), 0.0)}[spectrum]
    values = np.sort(values)[::-1]
    basis = np.linalg.qr(rng.standard_normal((d, d)))[0]
    matrix = (basis * values) @ basis.T
    found = whitening.leading(lambda q: matrix @ q, d, wanted)
    assert np.allclose(found.values, values[:wanted], rtol=1e-10, atol=1e-13 * values[0])
    assert found.residuals.max() <= 1e-12 * values[0]
    if spectrum in ("flat", "gap"):
        want = basis[:, :wanted]
        assert np.abs(np.abs((found.vectors * want).sum(axis=0)) - 1).max() < 1e-10


def test_a_missing_direction_is_noticed():
    values = np.array([9.0, 8, 7, 1, 0.5, 0.1])
    found = np.eye(6)[:, [0, 2]]
    assert whitening._larger(lambda q: np.diag(values) @ q, found, 7.0, 4, np.random.default_rng(0), 9.0)
    assert not whitening._larger(lambda q: np.diag(values) @ q, np.eye(6)[:, [0, 1]], 8.0, 4, np.random.default_rng(0), 9.0)


def test_partial_sums_are_added_in_tasks(spark):
    rng = np.random.default_rng(4)
    vectors = spark.createDataFrame([([int(v) for v in rng.integers(-9, 9, 5)],) for _ in range(300)], "x array<long>")
    fit = whitening.distinct_blocks(vectors.repartition(4))
    fit.blocks = fit.blocks.repartition(9)
    direct = whitening.summed(fit, lambda c: c.T @ c, (5, 5))
    assert np.allclose(whitening.summed(fit, lambda c: c.T @ c, (5, 5), direct=2), direct, rtol=1e-13)
    assert np.isclose(np.trace(direct) / fit.n, fit.trace, rtol=1e-13)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 1.0, 2.0]), (1, [0.5, 1.0, 2.0]), (2, [0.501, 1.0, 2.0]), (3, [-1.5, 0.25, 3.0]), (4, None), (5, [1.0, None, 1.0]), (6, [nan, 0.0, 0.0]), (7, [inf, 0.0, 0.0]), (8, []), (9, [1.0]), (None, [3.0, 3.0, 1.0])]
    docs = spark.createDataFrame([(*r, 1, "x", 2.0) for r in rows], "vec_id long, embedding array<float>, n long, x string, component double")
    got = whitening.whiten(docs).collect()
    assert sorted({str(r.vec_id) for r in got}) == ["1", "2", "3", "None"]
    values, vectors, n, sums, trace = brute([r[1] for r in rows if r[0] in (1, 2, 3, None)])
    assert n == 3 and {r.n for r in got} == {3}
    # Three vectors span two components.
    assert {r.component for r in got} == {1, 2} and len(got) == 5 * 2
    assert np.allclose(sorted({r.explained for r in got}, reverse=True), values[:2] / trace)
    one = whitening.whiten(docs.where("vec_id < 3"))
    assert one.count() == 0 and whitening.whiten(docs.where("false")).count() == 0
    assert one.columns == [f.split()[0] for f in whitening.SCHEMA.split(", ")]


def test_large_entries_stay_exact():
    big = np.array([[3 << 32, 1], [1, 2]], np.int64)
    with pytest.raises(OverflowError):
        whitening.deviations(big)
    assert whitening.deviations(big >> 3) == [(3 << 29) ** 2, 0]
