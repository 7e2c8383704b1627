"""Whitening against numpy on the whole table, and on awkward vectors."""

import math

import numpy as np
import pytest

from spectrafold.llm import queries, whitening


def whole(x):
    """(eigenvalues, components, trace, mean) by numpy, falling."""
    y = x - x.mean(axis=0)
    cov = y.T @ y / len(x)
    e, u = np.linalg.eigh(cov)
    return e[::-1], u[:, ::-1], np.trace(cov), x.mean(axis=0)


def test_query_equals_numpy(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    x = np.array([[math.floor(1024 * c) + 100_000 for c in r["embedding"]] for r in rows], dtype=np.int64)
    e, u, trace, mean = whole(x.astype(np.float64))
    got = queries.op11_whitening(spark, sf).collect()
    assert len(got) == 8 * len(rows)
    at = {r["vec_id"]: i for i, r in enumerate(rows)}
    z = np.zeros((len(rows), 8))
    sums = [int(s) for s in x.sum(axis=0)]
    for r in got:
        z[at[r["vec_id"]], r["component"] - 1] = r["whitened"]
        assert r["n"] == len(rows) and r["identity_error"] < 1e-9
        assert math.isclose(r["explained"], e[r["component"] - 1] / trace, rel_tol=1e-9)
        if r["component"] == 1:
            assert r["deviation"] == sum((len(rows) * int(v) - s) ** 2 for v, s in zip(x[at[r["vec_id"]]], sums))
    want = (x - mean) @ u[:, :8] / np.sqrt(e[:8])
    sign = np.sign((want * z).sum(axis=0))  # one sign a component, the same for all rows
    assert np.abs(z - want * sign).max() < 1e-6
    assert np.abs(z.T @ z / len(z) - np.eye(8)).max() < 1e-9


@pytest.mark.parametrize("d", [1, 2, 3, 9, 40])
@pytest.mark.parametrize("kind", ["plain", "equal", "clusters", "diagonal", "low_rank", "graded"])
def test_eigenpairs(d, kind):
    rng = np.random.default_rng(d)
    q, _ = np.linalg.qr(rng.standard_normal((d, d)))
    e = {"plain": rng.random(d) + 0.1, "equal": np.full(d, 3.0), "clusters": 5.0 - (np.arange(d) // 4) + 1e-9 * rng.random(d),
         "diagonal": np.arange(d) + 1.0, "low_rank": np.where(np.arange(d) < 2, 7.0, 0.0), "graded": 10.0 ** -np.arange(d)}[kind]
    v = np.diag(e) if kind == "diagonal" else (q * e) @ q.T
    v = (v + v.T) / 2
    values, vectors = whitening.leading_eigenpairs(v, 8)
    size = np.abs(v).max()
    assert np.allclose(values, np.linalg.eigvalsh(v)[::-1][:8], atol=1e-13 * size * d, rtol=0)
    assert np.abs(v @ vectors - vectors * values).max() < 1e-12 * size * d
    assert np.abs(vectors.T @ vectors - np.eye(min(8, d))).max() < 1e-9
    below = whitening.sturm_counts(*whitening.tridiagonal(v)[:2], np.array([-1e3, 1e3]))
    assert below.tolist() == [0, d]


SCHEMA = "vec_id long, embedding array<double>, n string, component string, whitened string"


def test_awkward_vectors(spark):
    rows = [(1, [0.5, 0.25]), (1, [0.5, 0.25]), (2, None), (3, []), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]),
            (None, [-0.5, 0.75]), (7, [0.0, 0.0]), (8, [1.0, 2.0, 3.0]), (9, [0.1, -0.9])]
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(3)
    got = whitening.whiten(df).collect()
    used = [v for i, v in rows if i in (1, 7, 9, None)]
    x = np.array([[math.floor(1024 * c) + 100_000 for c in v] for v in used], dtype=np.int64)
    assert sorted((r["vec_id"] or 0, r["component"]) for r in got) == sorted(((i or 0), c) for i in (1, 1, 7, 9, None) for c in (1, 2))
    sums = x.sum(axis=0)
    dev = sorted(int(((len(x) * r - sums) ** 2).sum()) for r in x)
    assert sorted(r["deviation"] for r in got if r["component"] == 1) == dev
    assert {r["n"] for r in got} == {5} and max(r["identity_error"] for r in got) < 1e-9
    assert math.isclose(sum({r["component"]: r["explained"] for r in got}.values()), 1.0)


def test_no_variance_and_empty_tables(spark):
    same = spark.createDataFrame([(i, [0.5, 0.5], "", "", "") for i in range(5)], SCHEMA)
    for df in (same, same.limit(0), same.where("vec_id = 1"), spark.createDataFrame([(1, [], "", "", ""), (2, None, "", "", "")], SCHEMA)):
        out = whitening.whiten(df)
        assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and out.count() == 0


def test_deviation_beyond_longs():
    model = whitening.Whitening(4, np.array([0, 0]), 1.0, np.array([1.0]), np.array([[1.0], [0.0]]))
    x = np.array([[1 << 29, 0], [1 << 32, 1 << 32]])
    assert model.deviations(x) == [(4 << 29) ** 2, None]
    assert model.deviations(x[:1]) == [(4 << 29) ** 2]
