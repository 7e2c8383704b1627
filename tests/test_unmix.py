"""Unmixing and factorisation against plain NumPy on small fixtures."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectrafold.operators import factorize as M
from spectrafold.operators import seeds as G
from spectrafold.operators import unmix as U
from spectrafold.operators._dense import nnls_rows
from spectrafold.tables import PIXEL


def table(spark, x, image="a", slice_id=0, nx=7):
    rows = [(image, slice_id, i // nx, i % nx, [float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "image_id STRING, slice_id INT, y INT, x INT, spectrum ARRAY<DOUBLE>")


def basis(spark, h, image="a"):
    return spark.createDataFrame([(image, i, [float(v) for v in r]) for i, r in enumerate(h)],
                                 "image_id STRING, component INT, spectrum ARRAY<DOUBLE>")


def collect_w(df):
    return np.array([r["w"] for r in df.orderBy("image_id", "slice_id", "y", "x").collect()])


def brute_nnls(x, h):
    k = len(h)
    best, arg = np.inf, None
    for n in range(k + 1):
        for s in itertools.combinations(range(k), n):
            w = np.zeros(k)
            if s:
                w[list(s)] = np.linalg.lstsq(h[list(s)].T, x, rcond=None)[0]
            if (w >= -1e-12).all():
                e = ((x - w @ h) ** 2).sum()
                if e < best - 1e-13:
                    best, arg = e, w
    return best, arg


def test_nnls_rows_against_all_subsets():
    rng = np.random.default_rng(1)
    for k, c in ((1, 4), (3, 8), (5, 9)):
        h, x = rng.random((k, c)), rng.normal(0.3, 1, (60, c))
        w = nnls_rows(x, h)
        assert (w >= 0).all()
        for xi, wi in zip(x, w):
            assert ((xi - wi @ h) ** 2).sum() == pytest.approx(brute_nnls(xi, h)[0], abs=1e-9)


def test_nnls_rows_with_dependent_basis():
    rng = np.random.default_rng(2)
    h = rng.random((2, 6))
    h = np.vstack([h, h[0] * 2, h[0] + h[1]])
    x = rng.random((40, 6))
    w = nnls_rows(x, h)
    for xi, wi in zip(x, w):
        assert ((xi - wi @ h) ** 2).sum() == pytest.approx(brute_nnls(xi, h)[0], abs=1e-8)


def test_fixed_h_recovers_and_ignores_partitioning(spark):
    rng = np.random.default_rng(3)
    h, w = rng.random((4, 12)), np.maximum(rng.normal(0.5, 1, (50, 4)), 0)
    p, b = table(spark, w @ h), basis(spark, h)
    got = collect_w(U.nnls_fixed_h(p, b, require=4))
    assert np.allclose(got, w, atol=1e-8)
    for n in (1, 7):
        assert np.allclose(collect_w(U.nnls_fixed_h(p.orderBy(F.rand(5)).repartition(n), b)), got, atol=1e-9)
    assert np.allclose(collect_w(U.nnls_fixed_h(p, b, limit=0)), got, atol=1e-9)  # basis joined, not broadcast
    with pytest.raises(ValueError):
        U.nnls_fixed_h(p, b, require=5)


def test_several_images_in_one_batch(spark):
    rng = np.random.default_rng(4)
    ha, hb = rng.random((2, 6)), rng.random((3, 5))
    wa, wb = rng.random((9, 2)), rng.random((9, 3))
    p = table(spark, wa @ ha, "a").unionByName(table(spark, wb @ hb, "b")).coalesce(1)
    out = U.nnls_fixed_h(p, basis(spark, ha, "a").unionByName(basis(spark, hb, "b")))
    assert np.allclose(collect_w(out.filter("image_id = 'a'")), wa, atol=1e-8)
    assert np.allclose(collect_w(out.filter("image_id = 'b'")), wb, atol=1e-8)


def numpy_mu(x, w, h, n, eps=1e-8, normalize=False):
    w, h = np.maximum(w, eps), np.maximum(h, eps)
    for _ in range(n):
        w = w * (x @ h.T / (w @ h @ h.T + eps))
        h = h * (w.T @ x / (w.T @ w @ h + eps))
        if normalize:
            s = np.maximum(w.sum(axis=0), eps)
            w, h = w / s, h * s[:, None]
    return w, h


@pytest.mark.parametrize("options", [{}, {"replay": 2}, {"replay": 3, "normalize_w_columns": True}, {"state_limit": 1}])
def test_mu_equals_numpy(spark, options):
    rng = np.random.default_rng(5)
    parts, want = [], {}
    h0 = rng.random((3, 6))
    for image in "ab":
        x, w0 = rng.random((30, 6)), rng.random((30, 3))
        w, h = numpy_mu(x, w0, h0, 7, normalize=options.get("normalize_w_columns", False))
        want[image] = (x, w, h)
        df = table(spark, x, image)
        wt = table(spark, w0, image).select(*PIXEL, F.col("spectrum").alias("w"))
        parts.append(df.join(wt, PIXEL))
    p = parts[0].unionByName(parts[1])
    b = basis(spark, h0, "a").unionByName(basis(spark, h0, "b"))
    fit = M.nmf(p, 3, spectra=b, w0="w", max_iter=7, track_error_every=1, tol=-1.0, **options)
    for image, (x, w, h) in want.items():
        assert np.allclose(collect_w(fit.abundance.filter(F.col("image_id") == image)), w, rtol=1e-7)
        got = np.array([r["spectrum"] for r in fit.spectra.filter(F.col("image_id") == image).orderBy("component").collect()])
        assert np.allclose(got, h, rtol=1e-7)
        rep = fit.report.filter(F.col("image_id") == image).first()
        assert rep["n_iter"] == 7 and rep["final_error"] == pytest.approx(np.linalg.norm(x - w @ h), rel=1e-6)
        assert all(b <= a * (1 + 1e-9) for a, b in zip(rep["history"], rep["history"][1:]))
    fit.release()


def test_cd_decreases_and_stops(spark):
    rng = np.random.default_rng(6)
    x = rng.random((40, 2)) @ rng.random((2, 8))
    rep = M.nmf_cd(table(spark, x), 2, max_iter=60).report.first()
    assert rep["relative_error"] < 0.05
    assert all(b <= a * (1 + 1e-9) + 1e-9 for a, b in zip(rep["history"], rep["history"][1:]))


def test_a_fit_in_a_task_is_the_fit_by_passes(spark):
    """Images of a task and larger ones take the same steps to the same end, alone and side by side."""
    rng = np.random.default_rng(12)
    p = table(spark, rng.random((60, 2)) @ rng.random((2, 5)), "a").unionByName(table(spark, rng.random((35, 5)), "b", 1))
    for solver in ("cd", "mu"):
        for options in ({}, {"normalize_w_columns": True, "patience": 2})[: 1 + (solver == "mu")]:
            fits = [M.nmf(p, 2, solver=solver, max_iter=40, track_error_every=2, task_limit=n, **options) for n in (10**6, 0, 300)]
            want = fits[0].report.orderBy("image_id").collect()
            assert [r["n_pixels"] for r in want] == [60, 35] and all(1 < r["n_iter"] <= 40 for r in want)
            for fit in fits:
                assert fit.abundance.columns == fits[0].abundance.columns and fit.report.schema == fits[0].report.schema
                assert np.allclose(collect_w(fit.abundance), collect_w(fits[0].abundance), rtol=1e-6, atol=1e-9)
                for a, b in zip(fit.report.orderBy("image_id").collect(), want):
                    assert a["n_iter"] == b["n_iter"] and np.allclose(a["history"], b["history"], rtol=1e-6, atol=1e-6)
                got, spectra = ([r["spectrum"] for r in f.spectra.orderBy("image_id", "component").collect()] for f in (fit, fits[0]))
                assert np.allclose(got, spectra, rtol=1e-6, atol=1e-9)


def test_cd_query_runs_to_its_end(spark, sf):
    """The registered query goes on until the violation is 1e-4 of the first one, or the reference's 500 iterations are over."""
    from spectrafold.plans import QUERIES, fixtures

    rows = fixtures.pixels_ord(spark, sf).select("image_id", "spectrum", M.random_w(3, 0).alias("w")).collect()
    for r in QUERIES["nmf_cd"](spark, sf).collect():
        x, w = (np.array([p[n] for p in rows if p["image_id"] == r["image_id"]]) for n in ("spectrum", "w"))
        h = np.sqrt(x.mean() / 3) * np.abs(np.random.default_rng(0).standard_normal((3, x.shape[1])))
        first, n = None, 0
        while n < 500 and (first is None or violation > 1e-4 * first):
            w, a = M.cd_w(x, w, h)
            h, b = M.cd_h(h, w.T @ w, w.T @ x)
            n, violation = n + 1, a + b
            first = first or violation
        assert n > 50 and abs(r["n_iter"] - n) <= 1 and r["n_checks"] == r["n_iter"] and r["monotone"]
        assert r["final_error"] == pytest.approx(np.linalg.norm(x - w @ h), rel=1e-6)


def test_smallest_case(spark):
    x = np.array([[2.0, 0.1, 1.0], [0.2, 1.9, 1.0], [1.8, 0.2, 0.9], [0.1, 2.1, 1.1]])
    h = np.array([[2, 0.1, 1.0], [0.1, 2, 1.0]])
    p = table(spark, x, nx=2).withColumn("w", F.array(F.lit(0.5), F.lit(0.5)))
    fit = M.nmf_seeded(p, basis(spark, h), 2, max_iter=200)
    assert fit.report.first()["relative_error"] < 0.05
    w = collect_w(U.nnls_fixed_h(p, basis(spark, h)))
    assert (w >= 0).all() and (w.argmax(axis=1) == [0, 1, 0, 1]).all()


def test_seeded_refuses_empty_map(spark):
    p = table(spark, np.ones((4, 3))).withColumn("w", F.array(F.lit(1.0), F.lit(0.0)))
    with pytest.raises(ValueError):
        M.nmf_seeded(p, basis(spark, np.ones((2, 3))), 2)


def test_pca_scores(spark):
    rng = np.random.default_rng(7)
    x = rng.random((60, 5)) @ rng.random((5, 6))
    x[:, 3] = 2.0  # no variance: dropped
    fit = M.pca(table(spark, x), 5)
    t = collect_w(fit.abundance)
    cov = np.cov(t.T)
    off = cov - np.diag(np.diag(cov))
    assert np.abs(off).max() < 1e-6 * np.diag(cov).max()
    assert t.min() == pytest.approx(0, abs=1e-6) and t.max() == pytest.approx(65535)
    assert sum(fit.report.first()["history"]) == pytest.approx(5)
    assert fit.spectra.first()["spectrum"][3] is None


def test_random_start_is_partition_independent(spark):
    p = table(spark, np.random.default_rng(8).random((35, 4)))
    a, b = (collect_w(M.nmf_mu(q, 2, max_iter=4).abundance) for q in (p.coalesce(1), p.repartition(6)))
    assert np.allclose(a, b, rtol=1e-9)


def test_fill_missing_h_uses_background_and_residual(spark):
    rng = np.random.default_rng(9)
    h = np.vstack([np.exp(-0.5 * ((np.arange(40) - m) / 3) ** 2) for m in (8, 28)])
    x = rng.random((49, 2)) @ h
    seeds = basis(spark, h[:1]).withColumn("background", F.lit(False))
    bg = spark.createDataFrame([("a", 2, None, True)], "image_id STRING, component INT, spectrum ARRAY<DOUBLE>, background BOOLEAN")
    out = {r["component"]: np.array(r["spectrum"]) for r in G.fill_missing_h(table(spark, x), seeds.unionByName(bg), 3).collect()}
    assert set(out) == {0, 1, 2}
    assert abs(out[1].argmax() - 28) <= 1
    assert np.allclose(out[2], x.mean(axis=0))


def test_parts_of_a_batch_come_back_in_place():
    import pyarrow as pa

    from spectrafold.operators._dense import groups, scattered

    rng = np.random.default_rng(2)
    keys = rng.integers(0, 9, 400)
    batch = pa.RecordBatch.from_pydict({"a": [None if k == 8 else f"k{k}" for k in keys], "b": (keys % 2).tolist()})
    found = dict(groups(batch, ["a", "b"]))
    assert {k: v.tolist() for k, v in found.items()} == {
        (None if k == 8 else f"k{k}", int(k % 2)): np.flatnonzero(keys == k).tolist() for k in set(keys.tolist())}
    parts = [(rows, rows[:, None] * 10.0 + np.arange(1 + key[1])) for key, rows in found.items() if key[0] != "k3"]
    want = [None if k == 3 else [i * 10.0 + c for c in range(1 + k % 2)] for i, k in enumerate(keys.tolist())]
    assert scattered(400, parts).to_pylist() == want
    assert scattered(2, []).to_pylist() == [None, None]
