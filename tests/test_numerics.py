"""Numerical methods: Matérn of any order, QR trees for spectra and principal axes."""

import math

import numpy as np
import pytest

from kernelspark.functions import kernels as KF
from kernelspark.operators import lowrank as L
from kernelspark.operators import partials, prep


def general(nu, r):
    s = np.sqrt(2 * nu) * r
    return np.exp((1 - nu) * math.log(2) - math.lgamma(nu) + nu * np.log(s) + KF.log_bessel_kv(nu, s))


@pytest.mark.parametrize("nu,poly", [(0.5, lambda s: 1.0), (1.5, lambda s: 1 + s), (2.5, lambda s: 1 + s + s * s / 3), (3.5, lambda s: 1 + s + 0.4 * s * s + s ** 3 / 15)])
def test_matern_equals_closed_forms(nu, poly):
    r = np.concatenate([[1e-12, 1e-6, 1e-3], np.linspace(0.01, 3, 400), np.linspace(3, 40, 200), [300.0]])
    s = np.sqrt(2 * nu) * r
    assert np.allclose(general(nu, r), poly(s) * np.exp(-s), rtol=1e-12, atol=1e-300)


@pytest.mark.parametrize("nu", [1e-4, 0.3, 1.0, 1.2, 2.0, 4.7, 20.3])
def test_bessel_against_its_integral(nu):
    t = np.linspace(0, 30, 200_001)
    for z in (1e-3, 0.1, 1.99, 2.01, 5.0, 30.0):
        with np.errstate(over="ignore", under="ignore"):
            f = np.exp(nu * t - z * np.cosh(t)) * 0.5 * (1 + np.exp(-2 * nu * t))
        assert math.exp(KF.log_bessel_kv(nu, np.array([z]))[0]) == pytest.approx(np.trapezoid(f, t), rel=1e-11)


def test_matern_edges_and_memory():
    k = KF.matern_np(np.array([0.0, 1e-300, 1e-9, 1e4]), 1.7)
    assert k[0] == 1.0 and k[1] == pytest.approx(1.0) and k[2] == pytest.approx(1.0) and k[3] == 0.0
    assert np.all(np.diff(KF.matern_np(np.linspace(0, 20, 500), 2.2)) < 0)
    import tracemalloc

    X = np.random.default_rng(0).random((1024, 4))
    tracemalloc.start()
    KF.KernelSpec("matern", 1.0, 1.7).block(X, X[:256])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 << 20


def rows_of(spark, M, name, parts=3):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(M)], f"id long, {name} array<double>").repartition(parts)


def test_small_singular_values_keep_their_size(spark):
    rng = np.random.default_rng(3)
    U, _ = np.linalg.qr(rng.standard_normal((200, 5)))
    W, _ = np.linalg.qr(rng.standard_normal((5, 5)))
    sigma = np.array([1.0, 1e-2, 1e-4, 1e-6, 1e-9])
    M = U * sigma
    df = rows_of(spark, M, "f", 7)
    assert L.spectrum(df, floor=0.0) == pytest.approx(list(sigma ** 2), rel=1e-10)
    V, lam, rank = L.eig_factor(rows_of(spark, (U * sigma) @ W.T, "f"), rel_tol=1e-20)
    assert rank == 5
    got = np.array([r.v for r in V.orderBy("id").collect()])
    assert np.allclose(got[:, :4].T @ got[:, :4], np.eye(4), atol=1e-8)
    assert np.allclose((got * lam) @ got.T, (M @ M.T), atol=1e-12)


def test_few_rows_and_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(partials, "FAN", 2)
    M = np.random.default_rng(4).standard_normal((6, 4))
    R = partials.tree_qr(rows_of(spark, M, "f", 6), 4, lambda pdf: np.stack(pdf["f"].to_numpy()))
    assert np.allclose(R.T @ R, M.T @ M)
    assert L.spectrum(rows_of(spark, M[:2], "f"), k=4, floor=0.0)[2:] == pytest.approx([0, 0], abs=1e-15)


def test_principal_axes_far_from_the_origin(spark):
    rng = np.random.default_rng(5)
    dev = np.array([3.0, 2.0, 1.5, 1.0, 0.5, 0.1])
    X = rng.standard_normal((2000, 6)) * dev + 1e7
    comps, mean, ratio = prep.pca_fit(rows_of(spark, X, "features"), 6)
    centred = X - X.mean(0)
    w, V = np.linalg.eigh(centred.T @ centred / (len(X) - 1))
    w, V = w[::-1], V[:, ::-1].T
    assert ratio * w.sum() == pytest.approx(w, rel=1e-6) and mean == pytest.approx(X.mean(0), rel=1e-12)
    assert np.allclose(np.abs((comps * V).sum(1)), 1, atol=1e-6)
    with pytest.raises(ValueError):
        prep.pca_fit(rows_of(spark, X[:0], "features"), 2)


@pytest.mark.parametrize("n,metric,own", [(1, "gaussian", True), (2, "gaussian", False), (9, "laplace", True), (300, "gaussian", True), (301, "laplace", False)])
def test_median_distance_by_bits(spark, n, metric, own):
    from kernelspark.operators import kernels as K

    X = np.random.default_rng(n).standard_normal((n, 3))
    X[n // 2:n // 2 + 3] = X[0]
    gap = X[:, None] - X[None]
    D = np.abs(gap).sum(2) if metric == "laplace" else np.sqrt((gap ** 2).sum(2))
    want = np.median(D.ravel() if own else D[~np.eye(n, dtype=bool)])
    got = K.median_bandwidth(rows_of(spark, X, "features"), KF.KernelSpec(metric), include_self=own).first()
    assert got.bandwidth == pytest.approx(want, rel=1e-12) and got.n_pairs == n * n - (0 if own else n)


def test_median_distance_without_rows_and_over_many(spark):
    from kernelspark.operators import kernels as K

    X = np.random.default_rng(2).standard_normal((3000, 2))      # beyond the size that one broadcast sample had
    df = rows_of(spark, X, "features", 4)
    assert K.median_bandwidth(df.where("id < 0"), KF.KernelSpec()).first().bandwidth is None
    D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(2))
    assert K.median_bandwidth(df, KF.KernelSpec()).first().bandwidth == pytest.approx(np.median(D), rel=1e-12)
