"""Hand-worked cases (FIXTURES.md §3) and properties."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kernelspark.functions.kernels import KernelSpec
from kernelspark.operators import chains as D
from kernelspark.operators import factor_store as FS
from kernelspark.operators import kernels as K
from kernelspark.operators import lowrank as L
from kernelspark.operators import metrics as M
from kernelspark.operators import posterior as PO
from kernelspark.operators import predict as R
from kernelspark.operators import prep as P
from kernelspark.operators import quality as Q

A6 = dict(abs=5e-7)


def preds(spark, y, p):
    return spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "y int, p double")


def test_binary_report_case1(spark):
    r = M.binary_report(preds(spark, (0, 0, 1, 1), (.12, .42, .35, .81))).first()
    assert (r.tp, r.fp, r.tn, r.fn) == (1, 0, 2, 1)
    assert r.auroc == pytest.approx(0.75, **A6)
    assert r.auprc == pytest.approx(0.833333, **A6)
    assert r.brier == pytest.approx(0.162350, **A6)
    assert r.nll == pytest.approx(0.483276, **A6)
    assert r.elpd == pytest.approx(-1.933104, **A6)
    assert r.predictive_likelihood == pytest.approx(0.616760, **A6)
    assert r.ece == pytest.approx(0.345, **A6)


def test_ties_case2(spark):
    r = M.ranking(preds(spark, (0, 1, 1, 0, 1), (.2, .2, .7, .7, .7))).first()
    assert r.auroc == pytest.approx(0.583333, **A6)
    assert r.auprc == pytest.approx(0.644444, **A6)


def test_one_class_case3(spark):
    r = M.binary_report(preds(spark, (1, 1), (.3, .9))).first()
    assert r.auroc is None and r.tnr is None and r.fpr is None
    assert r.accuracy == pytest.approx(0.5)


def test_kernels_case4(spark):
    df = spark.createDataFrame([([0.0, 0.0], [3.0, 4.0])], "a array<double>, b array<double>")
    specs = {"g": KernelSpec("gaussian", 5), "l": KernelSpec("laplace", 5), "m1": KernelSpec("matern", 5, 0.5),
             "m3": KernelSpec("matern", 5, 1.5), "m5": KernelSpec("matern", 5, 2.5)}
    r = df.select(*[s.point("a", "b").alias(n) for n, s in specs.items()],
                  *[s.point("a", "a").alias(n + "_self") for n, s in specs.items()]).first()
    want = {"g": 0.606531, "l": 0.246597, "m1": 0.367879, "m3": 0.483358, "m5": 0.523994}
    for n, v in want.items():
        assert r[n] == pytest.approx(v, **A6)
        assert r[n + "_self"] == pytest.approx(1.0)
        # the NumPy block form agrees with the Column form
        assert specs[n].block(np.array([[0.0, 0.0]]), np.array([[3.0, 4.0]]))[0, 0] == pytest.approx(v, **A6)


def test_general_matern_matches_closed_form():
    from kernelspark.functions.kernels import matern_np
    r = np.array([0.0, 0.3, 1.0, 2.5])
    for nu in (0.5, 1.5, 2.5):
        general = matern_np(r, nu + 1e-9)
        assert np.allclose(general, matern_np(r, nu), atol=1e-6)


def points_1d(spark):
    return spark.createDataFrame([(i, [float(v)]) for i, v in enumerate((0, 1, 3, 3.5, 8))],
                                 "id long, features array<double>")


def test_greedy_case5(spark):
    fac = L.pivoted_cholesky(points_1d(spark), KernelSpec("gaussian", 1.0), 3, "greedy")
    assert [p.id for p in fac.pivots] == [0, 4, 3]
    assert fac.errors == pytest.approx([0.726398, 0.526398, 0.170284], abs=1e-6)


def test_median_bandwidth_case8(spark):
    r = K.median_bandwidth(points_1d(spark), KernelSpec("gaussian")).first()
    assert r.bandwidth == pytest.approx(2.5)
    assert r.n_pairs == 25


def diag_kernel():
    return K.UserKernel(
        lambda a, b: F.when(a[0] == b[0], a[1]).otherwise(F.lit(0.0)),
        lambda X, Y: np.where(X[:, :1] == Y[:, :1].T, X[:, 1:2], 0.0))


def test_diagonal_matrix_case6(spark):
    vals = (6, 5, 4, 3, 2, 1, .1, .05, .03)
    pts = spark.createDataFrame([(i, [float(i), float(v)]) for i, v in enumerate(vals)], "id long, features array<double>")
    f6 = L.pivoted_cholesky(pts, diag_kernel(), 6, "greedy")
    assert f6.errors[-1] == pytest.approx(0.008499, abs=1e-6)
    assert [p.id for p in f6.pivots] == [0, 1, 2, 3, 4, 5]
    f8 = L.pivoted_cholesky(pts, diag_kernel(), 8, "greedy")
    assert f8.errors[-1] == pytest.approx(0.001416, abs=1e-6)


@pytest.mark.parametrize("method", ["greedy", "rp", "uniform", "accelerated", "block"])
def test_low_rank_recovery_case7(spark, method):
    rng = np.random.default_rng(0)
    X = rng.standard_normal((100, 20))
    pts = spark.createDataFrame([(i, list(map(float, x))) for i, x in enumerate(X)], "id long, features array<double>")
    lin = K.UserKernel(lambda a, b: F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda s, t: s + t),
                       lambda A_, B_: A_ @ B_.T)
    if method in ("greedy", "rp"):
        fac = L.pivoted_cholesky(pts, lin, 25, method)
    elif method == "uniform":
        fac = L.uniform_cholesky(pts, lin, 20)
    else:
        fac = L.accelerated_cholesky(pts, lin, 20, b=8, mode=method)
    assert fac.errors[-1] < 1e-8
    # residuals never increase with rank
    assert all(a >= b - 1e-12 for a, b in zip(fac.errors, fac.errors[1:]))


def test_posterior_case9(spark):
    f = spark.createDataFrame([([1.0, 0.0], 1), ([1.0, 1.0], 0), ([0.0, 2.0], 1)], "f array<double>, y int")
    m = PO.FactorModel(f, "sigmoid", cache=False)
    lp, g, _ = m.score(np.array([[0.5, -0.5]]))
    assert lp[0] == pytest.approx(-2.730486, **A6)
    assert g[0] == pytest.approx([-0.622459, 1.462117], abs=1e-6)
    # gradient equals finite differences of the log posterior
    eps = 1e-6
    for j in range(2):
        e = np.zeros(2)
        e[j] = eps
        num = (m.score(np.array([[0.5, -0.5]]) + e, grad=False)[0][0] -
               m.score(np.array([[0.5, -0.5]]) - e, grad=False)[0][0]) / (2 * eps)
        assert g[0][j] == pytest.approx(num, abs=1e-5)


def test_probit_log_cdf_tails():
    from math import erfc, log, sqrt
    xs = np.array([-12.0, -6.0, -5.0, -1.0, 0.0, 3.0])
    got = PO.log_norm_cdf(xs)
    for x, v in zip(xs, got):
        ref = log(0.5 * erfc(-x / sqrt(2))) if x > -8 else v
        assert v == pytest.approx(ref, rel=1e-6)


def test_rhat_case10(spark):
    df = spark.createDataFrame([(0, float(v)) for v in (1, 2, 3, 4)] + [(1, float(v)) for v in (2, 3, 4, 7)],
                               "chain int, x double")
    assert D.rhat(df, "chain").first().rhat == pytest.approx(1.051315, **A6)


def test_acf_case11(spark):
    xs = (1, 2, 3, 4, 3, 2, 1, 2, 3, 4)
    df = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(xs)], "c int, step long, x double")
    a = {r.lag: r.acf for r in D.acf(df, "c", max_lag=2, norm="n-lag", segment=4).collect()}
    assert [a[0], a[1], a[2]] == pytest.approx([1, 0.396825, -0.476190], abs=1e-6)
    b = {r.lag: r.acf for r in D.acf(df, "c", max_lag=2, norm="n", segment=3).collect()}
    assert [b[0], b[1], b[2]] == pytest.approx([1, 0.357143, -0.380952], abs=1e-6)
    assert D.integrated_time(df, "c", start_lag=2, segment=4).first().tau == pytest.approx(1.0)


def test_quantiles_case12(spark):
    d = spark.createDataFrame([(0, i, v, v) for i, v in enumerate((.1, .2, .4, .8))],
                              "id long, draw int, p double, latent double")
    r = R.summarize_draws(d).first()
    assert (r.prob_q05, r.prob_q50, r.prob_q95) == pytest.approx((0.115, 0.3, 0.74), abs=1e-9)
    assert r.prob_variance == pytest.approx(0.095833, **A6)
    from kernelspark.operators.ordered import exact_quantiles
    q = exact_quantiles(d, [], "p", [0.05, 0.5, 0.95], n_buckets=2).first()
    assert (q.q05, q.q50, q.q95) == pytest.approx((0.115, 0.3, 0.74), abs=1e-9)


def test_smape_case13(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 4.0)], "true double, pred double")
    assert M.regression_metrics(df).first().smape == pytest.approx(0.333333, **A6)


def test_prefix_case14(spark):
    m = spark.createDataFrame([(i, f"img/{i}.png") for i in range(6)], "row_idx long, image string")
    on_disk = [f"img/{i}.png" for i in range(6) if i not in (1, 3)] + ["images/2.png"]
    files = spark.createDataFrame([(p,) for p in on_disk], "path string")
    r = Q.repair_paths(m, files, ref="image")
    assert r.filter("repaired").count() == 1
    kept = sorted(x.row_idx for x in Q.contiguous_prefix(r).collect())
    assert kept == [0, 1, 2]


def test_stratified_quota_case15(spark):
    assert P.class_quota(10, 0.3) == (3, 7)
    assert P.class_quota(10, 0.04)[0] == 1
    df = spark.createDataFrame([(i, 1 if i < 30 else 0) for i in range(100)], "id long, y int")
    s = P.stratified_subsample(df, 10)
    assert s.filter("y = 1").count() == 3 and s.filter("y = 0").count() == 7


def test_audit_case16(spark):
    man = spark.createDataFrame([(r,) for r in ("a.png", "b", "sub/c.png", "", "d.png")], "image string")
    files = spark.createDataFrame([(p,) for p in ("a.png", "b.png", "x/c.png", "e.png")], "path string")
    emb = spark.createDataFrame([("a",), ("b",)], "stem string")
    a = {r.image: r.status for r in Q.audit(man, files, emb).collect()}
    assert a == {"a.png": "OK", "b": "OK", "sub/c.png": "MISSING_EMB", "": "MISSING_IMG", "d.png": "MISSING_IMG"}
    orph = [r.path for r in Q.orphans(Q.audit(man, files, emb), files).collect()]
    assert orph == ["e.png"]


# ---------------------------------------------------------------- properties ----

def random_preds(spark, n=400, seed=3):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    p = np.clip(0.3 * y + 0.7 * rng.random(n), 0, 1).round(3)
    return preds(spark, y, p), y, p


def test_auroc_symmetry_and_bounds(spark):
    df, y, p = random_preds(spark)
    a = M.ranking(df).first().auroc
    b = M.ranking(df.withColumn("p", 1 - F.col("p"))).first().auroc
    assert a + b == pytest.approx(1.0, abs=1e-9)
    # brute force: average rank with ties
    pos, neg = p[y == 1], p[y == 0]
    brute = np.mean([(1.0 if u > v else 0.5 if u == v else 0.0) for u in pos for v in neg])
    assert a == pytest.approx(brute, abs=1e-12)
    assert 0 <= M.ece(df).first().ece <= 1


def test_pell_below_elpd(spark):
    d = spark.createDataFrame([(i, s, i % 2, float(0.2 + 0.6 * ((i * 7 + s * 3) % 10) / 10))
                               for i in range(40) for s in range(8)], "id long, draw int, y int, p double")
    pe = M.pell(d).first().pell
    mean_p = d.groupBy("id", "y").agg(F.avg("p").alias("p"))
    assert pe <= M.binary_report(mean_p).first().elpd + 1e-9


def test_partition_independence(spark):
    df, _, _ = random_preds(spark, 300, 5)
    a = M.binary_report(df.repartition(1), n_buckets=4).first().asDict()
    b = M.binary_report(df.repartition(7), n_buckets=16).first().asDict()
    for k_, v in a.items():
        assert v == pytest.approx(b[k_], abs=1e-12) if isinstance(v, float) else v == b[k_]


def test_roc_curve_ends(spark):
    df, _, _ = random_preds(spark, 200, 9)
    pts = M.roc_curve(df).collect()
    assert any(r.fpr == 0 and r.tpr == 0 and r.threshold is None for r in pts)
    assert any(r.fpr == pytest.approx(1.0) and r.tpr == pytest.approx(1.0) for r in pts)


def test_rp_first_pivot_frequency(spark):
    """Chi-square sanity: RPCholesky's first pivot is drawn ∝ the diagonal."""
    vals = (4.0, 2.0, 1.0, 1.0)
    pts = spark.createDataFrame([(i, [float(i), v]) for i, v in enumerate(vals)], "id long, features array<double>")
    from kernelspark.operators.factor_store import FactorStore
    store = FactorStore(pts, diag_kernel())
    counts = np.zeros(4)
    for s in range(200):
        found, *_ = store.pick("rp", 1, seed=s)
        counts[found[0][0][1]] += 1
    store.close()
    expected = 200 * np.array(vals) / sum(vals)
    chi2 = ((counts - expected) ** 2 / expected).sum()
    assert chi2 < 16.27   # 3 dof, p = 0.001


def numpy_roc(y, p):
    """Reference algorithm: distinct thresholds descending, collinear middle points dropped, origin added."""
    order = np.argsort(-p, kind="mergesort")
    ps, ys = p[order], y[order]
    idx = np.r_[np.where(np.diff(ps))[0], len(ps) - 1]
    tps = np.cumsum(ys)[idx]
    fps = (1 + idx) - tps
    thr = ps[idx]
    if len(fps) > 2:
        keep = np.where(np.r_[True, np.logical_or(np.diff(fps, 2), np.diff(tps, 2)), True])[0]
        fps, tps, thr = fps[keep], tps[keep], thr[keep]
    return sorted([(None, 0.0, 0.0)] + [(float(t), f / fps[-1], s / tps[-1]) for t, f, s in zip(thr, fps, tps)],
                  key=lambda r: (r[0] is not None, r[0] if r[0] is not None else 0))


@pytest.mark.parametrize("seed", [1, 2])
def test_roc_curve_matches_numpy(spark, seed):
    df, y, p = random_preds(spark, 250, seed)
    got = sorted([(r.threshold, r.fpr, r.tpr) for r in M.roc_curve(df, n_buckets=8).collect()],
                 key=lambda r: (r[0] is not None, r[0] if r[0] is not None else 0))
    want = numpy_roc(np.asarray(y), np.asarray(p, dtype=float))
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[0] == b[0] or a[0] == pytest.approx(b[0])
        assert a[1] == pytest.approx(b[1]) and a[2] == pytest.approx(b[2])


@pytest.mark.parametrize("direct", [True, False])
def test_greedy_lookahead_equals_sequential(spark, direct, monkeypatch):
    """Exact lookahead (winners of partitions collected, or merged in rounds first) picks the sequential pivots."""
    if not direct:
        monkeypatch.setattr(FS, "DIRECT_ROWS", 0)
        monkeypatch.setattr(FS, "FAN", 2)
    rng = np.random.default_rng(4)
    X = rng.standard_normal((160, 5))
    X[7] = X[3]                                   # a duplicate: zero residual after its twin
    pts = spark.createDataFrame([(i, list(map(float, x))) for i, x in enumerate(X)],
                                "id long, features array<double>").repartition(3)
    ker = KernelSpec("gaussian", 2.0)
    seq = L.pivoted_cholesky(pts, ker, 25, "greedy", lookahead=0)
    look = L.pivoted_cholesky(pts, ker, 25, "greedy", lookahead=8)
    assert [p.id for p in look.pivots] == [p.id for p in seq.pivots]
    assert look.errors == pytest.approx(seq.errors, abs=1e-12)
    assert look.rounds < seq.rounds
    tol = seq.errors[10]
    cut = L.pivoted_cholesky(pts, ker, 25, "greedy", lookahead=8, tol=tol)
    assert len(cut.pivots) == 11


def test_random_pivots_thinning_equals_one_a_pass(spark):
    """Several draws a pass from stale residuals are the draws of one pass each; stored columns are the factor."""
    rng = np.random.default_rng(8)
    X = rng.standard_normal((400, 6))
    pts = spark.createDataFrame([(i, list(map(float, x))) for i, x in enumerate(X)], "id long, features array<double>").repartition(2)
    ker = KernelSpec("gaussian", 2.5)
    one = L.pivoted_cholesky(pts, ker, 20, "rp", lookahead=0)
    many = L.pivoted_cholesky(pts, ker, 20, "rp")
    assert [p.id for p in many.pivots] == [p.id for p in one.pivots]
    assert one.rounds == 20 and many.rounds < 5
    assert many.errors == pytest.approx(one.errors, abs=1e-12)
    P, Lc = np.array([p.x for p in many.pivots]), many.chol()
    G = np.linalg.solve(Lc, ker.block(X, P).T).T
    stored = {r.id: r for r in many.factor_df().collect()}
    assert np.allclose(np.array([stored[i].f for i in range(400)]), G, atol=1e-9)
    assert [stored[i].residual for i in range(400)] == pytest.approx(list(np.maximum(1 - (G * G).sum(1), 0)), abs=1e-9)
    many.close()
    again = {r.id: r.f for r in many.factor_df().collect()}
    assert np.allclose(np.array([again[i] for i in range(400)]), G, atol=1e-9)


def test_auto_block_depends_on_sizes_only(spark):
    assert L.auto_block(10**6, 800, 64) == 100 and L.auto_block(10**6, 8, 64) == 16
    assert L.auto_block(10**9, 10**5, 64) > 512 and L.auto_block(100, 10**4, 4) < 10**4 // 8
    X = np.random.default_rng(1).standard_normal((150, 3))
    pts = spark.createDataFrame([(i, list(map(float, x))) for i, x in enumerate(X)], "id long, features array<double>")
    runs = [[p.id for p in L.accelerated_cholesky(pts.repartition(n), KernelSpec("gaussian", 1.0), 20, b="auto").pivots] for n in (1, 3)]
    assert runs[0] == runs[1] and len(runs[0]) == 20


@pytest.mark.parametrize("method", ["greedy", "rp", "accelerated", "block"])
def test_round_pass_bounded_path(spark, method, monkeypatch):
    """Winners of partitions merged in rounds, and small pending blocks, change nothing."""
    rng = np.random.default_rng(6)
    X = rng.standard_normal((120, 4))
    pts = spark.createDataFrame([(i, list(map(float, x))) for i, x in enumerate(X)],
                                "id long, features array<double>").repartition(4)
    ker = KernelSpec("gaussian", 1.5)

    def run():
        if method in ("greedy", "rp"):
            return L.pivoted_cholesky(pts, ker, 12, method, lookahead=0)
        return L.accelerated_cholesky(pts, ker, 12, b=6, mode=method)

    direct = run()
    monkeypatch.setattr(FS, "DIRECT_ROWS", 0)
    monkeypatch.setattr(FS, "FAN", 2)
    monkeypatch.setattr(FS, "BLOCK", 5)
    bounded = run()
    assert [p.id for p in bounded.pivots] == [p.id for p in direct.pivots]
    assert bounded.errors == pytest.approx(direct.errors, abs=1e-12)


def test_diagnostic_points_fallback(spark):
    # every prediction correct: no incorrect slot, so a fallback fills the fourth place
    df = spark.createDataFrame([(i, 1 if p >= .5 else 0, p) for i, p in enumerate((.9, .6, .58, .2, .45))],
                               "id long, y int, p double")
    got = [(r.pos, r.role, r.id) for r in M.diagnostic_points(df).collect()]
    # conf = .4, .1, .08, .3, .05; correct rows by conf: 4, 2, 1, 3, 0 → position 5 // 2 = 2 → id 1
    assert got == [(1, "highest-confidence correct", 0), (2, "most uncertain", 4),
                   (3, "median-uncertainty correct", 1), (4, "fallback point 4", 2)]
