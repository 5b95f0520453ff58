"""Results that must not change with size, layout, skew or run length."""

import math
import re
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from kernelspark import session
from kernelspark.functions.kernels import KernelSpec
from kernelspark.operators import chains as D
from kernelspark.operators import metrics as M
from kernelspark.operators import ordered as O
from kernelspark.operators import posterior as PO
from kernelspark.operators import predict as R
from kernelspark.operators import samplers as S


@pytest.mark.parametrize("kernel", [KernelSpec("gaussian", 3.0), KernelSpec("laplace", 3.0), KernelSpec("matern", 3.0, nu=1.5)])
def test_block_kernel_does_not_depend_on_the_batch_or_the_pivots(kernel):
    rng = np.random.default_rng(0)
    X = 1000 + rng.standard_normal((4096, 64))
    P = X[:300]
    whole = kernel.block(X, P)
    assert np.array_equal(whole[1000:1050], kernel.block(X[1000:1050], P))
    assert np.array_equal(whole[:, :7], kernel.block(X, P[:7]))
    d = X[:40, None, :] - P[None, :, :]
    r = np.abs(d).sum(-1) if kernel.metric == "l1" else np.sqrt((d * d).sum(-1))
    direct = {"gaussian": np.exp(-0.5 * (r / 3.0) ** 2), "laplace": np.exp(-r / 3.0), "matern": (1 + math.sqrt(3) * r / 3.0) * np.exp(-math.sqrt(3) * r / 3.0)}
    assert np.abs(whole[:40] - direct[kernel.name]).max() < 1e-12 and (whole[np.arange(300), np.arange(300)] == 1.0).all()


def test_ranking_of_billions_of_rows(spark):
    n = 8_000_000_000
    scores = spark.createDataFrame([(0.2, n // 4, n), (0.7, n, n // 8)], "_p double, pos long, neg long")
    r = M.report_of_scores(scores, []).first()
    pos, neg = n + n // 4, n + n // 8
    right = n * n + 0.5 * ((n // 4) * n + n * (n // 8))
    assert math.isclose(r.auroc, right / (pos * neg), rel_tol=1e-12) and r.n == pos + neg


def test_quantiles_with_a_hot_value(spark):
    v = np.concatenate((np.full(700, 0.5), np.random.default_rng(1).random(300)))
    df = spark.createDataFrame([("a", float(x)) for x in v] + [(None, 1.0), ("b", None)], "k string, v double")
    got = {r.k: r for r in O.exact_quantiles(df, ["k"], "v", [0.0, 0.05, 0.5, 0.999, 1.0], names=list("zabcy")).collect()}
    assert np.allclose(list(got["a"])[1:], np.quantile(v, [0, 0.05, 0.5, 0.999, 1]))
    assert list(got[None])[1:] == [1.0] * 5


def test_median_uncertainty_row_with_a_hot_confidence(spark):
    rows = [(i, 1, 0.9) for i in range(40)] + [(100 + i, 1, 0.95) for i in range(9)]
    got = {r.role: r.id for r in M.diagnostic_points(spark.createDataFrame(rows, "id long, y int, p double").repartition(4)).collect()}
    assert got["median-uncertainty correct"] == 24


def test_total_row_beside_a_group_of_that_name(spark):
    rows = [("ALL", 1, 0.9), ("ALL", 0, 0.4), ("b", 0, 0.1), ("b", 1, 0.2), ("b", 1, 0.6)]
    got = M.report_with_total(spark.createDataFrame(rows, "g string, y int, p double"), "g").collect()
    assert sorted((r.g, r.n) for r in got) == [("ALL", 2), ("ALL", 5), ("b", 3)]


def chain(x):
    return [("c", i, float(v)) for i, v in enumerate(x)]


def plain_acf(x, lag):
    x = x - x.mean()
    return float((x[:len(x) - lag] * x[lag:]).mean() / x.var())


def test_chains_shorter_than_the_lags(spark):
    x = np.random.default_rng(2).standard_normal(100)
    df = spark.createDataFrame(chain(x), "k string, step long, x double")
    got = {r.lag: r.acf for r in D.acf(df, ["k"], segment=16).collect()}
    assert sorted(got) == list(range(100)) and all(math.isclose(got[k], plain_acf(x, k), abs_tol=1e-12) for k in got)
    assert D.geyer_ess(df, ["k"]).first().terminated


def test_a_slow_chain_extends_its_lags(spark):
    rng = np.random.default_rng(3)
    x = np.zeros(3000)
    for i in range(1, 3000):
        x[i] = 0.99 * x[i - 1] + rng.standard_normal()
    df = spark.createDataFrame(chain(x) + [("m", i, float(i)) for i in range(6)], "k string, step long, x double")
    got = {r.k: r for r in D.geyer_ess(df, ["k"], start_lag=4, segment=64).collect()}
    tau, k = 1.0, 1
    while (g := plain_acf(x, 2 * k) + plain_acf(x, 2 * k + 1)) >= 0:
        tau, k = tau + 2 * g, k + 1
    assert got["c"].terminated and math.isclose(got["c"].tau, tau, rel_tol=1e-9)
    c = np.array([((x - x.mean())[:3000 - l] * (x - x.mean())[l:]).sum() for l in range(1500)]) / ((x - x.mean()) ** 2).sum()
    taus = 2 * np.cumsum(c) - 1
    m = int(np.flatnonzero(np.arange(1500) >= 5 * taus)[0])
    t = {r.k: r for r in D.integrated_time(df, ["k"], start_lag=4, segment=64).collect()}["c"]
    assert t.win_lag == m and math.isclose(t.tau, taus[m], rel_tol=1e-9)


# ---- samplers ----------------------------------------------------------------------------

def gaussian_score(scale):
    def score(nu, grad):
        z = nu / scale
        return -0.5 * (z * z).sum(1), -z / scale if grad else None
    return score


@pytest.mark.parametrize("kind,warmup,steps,band", [("rwm", 1500, 3000, (0.15, 0.45)), ("mala", 1000, 2000, (0.42, 0.72)), ("hmc", 400, 1000, (0.7, 0.95))])
def test_samplers_reach_their_bands_and_the_target(kind, warmup, steps, band):
    scale = np.array([1.0, 0.5, 2.0])
    draws, taken = [], []
    for i, now, accepted, _ in S.walk(gaussian_score(scale), np.zeros((8, 3)), kind, steps, warmup, 0.5, 12):
        if i >= warmup:
            draws.append(now.nu.copy())
            taken.append(accepted)
    draws = np.array(draws)                                    # steps × chains × 3
    assert band[0] < np.mean(taken) < band[1]
    assert np.abs(draws.mean((0, 1)) / scale).max() < 0.15 and np.abs(draws.std((0, 1)) / scale - 1).max() < 0.15
    within, between = draws.var(0, ddof=1).mean(0), draws.mean(0).var(0, ddof=1)
    assert np.sqrt((within * (steps - 1) / steps + between) / within).max() < 1.06


@pytest.mark.parametrize("kind", ["rwm", "mala", "hmc"])
def test_no_warmup_keeps_the_step_size(kind):
    assert all((eps == 0.05).all() for *_, eps in S.walk(gaussian_score(1.0), np.zeros((2, 3)), kind, 5, 0, 0.05, 3))


def test_the_averaged_size_holds_from_the_first_kept_step():
    sizes = [eps.copy() for *_, eps in S.walk(gaussian_score(1.0), np.zeros((2, 3)), "hmc", 3, 20, 0.05, 3)]
    assert (sizes[0] == 0.05).all() and all((e == sizes[20]).all() for e in sizes[20:]) and (sizes[19] != sizes[20]).all()


def test_own_proposal_with_a_log_ratio():
    def independent(nu, eps, rng):
        new = 2.0 * rng.standard_normal(nu.shape)
        return new, 0.125 * ((new * new).sum(1) - (nu * nu).sum(1))

    got = np.concatenate([now.nu for *_, now, _, _ in [(None, now, a, e) for _, now, a, e in S.walk(gaussian_score(1.0), np.zeros((50, 1)), "rwm", 400, 0, 1.0, proposal=independent)]])
    assert abs(got.mean()) < 0.05 and abs(got.std() - 1) < 0.05


def counted(score):
    calls = []

    def count(nu, grad):
        calls.append(len(nu))
        return score(nu, grad)
    return count, calls


@pytest.mark.parametrize("kind,own", [("rwm", None), ("rwm", lambda nu, eps, rng: nu + eps[:, None] * rng.uniform(-1, 1, nu.shape)), ("mala", None), ("hmc", None)])
def test_chains_do_not_depend_on_how_far_a_pass_looks_ahead(kind, own):
    def run(ahead):
        score, calls = counted(gaussian_score(np.array([1.0, 0.5, 2.0])))
        got = [(i, now.nu.copy(), now.logp.copy(), a.copy(), e.copy()) for i, now, a, e in S.walk(score, np.zeros((5, 3)), kind, 83, 61, 0.9, 3, 7, proposal=own, ahead=ahead)]
        return got, len(calls)

    plain, calls = run(1)
    assert [i for i, *_ in plain] == list(range(144)) and 0.05 < np.mean([a for *_, a, _ in plain]) < 0.98
    for ahead in (2, 3, 5):
        got, fewer = run(ahead)
        assert all(a[0] == b[0] and all(np.array_equal(x, y) for x, y in zip(a[1:], b[1:], strict=True)) for a, b in zip(plain, got, strict=True))
        assert kind == "hmc" or fewer < calls


def test_a_pass_of_a_random_walk_takes_three_steps_by_default():
    score, calls = counted(gaussian_score(1.0))
    assert len(list(S.walk(score, np.zeros((4, 2)), "rwm", 300, 150, 0.5))) == 450
    assert len(calls) == 1 + 3 * 17 + 100          # the start, three warm-up stretches of 50, the kept steps
    assert set(calls[1:]) <= {7 * 4, 3 * 4}


@pytest.mark.parametrize("ahead", [1, 4])
def test_walks_without_steps_or_chains(ahead):
    assert not list(S.walk(gaussian_score(1.0), np.zeros((2, 2)), "rwm", 0, 0, 0.1, ahead=ahead))
    with pytest.raises(ValueError):
        next(S.walk(gaussian_score(1.0), np.zeros((2, 2)), "rwm", 5, 0, 0.1, ahead=0))


def test_points_are_scored_alike_however_many_there_are(spark):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(rng.standard_normal(3).tolist(), i % 2) for i in range(90)], "f array<double>, y int").repartition(4)
    points = rng.standard_normal((2 * PO.POINTS_AT_ONCE + 5, 3))
    model = PO.FactorModel(df)
    logp, grad, h = model.score(points, hessian=True)
    for i in (0, PO.POINTS_AT_ONCE, len(points) - 1):
        one, g, h1 = model.score(points[i:i + 1], hessian=True)
        assert abs(one[0] - logp[i]) < 1e-9 and np.abs(g[0] - grad[i]).max() < 1e-9 and (i or np.abs(h - h1).max() < 1e-9)
    model.close()


def test_sampler_on_a_factor_stores_its_chain(spark):
    rng = np.random.default_rng(4)
    f = rng.standard_normal((60, 2))
    y = (f[:, 0] + 0.3 * rng.standard_normal(60) > 0).astype(int)
    df = spark.createDataFrame([(f[i].tolist(), int(y[i])) for i in range(60)], "f array<double>, y int")
    out = PO.run_sampler(df, "ensemble_mala", n_steps=5, n_warmup=3, step_size=0.1)
    rows = out["chain"].collect()
    assert len(rows) == 8 * out["n_chains"] == 8 * 24 and sum(r.is_warmup for r in rows) == 3 * 24
    last = [r for r in rows if r.step == 7][0]
    logp = PO.FactorModel(df).score(np.array([last.nu]), grad=False)[0][0]
    assert math.isclose(logp, last.logp, rel_tol=1e-9)


def test_laplace_says_when_it_has_not_converged(spark):
    df = spark.createDataFrame([([1.0], 1), ([2.0], 0)], "f array<double>, y int")
    with pytest.raises(RuntimeError):
        PO.laplace(df, max_iter=1)


def test_erfc():
    x = np.concatenate((np.linspace(-6, 26, 4001), [0.0, 2.0, -2.0]))
    exact = np.array([math.erfc(v) for v in x])
    assert np.abs(PO.erfc(x) / exact - 1).max() < 1e-12


def test_passes_over_a_factor_have_as_many_tasks_as_are_worth_it(spark):
    """A sampler's every pass is a job: neither one task for all rows nor a task for some hundred."""
    rows = spark.range(0, 8000, 1, 64).select(F.array(F.col("id") / 8000, F.lit(1.0)).alias("f"), (F.col("id") % 2).alias("y"))
    models = {n: PO.FactorModel(df) for n, df in (("many", rows), ("one", rows.coalesce(1)), ("few", rows.limit(900)))}
    parts = {n: m.df.rdd.getNumPartitions() for n, m in models.items()}
    assert parts == {"many": 4, "one": 4, "few": 1}
    V = np.array([[0.3, -0.2], [1.0, 0.5]])
    assert np.allclose(models["many"].score(V)[0], models["one"].score(V)[0], rtol=1e-12)


# ---- prediction ---------------------------------------------------------------------------

@pytest.mark.parametrize("cells", [10_000, 40])
def test_kernel_sums_in_blocks(spark, cells):
    rng = np.random.default_rng(5)
    X, T, w = rng.standard_normal((50, 3)), rng.standard_normal((30, 3)), rng.standard_normal(50)
    ker = KernelSpec("gaussian", 1.0)
    train = spark.createDataFrame([(i, X[i].tolist(), float(w[i])) for i in range(50)], "id long, features array<double>, w double").repartition(3)
    test = spark.createDataFrame([(100 + i, T[i].tolist()) for i in range(30)], "id long, features array<double>")
    got = {r.id: r.f_star for r in R.kernel_weighted_sum(train, test, ker, "w", block_cells=cells).collect()}
    want = ker.block(T, X) @ w
    assert len(got) == 30 and all(math.isclose(got[100 + i], want[i], rel_tol=1e-9, abs_tol=1e-12) for i in range(30))
    assert R.kernel_weighted_sum(train, test.limit(0), ker, "w").collect() == []


def test_kernel_sums_spread_over_tasks(spark, tmp_path):
    """Sides of some thousand short rows give several tasks, and no call sees more than a tile of kernel values."""
    from pyspark import TaskContext

    class Noted:
        def quick_block(self, X, Y):
            assert X.shape[0] * Y.shape[0] <= 1 << 20
            (tmp_path / str(TaskContext.get().partitionId())).touch()
            return np.ones((len(X), len(Y)))

        block = quick_block

    rows = spark.range(5000).select("id", F.array(F.col("id").cast("double")).alias("features"), F.lit(0.5).alias("w"))
    got = R.kernel_weighted_sum(rows, rows, Noted(), "w").collect()
    assert len(got) == 5000 and {r.f_star for r in got} == {2500.0}
    assert len(list(tmp_path.iterdir())) > 3


def test_a_cell_of_kernel_sums_is_a_group(spark):
    """Cells that are rows of an Arrow batch would reach a worker up to ten thousand at once."""
    rows = spark.range(50).select("id", F.array(F.col("id").cast("double")).alias("features"), F.lit(0.5).alias("w"))
    plan = R.kernel_weighted_sum(rows, rows, KernelSpec("gaussian", 1.0), "w", block_cells=10)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "collect_list" not in plan and "MapInArrow " not in plan


def test_option_a_sums_are_made_once(spark):
    from kernelspark.plans import q_posterior

    out = q_posterior.q_option_a(spark, "/root/testdata/sf0.001")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroup" not in plan and out.count() == 1


def test_norm_expansion_only_where_it_is_as_good():
    rng = np.random.default_rng(9)
    X, Y = rng.standard_normal((40, 8)), rng.standard_normal((30, 8))
    for ker in (KernelSpec("gaussian", 0.7), KernelSpec("matern", 0.7), KernelSpec("laplace", 0.7)):
        for far in (0.0, 1.0, 1e3, 1e8):
            assert np.abs(ker.quick_block(X + far, Y + far) - ker.block(X + far, Y + far)).max() <= 1e-12
        assert ker.quick_block(X[:0], Y).shape == (0, 30)


@pytest.mark.parametrize("noise", [True, False])
def test_summaries_made_with_the_draws(spark, noise):
    rng = np.random.default_rng(6)
    P = rng.standard_normal((4, 3))
    ker = KernelSpec("gaussian", 1.5)
    L = np.linalg.cholesky(ker.block(P, P))
    df = spark.createDataFrame([(i, rng.standard_normal(3).tolist(), i % 2) for i in range(40)], "id long, features array<double>, y int").repartition(3)
    how = (ker, P, L, rng.standard_normal((16, 4)))
    draws = R.pivot_predict(df, *how, noise=noise)
    want = {r.id: r for r in R.summarize_draws(draws).collect()}
    for r in R.pivot_summary(df, *how, noise=noise).collect():
        assert np.allclose([r[c] for c in R.SUMMARY_OUT], [want[r.id][c] for c in R.SUMMARY_OUT], atol=1e-10)
    a = M.pell(draws.join(df.select("id", "y"), "id")).first()
    b = M.pell_of_draws(R.pivot_draw_likelihood(df, *how, noise=noise)).first()
    assert np.allclose(list(a), list(b))


def test_epochs_after_the_stop_do_not_count(spark):
    scores = [0.1, 0.5, 0.4, 0.3, 0.2, 0.9]
    df = spark.createDataFrame([("r", i + 1, s) for i, s in enumerate(scores)], "run string, epoch int, score double")
    r = M.best_epoch(df, patience=3).first()
    assert (r.best_epoch, r.best_score, r.stop_epoch, r.n_epochs) == (2, 0.5, 5, 6)


def test_a_cluster_without_a_shared_folder_is_refused(spark):
    class Conf(dict):
        def get(self, key, default=None):
            return default

    context = SimpleNamespace(master="yarn", getConf=lambda: Conf(), _jsc=SimpleNamespace(
        sc=lambda: SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isDefined=lambda: False))))
    with pytest.raises(ValueError):
        session.ensure_checkpoint_dir(SimpleNamespace(sparkContext=context, conf=Conf()))


def test_rank_sums_are_doubles(spark):
    df = spark.range(1).select(F.lit(4_000_000_000).alias("pos"), F.lit(4_000_000_000).alias("neg"), F.lit(4_000_000_000).alias("cum_pos"), F.lit(4_000_000_000).alias("cum_neg"))
    assert df.agg(*M.rank_sums()).first()["_a2"] == 1.6e19


# ---- folds and blocks ---------------------------------------------------------------------------

def test_tree_sum_folds_until_it_fits(spark):
    import pandas as pd
    from kernelspark.operators import partials

    def part(batches):
        n = sum(len(b) for b in batches)
        yield partials.emit(np.array([n, 2.0 * n]))

    df = spark.range(0, 100, 1, 70).mapInPandas(part, partials.SCHEMA)
    assert partials.tree_sum(df, 2).tolist() == partials.tree_sum(df, 2, direct_cells=2).tolist() == [100.0, 200.0]
    assert pd.notna(partials.tree_sum(df, 2, direct_cells=5)[0])


def test_cross_kernel_in_blocks(spark, monkeypatch):
    from kernelspark.operators import kernels as K

    rng = np.random.default_rng(7)
    X = rng.standard_normal((25, 2))
    df = spark.createDataFrame([(i, X[i].tolist()) for i in range(25)], "id long, features array<double>")
    ker = KernelSpec("gaussian", 1.0)
    whole = sorted(map(tuple, K.cross_kernel_long(df, df, ker).collect()))
    monkeypatch.setattr(K.grid, "GRID_CELLS", 12)
    cells = K.cross_kernel_long(df, df, ker)
    assert sorted(map(tuple, cells.collect())) == whole and len(whole) == 625
    small = cells._jdf.queryExecution().optimizedPlan().toString().count("\n")
    assert small == K.cross_kernel_long(df.limit(3), df, ker)._jdf.queryExecution().optimizedPlan().toString().count("\n")
    assert K.cross_kernel_long(df.limit(0), df, ker).collect() == []


def test_projection_and_moments(spark):
    from kernelspark.operators import prep

    rng = np.random.default_rng(8)
    X = 1e6 + rng.standard_normal((50, 4))
    df = spark.createDataFrame([(i, X[i].tolist()) for i in range(50)] + [(50, None)], "id long, features array<double>").repartition(3)
    got = prep.feature_moments(df).orderBy("dim").collect()
    assert np.allclose([r["mean"] for r in got], X.mean(0)) and np.allclose([r["std"] for r in got], X.std(0), rtol=1e-6)
    C, mean = rng.standard_normal((2, 4)), X.mean(0)
    rows = {r.id: r.projected for r in prep.pca_transform(df, C, mean).collect()}
    assert rows[50] is None and np.allclose([rows[i] for i in range(50)], (X - mean) @ C.T)
    assert prep.feature_moments(df.filter("id < 0")).collect() == []


def test_frobenius_of_all_pairs_is_the_matrix_norm(spark):
    from kernelspark.operators import lowrank as L

    rng = np.random.default_rng(9)
    X = rng.standard_normal((20, 2))
    df = spark.createDataFrame([(i, X[i].tolist()) for i in range(20)], "id long, features array<double>")
    ker = KernelSpec("gaussian", 1.0)
    fac = L.pivoted_cholesky(df, ker, 4, method="greedy")
    pairs = spark.createDataFrame([(i, j) for i in range(20) for j in range(20)], "i long, j long")
    f = {r.id: r.f for r in fac.factor_df().collect()}
    Fm = np.array([f[i] for i in range(20)])
    Km = ker.block(X, X)
    got = L.pair_frobenius(pairs, df, fac.factor_df(), ker).first()
    assert math.isclose(got.rel_frobenius, np.linalg.norm(Km - Fm @ Fm.T) / np.linalg.norm(Km), rel_tol=1e-9)


def test_shards_are_written_where_their_rows_are_read(spark, tmp_path):
    from kernelspark.sources import readers, sinks

    rows = spark.range(0, 30_000, 1, 3).select("id", F.when(F.col("id") % 3 == 0, "test").otherwise("train").alias("p"))
    written = sinks.write_shards(rows, str(tmp_path / "a"), "p")
    assert "Exchange" not in written._jdf.queryExecution().executedPlan().toString()
    for _ in range(2):      # a job that runs again leaves the same files
        assert sorted(r["rows"] for r in written.collect()) == [3333, 3333, 3334, 6666, 6667, 6667]
    got = readers.route_shards(spark, str(tmp_path / "a"), {"train-": "train", "test-": "test"}).collect()
    assert {(r.split, r.shards, r["rows"], r["columns"]) for r in got} == {("train", 3, 20_000, 1), ("test", 3, 10_000, 1)}


def test_weights_and_solves_read_a_stored_factor(spark):
    from kernelspark.operators import lowrank as L
    from kernelspark.operators import predict as R

    rng = np.random.default_rng(12)
    X = rng.standard_normal((30, 2))
    df = spark.createDataFrame([(i, X[i].tolist()) for i in range(30)], "id long, features array<double>").repartition(3)
    f = L.pivoted_cholesky(df, KernelSpec("gaussian", 1.0), 3).factor_df()
    Fm = {r.id: np.array(r.f) for r in f.collect()}
    M = np.array([Fm[i] for i in range(30)])
    nu = np.array([0.3, -0.2, 0.5])
    weights = R.option_a_weights(f, nu, 3)
    solved = L.woodbury_solve(f.withColumn("r", F.col("id").cast("double")), "r", nugget=0.1, k=3)
    for made, most in ((weights, 1), (solved, 0)):    # Python processes of a task
        assert len(re.findall(r"MapIn(?:Pandas|Arrow)|ArrowEvalPython", made._jdf.queryExecution().sparkPlan().toString())) == most
    want = M @ np.linalg.solve(M.T @ M, nu)
    assert np.allclose([r.alpha for r in weights.orderBy("id").collect()], want)
    want = np.linalg.solve(M @ M.T + 0.1 * np.eye(30), np.arange(30.0))
    assert np.allclose([r.solution for r in solved.orderBy("id").collect()], want)


def test_kernel_sums_read_a_block_where_it_lies(spark, monkeypatch):
    """Blocks of several Arrow batches give the same sums and are not put together."""
    import pyarrow as pa
    from kernelspark.operators import grid

    block = pa.table({"x": pa.array([[1.0, 2.0]] * 1300, pa.list_(pa.float64())), "w": pa.array(np.arange(1300.0))})
    block = pa.Table.from_batches(block.to_batches(max_chunksize=600))
    lies = {np.asarray(b.column(0).flatten()).__array_interface__["data"][0] for b in block.to_batches()}
    tiles = list(grid._tiles(block))
    assert [len(t["x"]) for t in tiles] == [512, 88, 512, 88, 100]
    assert lies <= {t["x"].__array_interface__["data"][0] for t in tiles}
    rng = np.random.default_rng(13)
    X, w = rng.standard_normal((70, 3)), rng.standard_normal(70)
    df = spark.createDataFrame([(i, X[i].tolist(), float(w[i])) for i in range(70)], "id long, features array<double>, w double")
    ker = KernelSpec("gaussian", 1.0)
    rows = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "8")
    try:
        got = {r.id: r.s for r in grid.weighted_sums(df, df, ker.quick_block, "w", "id", "features", "s").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    assert np.allclose([got[i] for i in range(70)], ker.block(X, X) @ w)
