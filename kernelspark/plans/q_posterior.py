"""Named posterior, prediction and classifier queries (M*, R*, B5)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import rng
from ..functions.kernels import KernelSpec
from ..operators import lowrank as L
from ..operators import metrics as M
from ..operators import posterior as PO
from ..operators import predict as R
from ..session import checkpoint_table, ensure_checkpoint_dir
from . import views as V
from .catalog import register

N_NU = 3
NU_SCALE = 0.05


def _nus(k: int) -> np.ndarray:
    return np.array([[NU_SCALE * rng.std_normal_py(f"nu{c}", j, 42) for j in range(k)] for c in range(N_NU)])


def _nu_sql(k: int) -> str:
    vals = ", ".join(f"({c}, [{', '.join(repr(float(v)) for v in row)}])" for c, row in enumerate(_nus(k)))
    return f"SELECT * FROM (VALUES {vals}) t(chain, nu)"


_DIM = 64
_LP_SQL = (f"WITH e AS ({V.EMB_SQL}), v AS ({_nu_sql(_DIM)}), "
           "z AS (SELECT v.chain, e.y, list_sum(list_transform(list_zip(e.features, v.nu), lambda q: q[1] * q[2])) AS z "
           "FROM e, v), l AS (SELECT chain, sum(CASE WHEN y = 1 THEN -ln(1 + exp(-z)) ELSE -ln(1 + exp(z)) END) AS ll "
           "FROM z GROUP BY chain) SELECT CAST(chain AS INTEGER) AS chain, "
           "ll - 0.5 * list_sum(list_transform(nu, lambda a: a * a)) AS logp FROM l JOIN v USING (chain)")


@register("log_posterior", _LP_SQL, ("logp",), ops=("M1", "M3"))
def q_log_posterior(spark, sf):
    """Log posterior of 3 ν vectors in one pass, the embedding as the factor (k = 64)."""
    e = V.emb(spark, sf).select(F.col("features").alias("f"), "y")
    return PO.log_posterior(e, _nus(_DIM)).select("chain", "logp").distinct()


_GRAD_SQL = (f"WITH e AS ({V.EMB_SQL}), v AS ({_nu_sql(_DIM)}), "
             "z AS (SELECT v.chain, e.y, e.features, list_sum(list_transform(list_zip(e.features, v.nu), "
             "lambda q: q[1] * q[2])) AS z FROM e, v), "
             "u AS (SELECT chain, y - 1.0 / (1.0 + exp(-z)) AS r, unnest(features) AS fv, "
             "generate_subscripts(features, 1) AS j FROM z), "
             "g AS (SELECT chain, j, sum(r * fv) AS s FROM u GROUP BY chain, j) "
             "SELECT CAST(g.chain AS INTEGER) AS chain, CAST(j - 1 AS INTEGER) AS dim, s - v.nu[j] AS grad "
             "FROM g JOIN v USING (chain)")


@register("log_posterior_grad", _GRAD_SQL, ("grad",), ops=("M2",))
def q_grad(spark, sf):
    e = V.emb(spark, sf).select(F.col("features").alias("f"), "y")
    return PO.log_posterior(e, _nus(_DIM)).select("chain", "dim", "grad")


def _pipeline_factor(spark, sf, k=8):
    """Greedy pivots on the train split, Nyström factor rows for every embedding."""
    e = V.emb(spark, sf)
    pts = e.select("id", "features")
    ker = KernelSpec("gaussian", 1.0)
    fac = L.pivoted_cholesky(e.filter("split = 'train'").select("id", "features"), ker, k, method="greedy")
    Lc = np.linalg.cholesky(fac.kpp() + 1e-10 * np.trace(fac.kpp()) / k * np.eye(fac.k))
    Px = np.array([p.x for p in fac.pivots])
    fr = L.factor_from_pivots(pts, ker, Px, Lc).join(e.select("id", "y", "split"), "id")
    return fr, ker, Px, Lc


@register("laplace_posterior", None, ops=("M8",))
def q_laplace(spark, sf):
    fr, *_ = _pipeline_factor(spark, sf)
    nu, cov, logp, passes = PO.laplace(fr.filter("split = 'train'"))
    return spark.createDataFrame([(j, float(nu[j]), float(cov[j, j]), logp, passes) for j in range(len(nu))],
                                 "dim int, nu_mode double, nu_var double, logp double, passes int")


def _sampler(kind, spark, sf, **kw):
    """Run lengths are arguments: each step is a Spark pass, and these queries show the
    samplers at work rather than run an experiment (samplers.FULL_STEPS and its kin)."""
    fr, *_ = _pipeline_factor(spark, sf, k=6)
    ch = PO.run_sampler(fr.filter("split = 'train'"), kind, **kw)["chain"]
    return ch.groupBy("chain").agg(F.count(F.lit(1)).alias("steps"), F.avg(F.col("accepted").cast("double"))
                                   .alias("accept_rate"), F.max_by("logp", "step").alias("last_logp"))


@register("sampler_rwm", None, ops=("M4", "M9"))
def q_rwm(spark, sf):
    return _sampler("rwm", spark, sf, n_steps=100, n_warmup=100, n_chains=4, step_size=0.2)


#: Keyed walks for SQL: first dimensions as the factor, chains, warm-up and kept steps, first step sizes.
WALK_K, WALK_CHAINS, WALK_WARMUP, WALK_KEPT, WALK_SIZE, LANGEVIN_SIZE = 8, 3, 60, 40, 0.3, 0.9
_SEED, _NOISE_KEY = "42", "(c.chain || ':' || c.step)"
_ACCEPT = rng.u01_open_sql(_NOISE_KEY, "'accept'", _SEED)
_NORMAL = (f"sqrt(-2.0 * ln({rng.u01_open_sql(_NOISE_KEY, '2 * (j - 1)', _SEED)})) * "
           f"cos({2 * np.pi!r} * {rng.u01_sql(_NOISE_KEY, '2 * (j - 1) + 1', _SEED)})")


def _walk_sql(chains: int, target: float, first_size: float, langevin: bool = False) -> str:
    """One recursion a step: candidate from the keyed noise, its log posterior over all rows, verdict, step size."""
    dims = range(1, WALK_K + 1)

    def each(text: str) -> str:
        return "[" + ", ".join(text.replace("@", str(j)) for j in dims) + "]"

    z = "[" + ", ".join(_NORMAL.replace("(j - 1)", str(j)) for j in range(WALK_K)) + "]"
    slope = "sum((y - 1.0::DOUBLE / (1.0::DOUBLE + exp(-list_dot_product(f, {at})))) * f[@]) - {minus}"
    start = f"(SELECT {each('sum((y - 0.5::DOUBLE) * f[@])')} FROM e)" if langevin else "[0.0::DOUBLE]"
    drift = " + 0.5::DOUBLE * w.eps * w.eps * w.grad[@]" if langevin else ""
    slopes = each(slope.format(at="cand", minus="any_value(cand[@])")) if langevin else "[0.0::DOUBLE]"
    back = " + ".join(f"pow((nu[{j}] - cand[{j}]) / eps - 0.5::DOUBLE * eps * ngrad[{j}], 2)" for j in dims)
    ratio = f" + 0.5::DOUBLE * (list_dot_product(z, z) - ({back}))" if langevin else ""
    last = f"step < {WALK_WARMUP} AND (step + 1) % 50 = 0"
    off = f"(taken + yes::BIGINT) / 50.0::DOUBLE - {target}::DOUBLE"
    return f"""
WITH RECURSIVE e AS MATERIALIZED (SELECT features[1:{WALK_K}] AS f, y FROM ({V.EMB_SQL}) WHERE split = 'train'),
c AS MATERIALIZED (SELECT chain, step FROM range(0, {chains}) a(chain), range(0, {WALK_WARMUP + WALK_KEPT}) b(step)),
noise AS MATERIALIZED (SELECT c.chain, c.step, {z} AS z, ln({_ACCEPT}) AS lu FROM c),
w AS (
  SELECT CAST(chain AS BIGINT) AS chain, CAST(-1 AS BIGINT) AS step, [0.0::DOUBLE FOR i IN range(0, {WALK_K})] AS nu, {start} AS grad,
         (SELECT count(*) FROM e) * ln(0.5::DOUBLE) AS logp, false AS accepted, CAST(0 AS BIGINT) AS taken, {first_size!r}::DOUBLE AS eps, {first_size!r}::DOUBLE AS used
  FROM range(0, {chains}) r(chain)
  UNION ALL
  SELECT chain, step, CASE WHEN yes THEN cand ELSE nu END, CASE WHEN yes THEN ngrad ELSE grad END, CASE WHEN yes THEN new ELSE logp END, yes,
         CASE WHEN {last} THEN 0 ELSE taken + yes::BIGINT END,
         CASE WHEN {last} THEN eps * CASE WHEN {off} > 0.10::DOUBLE THEN 1.1::DOUBLE WHEN {off} < -0.10::DOUBLE THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END ELSE eps END, eps
  FROM (SELECT *, lu < least(new - logp{ratio}, 0.0::DOUBLE) AS yes FROM (
    SELECT chain, step, any_value(nu) AS nu, any_value(grad) AS grad, any_value(cand) AS cand, any_value(z) AS z, any_value(logp) AS logp,
           any_value(taken) AS taken, any_value(eps) AS eps, any_value(lu) AS lu, {slopes} AS ngrad,
           sum(-ln(1 + exp(CASE WHEN y = 1 THEN -1 ELSE 1 END * list_dot_product(f, cand)))) - 0.5 * any_value(list_dot_product(cand, cand)) AS new
    FROM (SELECT w.chain, n.step, w.nu, w.grad, w.logp, w.taken, w.eps, n.lu, n.z, {each(f'w.nu[@]{drift} + w.eps * n.z[@]')} AS cand
          FROM w JOIN noise n ON n.chain = w.chain AND n.step = w.step + 1), e
    GROUP BY chain, step)))
SELECT CAST(chain AS INTEGER) AS chain, CAST(step AS INTEGER) AS step, accepted, used AS step_size, logp, nu[1] AS nu_first, nu[{WALK_K}] AS nu_last
FROM w WHERE step >= 0
"""


_WALK_COLUMNS = ("step_size", "logp", "nu_first", "nu_last")


def _keyed_walk(spark, sf, kind: str, size: float = WALK_SIZE):
    e = V.emb(spark, sf).filter("split = 'train'").select(F.slice("features", 1, WALK_K).alias("f"), "y")
    out = PO.run_sampler(e, kind, n_steps=WALK_KEPT, n_warmup=WALK_WARMUP, n_chains=WALK_CHAINS, step_size=size, seed=42)
    return out["chain"].select("chain", "step", "accepted", "step_size", "logp",
                               F.element_at("nu", 1).alias("nu_first"), F.element_at("nu", WALK_K).alias("nu_last"))


@register("sampler_keyed_walk", _walk_sql(WALK_CHAINS, 0.3, WALK_SIZE), _WALK_COLUMNS, ops=("M4", "M9"))
def q_keyed_walk(spark, sf):
    """Every state of random walks with adapted steps; SQL takes one step a recursion, Spark three a pass."""
    return _keyed_walk(spark, sf, "rwm")


@register("sampler_keyed_langevin", _walk_sql(WALK_CHAINS, 0.57, LANGEVIN_SIZE, True), _WALK_COLUMNS, ops=("M5", "M9"))
def q_keyed_langevin(spark, sf):
    """The same along the gradient; each chain goes past its refusals at its own pace."""
    return _keyed_walk(spark, sf, "mala", LANGEVIN_SIZE)


@register("sampler_keyed_ensemble", _walk_sql(24, 0.3, WALK_SIZE), _WALK_COLUMNS, ops=("M7",))
def q_keyed_ensemble(spark, sf):
    """24 walkers (the count follows from the dimensions) with Gaussian moves."""
    return _keyed_walk(spark, sf, "ensemble")


@register("sampler_mala", None, ops=("M5",))
def q_mala(spark, sf):
    return _sampler("mala", spark, sf, n_steps=60, n_warmup=100, n_chains=4, step_size=0.1)


@register("sampler_hmc", None, ops=("M6",))
def q_hmc(spark, sf):
    return _sampler("hmc", spark, sf, n_steps=10, n_warmup=10, n_chains=2, step_size=0.1)


@register("sampler_ensemble", None, ops=("M7",))
def q_ensemble(spark, sf):
    return _sampler("ensemble", spark, sf, n_steps=60, n_warmup=50, step_size=0.2)


@register("sampler_ensemble_mala", None, ops=("M7",))
def q_ensemble_mala(spark, sf):
    return _sampler("ensemble_mala", spark, sf, n_steps=40, n_warmup=50, step_size=0.1)


@register("posterior_mean_probability", None, ops=("M10",))
def q_pmean(spark, sf):
    fr, *_ = _pipeline_factor(spark, sf)
    nu, cov, _, _ = PO.laplace(fr.filter("split = 'train'"))
    dr = PO.laplace_draws(nu, cov, 500)
    pm = PO.posterior_mean_probability(fr.filter("split = 'train'"), dr)
    return M.binary_report(pm.join(fr.select("id", "y"), "id"), "y", "p_mean")


def _predictive(spark, sf):
    """(test rows with labels, what the pivot predictor takes)."""
    e = V.emb(spark, sf)
    fr, ker, Px, Lc = _pipeline_factor(spark, sf)
    nu, cov, _, _ = PO.laplace(fr.filter("split = 'train'"))
    return e.filter("split = 'test'").select("id", "features", "y"), (ker, Px, Lc, PO.laplace_draws(nu, cov, 64))


@register("pivot_predictive", None, ops=("R1", "R6", "E8", "E16"))
def q_pivot_predict(spark, sf):
    t, how = _predictive(spark, sf)
    rep = M.binary_report(R.pivot_summary(t, *how).join(t.select("id", "y"), "id"), "y", "prob_mean")
    return rep.crossJoin(M.pell_of_draws(R.pivot_draw_likelihood(t, *how)))   # two one-row tables


@register("option_b_mean", None, ops=("R3",))
def q_option_b(spark, sf):
    t, how = _predictive(spark, sf)
    return R.pivot_summary(t, *how, noise=False).select("id", "prob_mean", "latent_mean", "latent_variance")


@register("option_a_mean", None, ops=("R2", "E22"))
def q_option_a(spark, sf):
    e = V.emb(spark, sf)
    fr, ker, Px, Lc = _pipeline_factor(spark, sf)
    train = fr.filter("split = 'train'")
    nu, cov, _, _ = PO.laplace(train)
    alpha = R.option_a_weights(train, nu, len(nu))
    tr = alpha.join(e.select("id", "features"), "id")
    fa = R.kernel_weighted_sum(tr, e.filter("split = 'test'").select("id", "features"), ker, "alpha")
    fb = fr.filter("split = 'test'").select("id", "f")
    fb = R.row_dots(fb, nu, "id", "f", "f_b")
    # stored: the comparison reads it several times, and the kernel sums are the work
    j = checkpoint_table(fa.join(fb, "id").join(e.select("id", "y"), "id"), spark, "option-a")
    a = j.select("id", "y", F.expr("1 / (1 + exp(-f_star))").alias("p"))
    b = j.select("id", "y", F.expr("1 / (1 + exp(-f_b))").alias("p"))
    return M.method_pair(a, b)


@register("nugget_mean", None, ops=("R4", "L16"))
def q_nugget(spark, sf):
    e = V.emb(spark, sf)
    fr, ker, Px, Lc = _pipeline_factor(spark, sf)
    train = fr.filter("split = 'train'")
    nu, cov, _, _ = PO.laplace(train)
    t = train.join(R.row_dots(train, nu, "id", "f", "flat"), "id")
    w = L.woodbury_solve(t, "flat", nugget=0.1, k=len(nu))
    tr = w.join(e.select("id", "features"), "id")
    return R.kernel_weighted_sum(tr, e.filter("split = 'test'").select("id", "features"), ker, "solution")


@register("linear_probe", None, ops=("R7",))
def q_linear(spark, sf):
    e = V.emb(spark, sf)
    mdl = R.fit_linear_probe(e.filter("split = 'train'"), "y", reg=0.01)
    return M.binary_report(R.score_model(mdl, e.filter("split = 'test'")), "y", "p")


@register("mlp_classifier", None, ops=("R8",))
def q_mlp(spark, sf):
    e = V.emb(spark, sf)
    mdl = R.fit_mlp(e.filter("split = 'train'"), "y", hidden=(16,), max_iter=30)
    return M.binary_report(R.score_model(mdl, e.filter("split = 'test'")), "y", "p")


@register("chunked_scoring", None, ops=("R9", "U1"))
def q_chunked(spark, sf):
    e = V.emb(spark, sf)
    mdl = R.fit_linear_probe(e.filter("split = 'train'"), "y", reg=0.01)
    w = mdl.coefficients.toArray()
    obj = R.NumpyLogistic(w, mdl.intercept)
    s = R.score_chunked(e.filter("split = 'test'"), obj, batch_rows=64)
    return M.binary_report(s.join(e.select("id", "y"), "id"), "y", "p")


@register("model_selection", None, ops=("R10", "E26"))
def q_select(spark, sf):
    import uuid
    e = V.emb(spark, sf)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/models/{uuid.uuid4().hex[:10]}"
    grid = [{"kind": "linear", "reg": 0.1}, {"kind": "linear", "reg": 0.001}, {"kind": "mlp", "hidden": [8]}]
    mdl, params, scores = R.select_best(e.filter("split = 'train'"), e.filter("split = 'valid'"), grid, path)
    rep = M.binary_report(R.score_model(mdl, e.filter("split = 'test'")), "y", "p")
    return rep.withColumn("best_params", F.lit(str(params)))


@register("float_precision", None, ops=("B5",))
def q_precision(spark, sf):
    """log posterior with float32 vs float64 factor rows: mean / max abs difference over ν batch."""
    e = V.emb(spark, sf).select(F.col("features").alias("f"), "y")
    V64 = _nus(_DIM)
    a = PO.FactorModel(e, cache=False).score(V64, grad=False)[0]
    b = PO.FactorModel(e, cache=False, dtype="float").score(V64, grad=False)[0]
    d = np.abs(a - b)
    return spark.createDataFrame([(float(d.mean()), float(d.max()), N_NU)],
                                 "mean_abs_diff double, max_abs_diff double, n_nu int")


@register("joint_predictive", None, ops=("R5", "L3"))
def q_joint(spark, sf):
    """Joint draws over the test rows; summary per row plus the report of the mean probability."""
    e = V.emb(spark, sf)
    fr, ker, Px, Lc = _pipeline_factor(spark, sf)
    nu, cov, _, _ = PO.laplace(fr.filter("split = 'train'"))
    d = R.joint_predictive_draws(e.filter("split = 'test'").select("id", "features"), ker, Px, Lc, nu, cov,
                                 n_draws=32, rank=16, b=8)
    s = R.summarize_draws(d)
    return M.binary_report(s.join(e.select("id", "y"), "id"), "y", "prob_mean")


@register("log_posterior_probit", None, ops=("M1", "M2", "M3"))
def q_probit(spark, sf):
    """Probit-link log posterior and gradient norm for 3 ν vectors (stable log Φ, no scipy)."""
    e = V.emb(spark, sf).select(F.col("features").alias("f"), "y")
    lp = PO.log_posterior(e, _nus(_DIM), link="probit")
    return lp.groupBy("chain").agg(F.first("logp").alias("logp"), F.sqrt(F.sum(F.col("grad") * F.col("grad")))
                                   .alias("grad_norm"))


@register("sampler_custom_proposal", None, ops=("U1", "M4"))
def q_custom_proposal(spark, sf):
    """Metropolis with a caller-supplied proposal: an independence move from N(0, 0.25 I) whose log ratio is returned."""
    def independent(nu, eps, rng):
        new = 0.5 * rng.standard_normal(nu.shape)
        return new, 2.0 * ((new * new).sum(1) - (nu * nu).sum(1))
    return _sampler("rwm", spark, sf, n_steps=100, n_warmup=20, n_chains=4, proposal=independent)


@register("link_functions", None, ops=("M3",))
def q_links(spark, sf):
    """Sigmoid (JVM expression) and probit Φ (vectorised pandas UDF) on every latent draw."""
    d = V.draws(spark, sf)
    lat = F.col("latent")
    sig = F.lit(1.0) / (F.lit(1.0) + F.exp(-lat))
    return d.groupBy("draw").agg(F.avg(sig).alias("mean_sigmoid"), F.avg(R.norm_cdf_col(lat)).alias("mean_probit"),
                                 F.max(F.abs(sig - F.col("p"))).alias("max_sigmoid_err"))
