"""Factor, solve, posterior and prediction queries small enough to write out in SQL.

Greedy pivots are unrolled round by round (SQL-k). Solves and eigenvalues use rank 2,
where closed forms exist; posterior draws are fixed vectors written as literals on both
sides. The operators are the ones that larger ranks use.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import rng
from ..functions.kernels import KernelSpec
from ..operators import lowrank as L
from ..operators import posterior as PO
from ..operators import predict as R
from ..sources import sinks as SK
from . import sql_lowrank as SL
from . import views as V
from .catalog import register
from .q_sources import scratch

BW = 1.0
K = 8
NUGGET = 0.1
TRAIN = f"id IN (SELECT id FROM ({V.EMB_SQL}) WHERE split = 'train')"
_NU = [[0.05 * rng.std_normal_py(f"nu{c}", j, 42) for j in range(64)] for c in range(3)]
NU2 = [0.7, -0.4]


def _factor(spark, sf, k):
    """Greedy factor over all embeddings: (id, f, residual) stored, and the pivots' K_PP."""
    fac = L.pivoted_cholesky(V.emb(spark, sf).select("id", "features"), KernelSpec("gaussian", BW), k, method="greedy")
    return fac


def _ctes(k, among="TRUE"):
    return SL.pivots_sql(V.EMB_SQL, k, "greedy", bandwidth=BW, among=among)[0]


def _sum(terms):
    return " + ".join(terms)


def _fs(k, fmt):
    return _sum(fmt.format(j=j) for j in range(1, k + 1))


# ---- L11, L13, L12 -------------------------------------------------------------------------------

_MATVEC_SQL = (f"WITH {_ctes(K)}, e AS ({V.EMB_SQL}), w AS (SELECT "
               + ", ".join(f"sum(f{j} * y) AS w{j}" for j in range(1, K + 1))
               + f" FROM s{K} JOIN e USING (id)) SELECT id, {_fs(K, 'f{j} * w{j}')} AS av FROM s{K}, w")


@register("matvec_greedy", _MATVEC_SQL, ("av",), ops=("L11",))
def q_matvec(spark, sf):
    """(F Fᵀ) y row by row, rank 8."""
    fac = _factor(spark, sf, K)
    y = V.emb(spark, sf).select("id", F.col("y").cast("double").alias("v"))
    return L.lowrank_matvec(fac.factor_df(), y).select("id", F.col("Av").alias("av"))


_SCALED_SQL = (f"WITH {_ctes(K)}, e AS ({V.EMB_SQL}), n AS (SELECT id, {_fs(K, 'f{j} * f{j}')} AS q, (klass + 1) / 10.0 AS s "
               f"FROM s{K} JOIN e USING (id)) SELECT id, q * s * s AS n_lowrank, q * s AS n_nystrom FROM n")


@register("scaled_greedy", _SCALED_SQL, ("n_lowrank", "n_nystrom"), ops=("L13",))
def q_scaled(spark, sf):
    """Squared row norms of the factor scaled by s (low-rank form) and by √s (Nyström form)."""
    f = _factor(spark, sf, K).factor_df()
    s = V.emb(spark, sf).select("id", ((F.col("klass") + 1) / 10.0).alias("s"))
    norm = F.aggregate("f", F.lit(0.0), lambda a, v: a + v * v)
    lr = L.scale_factor(f, s, mode="lowrank").select("id", norm.alias("n_lowrank"))
    return lr.join(L.scale_factor(f, s, mode="nystrom").select("id", norm.alias("n_nystrom")), "id")


_NYSTROM_SQL = f"WITH {_ctes(K)} SELECT id, {_fs(K, 'f{j} * f{j}')} AS sq_norm, greatest(1.0 - ({_fs(K, 'f{j} * f{j}')}), 0.0) AS residual FROM s{K}"


@register("nystrom_greedy", _NYSTROM_SQL, ("sq_norm", "residual"), ops=("L12",))
def q_nystrom(spark, sf):
    """Nyström rows from the pivots alone equal the factor's rows."""
    fac = _factor(spark, sf, K)
    P = np.array([p.x for p in fac.pivots])
    fr = L.factor_from_pivots(V.emb(spark, sf).select("id", "features"), fac.kernel, P, L.nystrom_chol(fac.kpp(), 1e-13))
    return fr.select("id", F.aggregate("f", F.lit(0.0), lambda a, v: a + v * v).alias("sq_norm"), "residual")


# ---- S10, Q14, Q15 -----------------------------------------------------------------------------------

_BUNDLE_SQL = (f"WITH {_ctes(K)}, piv AS (" + " UNION ALL ".join(
    f"SELECT {j} AS r, p.id, {', '.join(f's.f{i}' for i in range(1, K + 1))}, p.x FROM p{j} p JOIN s{K} s USING (id)" for j in range(1, K + 1)) + "), "
    f"c AS (SELECT abs(({_fs(K, 'a.f{j} * b.f{j}')}) - {SL.gaussian_sql('a.x', 'b.x', repr(BW))}) AS e FROM piv a, piv b) "
    f"SELECT (SELECT count(*) FROM s{K}) AS rows, CAST({K} AS BIGINT) AS pivots, CAST({K * K} AS BIGINT) AS core_cells, "
    f"(SELECT sum({_fs(K, 'f{j}')}) FROM s{K}) AS factor_sum, CAST((SELECT sum(id * r) FROM piv) AS BIGINT) AS pivot_sum, "
    "(SELECT max(e) FROM c) AS max_abs_err, (SELECT max(e) FROM c) <= 1e-3 AS consistent")


@register("bundle_greedy", _BUNDLE_SQL, ("factor_sum", "max_abs_err"), ops=("S10", "Q14", "Q15"))
def q_bundle(spark, sf):
    """A factor bundle written, read back, counted, and F_P F_Pᵀ held against K_PP."""
    path = scratch(spark, "bundle-greedy")
    fac = _factor(spark, sf, K)
    SK.write_factor_bundle(spark, path, "run-1", fac.factor_df().select("id", "f"),
                           fac.pivots_df(spark).select("rank", F.col("pivot_id").alias("id")), fac.kpp(),
                           {"k": fac.k, "n": fac.n, "rel_trace_error": fac.errors[-1]})
    b = SK.read_factor_bundle(spark, path, "run-1")
    total = b["factor"].agg(F.count(F.lit(1)).alias("rows"), F.sum(F.aggregate("f", F.lit(0.0), lambda a, v: a + v)).alias("factor_sum"))
    piv = b["pivots"].agg(F.count(F.lit(1)).alias("pivots"), F.sum(F.col("id") * F.col("rank")).alias("pivot_sum"))
    core = b["kpp"].agg(F.count(F.lit(1)).alias("core_cells"))
    fp = b["factor"].join(F.broadcast(b["pivots"]), "id").select("rank", "f")          # k rows
    pair = fp.select((F.col("rank") - 1).alias("i"), F.col("f").alias("a")).join(
        F.broadcast(fp.select((F.col("rank") - 1).alias("j"), F.col("f").alias("b"))), F.lit(True)).join(b["kpp"], ["i", "j"])
    err = pair.agg(F.max(F.abs(A.dot(F.col("a"), F.col("b")) - F.col("v"))).alias("max_abs_err"))
    return total.crossJoin(piv).crossJoin(core).crossJoin(err).withColumn("consistent", F.col("max_abs_err") <= 1e-3)   # one-row tables


# ---- rank 2: L14–L16, L19, M8, R2, R4 ---------------------------------------------------------------------

_G2 = (f"{_ctes(2)}, g AS (SELECT sum(f1 * f1) AS a, sum(f1 * f2) AS b, sum(f2 * f2) AS c FROM s2), "
       "ev AS (SELECT (a + c) / 2 AS m, sqrt((a - c) * (a - c) / 4 + b * b) AS r FROM g)")


@register("spectrum_rank2", f"WITH {_G2} SELECT CAST(1 AS INTEGER) AS idx, m + r AS eigenvalue FROM ev UNION ALL SELECT CAST(2 AS INTEGER), m - r FROM ev",
          ("eigenvalue",), ops=("L19", "L14"))
def q_spectrum2(spark, sf):
    s = L.spectrum(_factor(spark, sf, 2).factor_df(), k=2)
    return spark.createDataFrame([(i + 1, v) for i, v in enumerate(s)], "idx int, eigenvalue double")


def _ridge_sql(mu):
    """(F Fᵀ + μ I)⁻¹ y by the 2 × 2 inverse."""
    return (f"{_G2}, e AS ({V.EMB_SQL}), b AS (SELECT sum(f1 * y) AS u, sum(f2 * y) AS v FROM s2 JOIN e USING (id)), "
            f"c AS (SELECT ((c + {mu}) * u - b * v) / ((a + {mu}) * (c + {mu}) - b * b) AS c1, "
            f"((a + {mu}) * v - b * u) / ((a + {mu}) * (c + {mu}) - b * b) AS c2 FROM (SELECT g.a, g.b, g.c, b.u, b.v FROM g, b)), "
            f"w AS (SELECT id, (y - f1 * c1 - f2 * c2) / {mu} AS solution FROM s2 JOIN e USING (id), c)")


@register("ridge_rank2", f"WITH {_ridge_sql(NUGGET)} SELECT id, solution, solution AS by_eigen FROM w", ("solution", "by_eigen"), ops=("L16", "L14", "L15"))
def q_ridge2(spark, sf):
    """One system solved by the Woodbury form and by the eigendecomposition."""
    f = _factor(spark, sf, 2).factor_df()
    y = V.emb(spark, sf).select("id", F.col("y").cast("double").alias("rhs"))
    a = L.woodbury_solve(f.join(y, "id"), "rhs", nugget=NUGGET, k=2)
    vec, s, _ = L.eig_factor(f, k=2)
    return a.join(L.krr_solve(vec, s, y, "rhs", lam=NUGGET).withColumnRenamed("solution", "by_eigen"), "id")


_KT = SL.gaussian_sql("t.features", "r.features", repr(BW))


@register("nugget_rank2", f"WITH {_ridge_sql(NUGGET)} SELECT t.id AS id, sum({_KT} * w.solution) AS f_star FROM e t, e r JOIN w USING (id) "
          "WHERE t.split = 'test' GROUP BY t.id", ("f_star",), ops=("R4",))
def q_nugget2(spark, sf):
    """Kernel-weighted sums over all rows at every test row, weights from the rank-2 solve."""
    e = V.emb(spark, sf)
    f = _factor(spark, sf, 2).factor_df().join(e.select("id", F.col("y").cast("double").alias("rhs")), "id")
    w = L.woodbury_solve(f, "rhs", nugget=NUGGET, k=2).join(e.select("id", "features"), "id")
    return R.kernel_weighted_sum(w, e.filter("split = 'test'").select("id", "features"), KernelSpec("gaussian", BW), "solution")


_OPTION_A_SQL = (f"WITH {_G2}, e AS ({V.EMB_SQL}), c AS (SELECT (c * {NU2[0]} - b * {NU2[1]}) / (a * c - b * b) AS c1, "
                 f"(a * {NU2[1]} - b * {NU2[0]}) / (a * c - b * b) AS c2 FROM g), w AS (SELECT id, f1 * c1 + f2 * c2 AS alpha FROM s2, c) "
                 f"SELECT t.id AS id, sum({_KT} * w.alpha) AS f_star FROM e t, e r JOIN w USING (id) WHERE t.split = 'test' GROUP BY t.id")


@register("option_a_rank2", _OPTION_A_SQL, ("f_star",), ops=("R2",))
def q_option_a2(spark, sf):
    """α = Q R⁻ᵀ ν for a fixed ν, then K α at every test row."""
    e = V.emb(spark, sf)
    w = R.option_a_weights(_factor(spark, sf, 2).factor_df(), np.array(NU2), 2).join(e.select("id", "features"), "id")
    return R.kernel_weighted_sum(w, e.filter("split = 'test'").select("id", "features"), KernelSpec("gaussian", BW), "alpha")


def _newton_sql(steps=12):
    """Newton's method for the rank-2 mode, unrolled; the last round gives covariance and log posterior."""
    out = [_ctes(2), f"e AS ({V.EMB_SQL})", "tr AS (SELECT f1, f2, y FROM s2 JOIN e USING (id) WHERE split = 'train')", "n0 AS (SELECT CAST(0 AS DOUBLE) AS u, CAST(0 AS DOUBLE) AS v)"]
    for i in range(steps + 1):
        out.append(f"q{i} AS (SELECT f1, f2, y, u, v, 1 / (1 + exp(-(f1 * u + f2 * v))) AS p FROM tr, n{i})")
        out.append(f"h{i} AS (SELECT any_value(u) AS u, any_value(v) AS v, sum((y - p) * f1) - any_value(u) AS g1, sum((y - p) * f2) - any_value(v) AS g2, "
                   "1 + sum(p * (1 - p) * f1 * f1) AS a, sum(p * (1 - p) * f1 * f2) AS b, 1 + sum(p * (1 - p) * f2 * f2) AS c, "
                   f"sum(CASE WHEN y = 1 THEN ln(p) ELSE ln(1 - p) END) AS ll FROM q{i})")
        out.append(f"n{i + 1} AS (SELECT u + (c * g1 - b * g2) / (a * c - b * b) AS u, v + (a * g2 - b * g1) / (a * c - b * b) AS v FROM h{i})")
    last = f"h{steps}"
    return (f"WITH {', '.join(out)} SELECT CAST(0 AS INTEGER) AS dim, u AS nu_mode, c / (a * c - b * b) AS nu_var, ll - (u * u + v * v) / 2 AS logp FROM {last} "
            f"UNION ALL SELECT CAST(1 AS INTEGER), v, a / (a * c - b * b), ll - (u * u + v * v) / 2 FROM {last}")


@register("laplace_rank2", _newton_sql(), ("nu_mode", "nu_var", "logp"), ops=("M8",))
def q_laplace2(spark, sf):
    """Posterior mode, marginal variances and log posterior on the train rows."""
    e = V.emb(spark, sf).filter("split = 'train'").select("id", "y")
    nu, cov, logp, _ = PO.laplace(_factor(spark, sf, 2).factor_df().join(e, "id"))
    return spark.createDataFrame([(j, float(nu[j]), float(cov[j, j]), logp) for j in range(2)], "dim int, nu_mode double, nu_var double, logp double")


# ---- fixed draws: M10, R3, R6 ---------------------------------------------------------------------------------

def _nus_sql(k):
    return f"SELECT * FROM (VALUES {', '.join(f'({c}, [{chr(44).join(repr(float(v)) for v in row[:k])}])' for c, row in enumerate(_NU))}) t(draw, nu)"


_M10_SQL = (f"WITH e AS ({V.EMB_SQL}), v AS ({_nus_sql(64)}), z AS (SELECT e.id, {A.dot_sql('e.features', 'v.nu')} AS z FROM e, v) "
            "SELECT id, avg(1 / (1 + exp(-z))) AS p_mean FROM z GROUP BY id")


@register("posterior_mean_fixed", _M10_SQL, ("p_mean",), ops=("M10",))
def q_mean_fixed(spark, sf):
    """Mean probability of every row over three fixed draws, the embedding as the factor."""
    return PO.posterior_mean_probability(V.emb(spark, sf).select("id", F.col("features").alias("f")), np.array(_NU))


_R3_SQL = (f"WITH {_ctes(K, TRAIN)}, e AS ({V.EMB_SQL}), v AS ({_nus_sql(K)}), z AS (SELECT s.id, {_sum(f's.f{j} * v.nu[{j}]' for j in range(1, K + 1))} AS z "
           f"FROM s{K} s JOIN e ON e.id = s.id AND e.split = 'test', v) SELECT id, avg(1 / (1 + exp(-z))) AS prob_mean, var_samp(1 / (1 + exp(-z))) AS prob_variance, "
           "quantile_cont(z, 0.05) AS latent_q05, quantile_cont(z, 0.5) AS latent_q50, avg(z) AS latent_mean FROM z GROUP BY id")


@register("option_b_fixed", _R3_SQL, ("prob_mean", "prob_variance", "latent_q05", "latent_q50", "latent_mean"), ops=("R3", "R6", "L12"))
def q_option_b_fixed(spark, sf):
    """Noise-free pivot predictor at the test rows, pivots from the train rows, summarised over three fixed draws."""
    e = V.emb(spark, sf)
    ker = KernelSpec("gaussian", BW)
    fac = L.pivoted_cholesky(e.filter("split = 'train'").select("id", "features"), ker, K, method="greedy")
    P = np.array([p.x for p in fac.pivots])
    s = R.pivot_summary(e.filter("split = 'test'").select("id", "features"), ker, P, L.nystrom_chol(fac.kpp(), 1e-13), np.array(_NU)[:, :K], noise=False)
    return s.select("id", "prob_mean", "prob_variance", "latent_q05", "latent_q50", "latent_mean")


# ---- S14 ------------------------------------------------------------------------------------------------------------

_S14_SQL = (f"SELECT CAST(row_number() OVER (ORDER BY step) - 1 AS INTEGER) AS accepted_idx, CAST(step - 100 AS INTEGER) AS post_warmup_idx, "
            f"x AS logp, x / 2 AS nu_0 FROM ({V.CHAIN_SQL}) WHERE chain = 1 AND step >= 100 AND accepted")


@register("chain_tsv_events", _S14_SQL, ("logp", "nu_0"), ops=("S14",))
def q_chain_tsv(spark, sf):
    """Chain 1 of the events written as TSV and read back."""
    path = scratch(spark, "chain-events")
    c = V.chain(spark, sf).select("chain", "step", F.array(F.col("x") / 2).alias("nu"), F.col("x").alias("logp"), "accepted")
    k = SK.write_chain(c, path, warmup=100, chain_id=1)
    d = SK.read_chain(spark, path, k)
    return d.select(F.col("accepted_idx").cast("int").alias("accepted_idx"), F.col("post_warmup_idx").cast("int").alias("post_warmup_idx"), "logp", "nu_0")


# ---- K10, L10 over a pair table -----------------------------------------------------------------------------------

STEPS = (0, 1, 7, 50, 113)
_PAIRS_SQL = f"SELECT a.id AS i, a.id + s AS j FROM ({V.EMB_SQL}) a, (VALUES {', '.join(f'({s})' for s in STEPS)}) t(s)"


def _pairs(spark, sf):
    """Every row paired with the rows some ids further on."""
    return V.emb(spark, sf).select(F.col("id").alias("i"), F.explode(F.array(*[F.col("id") + s for s in STEPS])).alias("j"))


_K10_SQL = (f"WITH e AS ({V.EMB_SQL}) SELECT quantile_cont(sqrt({A.sqdist_sql('a.features', 'b.features')}), 0.5) AS bandwidth, count(*) AS n_pairs "
            f"FROM ({_PAIRS_SQL}) p JOIN e a ON a.id = p.i JOIN e b ON b.id = p.j")


@register("median_of_pairs", _K10_SQL, ("bandwidth",), ops=("K10",))
def q_median_pairs(spark, sf):
    from ..operators import kernels as KO
    return KO.median_of_pairs(_pairs(spark, sf), V.emb(spark, sf).select("id", "features"), KernelSpec("gaussian", BW))


_KP = SL.gaussian_sql("a.x", "b.x", repr(BW))
_GAP = f"(({_KP}) - ({_fs(K, 'a.f{j} * b.f{j}')}))"
_L10_SQL = (f"WITH {_ctes(K)} SELECT sqrt(sum({_GAP} * {_GAP}) / sum(({_KP}) * ({_KP}))) AS rel_frobenius, count(*) AS n_pairs "
            f"FROM ({_PAIRS_SQL}) p JOIN s{K} a ON a.id = p.i JOIN s{K} b ON b.id = p.j")


@register("frobenius_of_pairs", _L10_SQL, ("rel_frobenius",), ops=("L10",))
def q_frobenius_pairs(spark, sf):
    fac = _factor(spark, sf, K)
    return L.pair_frobenius(_pairs(spark, sf), V.emb(spark, sf).select("id", "features"), fac.factor_df(), fac.kernel)
