"""Named kernel and low-rank queries (K*, L*) over the embeddings table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions.kernels import KernelSpec
from ..operators import kernels as K
from ..operators import lowrank as L
from . import sql_lowrank as SL
from . import views as V
from .catalog import register

FLAGSHIP_K = 8
SQLK = 5           # rounds unrolled in oracle text


def _points(spark, sf):
    return V.emb(spark, sf).select("id", "features")


def _bw(spark, sf) -> float:
    return K.bandwidth_value(_points(spark, sf), KernelSpec("gaussian"))


def _factor(spark, sf, k, rule, seed=42):
    pts = _points(spark, sf)
    ker = KernelSpec("gaussian", _bw(spark, sf))
    if rule in ("greedy", "rp"):
        return L.pivoted_cholesky(pts, ker, k, method=rule, seed=seed)
    if rule == "uniform":
        return L.uniform_cholesky(pts, ker, k, seed=seed)
    return L.accelerated_cholesky(pts, ker, k, b=4, seed=seed, mode=rule)


# ---------------------------------------------------------------- K10/K11 ------

@register("median_bandwidth", SL.median_bw_sql(V.EMB_SQL), ("bw",), ops=("K11", "K10", "P1"))
def q_median_bandwidth(spark, sf):
    """Median heuristic on ≤1000 keyed-random rows, all ordered pairs incl. the diagonal."""
    r = K.approx_median_bandwidth(_points(spark, sf), KernelSpec("gaussian"))
    return r.select(F.col("bandwidth").alias("bw"), "n_pairs")


_LAPLACE_BW_SQL = SL.median_bw_sql(V.EMB_SQL, metric="l1")


@register("median_bandwidth_l1", _LAPLACE_BW_SQL, ("bw",), ops=("K11",))
def q_median_bandwidth_l1(spark, sf):
    r = K.approx_median_bandwidth(_points(spark, sf), KernelSpec("laplace"))
    return r.select(F.col("bandwidth").alias("bw"), "n_pairs")


# ---------------------------------------------------------------- K1–K5, K13, K14 --

def _aligned_sql():
    e = V.EMB_SQL
    a, b = "a.features", "b.features"
    sq = A.sqdist_sql(a, b)
    l1 = A.l1dist_sql(a, b)
    r = f"(sqrt({sq}) / 2.0)"
    exp_sq = f"greatest({A.norm2_sql(a)} + {A.norm2_sql(b)} - 2.0 * {A.dot_sql(a, b)}, 0.0)"
    return (f"SELECT a.id AS id, exp(-0.5 * {sq} / (2.0 * 2.0)) AS k_gauss, exp(-{l1} / 2.0) AS k_laplace, "
            f"exp(-{r}) AS k_m12, (1 + sqrt(3.0) * {r}) * exp(-sqrt(3.0) * {r}) AS k_m32, "
            f"(1 + sqrt(5.0) * {r} + 5.0 / 3.0 * {r} * {r}) * exp(-sqrt(5.0) * {r}) AS k_m52, "
            f"exp(-0.5 * {exp_sq} / (2.0 * 2.0)) AS k_gauss_expanded "
            f"FROM ({e}) a JOIN ({e}) b ON b.id = a.id + 1")


@register("aligned_kernels", _aligned_sql(), ("k_gauss", "k_laplace", "k_m12", "k_m32", "k_m52", "k_gauss_expanded"),
          ops=("K1", "K2", "K3", "K5", "K13", "K14"))
def q_aligned_kernels(spark, sf):
    """Every row paired with the next id: Gaussian, Laplace, Matérn ½/3⁄2/5⁄2, norm-expansion Gaussian."""
    e = _points(spark, sf)
    left = e.select("id", F.col("features").alias("a"))
    right = e.select((F.col("id") - 1).alias("id"), F.col("features").alias("b"))
    j = left.join(right, "id")
    out = [F.col("id")]
    for name, ks in (("k_gauss", KernelSpec("gaussian", 2.0)), ("k_laplace", KernelSpec("laplace", 2.0)),
                     ("k_m12", KernelSpec("matern", 2.0, 0.5)), ("k_m32", KernelSpec("matern", 2.0, 1.5)),
                     ("k_m52", KernelSpec("matern", 2.0, 2.5)),
                     ("k_gauss_expanded", KernelSpec("gaussian", 2.0, stable=False))):
        out.append(ks.point("a", "b").alias(name))
    return j.select(*out)


# ---------------------------------------------------------------- K6–K9 ---------

def _centers_sql(m=8, seed=42):
    return SL.sample_sql(V.EMB_SQL, m, seed)


_BLOCK_SQL = (f"SELECT e.id AS id, c.id AS center_id, exp(-0.5 * {A.sqdist_sql('e.features', 'c.features')} / (1.5 * 1.5)) AS k "
              f"FROM ({V.EMB_SQL}) e, ({_centers_sql()}) c")


@register("kernel_block", _BLOCK_SQL, ("k",), ops=("K6", "K8", "P1"))
def q_kernel_block(spark, sf):
    """Every row against 8 keyed-random centers (broadcast, Arrow BLAS), exploded to long form."""
    from ..operators import prep
    pts = _points(spark, sf)
    chosen = prep.subsample(pts, 8).select("id")
    ids = [r["id"] for r in chosen.orderBy("id").collect()]   # 8 ids
    blk = K.out_of_sample(pts, pts, chosen, KernelSpec("gaussian", 1.5))   # K8 → K6 block
    ex = blk.select("id", F.posexplode("k").alias("j", "k"))
    id_arr = F.array(*[F.lit(int(i)) for i in ids])
    return ex.select("id", F.element_at(id_arr, F.col("j") + 1).cast("long").alias("center_id"), "k")


_TRACE_SQL = (f"SELECT split, sum(exp(-0.5 * {A.sqdist_sql('features', 'features')})) AS trace, count(*) AS n "
              f"FROM ({V.EMB_SQL}) GROUP BY split")


@register("kernel_trace", _TRACE_SQL, ("trace",), ops=("K9",))
def q_kernel_trace(spark, sf):
    e = V.emb(spark, sf)
    d = K.diagonal(e.select("id", "split", "features"), KernelSpec("gaussian"))
    return d.join(e.select("id", "split"), "id").groupBy("split").agg(F.sum("diag").alias("trace"),
                                                                      F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- L5, L1, L6 (SQL-k) ---

@register("greedy_pivots", SL.error_by_rank_sql(V.EMB_SQL, FLAGSHIP_K, "greedy"), ("rel_trace_error",),
          ops=("L5", "L7", "L8", "L9", "K11", "K12"))
def q_greedy_pivots(spark, sf):
    """Flagship: greedy pivoted Cholesky, rank 8, approximate-median bandwidth."""
    fac = _factor(spark, sf, FLAGSHIP_K, "greedy")
    fac.close()
    return L.error_by_rank(fac).select("rank", "pivot_id", "rel_trace_error")


@register("rp_pivots", SL.error_by_rank_sql(V.EMB_SQL, SQLK, "rp"), ("rel_trace_error",), ops=("L1", "L20"))
def q_rp_pivots(spark, sf):
    """Randomly pivoted Cholesky: one Gumbel-max draw ∝ residual per round."""
    fac = _factor(spark, sf, SQLK, "rp")
    fac.close()
    return L.error_by_rank(fac).select("rank", "pivot_id", "rel_trace_error")


@register("uniform_pivots", SL.error_by_rank_sql(V.EMB_SQL, SQLK, "uniform"), ("rel_trace_error",), ops=("L6",))
def q_uniform_pivots(spark, sf):
    fac = _factor(spark, sf, SQLK, "uniform")
    fac.close()
    return L.error_by_rank(fac).select("rank", "pivot_id", "rel_trace_error")


@register("rank_sweep", SL.error_by_rank_sql(V.EMB_SQL, SQLK, "greedy", with_queries=True), ("rel_trace_error",),
          ops=("L21", "L9", "K15"))
def q_rank_sweep(spark, sf):
    """One max-k factor read at every prefix rank, with the kernel-entry count."""
    fac = _factor(spark, sf, SQLK, "greedy")
    fac.close()
    return L.error_by_rank(fac).select("rank", "pivot_id", "rel_trace_error",
                                       K.kernel_queries(F.lit(fac.n), F.col("rank") + 0).alias("kernel_queries"))


@register("pivot_kpp", SL.kpp_sql(V.EMB_SQL, SQLK, "greedy"), ("v",), ops=("K12", "Q15"))
def q_pivot_kpp(spark, sf):
    """K_PP of the greedy pivots, long form, symmetrised."""
    fac = _factor(spark, sf, SQLK, "greedy")
    piv = fac.pivots_df(spark).select("rank", F.col("pivot_id").alias("id"), "features")
    fac.close()
    return K.pivot_submatrix(piv, fac.kernel, key="id", rank="rank")


# ---------------------------------------------------------------- L2, L3 (rows) --

@register("accelerated_pivots", None, ops=("L3", "L4", "L20", "L7"))
def q_accelerated(spark, sf):
    fac = _factor(spark, sf, 32, "accelerated")
    fac.close()
    return L.error_by_rank(fac).select("rank", "pivot_id", "rel_trace_error")


@register("block_pivots", None, ops=("L2",))
def q_block(spark, sf):
    fac = _factor(spark, sf, 32, "block")
    fac.close()
    return L.error_by_rank(fac).select("rank", "pivot_id", "rel_trace_error")


@register("factor_stats", None, ops=("L8", "K15", "L21"))
def q_factor_stats(spark, sf):
    fac = _factor(spark, sf, 16, "accelerated")
    fac.close()
    return L.factor_stats(fac, spark)


# ---------------------------------------------------------------- L11–L19 (rows) --

@register("spectrum", None, ops=("L19", "L14"))
def q_spectrum(spark, sf):
    fac = _factor(spark, sf, 16, "greedy")
    s = L.spectrum(fac.factor_df(), k=fac.k)
    fac.close()
    return spark.createDataFrame([(i + 1, v) for i, v in enumerate(s)], "idx int, eigenvalue double")


@register("woodbury_solve", None, ops=("L16", "L11"))
def q_woodbury(spark, sf):
    fac = _factor(spark, sf, 16, "greedy")
    e = V.emb(spark, sf).select("id", F.col("y").cast("double").alias("rhs"))
    f = fac.factor_df().join(e, "id")
    return L.woodbury_solve(f, "rhs", nugget=0.1, k=fac.k)


@register("krr_eig_solve", None, ops=("L14", "L15"))
def q_krr_eig(spark, sf):
    fac = _factor(spark, sf, 16, "greedy")
    V_, s, r = L.eig_factor(fac.factor_df(), k=fac.k)
    rhs = V.emb(spark, sf).select("id", F.col("y").cast("double").alias("b"))
    return L.krr_solve(V_, s, rhs, "b", lam=0.1)


@register("nystrom_krr", None, ops=("L17", "L18", "L12"))
def q_nystrom_krr(spark, sf):
    """Nyström KRR on the train split, landmarks by greedy pivots, predictions on test."""
    e = V.emb(spark, sf)
    ker = KernelSpec("gaussian", _bw(spark, sf))
    train = e.filter("split = 'train'").withColumn("target", F.col("klass").cast("double"))
    lm = L.choose_landmarks(train.select("id", "features"), 16, "greedy", ker)
    beta = L.nystrom_krr_fit(train, ker, lm, lam=1e-3)
    pred = L.nystrom_krr_predict(e.filter("split = 'test'"), ker, lm, beta)
    from ..operators import metrics as M
    j = pred.join(e.select("id", F.col("klass").cast("double").alias("target")), "id")
    terr = L.landmark_trace_error(train.select("id", "features"), ker, lm)
    return M.regression_metrics(j, "target", "prediction").withColumn("trace_error", F.lit(terr))


@register("nystrom_factor", None, ops=("L12", "L13"))
def q_nystrom_factor(spark, sf):
    """Pivot-based (Nyström) factor rows for every embedding; residual per split."""
    fac = _factor(spark, sf, 12, "greedy")
    Lc = L.nystrom_chol(fac.kpp())
    Px = np.array([p.x for p in fac.pivots])
    e = V.emb(spark, sf)
    fr = L.factor_from_pivots(e.select("id", "features"), fac.kernel, Px, Lc)
    return fr.join(e.select("id", "split"), "id").groupBy("split").agg(
        F.avg("residual").alias("mean_residual"), F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- K4, K16 ---------

@register("matern_general", None, ops=("K4",))
def q_matern_general(spark, sf):
    """General-ν Matérn (ν = 1) on aligned pairs through a vectorised pandas UDF,
    next to the closed form at ν = 3⁄2 and its general-ν evaluation (they must agree)."""
    e = _points(spark, sf)
    j = e.select("id", F.col("features").alias("a")).join(
        e.select((F.col("id") - 1).alias("id"), F.col("features").alias("b")), "id")
    k1 = KernelSpec("matern", 2.0, 1.0).point("a", "b")
    k15 = KernelSpec("matern", 2.0, 1.5).point("a", "b")
    k15g = KernelSpec("matern", 2.0, 1.5 + 1e-9).point("a", "b")
    return j.select("id", k1.alias("k_nu1"), k15.alias("k_nu15_closed"), k15g.alias("k_nu15_general"))


_R72 = f"(sqrt(7.0) * sqrt({A.sqdist_sql('a.features', 'b.features')}) / 2.0)"


@register("matern_half_integer", f"SELECT id, (1 + s + 0.4 * s * s + s * s * s / 15.0) * exp(-s) AS k_m72 FROM (SELECT a.id AS id, {_R72} AS s "
          f"FROM ({V.EMB_SQL}) a JOIN ({V.EMB_SQL}) b ON b.id = a.id + 1)", ("k_m72",), ops=("K4",))
def q_matern_half_integer(spark, sf):
    """Matérn ν = 7⁄2 on aligned pairs by the general form (series and continued fraction); SQL has the closed form."""
    e = _points(spark, sf)
    j = e.select("id", F.col("features").alias("a")).join(e.select((F.col("id") - 1).alias("id"), F.col("features").alias("b")), "id")
    return j.select("id", KernelSpec("matern", 2.0, 3.5).point("a", "b").alias("k_m72"))


_USER_SQL = (f"SELECT a.id AS id, {A.dot_sql('a.features', 'b.features')} AS k_linear, "
             f"pow(1.0 + {A.dot_sql('a.features', 'b.features')}, 2) AS k_poly2 "
             f"FROM ({V.EMB_SQL}) a JOIN ({V.EMB_SQL}) b ON b.id = a.id + 1")


@register("user_kernel", _USER_SQL, ("k_linear", "k_poly2"), ops=("K16", "U1"))
def q_user_kernel(spark, sf):
    """Caller-supplied kernels (a Column function + a NumPy block): linear and degree-2 polynomial."""
    lin = K.UserKernel(A.dot, lambda X, Y: X @ Y.T, name="linear")
    poly = K.UserKernel(lambda a, b: F.pow(F.lit(1.0) + A.dot(a, b), 2), lambda X, Y: (1 + X @ Y.T) ** 2, "poly2")
    e = _points(spark, sf)
    nxt = e.select((F.col("id") - 1).alias("id"), "features")     # row i paired with row i + 1 (K5)
    a = K.aligned_kernel(e, nxt, lin).withColumnRenamed("k", "k_linear")
    b = K.aligned_kernel(e, nxt, poly).withColumnRenamed("k", "k_poly2")
    return a.join(b, "id")


_CROSS_SQL = (f"SELECT e.id AS i, c.id AS j, exp(-0.5 * {A.sqdist_sql('e.features', 'c.features')} / (1.5 * 1.5)) AS k "
              f"FROM (SELECT * FROM ({V.EMB_SQL}) WHERE split = 'test') e, ({_centers_sql()}) c")


@register("cross_kernel_long", _CROSS_SQL, ("k",), ops=("K7",))
def q_cross_long(spark, sf):
    """Test rows × 8 keyed-random centers in long form (the centers side is size-checked, broadcast)."""
    from ..operators import prep
    e = V.emb(spark, sf)
    centers = prep.subsample(e.select("id", "features"), 8)
    return K.cross_kernel_long(e.filter("split = 'test'").select("id", "features"), centers,
                               KernelSpec("gaussian", 1.5))


@register("lowrank_matvec", None, ops=("L11",))
def q_matvec(spark, sf):
    """(F Fᵀ) y with one Fᵀy aggregate and a per-row dot; summed per split."""
    fac = _factor(spark, sf, 16, "greedy")
    e = V.emb(spark, sf)
    av = L.lowrank_matvec(fac.factor_df(), e.select("id", F.col("y").cast("double").alias("v")))
    return av.join(e.select("id", "split"), "id").groupBy("split").agg(F.sum("Av").alias("sum_Av"),
                                                                      F.count(F.lit(1)).alias("n"))


@register("scaled_factor", None, ops=("L13",))
def q_scaled(spark, sf):
    """Row scaling of a factor by s = (1 + class) / 10 (low-rank form G·s and Nyström form √s)."""
    fac = _factor(spark, sf, 12, "greedy")
    e = V.emb(spark, sf)
    sc = e.select("id", ((F.col("klass") + 1) / 10.0).alias("s"))
    norm = F.aggregate("f", F.lit(0.0), lambda a, v: a + v * v)
    lr = L.scale_factor(fac.factor_df(), sc, mode="lowrank").select("id", norm.alias("n_lowrank"))
    ny = L.scale_factor(fac.factor_df(), sc, mode="nystrom").select("id", norm.alias("n_nystrom"))
    return lr.join(ny, "id").join(e.select("id", "split"), "id").groupBy("split").agg(
        F.avg("n_lowrank").alias("mean_sq_norm_lowrank"), F.avg("n_nystrom").alias("mean_sq_norm_nystrom"))
