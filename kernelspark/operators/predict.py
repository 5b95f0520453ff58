"""Predictive distributions: summaries of draws (R6) and pivot-based prediction.

The heavy parts run per row on executors: rows meet only k-sized broadcast
state (pivot features, a k×k Cholesky factor, a k-vector or a batch of
k-vectors). Nothing N-sized reaches the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rng import keyed_normal_np
from . import grid
from .partials import bounded_broadcast

SUMMARY_OUT = [f"{pre}_{s}" for pre in ("prob", "latent")
               for s in ("mean", "variance", "std", "q05", "q50", "q95", "central_90_width")]


def summarize_draws(draws: DataFrame, key="id", p="p", latent="latent") -> DataFrame:
    """Per-row mean, sample variance/std (ddof 1), q05/q50/q95 and 90 % width.

    One shuffle on ``key``; each group holds one row's draws (the draw count
    is a run parameter, not data-sized), so exact percentiles are bounded.
    """
    aggs = []
    for v, pre in ((p, "prob"), (latent, "latent")):
        c = F.col(v).cast("double")
        q = F.percentile(c, [0.05, 0.5, 0.95])
        aggs += [F.avg(c).alias(f"{pre}_mean"), F.var_samp(c).alias(f"{pre}_variance"),
                 F.stddev_samp(c).alias(f"{pre}_std"), q.alias(f"_{pre}_q")]
    a = draws.groupBy(key).agg(*aggs)
    out = [F.col(key)]
    for pre in ("prob", "latent"):
        qa = F.col(f"_{pre}_q")
        out += [F.col(f"{pre}_mean"), F.col(f"{pre}_variance"), F.col(f"{pre}_std"),
                qa[0].alias(f"{pre}_q05"), qa[1].alias(f"{pre}_q50"), qa[2].alias(f"{pre}_q95"),
                (qa[2] - qa[0]).alias(f"{pre}_central_90_width")]
    return a.select(*out)


# ---- probit helpers (no scipy) -----------------------------------------------------

def norm_cdf_np(x: np.ndarray) -> np.ndarray:
    from .posterior import erfc
    return 0.5 * erfc(-np.asarray(x, dtype=np.float64) / np.sqrt(2.0))


def norm_cdf_col(x):
    """Φ(x) as a Column via a vectorised pandas UDF."""
    @F.pandas_udf("double")
    def _phi(s: pd.Series) -> pd.Series:
        return pd.Series(norm_cdf_np(s.to_numpy(dtype=np.float64)))

    return _phi(x)


# ---- R1, R3: pivot (inducing-point) predictor ------------------------------------------

def _sigmoid(z):
    return 0.5 * (1.0 + np.tanh(0.5 * z))


def _latent(points: DataFrame, kernel, pivot_x, L, nu_draws, noise: bool, seed: int, var_floor: float):
    """Function of a pandas batch (id, x) → latent draws (rows × S); pivots, Cholesky factor and draws are broadcast."""
    sc = points.sparkSession.sparkContext
    bP = bounded_broadcast(sc, pivot_x, "pivots")
    bL = bounded_broadcast(sc, L, "pivot Cholesky")
    bV = bounded_broadcast(sc, nu_draws, "posterior draws")

    def latent(pdf):
        X = np.stack(pdf["x"].to_numpy())
        Fm = np.linalg.solve(bL.value, kernel.block(X, bP.value).T).T
        lat = Fm @ bV.value.T                                       # n_b × S
        if noise:
            var = np.maximum(kernel.diag_np(X) - (Fm * Fm).sum(1), var_floor)
            lat = lat + np.sqrt(var)[:, None] * keyed_normal_np(pdf["id"].to_numpy(), lat.shape[1], seed)
        return lat

    return latent


def pivot_predict(points: DataFrame, kernel, pivot_x: np.ndarray, L: np.ndarray, nu_draws: np.ndarray,
                  key: str = "id", features: str = "features", noise: bool = True, seed: int = 42,
                  var_floor: float = 1e-8) -> DataFrame:
    """R1 (noise=True) / R3 (noise=False): predictive draws at every row.

    F(x) = L⁻¹ k(P, x); latent_s = F(x)·ν_s (+ √var·ε_s with var = k(x,x) − ‖F(x)‖²
    clipped at var_floor, ε keyed by (seed, id, draw)); p_s = σ(latent_s). Output is long
    ``(id, draw, latent, p)``; summaries and likelihoods don't need it
    (``pivot_summary``, ``pivot_draw_likelihood``).
    """
    latent = _latent(points, kernel, pivot_x, L, nu_draws, noise, seed, var_floor)

    def fn(batches):
        for pdf in batches:
            if len(pdf) == 0:
                continue
            lat = latent(pdf)
            S = lat.shape[1]
            yield pd.DataFrame({"id": np.repeat(pdf["id"].to_numpy().astype(np.int64), S),
                                "draw": np.tile(np.arange(S, dtype=np.int32), len(pdf)),
                                "latent": lat.ravel(), "p": _sigmoid(lat.ravel())})

    src = points.select(F.col(key).cast("long").alias("id"), F.col(features).cast("array<double>").alias("x"))
    return src.mapInPandas(fn, "id long, draw int, latent double, p double")


def pivot_summary(points: DataFrame, kernel, pivot_x: np.ndarray, L: np.ndarray, nu_draws: np.ndarray,
                  key: str = "id", features: str = "features", noise: bool = True, seed: int = 42,
                  var_floor: float = 1e-8) -> DataFrame:
    """R1/R3 + R6: the summary of every row's draws, made where the draws are: one row per row, no shuffle."""
    latent = _latent(points, kernel, pivot_x, L, nu_draws, noise, seed, var_floor)

    def fn(batches):
        for pdf in batches:
            if len(pdf) == 0:
                continue
            lat = latent(pdf)
            out = {"id": pdf["id"].to_numpy().astype(np.int64)}
            for name, v in (("prob", _sigmoid(lat)), ("latent", lat)):
                q = np.quantile(v, [0.05, 0.5, 0.95], axis=1)
                var = v.var(1, ddof=1) if v.shape[1] > 1 else np.full(len(v), np.nan)
                for s, x in zip(("mean", "variance", "std", "q05", "q50", "q95", "central_90_width"),
                                (v.mean(1), var, np.sqrt(var), *q, q[2] - q[0])):
                    out[f"{name}_{s}"] = x
            yield pd.DataFrame(out)

    src = points.select(F.col(key).cast("long").alias("id"), F.col(features).cast("array<double>").alias("x"))
    return src.mapInPandas(fn, "id long, " + ", ".join(f"{c} double" for c in SUMMARY_OUT))


def pivot_draw_likelihood(points: DataFrame, kernel, pivot_x: np.ndarray, L: np.ndarray, nu_draws: np.ndarray,
                          key: str = "id", features: str = "features", y: str = "y", noise: bool = True,
                          seed: int = 42, var_floor: float = 1e-8, eps: float = 1e-12) -> DataFrame:
    """(draw, ll, n): Σ log p(y | draw) of every draw, summed per partition before the shuffle (for PELL)."""
    latent = _latent(points, kernel, pivot_x, L, nu_draws, noise, seed, var_floor)
    S = len(nu_draws)

    def fn(batches):
        ll, n = np.zeros(S), 0
        for pdf in batches:
            if len(pdf) == 0:
                continue
            p = np.clip(_sigmoid(latent(pdf)), eps, 1.0 - eps)
            one = pdf["y"].to_numpy().astype(bool)[:, None]
            ll += np.log(np.where(one, p, 1.0 - p)).sum(0)
            n += len(pdf)
        yield pd.DataFrame({"draw": np.arange(S, dtype=np.int32), "ll": ll, "n": np.full(S, n, dtype=np.int64)})

    src = points.select(F.col(key).cast("long").alias("id"), F.col(features).cast("array<double>").alias("x"),
                        F.col(y).cast("int").alias("y"))
    return src.mapInPandas(fn, "draw int, ll double, n long").groupBy("draw").agg(F.sum("ll").alias("ll"), F.sum("n").alias("n"))


# ---- R2, R4: kernel-weighted sums over the training rows ------------------------------------

def kernel_weighted_sum(train: DataFrame, test: DataFrame, kernel, weight: str, key: str = "id",
                        features: str = "features", block_cells: int | None = None) -> DataFrame:
    """f*(t) = Σ_i k(t, x_i)·w_i for every test row t: ``(id, f_star)``.

    One job on a grid of (test block, train block) cells, each a group of a shuffle with about
    one cell a partition; partial sums are added by id. Any number of rows works on either
    side and none passes through the driver.
    """
    return grid.weighted_sums(train, test, kernel.quick_block, weight, key, features, "f_star", block_cells)


def option_a_weights(factor: DataFrame, nu: np.ndarray, k: int) -> DataFrame:
    """R2: α = Q R⁻ᵀ ν with F = Q R, i.e. α_i = F_i (FᵀF)⁻¹ ν, per training row."""
    from .lowrank import gram, stored_factor
    factor = stored_factor(factor)
    G = gram(factor, k=k)
    c = np.linalg.solve(G, np.asarray(nu, dtype=np.float64))
    return row_dots(factor, c, "id", "f", "alpha")


def row_dots(rows: DataFrame, v: np.ndarray, key: str, f: str, out: str) -> DataFrame:
    """(key, f·v) per row; v is broadcast, not written into the plan."""
    sent = bounded_broadcast(rows.sparkSession, v, "vector")

    def fn(batches):
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({key: pdf[key], out: np.stack(pdf["_f"].to_numpy()) @ sent.value})

    src = rows.select(key, F.col(f).cast("array<double>").alias("_f"))
    return src.mapInPandas(fn, f"`{key}` {rows.schema[key].dataType.simpleString()}, `{out}` double")


# ---- R7–R10: MLlib classifiers on embeddings ----------------------------------------------------

def _vec(df: DataFrame, features: str = "features"):
    from pyspark.ml.functions import array_to_vector
    return df.withColumn("_fv", array_to_vector(F.col(features).cast("array<double>")))


def fit_linear_probe(train: DataFrame, label: str = "y", features: str = "features", reg: float = 0.0,
                     max_iter: int = 100):
    """Logistic regression on the embedding (MLlib, distributed L-BFGS)."""
    from pyspark.ml.classification import LogisticRegression
    lr = LogisticRegression(featuresCol="_fv", labelCol=label, regParam=reg, maxIter=max_iter,
                            probabilityCol="_prob", rawPredictionCol="_raw", predictionCol="_pred")
    return lr.fit(_vec(train.withColumn(label, F.col(label).cast("double")), features))


def fit_mlp(train: DataFrame, label: str = "y", features: str = "features", hidden=(32,), max_iter: int = 50,
            seed: int = 42):
    """Multilayer perceptron (MLlib; sigmoid hidden units, softmax output)."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    d = len(train.select(features).first()[0])
    mlp = MultilayerPerceptronClassifier(featuresCol="_fv", labelCol=label, layers=[d, *hidden, 2],
                                         maxIter=max_iter, seed=seed, probabilityCol="_prob",
                                         rawPredictionCol="_raw", predictionCol="_pred")
    return mlp.fit(_vec(train.withColumn(label, F.col(label).cast("double")), features))


def score_model(model, df: DataFrame, key: str = "id", label: str = "y", features: str = "features") -> DataFrame:
    """Positive-class probability per row (vector_to_array on the probability column)."""
    from pyspark.ml.functions import vector_to_array
    out = model.transform(_vec(df, features))
    return out.select(key, label, vector_to_array("_prob")[1].alias("p"))


def score_chunked(df: DataFrame, model_obj, key: str = "id", features: str = "features",
                  batch_rows: int = 1000) -> DataFrame:
    """Any object with ``predict_proba`` applied to Arrow batches of ≤ batch_rows rows."""
    bc = df.sparkSession.sparkContext.broadcast(model_obj)

    def fn(batches):
        for pdf in batches:
            for s in range(0, len(pdf), batch_rows):
                part = pdf.iloc[s:s + batch_rows]
                if len(part) == 0:
                    continue
                X = np.stack(part["x"].to_numpy())
                P = np.asarray(bc.value.predict_proba(X))
                yield pd.DataFrame({key: part[key].astype("int64"), "p": P[:, 1]})

    return df.select(F.col(key).cast("long").alias(key), F.col(features).cast("array<double>").alias("x")) \
        .mapInPandas(fn, f"{key} long, p double")


class NumpyLogistic:
    """A plain predict_proba model (weights w, bias b) for R9."""

    def __init__(self, w, b):
        self.w = np.asarray(w, dtype=np.float64)
        self.b = float(b)

    def predict_proba(self, X):
        p = _sigmoid(X @ self.w + self.b)
        return np.stack([1 - p, p], axis=1)


def select_best(train: DataFrame, valid: DataFrame, grid, path: str, label: str = "y", key: str = "id"):
    """Fit each candidate on train, keep the best validation AUROC (first wins),
    save it, reload it; returns (loaded model, best params, table of scores)."""
    from . import metrics as M
    best, best_auc, best_params, scores = None, None, None, []
    for params in grid:
        kind = params["kind"]
        mdl = fit_linear_probe(train, label, reg=params.get("reg", 0.0)) if kind == "linear" else \
            fit_mlp(train, label, hidden=tuple(params.get("hidden", (16,))), max_iter=params.get("max_iter", 50))
        auc = M.ranking(score_model(mdl, valid, key, label), label, "p").first()["auroc"]
        scores.append((str(params), float(auc) if auc is not None else None))
        if auc is not None and (best_auc is None or auc > best_auc):
            best, best_auc, best_params = mdl, auc, params
    best.write().overwrite().save(path)
    loaded = type(best).load(path)
    return loaded, best_params, scores


# ---- R5: joint low-rank predictive draws -------------------------------------------------

def joint_predictive_draws(test: DataFrame, kernel, pivot_x: np.ndarray, L: np.ndarray, nu_mean: np.ndarray,
                           nu_cov: np.ndarray, n_draws: int = 64, rank: int = 32, b: int = 16, seed: int = 42,
                           key: str = "id", features: str = "features") -> DataFrame:
    """Draws of the latent at all test rows JOINTLY (correlated across rows).

    f* = F* m + F* chol(Σ) ξ + G ζ, where F*(x) = L⁻¹ k(P, x) are the test rows'
    factor coordinates, ν ~ N(m, Σ) the posterior, and G a low-rank factor of
    the residual kernel k(x, x') − F(x)·F(x') on the test rows, built by the
    accelerated pivoted Cholesky over the implicit kernel (never a matrix).
    ξ (S × k) and ζ (S × r) are drawn on the driver and broadcast.
    """
    from .kernels import ResidualKernel
    from .lowrank import accelerated_cholesky, factor_from_pivots

    d = int(np.asarray(pivot_x).shape[1])
    fx = factor_from_pivots(test, kernel, pivot_x, L, key, features)
    z = fx.join(test.select(F.col(key).cast("long").alias("id"), F.col(features).cast("array<double>").alias("x")),
                "id").select("id", F.concat("x", "f").alias("z"), "f")
    rk = ResidualKernel(kernel, d)
    res = accelerated_cholesky(z.select("id", F.col("z").alias("features")), rk, rank, b=b, seed=seed)
    Pz = np.array([p.x for p in res.pivots], dtype=np.float64)
    Lz = res.chol()
    g = factor_from_pivots(z.select("id", F.col("z").alias("features")), rk, Pz, Lz).select("id", F.col("f").alias("g"))
    rng = np.random.default_rng(seed)
    k = len(nu_mean)
    Lsig = np.linalg.cholesky(nu_cov + 1e-12 * np.eye(k))
    A = (rng.standard_normal((n_draws, k)) @ Lsig.T) + np.asarray(nu_mean)[None, :]   # S × k
    B = rng.standard_normal((n_draws, res.k))                                          # S × r
    sc = test.sparkSession.sparkContext
    bA, bB = bounded_broadcast(sc, A, "latent draws"), bounded_broadcast(sc, B, "residual draws")
    r_k = res.k

    def fn(batches):
        for pdf in batches:
            if len(pdf) == 0:
                continue
            Fm = np.stack(pdf["f"].to_numpy())
            Gm = np.stack(pdf["g"].to_numpy()) if r_k else np.zeros((len(Fm), 0))
            lat = Fm @ bA.value.T + Gm @ bB.value.T
            S = lat.shape[1]
            yield pd.DataFrame({"id": np.repeat(pdf["id"].to_numpy().astype(np.int64), S),
                                "draw": np.tile(np.arange(S, dtype=np.int32), len(Fm)),
                                "latent": lat.ravel(), "p": _sigmoid(lat.ravel())})

    return fx.select("id", "f").join(g, "id").mapInPandas(fn, "id long, draw int, latent double, p double")
