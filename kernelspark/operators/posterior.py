"""Posterior inference in factor coordinates.

Model: latent f = F ν over the rows of a factor table ``(id, f, y)``,
ν ~ N(0, I), Bernoulli likelihood with a sigmoid or probit link.

The unit of work is ONE pass over the factor rows for a whole batch of ν
vectors (all chains or walkers at once): each Arrow batch computes
Z = F_b Vᵀ; each partition emits ONE vector of partial log-likelihood sums
(C values) and gradient sums Fᵀ(∂ℓ/∂f) (C × k values), folded by a tree sum
(``partials.tree_sum``). Only C × k numbers reach the driver. Samplers and Newton steps are driver loops
over such passes; a random-walk pass scores all futures of several steps (``samplers``).
The Laplace approximation (≤ ~10 passes) is the default posterior.
"""

from __future__ import annotations

import math
import time
import uuid

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from . import samplers
from .partials import SCHEMA as PARTIAL
from .partials import emit_arrow, tree_sum
from .partials import MAX_BROADCAST_CELLS
from .partials import bounded_broadcast

# Fixed values that must equal the reference's.
SIGMOID_EPS = 1e-10

#: Points that a task scores at once: its memory is rows of a batch × this, however many futures a pass scores.
POINTS_AT_ONCE = 64
#: Rows that are worth a partition of their own, while there are cores, and factor values of a partition at most.
LEAST_ROWS, MOST_VALUES = 1000, 1 << 23


# ---- links (M3) ----------------------------------------------------------------------

def sigmoid(z):
    return 0.5 * (1.0 + np.tanh(0.5 * z))


def log_sigmoid(z):
    z = np.asarray(z, dtype=np.float64)
    return -np.logaddexp(0.0, -z)


def erfc(x: np.ndarray) -> np.ndarray:
    """Complementary error function of a whole array: Taylor series of erf inside, continued fraction outside |x| = 2."""
    x = np.asarray(x, dtype=np.float64)
    a = np.abs(x)
    near = np.minimum(a, 2.0)
    term = total = near
    for n in range(1, 40):
        term = -term * near * near / n
        total = total + term / (2 * n + 1)
    inside = 1.0 - 2.0 / math.sqrt(math.pi) * total
    far = np.maximum(a, 2.0)
    tail = far
    for n in range(60, 0, -1):
        tail = far + 0.5 * n / tail
    outside = np.exp(-far * far) / (math.sqrt(math.pi) * tail)
    up = np.where(a < 2.0, inside, outside)
    return np.where(x < 0, 2.0 - up, up)


def log_norm_cdf(x):
    """log Φ(x) without scipy: erfc above −5, asymptotic series below."""
    x = np.asarray(x, dtype=np.float64)
    out = np.empty_like(x)
    hi = x >= -5.0
    if hi.any():
        out[hi] = np.log(0.5 * erfc(-x[hi] / math.sqrt(2.0)))
    lo = ~hi
    if lo.any():
        t = x[lo]
        t2 = 1.0 / (t * t)
        series = 1.0 - t2 + 3.0 * t2 ** 2 - 15.0 * t2 ** 3 + 105.0 * t2 ** 4
        out[lo] = -0.5 * t * t - np.log(-t) - 0.5 * math.log(2 * math.pi) + np.log(series)
    return out


def norm_logpdf(x):
    return -0.5 * np.asarray(x) ** 2 - 0.5 * math.log(2 * math.pi)


def loglik_and_dz(Z: np.ndarray, y: np.ndarray, link: str):
    """Per-row log-likelihood and ∂ℓ/∂z for latent Z (n × C) and labels y (n)."""
    yy = y[:, None]
    if link == "sigmoid":
        ll = yy * log_sigmoid(Z) + (1 - yy) * log_sigmoid(-Z)
        dz = yy - sigmoid(Z)
    elif link == "sigmoid_eps":
        p = sigmoid(Z)
        ll = yy * np.log(p + SIGMOID_EPS) + (1 - yy) * np.log(1 - p + SIGMOID_EPS)
        dz = yy - p
    elif link == "probit":
        lp, ln = log_norm_cdf(Z), log_norm_cdf(-Z)
        ll = yy * lp + (1 - yy) * ln
        imr_pos = np.exp(norm_logpdf(Z) - lp)
        imr_neg = np.exp(norm_logpdf(-Z) - ln)
        dz = yy * imr_pos - (1 - yy) * imr_neg
    else:
        raise ValueError(f"unknown link {link!r}")
    return ll, dz


def bounded_broadcast_check(a, what: str) -> np.ndarray:
    a = np.asarray(a, dtype=np.float64)
    if a.size > MAX_BROADCAST_CELLS:
        raise ValueError(f"{what}: {a.shape} exceeds the broadcast bound of {MAX_BROADCAST_CELLS} cells")
    return a


# ---- M1, M2: one pass for a batch of ν -----------------------------------------------------

class FactorModel:
    """A cached factor table and the batched log-posterior / gradient pass.

    Cached rows are spread over all cores, however few bytes they are: a join before leaves
    small tables in one partition, and each of a sampler's hundreds of passes would be one task.
    """

    def __init__(self, factor: DataFrame, link: str = "sigmoid", f: str = "f", y: str = "y",
                 dtype: str = "double", cache: bool = True):
        src = factor.select(F.col(f).cast(f"array<{dtype}>").alias("f"), F.col(y).cast("double").alias("y"))
        self.spark: SparkSession = factor.sparkSession
        self.dtype = np.float32 if dtype == "float" else np.float64
        self.df, self.parts = src, None
        if cache:
            src.persist(StorageLevel.MEMORY_AND_DISK)
            rows = src.count()
        self.k = len(src.select("f").first()["f"])
        if cache:
            self.parts = max(1, min(self.spark.sparkContext.defaultParallelism, rows // LEAST_ROWS), rows * self.k // MOST_VALUES)
            self.df = src.repartition(self.parts).persist(StorageLevel.MEMORY_AND_DISK)
            self.df.count()
            src.unpersist()
        self.link = link
        self.n_passes = 0

    def score(self, V: np.ndarray, grad: bool = True, hessian: bool = False):
        """Return (logp C, grad C×k or None, FᵀWF k×k for the first ν if hessian)."""
        V = np.atleast_2d(np.asarray(V, dtype=np.float64))
        C, k = V.shape
        bc = self.spark.sparkContext.broadcast(
            bounded_broadcast_check(V, "nu batch").astype(self.dtype))
        link, want_g, want_h, dt = self.link, grad, hessian, self.dtype

        def part(batches):
            ll_s = np.zeros(C)
            g_s = np.zeros((C, k))
            h_s = np.zeros((k, k))
            seen = False
            for got in batches:
                if got.num_rows == 0:
                    continue
                seen = True
                Fm = np.asarray(got.column(0).flatten(), dtype=dt).reshape(got.num_rows, k)
                y = np.asarray(got.column(1), dtype=np.float64)
                Fd = Fm.astype(np.float64)
                for a in range(0, C, POINTS_AT_ONCE):
                    some = slice(a, a + POINTS_AT_ONCE)
                    Z = (Fm @ bc.value[some].T).astype(np.float64)
                    ll, dz = loglik_and_dz(Z, y, link)
                    ll_s[some] += ll.sum(0)
                    if want_g:
                        g_s[some] += dz.T @ Fd
                    if want_h and a == 0:
                        p = sigmoid(Z[:, 0])
                        h_s += (Fd * (p * (1 - p))[:, None]).T @ Fd
            if seen:
                vals = [ll_s]
                if want_g:
                    vals.append(g_s.ravel())
                if want_h:
                    vals.append(h_s.ravel())
                yield emit_arrow(np.concatenate(vals))

        size = C + (C * k if grad else 0) + (k * k if hessian else 0)
        vec = tree_sum(self.df.mapInArrow(part, PARTIAL), size, parts=self.parts)
        bc.destroy()      # one broadcast per step: release it, samplers run thousands
        self.n_passes += 1
        ll = vec[:C]
        logp = ll - 0.5 * np.sum(V * V, axis=1)
        g = h = None
        off = C
        if grad:
            g = vec[off:off + C * k].reshape(C, k) - V
            off += C * k
        if hessian:
            h = vec[off:off + k * k].reshape(k, k)
        return logp, g, h

    def close(self):
        self.df.unpersist()


def log_posterior(factor: DataFrame, V: np.ndarray, link: str = "sigmoid", **kw) -> DataFrame:
    """M1+M2 as a DataFrame: (chain, logp) and the gradient (chain, dim, grad)."""
    m = FactorModel(factor, link, cache=False, **kw)
    logp, g, _ = m.score(V, grad=True)
    spark = factor.sparkSession
    rows = [(c, float(logp[c]), j, float(g[c, j])) for c in range(len(logp)) for j in range(g.shape[1])]
    return spark.createDataFrame(rows, "chain int, logp double, dim int, grad double")   # C × k rows


# ---- M8: Laplace approximation --------------------------------------------------------------

def laplace(factor: DataFrame, max_iter: int = 100, tol: float = 1e-8, **kw):
    """Newton in k dims: each pass returns gradient and FᵀWF; ν ← ν + (I + FᵀWF)⁻¹ ∇.

    Returns (mode ν̂, covariance (I + FᵀWF)⁻¹, log posterior at the mode, passes). The log
    posterior is concave, so Newton steps end after a few passes; a run that has not
    converged after ``max_iter`` raises, it never returns another point as the mode.
    """
    m = FactorModel(factor, "sigmoid", **kw)
    nu = np.zeros(m.k)
    logp = None
    for _ in range(max_iter):
        logp, g, h = m.score(nu[None, :], grad=True, hessian=True)
        A = np.eye(m.k) + h
        step = np.linalg.solve(A, g[0])
        nu = nu + step
        if np.max(np.abs(step)) < tol:
            break
    else:
        m.close()
        raise RuntimeError(f"the posterior mode was not found in {max_iter} Newton steps")
    logp, g, h = m.score(nu[None, :], grad=True, hessian=True)
    cov = np.linalg.inv(np.eye(m.k) + h)
    passes = m.n_passes
    m.close()
    return nu, 0.5 * (cov + cov.T), float(logp[0]), passes


def laplace_draws(nu: np.ndarray, cov: np.ndarray, n_draws: int, seed: int = 42) -> np.ndarray:
    """Posterior draws ν_s = ν̂ + chol(Σ) ξ_s (S × k, driver-sized)."""
    rng = np.random.default_rng(seed)
    L = np.linalg.cholesky(cov + 1e-12 * np.eye(len(nu)))
    return nu[None, :] + rng.standard_normal((n_draws, len(nu))) @ L.T


# ---- M4–M7, M9: lock-step samplers -----------------------------------------------------------

CHAIN = "chain int, step int, nu array<double>, logp double, accepted boolean, step_time double, is_warmup boolean, step_size double"
#: Steps whose rows the driver holds before they are appended to the stored chain table.
STEPS_HELD = 200


def run_sampler(factor: DataFrame, kind: str = "rwm", n_steps: int = samplers.FULL_STEPS,
                n_warmup: int = samplers.FULL_WARMUP, n_chains: int = 4, step_size: float = 0.1,
                n_leapfrog: int = samplers.FULL_LEAPFROGS, link: str = "sigmoid", seed: int = 42,
                target_accept: float | None = None, adapt: bool = True, proposal=None, ahead: int | None = None, **kw):
    """RWM (M4), MALA (M5), HMC with dual averaging (M6), many walkers with Gaussian or MALA
    moves (M7: 'ensemble', 'ensemble_mala'), independent chains (M9 = the chain axis).

    Run lengths default to the reference's full ones. A Spark pass scores all chains at once
    and, without a gradient, ``ahead`` steps (fewer where the points would not fit the
    broadcast bound); a Langevin pass goes to each chain's next accepted step, at most
    ``ahead``; an HMC step is ``n_leapfrog`` passes. The chains depend on seed, chain and step
    alone. Chain rows are appended to a stored table every STEPS_HELD steps; step_time is the
    time since the row before, so the first step of a pass carries it. Returns a dict with the
    chain table (DataFrame), the number of passes, the final step sizes and the number of chains.
    """
    m = FactorModel(factor, link, **kw)
    if kind.startswith("ensemble"):
        n_chains = min(max(2 * m.k + 2, 24), 100)
    base = {"ensemble": "rwm", "ensemble_mala": "mala"}.get(kind, kind)

    ahead = samplers.AHEAD.get(base, 1) if ahead is None else ahead
    while ahead > 1 and n_chains * m.k * (2 ** ahead - 1 if base == "rwm" else ahead) > MAX_BROADCAST_CELLS:
        ahead -= 1

    def score(nu, grad):
        return m.score(nu, grad=grad)[:2]

    path = f"{ensure_checkpoint_dir(m.spark).rstrip('/')}/chains/{uuid.uuid4().hex[:12]}"
    held, eps, t0 = [], None, time.perf_counter()

    def store():
        m.spark.createDataFrame(held, CHAIN).coalesce(1).write.mode("append").parquet(path)
        held.clear()

    for step, now, accepted, eps in samplers.walk(score, np.zeros((n_chains, m.k)), base, n_steps, n_warmup, step_size,
                                                  n_leapfrog, seed, target_accept, adapt, proposal, ahead):
        t1 = time.perf_counter()
        held += [(c, step, now.nu[c].tolist(), float(now.logp[c]), bool(accepted[c]), t1 - t0, step < n_warmup, float(eps[c]))
                 for c in range(n_chains)]
        if (step + 1) % STEPS_HELD == 0:
            store()
        t0 = time.perf_counter()
    if held or not (n_steps + n_warmup):
        store()
    passes = m.n_passes
    m.close()
    return dict(chain=m.spark.read.schema(CHAIN).parquet(path), passes=passes,
                step_size=[] if eps is None else eps.tolist(), n_chains=n_chains)


# ---- M10 -----------------------------------------------------------------------------------------

def posterior_mean_probability(factor: DataFrame, draws: np.ndarray, max_draws: int = 400, seed: int = 42,
                               f: str = "f", key: str = "id") -> DataFrame:
    """Per row mean of σ(F ν_s) over ≤ 400 random posterior draws (broadcast S × k)."""
    S = draws.shape[0]
    if S > max_draws:
        idx = np.sort(np.random.default_rng(seed).choice(S, max_draws, replace=False))
        draws = draws[idx]
    bc = bounded_broadcast(factor.sparkSession, draws, "posterior draws")

    def fn(batches):
        for pdf in batches:
            if len(pdf) == 0:
                continue
            Fm = np.stack(pdf["f"].to_numpy())
            P = sigmoid(Fm @ bc.value.T)
            yield pd.DataFrame({key: pdf[key].astype("int64"), "p_mean": P.mean(1)})

    return factor.select(F.col(key).cast("long").alias(key), F.col(f).cast("array<double>").alias("f")) \
        .mapInPandas(fn, f"{key} long, p_mean double")
