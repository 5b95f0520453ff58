"""Pivoted Cholesky low-rank factors and kernel regression on Spark.

Rows keep their factor columns and residual in a ``FactorStore`` (id, x, g, d): a round
picks candidates from (id, d), fetches those few rows, lets the driver accept pivots among
them, and appends the accepted columns to every row. Nothing N-sized moves and nothing
shuffles. The driver holds the pivots and L with L Lᵀ = K_PP.

Pivot rules
-----------
greedy (L5)        arg-max residual, ties by lowest id; exact lookahead takes several
                   pivots per pass from the top-m rows while they provably stay global
rp (L1)            one draw ∝ residual: Gumbel-max on keyed md5 noise (SQL-repeatable); exact
                   thinning takes several draws per pass, as stale residuals are upper bounds
uniform (L6)       P1 sample order, null pivots (residual < 1e-14) skipped
accelerated (L3)   b iid draws ∝ residual (independent Gumbel-max per draw in
                   one pass), accepted by rejection on the driver's b×b block
block (L2)         2b iid draws, unique in draw order, first b, regularised
"""

from __future__ import annotations

import math
import time
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import rng
from ..functions.kernels import KernelSpec
from ..session import checkpoint_table
from .factor_store import Candidates, FactorStore
from .kernels import kernel_diag_col
from .partials import SCHEMA as PARTIAL
from .partials import bounded_broadcast, emit, emit_arrow, tree_qr, tree_sum

# Fixed values shared with the reference's numerics.
NULL_PIVOT = 1e-14          # residual below this is a null pivot / stop


@dataclass
class Pivot:
    rank: int
    id: int
    x: list
    fvec: list
    resid: float


@dataclass
class Factor:
    store: FactorStore           # rows (id, x, g, d)
    kernel: KernelSpec
    pivots: list = field(default_factory=list)
    trace: float = 0.0
    n: int = 0
    errors: list = field(default_factory=list)   # relative trace error after each pivot
    elapsed: list = field(default_factory=list)  # driver clock after each pivot (s)
    rounds: int = 0
    method: str = ""
    closed: bool = False

    @property
    def k(self) -> int:
        return len(self.pivots)

    @property
    def points(self) -> DataFrame:
        return self.store.points

    def accept(self, ident: int, x, fvec, resid: float, clock: float) -> None:
        self.pivots.append(Pivot(self.k + 1, int(ident), [float(v) for v in x], [float(v) for v in fvec], float(resid)))
        self.elapsed.append(clock)

    def append_columns(self) -> None:
        """Columns of the pivots that the store doesn't have yet."""
        new = self.pivots[self.store.k:]
        self.store.extend([p.x for p in new], [p.fvec for p in new], [p.resid for p in new])

    def factor_df(self) -> DataFrame:
        """Factor rows (id, f, residual): the stored columns; after ``close`` one lazy Arrow pass F(x) = L⁻¹ k(P, x)."""
        if not self.closed and self.store.k == self.k:
            return self.store.columns_df()
        P = np.array([p.x for p in self.pivots], dtype=np.float64)
        return factor_from_pivots(self.points, self.kernel, P, self.chol(), features="x")

    def pivots_df(self, spark: SparkSession) -> DataFrame:
        rows = [(p.rank, int(p.id), float(p.resid), float(e), float(t), [float(v) for v in p.x])
                for p, e, t in zip(self.pivots, self.errors, self.elapsed)]
        schema = "rank int, pivot_id long, pivot_residual double, rel_trace_error double, elapsed_sec double, " \
                 "features array<double>"
        return spark.createDataFrame(rows, schema)   # k rows: bounded by the rank

    def close(self) -> None:
        """Release the stored rows (factor_df() then recomputes from the source)."""
        self.closed = True
        self.store.close()

    def kpp(self) -> np.ndarray:
        """K12 on the driver: K_PP from the k pivot rows, symmetrised."""
        X = np.array([p.x for p in self.pivots], dtype=np.float64)
        K = self.kernel.block(X, X)
        return 0.5 * (K + K.T)

    def chol(self) -> np.ndarray:
        """Lower-triangular L with L Lᵀ = K_PP as the pivots built it."""
        k = self.k
        L = np.zeros((k, k))
        for j, p in enumerate(self.pivots):
            L[j, :j] = p.fvec[:j]
            L[j, j] = math.sqrt(p.resid)
        return L


# ---------------------------------------------------------------- L1, L5 ------

#: Candidates a round of the random rule keeps, and rounds that one pass prepares.
RP_KEEP, RP_ROUNDS = 32, 16


def pivoted_cholesky(points: DataFrame, kernel: KernelSpec, k: int, method: str = "greedy",
                     seed: int = 42, tol: float = 0.0, key: str = "id", features: str = "features",
                     lookahead: int = 1024) -> Factor:
    """L5 (greedy) / L1 (rp): the pivots of one choice per round, several of them a pass.

    Residuals only fall as pivots are added. greedy: a row outside the pass's top
    ``lookahead`` keeps a key (d, −id) below the next key, the cutoff; while the best updated key
    among the fetched rows is above it, that row is the global arg-max. rp: the same holds for
    ln d + noise of each of the next rounds, whose noise is known beforehand. Otherwise a new
    pass starts, whose first choice needs no bound. ``lookahead=0`` takes one pivot a pass.

    Stops early (L7) when the max residual is ≤ 1e-14 or the residual trace
    is ≤ tol · trace.
    """
    if method not in ("greedy", "rp"):
        raise ValueError("method must be 'greedy' or 'rp'")
    fac = Factor(FactorStore(points, kernel, key, features), kernel, method=method)
    t0 = time.time()
    while fac.k < k:
        keep = 1 if not lookahead else lookahead if method == "greedy" else RP_KEEP
        slots = 1 if method == "greedy" or not lookahead else min(RP_ROUNDS, k - fac.k)
        found, tr, dmax, n = fac.store.pick(method, keep + 1, slots, fac.k, seed)
        if fac.rounds == 0:
            fac.trace, fac.n = tr, n
        fac.rounds += 1
        if not found or dmax <= NULL_PIVOT or (tol > 0 and tr <= tol * fac.trace):
            break
        block = Candidates(kernel, fac.store.fetch(r[1] for rows in found.values() for r in rows[:keep]))
        before = fac.k
        if method == "greedy":
            _accept_greedy(fac, block, found[0], keep, 1 if not lookahead else k - fac.k, t0)
        else:
            _accept_random(fac, block, found, keep, t0)
        if fac.k == before:
            break
        fac.append_columns()
    _fill_errors(fac)
    if tol > 0:                            # L7: keep the prefix up to the first rank within tolerance
        for r, e in enumerate(fac.errors):
            if e <= tol:
                fac.pivots, fac.errors, fac.elapsed = fac.pivots[:r + 1], fac.errors[:r + 1], fac.elapsed[:r + 1]
                break
    return fac


def _accept_greedy(fac: Factor, block: Candidates, rows: list, keep: int, limit: int, t0: float) -> None:
    cutoff = (rows[keep][0], -rows[keep][1]) if len(rows) > keep else None
    for _ in range(limit):
        free = [i for i in block.ids if i not in block.used]
        if not free:
            return
        best = max(free, key=lambda i: (block.d[block.at[i]], -i))
        d = float(block.d[block.at[best]])
        if (cutoff is not None and not (d, -best) > cutoff) or d <= NULL_PIVOT:
            return                         # the global arg-max may lie outside, or nothing is left (L7)
        fac.accept(best, *block.accept(best), time.time() - t0)


def _accept_random(fac: Factor, block: Candidates, found: dict, keep: int, t0: float) -> None:
    for slot, rows in found.items():
        live = [(math.log(block.d[block.at[i]]) + g, i) for _, i, _, g in rows[:keep] if block.d[block.at[i]] > 0]
        if not live:
            return
        value, best = max(live, key=lambda c: (c[0], -c[1]))
        if slot:                           # the first choice of a pass is fresh; later ones need the bound
            if len(rows) > keep and not value > rows[keep][0] + 1e-9:
                return
            if block.d[block.at[best]] <= NULL_PIVOT:
                return
        fac.accept(best, *block.accept(best), time.time() - t0)


def _grow(P: np.ndarray, L: np.ndarray, x, fvec, resid: float):
    m = L.shape[0]
    L2 = np.zeros((m + 1, m + 1))
    L2[:m, :m] = L
    L2[m, :m] = fvec
    L2[m, m] = math.sqrt(resid)
    P2 = np.asarray(x, dtype=np.float64)[None, :] if m == 0 else np.vstack([P, np.asarray(x, dtype=np.float64)])
    return P2, L2


# ---------------------------------------------------------------- L6 ----------

def uniform_cholesky(points: DataFrame, kernel: KernelSpec, k: int, seed: int = 42, key: str = "id",
                     features: str = "features") -> Factor:
    """Pivots in keyed-uniform order without replacement; null pivots skipped.

    Candidates come in pages of k (TakeOrdered, k rows per page); their
    Cholesky runs on the driver; one pass then gives every prefix error.
    """
    fac = Factor(FactorStore(points, kernel, key, features), kernel, method="uniform")
    base = fac.store.points.select("id", "x", rng.u01(F.col("id"), "uniform", seed).alias("_u"))
    t0 = time.time()
    P, L = np.zeros((0, 0)), np.zeros((0, 0))
    offset = None
    while fac.k < k:
        page = base if offset is None else base.filter(
            (F.col("_u") > offset[0]) | ((F.col("_u") == offset[0]) & (F.col("id") > offset[1])))
        rows = page.orderBy("_u", "id").limit(k).select("id", "x", "_u").collect()   # ≤ k rows
        if not rows:
            break
        offset = (rows[-1]["_u"], rows[-1]["id"])
        for r in rows:
            if fac.k >= k:
                break
            x = np.asarray(r["x"], dtype=np.float64)
            kx = float(kernel.block(x[None, :], x[None, :])[0, 0])
            fvec = _forward(L, kernel.block(P, x[None, :])[:, 0]) if fac.k else np.zeros(0)
            resid = kx - float(fvec @ fvec)
            if resid < NULL_PIVOT:
                continue
            fac.accept(r["id"], x, fvec, resid, time.time() - t0)
            P, L = _grow(P, L, x, fvec, resid)
        if len(rows) < k:
            break
    fac.append_columns()
    _fill_errors(fac)
    return fac


def _forward(L: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Solve L z = b for lower-triangular L (k small)."""
    n = L.shape[0]
    z = np.zeros(n)
    for i in range(n):
        z[i] = (b[i] - L[i, :i] @ z[:i]) / L[i, i]
    return z


def _fill_errors(fac: Factor) -> None:
    """Every prefix error from the stored columns: partial Σ_x G_r(x)² per rank r, n and Σ d."""
    k = fac.k

    source, read = fac.store.rows()

    def part(batches):
        acc = np.zeros(k + 2)
        seen = False
        for got in batches:
            if got.num_rows:
                seen = True
                _, G, d = read(got)
                acc[:k] += np.einsum("ij,ij->j", G, G)
                acc[k] += len(d)
                acc[k + 1] += float(d.sum())
        if seen:
            yield emit_arrow(acc)

    vec = tree_sum(source.mapInArrow(part, PARTIAL), k + 2)
    if fac.rounds == 0:                    # no pass has seen the diagonal yet
        fac.n, fac.trace = int(vec[k]), float(vec[:k].sum() + vec[k + 1])
    left = fac.trace - np.cumsum(vec[:k])
    fac.errors = [float(max(e, 0.0) / fac.trace) if fac.trace > 0 else 0.0 for e in left]


# ---------------------------------------------------------------- L2, L3, L4, L20 ---

def rejection_cholesky(H: np.ndarray, dprop: np.ndarray, u: np.ndarray, limit: int):
    """L4: sequential rejection on the b×b residual block.

    Candidate i is accepted when u_i · d_i < H_ii (H updated by every
    acceptance). Returns accepted indices, their residuals and the block
    Cholesky columns.
    """
    H = H.copy()
    b = H.shape[0]
    acc, res, cols = [], [], []
    for i in range(b):
        if len(acc) >= limit:
            break
        hii = H[i, i]
        if hii > NULL_PIVOT and u[i] * dprop[i] < hii:
            c = H[:, i] / math.sqrt(hii)
            acc.append(i)
            res.append(hii)
            cols.append(c)
            H -= np.outer(c, c)
    G = np.array(cols).T if cols else np.zeros((b, 0))
    return acc, res, G


def _driver_u(seed: int, rnd: int, i: int) -> float:
    return rng.u01_py(f"rej:{rnd}:{i}", 0, seed)


def auto_block(n: int, k: int, d: int) -> int:
    """Block size of ``b='auto'``, from the sizes alone: an eighth of the rank, as long as the
    driver's b × b block work (b² of them a pass, b³ to factor it) stays below the rows' share."""
    most = max(16, math.isqrt(max(1, n * (d + k)) // max(1, d)))
    return max(1, min(max(16, -(-k // 8)), most))


def accelerated_cholesky(points: DataFrame, kernel: KernelSpec, k: int, b: int | str = 32, seed: int = 42,
                         tol: float = 0.0, key: str = "id", features: str = "features",
                         mode: str = "accelerated") -> Factor:
    """L3 (mode='accelerated') and L2 (mode='block').

    A round draws b (or 2b) candidates ∝ residual with replacement (independent Gumbel-max per
    draw; a partition sends only its local winners' keys), fetches their rows, and the driver
    works on the b×b block: rejection (L3) or a regularised block Cholesky of the first b
    unique draws in draw order (L2). ``b='auto'`` takes b from n, k and d (``auto_block``), so the
    pivots depend on the data and the seed only.
    """
    fac = Factor(FactorStore(points, kernel, key, features), kernel, method=mode)
    if b == "auto":
        size = fac.store.points.select(F.count(F.lit(1)), F.max(F.size("x"))).first()
        b = auto_block(int(size[0]), k, int(size[1] or 1))
    draws = 2 * int(b) if mode == "block" else int(b)
    t0 = time.time()
    while fac.k < k:
        found, tr, dmax, n = fac.store.pick("iid", 1, draws, fac.rounds, seed)
        if fac.rounds == 0:
            fac.trace, fac.n = tr, n
        fac.rounds += 1
        remaining = k - fac.k
        if dmax <= NULL_PIVOT or (tol > 0 and tr <= tol * fac.trace) or not found:
            break
        chosen = [rows[0][1] for rows in found.values()]
        if mode == "block":
            chosen = list(dict.fromkeys(chosen))[:min(int(b), remaining)]
        rows = fac.store.fetch(chosen)
        X = np.array([rows[i][0] for i in chosen])
        Fc = np.array([rows[i][1] for i in chosen]).reshape(len(chosen), fac.k)
        H = kernel.block(X, X) - Fc @ Fc.T
        H = 0.5 * (H + H.T)
        dprop = np.array([rows[i][2] for i in chosen])
        if mode == "block":
            reg = np.finfo(float).eps * len(chosen) * 2 * max(float(np.max(np.diag(H))), 0.0)
            acc, res, G = rejection_cholesky(H + reg * np.eye(len(chosen)), np.zeros(len(chosen)),
                                             np.zeros(len(chosen)), remaining)
        else:
            u = np.array([_driver_u(seed, fac.rounds - 1, i) for i in range(len(chosen))])
            acc, res, G = rejection_cholesky(H, dprop, u, remaining)
        for j, (i, hii) in enumerate(zip(acc, res)):
            fac.accept(chosen[i], X[i], [*Fc[i], *G[i, :j]], hii, time.time() - t0)
        fac.append_columns()
    _fill_errors(fac)
    return fac


# ---------------------------------------------------------------- L8, L9, L21 ---

def error_by_rank(fac: Factor) -> DataFrame:
    """Rank, pivot id, relative trace error and elapsed time from one factor."""
    return fac.pivots_df(fac.points.sparkSession).drop("features")


def factor_stats(fac: Factor, spark: SparkSession) -> DataFrame:
    """L8 + run stats: one row (k, n, traces, relative error, kernel queries, rounds)."""
    err = float(fac.errors[-1]) if fac.errors else 1.0
    tr = float(fac.trace)
    row = [(fac.method, len(fac.pivots), int(fac.n), tr, tr * (1 - err), tr * err, err,
            int(fac.n * (fac.k + 1)), int(fac.rounds))]
    return spark.createDataFrame(row, "method string, k_actual int, n long, trace_K double, trace_FFt double, "
                                      "trace_residual double, rel_trace_error double, kernel_queries long, "
                                      "rounds int")


# ---------------------------------------------------------------- Gram, eig, solves ---

def gram(factor: DataFrame, f: str = "f", rhs: str | None = None, k: int | None = None):
    """FᵀF (k×k) and optionally Fᵀrhs in ONE pass: Arrow partials, k² long rows summed.

    Returns NumPy arrays on the driver (k-sized).
    """
    cols = [F.col(f).cast("array<double>").alias("f")]
    if rhs is not None:
        cols.append(F.col(rhs).cast("double").alias("r"))
    src = factor.select(*cols)
    if k is None:
        k = len(src.select("f").first()[0])
    kk = k

    def part(batches):
        G = np.zeros((kk, kk))
        b = np.zeros(kk)
        seen = False
        for pdf in batches:
            if len(pdf) == 0:
                continue
            seen = True
            Fm = np.stack(pdf["f"].to_numpy())
            G += Fm.T @ Fm
            if "r" in pdf:
                b += Fm.T @ pdf["r"].to_numpy(dtype=np.float64)
        if seen:
            yield emit(np.concatenate([G.ravel(), b]))

    vec = tree_sum(src.mapInPandas(part, PARTIAL), kk * kk + kk)   # one k² + k vector per partition
    G = vec[:kk * kk].reshape(kk, kk)
    return (G, vec[kk * kk:]) if rhs is not None else G


def map_rows(df: DataFrame, fn, in_cols: list[str], out_schema: str, keep: list[str]) -> DataFrame:
    """Apply a NumPy function to Arrow batches of rows (per-row maths vs broadcast state)."""
    def run(batches):
        for pdf in batches:
            if len(pdf) == 0:
                continue
            yield fn(pdf)
    return df.select(*keep, *[c for c in in_cols if c not in keep]).mapInPandas(run, out_schema)


def factor_svd(factor: DataFrame, k: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Singular values of F (descending) and its right singular vectors, from a tree of QRs."""
    src = factor.select(F.col("f").cast("array<double>").alias("f"))
    if k is None:
        k = len(src.first()["f"])
    _, s, W = np.linalg.svd(tree_qr(src, k, lambda pdf: np.stack(pdf["f"].to_numpy())))
    return s, W.T


def eig_factor(factor: DataFrame, k: int | None = None, rel_tol: float = 1e-20):
    """Compact eigendecomposition K ≈ V Λ Vᵀ from F.

    F = Q R by a tree of QRs, R = U S Wᵀ on the driver; V = F W S⁻¹ per row (Arrow), Λ = S².
    Eigenvalues up to ``rel_tol`` times the largest count as zero.
    Returns (V DataFrame <id, v>, eigenvalues, rank).
    """
    s, W = factor_svd(factor, k)
    keep = s * s > rel_tol * (s[0] * s[0] if len(s) else 0.0)
    s, W = s[keep], W[:, keep]
    bc = bounded_broadcast(factor.sparkSession, W / s[None, :], "eigenvector map")

    def fn(pdf):
        Fm = np.stack(pdf["f"].to_numpy())
        return pd.DataFrame({"id": pdf["id"].astype("int64"), "v": list(Fm @ bc.value)})

    V = map_rows(factor, fn, ["f"], "id long, v array<double>", ["id"])
    return V, s * s, int(len(s))


def spectrum(factor: DataFrame, k: int | None = None, floor: float = 1e-16) -> list[float]:
    """Eigenvalues of F Fᵀ (squared singular values of F), descending, floored."""
    s, _ = factor_svd(factor, k)
    return [float(max(v * v, floor)) for v in s]


def stored_factor(factor: DataFrame, *more: str) -> DataFrame:
    """(id, f, more) written once, for a factor that is read twice: what reads it runs no Python of the factor's own beside its own."""
    return checkpoint_table(factor.select("id", "f", *more), factor.sparkSession, "factor-rows")


def woodbury_solve(factor: DataFrame, rhs: str, nugget: float, k: int | None = None) -> DataFrame:
    """(F Fᵀ + ν I)⁻¹ rhs = (rhs − F (ν I + FᵀF)⁻¹ Fᵀ rhs) / ν, one aggregate pass."""
    factor = stored_factor(factor, rhs)
    G, b = gram(factor, rhs=rhs, k=k)
    c = np.linalg.solve(nugget * np.eye(len(b)) + G, b)
    lit_c = A.lit_vector(c)
    return factor.select("id", ((F.col(rhs) - A.dot(F.col("f"), lit_c)) / F.lit(float(nugget))).alias("solution"))


def krr_solve(V: DataFrame, eigvals, rhs_df: DataFrame, rhs: str, lam: float) -> DataFrame:
    """(V Λ Vᵀ + λ I)⁻¹ b with orthonormal V: V diag(1/(Λ+λ)) Vᵀb + (b − V Vᵀb)/λ."""
    j = V.join(rhs_df.select("id", F.col(rhs).cast("double").alias("_b")), "id")
    r = len(eigvals)
    _, vtb = gram(j.select(F.col("v").alias("f"), "_b"), f="f", rhs="_b", k=r)
    coef = vtb / (np.asarray(eigvals) + lam)
    resid_coef = vtb
    out = A.dot(F.col("v"), A.lit_vector(coef)) + (F.col("_b") - A.dot(F.col("v"), A.lit_vector(resid_coef))) / F.lit(lam)
    return j.select("id", out.alias("solution"))


# ---------------------------------------------------------------- L12, L13 ------

def factor_from_pivots(points: DataFrame, kernel: KernelSpec, pivot_x: np.ndarray, L: np.ndarray,
                       key: str = "id", features: str = "features") -> DataFrame:
    """Nyström factor rows F(x) = L⁻¹ k(P, x) and residual k(x,x) − ‖F(x)‖².

    Pivots (k × d) and L (k × k) are broadcast; each Arrow batch does one
    kernel block and one triangular solve by BLAS.
    """
    sc = points.sparkSession.sparkContext
    bP, bL = bounded_broadcast(sc, pivot_x, "pivots"), bounded_broadcast(sc, L, "pivot Cholesky")

    def fn(pdf):
        X = np.stack(pdf["x"].to_numpy())
        Kxp = kernel.block(X, bP.value)                    # n_b × k
        Fm = np.linalg.solve(bL.value, Kxp.T).T if bL.value.size else np.zeros((len(X), 0))
        diag = kernel.diag_np(X)
        res = np.maximum(diag - (Fm * Fm).sum(1), 0.0)
        return pd.DataFrame({"id": pdf["id"].astype("int64"), "f": list(Fm), "residual": res})

    src = points.select(F.col(key).cast("long").alias("id"), F.col(features).cast("array<double>").alias("x"))
    return map_rows(src, fn, ["x"], "id long, f array<double>, residual double", ["id"])


def nystrom_chol(kpp: np.ndarray, eps: float = 1e-10) -> np.ndarray:
    """chol(C + tr(C)·eps·I) for the Nyström core."""
    C = 0.5 * (kpp + kpp.T)
    return np.linalg.cholesky(C + np.trace(C) * eps * np.eye(C.shape[0]))


def scale_factor(factor: DataFrame, scale: DataFrame, key: str = "id", s: str = "s", mode: str = "lowrank"):
    """Row scaling of a factor: G·s (low-rank) or √s (Nyström form)."""
    j = factor.join(scale.select(key, F.col(s).cast("double").alias("_s")), key)
    mult = F.sqrt(F.col("_s")) if mode == "nystrom" else F.col("_s")
    return j.withColumn("f", F.transform("f", lambda v: v * mult)).drop("_s")


def lowrank_matvec(factor: DataFrame, vec: DataFrame, key: str = "id", v: str = "v") -> DataFrame:
    """(F Fᵀ) v: one aggregate Fᵀv (k-vector), then a per-row dot."""
    j = factor.join(vec.select(key, F.col(v).cast("double").alias("_v")), key)
    k = len(factor.select("f").first()[0])
    _, ftv = gram(j.select("f", "_v"), rhs="_v", k=k)
    return j.select(key, A.dot(F.col("f"), A.lit_vector(ftv)).alias("Av"))


def pair_frobenius(pairs: DataFrame, points: DataFrame, factor: DataFrame, kernel: KernelSpec, key: str = "id",
                   features: str = "features") -> DataFrame:
    """L10 over a caller's pair table: ‖K − F Fᵀ‖ / ‖K‖ of the cells (i, j), by equi-joins.

    With every ordered pair it is the relative Frobenius error; a keyed sample of pairs
    estimates it without n² cells.
    """
    x = points.select(F.col(key), F.col(features).cast("array<double>").alias("_x")).join(factor.select(key, "f"), key)
    a = x.select(F.col(key).alias("i"), F.col("_x").alias("_a"), F.col("f").alias("_fa"))
    b = x.select(F.col(key).alias("j"), F.col("_x").alias("_b"), F.col("f").alias("_fb"))
    j = pairs.select("i", "j").join(a, "i").join(b, "j")
    k = kernel.point("_a", "_b")
    gap = k - A.dot(F.col("_fa"), F.col("_fb"))
    return j.agg(F.sqrt(F.sum(gap * gap) / F.sum(k * k)).alias("rel_frobenius"), F.count(F.lit(1)).alias("n_pairs"))


# ---------------------------------------------------------------- L17, L18 ---------

def nystrom_krr_fit(train: DataFrame, kernel: KernelSpec, landmarks: np.ndarray, lam: float,
                    key: str = "id", features: str = "features", target: str = "target"):
    """β = (K_nmᵀ K_nm + λ K_mm)⁻¹ K_nmᵀ y with a lstsq fallback.

    One pass: each Arrow batch forms its K_nm block against the broadcast
    landmarks and emits partial K_nmᵀK_nm and K_nmᵀy; the m×m solve is on
    the driver.
    """
    Lm = np.asarray(landmarks, dtype=np.float64)
    m = Lm.shape[0]
    bc = bounded_broadcast(train.sparkSession, Lm, "landmarks")

    def part(batches):
        G = np.zeros((m, m))
        b = np.zeros(m)
        seen = False
        for pdf in batches:
            if len(pdf) == 0:
                continue
            seen = True
            X = np.stack(pdf["x"].to_numpy())
            K = kernel.block(X, bc.value)
            G += K.T @ K
            b += K.T @ pdf["t"].to_numpy(dtype=np.float64)
        if seen:
            yield emit(np.concatenate([G.ravel(), b]))

    src = train.select(F.col(features).cast("array<double>").alias("x"), F.col(target).cast("double").alias("t"))
    vec = tree_sum(src.mapInPandas(part, PARTIAL), m * m + m)
    bc.destroy()
    KtK, Kty = vec[:m * m].reshape(m, m), vec[m * m:]
    Kmm = kernel.block(Lm, Lm)
    A_ = KtK + lam * Kmm
    try:
        beta = np.linalg.solve(A_, Kty)
        if not np.all(np.isfinite(beta)):
            raise np.linalg.LinAlgError
    except np.linalg.LinAlgError:
        beta = np.linalg.lstsq(A_, Kty, rcond=None)[0]
    return beta


def landmark_trace_error(points: DataFrame, kernel: KernelSpec, landmarks: np.ndarray,
                         key: str = "id", features: str = "features") -> float:
    """L17 trace error of the landmarks: Σ (k(x,x) − k_xmᵀ K_mm⁻¹ k_xm) / Σ k(x,x), one pass."""
    Lm = nystrom_chol(kernel.block(landmarks, landmarks))
    r = factor_from_pivots(points, kernel, landmarks, Lm, key, features) \
        .agg(F.sum("residual").alias("res"), F.count(F.lit(1)).alias("n")).first()
    return float(r["res"]) / float(r["n"]) if r["n"] else 0.0   # stationary kernels: Σ k(x,x) = n


def nystrom_krr_predict(test: DataFrame, kernel: KernelSpec, landmarks: np.ndarray, beta: np.ndarray,
                        key: str = "id", features: str = "features") -> DataFrame:
    """Prediction K(x, landmarks)·β per row (Arrow batches)."""
    sc = test.sparkSession.sparkContext
    bL, bB = bounded_broadcast(sc, landmarks, "landmarks"), bounded_broadcast(sc, beta, "KRR weights")

    def fn(pdf):
        X = np.stack(pdf["x"].to_numpy())
        return pd.DataFrame({"id": pdf["id"].astype("int64"), "prediction": kernel.block(X, bL.value) @ bB.value})

    src = test.select(F.col(key).cast("long").alias("id"), F.col(features).cast("array<double>").alias("x"))
    return map_rows(src, fn, ["x"], "id long, prediction double", ["id"])


def choose_landmarks(points: DataFrame, m: int, rule: str = "uniform", kernel: KernelSpec | None = None,
                     seed: int = 42, key: str = "id", features: str = "features") -> np.ndarray:
    """L17 landmark rules: 'uniform' (P1), 'diagonal' (top-m diagonal, id tie-break),
    'greedy' / 'rp' (pivoted Cholesky pivots)."""
    from . import prep

    if rule == "uniform":
        rows = prep.subsample(points.select(key, features), m, key, seed).collect()
    elif rule == "diagonal":
        diag = kernel_diag_col(kernel, F.col(features).cast("array<double>"))
        rows = points.select(key, features, diag.alias("_dg")).orderBy(F.col("_dg").desc(), F.col(key)).limit(m).collect()
    elif rule in ("greedy", "rp"):
        fac = pivoted_cholesky(points, kernel, m, method=rule, seed=seed, key=key, features=features)
        return np.array([p.x for p in fac.pivots], dtype=np.float64)
    else:
        raise ValueError(rule)
    return np.array([r[features] for r in rows], dtype=np.float64)
