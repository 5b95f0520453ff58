"""Kernel specifications: one object, three evaluation forms.

* ``point(a, b)``   – Catalyst Column for the kernel between two array columns
                      (K1–K3, K5, K14); used by joins and per-row maps.
* ``block(X, Y)``   – NumPy block for Arrow batches against broadcast pivots (K6).
* ``sql(a, b)``     – DuckDB text of the point form (oracle).

Distances: Gaussian and Matérn use L2, Laplace uses L1. ``stable=True``
computes the explicit difference (K14); ``stable=False`` uses the norm
expansion (K13), clamped at zero.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import arrays as A

KERNELS = ("gaussian", "laplace", "matern")


@dataclass(frozen=True)
class KernelSpec:
    name: str = "gaussian"
    bandwidth: float = 1.0
    nu: float = 0.5
    stable: bool = True

    def __post_init__(self):
        if self.name not in KERNELS:  # exact name match, not a substring test
            raise ValueError(f"unknown kernel {self.name!r}; expected one of {KERNELS}")
        if not self.bandwidth > 0:
            raise ValueError("bandwidth must be positive")

    def with_bandwidth(self, bw: float) -> "KernelSpec":
        return KernelSpec(self.name, float(bw), self.nu, self.stable)

    @property
    def metric(self) -> str:
        return "l1" if self.name == "laplace" else "l2"

    # ---- Column form ---------------------------------------------------------
    def distance(self, a, b) -> Column:
        if self.metric == "l1":
            return A.l1dist(a, b)
        sq = A.sqdist(a, b) if self.stable else A.sqdist_expanded(a, b)
        return F.sqrt(sq)

    def point(self, a, b) -> Column:
        bw = F.lit(float(self.bandwidth))
        if self.name == "gaussian":
            sq = A.sqdist(a, b) if self.stable else A.sqdist_expanded(a, b)
            return F.exp(F.lit(-0.5) * sq / (bw * bw))
        if self.name == "laplace":
            return F.exp(-A.l1dist(a, b) / bw)
        r = self.distance(a, b) / bw
        return _matern_col(r, self.nu)

    def diag(self) -> Column:
        # every kernel here is stationary: k(x, x) = 1
        return F.lit(1.0)

    def diag_np(self, X: np.ndarray) -> np.ndarray:
        """k(x, x) per row (1 for the stationary kernels here)."""
        return np.ones(len(X))

    # ---- NumPy block form ------------------------------------------------------
    def block(self, X: np.ndarray, Y: np.ndarray) -> np.ndarray:
        X = np.asarray(X, dtype=np.float64)
        Y = np.asarray(Y, dtype=np.float64)
        if self.metric == "l1":
            return np.exp(-difference_sums(X, Y, np.abs) / self.bandwidth)
        if self.stable:
            sq = difference_sums(X, Y, np.square)
        else:
            sq = (X * X).sum(1)[:, None] + (Y * Y).sum(1)[None, :] - 2.0 * X @ Y.T
            np.maximum(sq, 0.0, out=sq)
        if self.name == "gaussian":
            return np.exp(-0.5 * sq / self.bandwidth ** 2)
        return matern_np(np.sqrt(sq) / self.bandwidth, self.nu)

    def quick_block(self, X: np.ndarray, Y: np.ndarray) -> np.ndarray:
        """``block`` to EXPANSION_ERROR: by the norm expansion, one matrix product, where its rounding stays below that.

        Only the Gaussian: the root in the others' distances makes rounding near zero larger.
        """
        X, Y = np.asarray(X, dtype=np.float64), np.asarray(Y, dtype=np.float64)
        x, y, bw = np.einsum("ij,ij->i", X, X), np.einsum("ij,ij->i", Y, Y), self.bandwidth ** 2
        largest = np.sqrt(x.max(initial=0.0)) + np.sqrt(y.max(initial=0.0))
        if self.name != "gaussian" or not (X.shape[1] + 4) * np.finfo(np.float64).eps * largest ** 2 <= EXPANSION_ERROR * bw:
            return self.block(X, Y)
        out = X @ Y.T
        out -= 0.5 * x[:, None]
        out -= 0.5 * y[None, :]
        np.minimum(out, 0.0, out=out)
        out /= bw
        return np.exp(out, out=out)

    # ---- DuckDB text -------------------------------------------------------------
    def sql(self, a: str, b: str) -> str:
        bw = repr(float(self.bandwidth))
        if self.name == "gaussian":
            return f"exp(-0.5 * {A.sqdist_sql(a, b)} / ({bw} * {bw}))"
        if self.name == "laplace":
            return f"exp(-{A.l1dist_sql(a, b)} / {bw})"
        r = f"(sqrt({A.sqdist_sql(a, b)}) / {bw})"
        if self.nu == 0.5:
            return f"exp(-{r})"
        if self.nu == 1.5:
            return f"((1 + sqrt(3.0) * {r}) * exp(-sqrt(3.0) * {r}))"
        if self.nu == 2.5:
            return f"((1 + sqrt(5.0) * {r} + 5.0 / 3.0 * {r} * {r}) * exp(-sqrt(5.0) * {r}))"
        raise ValueError("general-nu Matérn has no SQL form")


#: Difference in a kernel value, of 1 at most, that the norm expansion may make.
EXPANSION_ERROR = 1e-12
#: Cells of a difference block held at once.
BLOCK_CELLS = 1 << 18


def difference_sums(X: np.ndarray, Y: np.ndarray, size) -> np.ndarray:
    """Σ_j size(x_j − y_j) for all row pairs, one dimension at a time over blocks of rows.

    Each cell adds its dimensions in order, so the value does not depend on the number of
    rows, of pivots or of rows in a block.
    """
    out = np.zeros((len(X), len(Y)))
    step = max(1, BLOCK_CELLS // max(1, len(Y)))
    for a in range(0, len(X), step):
        block = out[a:a + step]
        for j in range(X.shape[1]):
            block += size(X[a:a + step, j, None] - Y[None, :, j])
    return out


def _matern_col(r: Column, nu: float) -> Column:
    if nu == 0.5:
        return F.exp(-r)
    if nu == 1.5:
        s3 = F.lit(math.sqrt(3.0))
        return (F.lit(1.0) + s3 * r) * F.exp(-s3 * r)
    if nu == 2.5:
        s5 = F.lit(math.sqrt(5.0))
        return (F.lit(1.0) + s5 * r + F.lit(5.0 / 3.0) * r * r) * F.exp(-s5 * r)
    return matern_general_udf(float(nu))(r)


# ---- general-nu Matérn (K4) ------------------------------------------------------

#: Arguments up to which the power series at 0 is used, and cells worked on at once.
_SERIES_TO, _CELLS = 2.0, 1 << 16
_EULER = 0.57721566490153286061


def _gamma_pair(mu: float) -> tuple[float, float, float, float]:
    """(Γ₁, Γ₂, 1/Γ(1+μ), 1/Γ(1−μ)) for |μ| ≤ ½, with Γ₁ = (1/Γ(1−μ) − 1/Γ(1+μ)) / 2μ and Γ₂ half their sum."""
    up, down = 1.0 / math.gamma(1.0 + mu), 1.0 / math.gamma(1.0 - mu)
    if abs(mu) > 1e-3:
        return (down - up) / (2.0 * mu), 0.5 * (down + up), up, down
    # 1/Γ(1+x) = 1 + γx + a₂x² + a₃x³ + …: the odd part by x, from the Taylor coefficients
    a3 = _EULER ** 3 / 6.0 - _EULER * math.pi ** 2 / 12.0 + 1.2020569031595942 / 3.0
    return -(_EULER + a3 * mu * mu), 0.5 * (down + up), up, down


def _kv_series(mu: float, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """K_μ and K_{μ+1} for 0 < z ≤ 2 and |μ| ≤ ½: the ascending series with its limit at μ = 0."""
    g1, g2, up, down = _gamma_pair(mu)
    half = 0.5 * z
    log = -np.log(half)
    e = mu * log
    sinhc = np.where(np.abs(e) < 1e-8, 1.0, np.sinh(e) / np.where(e == 0, 1.0, e))
    ratio = 1.0 if abs(mu) < 1e-15 else math.pi * mu / math.sin(math.pi * mu)
    f = ratio * (np.cosh(e) * g1 + sinhc * log * g2)
    p, q = 0.5 * np.exp(e) / up, 0.5 * np.exp(-e) / down
    c, k0, k1 = np.ones_like(z), f.copy(), p.copy()
    square = half * half
    for i in range(1, 60):
        f = (i * f + p + q) / (i * i - mu * mu)
        c = c * square / i
        p, q = p / (i - mu), q / (i + mu)
        more = c * f
        k0 += more
        k1 += c * (p - i * f)
        if np.all(np.abs(more) <= 1e-17 * np.abs(k0)):
            break
    return k0, k1 / half


def _kv_fraction(mu: float, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """K_μ and K_{μ+1}, both times e^z, for z > 2 and |μ| ≤ ½: Steed's continued fraction and its sum."""
    b = 2.0 * (1.0 + z)
    d = 1.0 / b
    h = delta = d.copy()
    a1 = 0.25 - mu * mu
    q1, q2 = np.zeros_like(z), np.ones_like(z)
    q = c = np.full_like(z, a1)
    a = -a1
    s = 1.0 + q * delta
    for i in range(2, 20_000):
        a -= 2 * (i - 1)
        c = -a * c / i
        q1, q2 = q2, (q1 - b * q2) / a
        q = q + c * q2
        b = b + 2.0
        d = 1.0 / (b + a * d)
        delta = (b * d - 1.0) * delta
        h = h + delta
        more = q * delta
        s = s + more
        if np.all(np.abs(more) <= 1e-17 * np.abs(s)):
            break
    k0 = np.sqrt(math.pi / (2.0 * z)) / s
    return k0, k0 * (mu + z + 0.5 - a1 * h) / z


def log_bessel_kv(nu: float, z: np.ndarray) -> np.ndarray:
    """ln K_ν(z) for z > 0: series up to 2, continued fraction beyond, then the upward recurrence in ν.

    Memory is a few numbers a cell; the recurrence carries a scale, so nothing overflows.
    """
    nu = abs(float(nu))
    up = int(nu + 0.5)
    mu = nu - up
    z = np.asarray(z, dtype=np.float64)
    out = np.empty(z.shape)
    flat, res = z.ravel(), out.reshape(-1)
    for lo in range(0, flat.size, _CELLS):
        part = flat[lo:lo + _CELLS]
        small = part <= _SERIES_TO
        k0, k1, scale = np.empty_like(part), np.empty_like(part), np.where(small, 0.0, -part)
        if small.any():
            k0[small], k1[small] = _kv_series(mu, part[small])
        if not small.all():
            k0[~small], k1[~small] = _kv_fraction(mu, part[~small])
        for j in range(1, up + 1):
            k0, k1 = k1, k0 + 2.0 * (mu + j) / part * k1
            size = np.maximum(k1, 1e-300)
            k0, k1, scale = k0 / size, k1 / size, scale + np.log(size)
        res[lo:lo + _CELLS] = np.log(k0) + scale
    return out


def matern_np(r: np.ndarray, nu: float) -> np.ndarray:
    r = np.asarray(r, dtype=np.float64)
    if nu == 0.5:
        return np.exp(-r)
    if nu == 1.5:
        s = math.sqrt(3.0) * r
        return (1 + s) * np.exp(-s)
    if nu == 2.5:
        s = math.sqrt(5.0) * r
        return (1 + s + s * s / 3.0) * np.exp(-s)
    s = math.sqrt(2.0 * nu) * r
    out = np.ones_like(r)  # value 1 at distance 0 (no 0·∞)
    nz = s > 0
    if nz.any():
        sv = np.maximum(s[nz], 1e-150)
        log = (1.0 - nu) * math.log(2.0) - math.lgamma(nu) + nu * np.log(sv) + log_bessel_kv(nu, sv)
        out[nz] = np.minimum(np.exp(log), 1.0)
    return out


def matern_general_udf(nu: float):
    @F.pandas_udf("double")
    def _matern(r: pd.Series) -> pd.Series:
        return pd.Series(matern_np(r.to_numpy(dtype=np.float64), nu))

    return _matern
