"""Kernel operators over embedding tables.

The kernel matrix is never materialised. Rows meet either a second row by an
explicit pairing (aligned rows, K5), a small broadcast side whose size is
checked (pivots, a bounded sample: K6–K8, K10–K12), or a single driver
vector. Pair tables exist only for sides with a proven bound.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions.kernels import KernelSpec, difference_sums
from ..session import checkpoint_table
from . import grid, prep
from .ordered import exact_quantiles
from .partials import SCHEMA as PARTIAL
from .partials import bounded_broadcast, emit, tree_sum

# A broadcast side is allowed only below this many rows × dims (doubles).
from .partials import MAX_BROADCAST_CELLS  # noqa: E402  (one shared bound)


def _check_small(df: DataFrame, what: str, max_rows: int | None = None, dim: int | None = None) -> int:
    n = df.count()
    if max_rows is not None and n > max_rows:
        raise ValueError(f"{what}: {n} rows exceeds the broadcast bound {max_rows}")
    if dim is not None and n * dim > MAX_BROADCAST_CELLS:
        raise ValueError(f"{what}: {n}×{dim} exceeds the broadcast bound of {MAX_BROADCAST_CELLS} cells")
    return n


# ---- K5: aligned rows --------------------------------------------------------------

def aligned_kernel(left: DataFrame, right: DataFrame, kernel: KernelSpec, key: str = "id",
                   features: str = "features") -> DataFrame:
    """K5: k(x_i, y_i) for rows paired by ``key`` (one value per pair)."""
    l_ = left.select(key, F.col(features).cast("array<double>").alias("_a"))
    r_ = right.select(key, F.col(features).cast("array<double>").alias("_b"))
    return l_.join(r_, key).select(key, kernel.point("_a", "_b").alias("k"))


# ---- K6, K7, K8: block against a small side ---------------------------------------------

def kernel_block(points: DataFrame, centers: DataFrame, kernel: KernelSpec, key: str = "id",
                 features: str = "features", center_key: str = "id", out: str = "k") -> DataFrame:
    """K6: per row, the vector k(x, c_1..c_m) against m broadcast centers.

    The centers (m × d) are checked against the broadcast bound, collected
    once, and every Arrow batch of rows computes its m-wide block by BLAS.
    """
    dim = len(centers.select(features).first()[0])
    _check_small(centers, "kernel_block centers", dim=dim)
    crow = centers.select(center_key, F.col(features).cast("array<double>").alias("f")).orderBy(center_key).collect()
    C = np.array([r["f"] for r in crow], dtype=np.float64)
    bc = bounded_broadcast(points.sparkSession, C, "kernel_block centers")
    schema = f"{key} long, {out} array<double>"

    def fn(batches):
        Cm = bc.value
        for pdf in batches:
            if len(pdf) == 0:
                continue
            X = np.stack(pdf[features].to_numpy())
            Kb = kernel.block(X, Cm)
            yield pd.DataFrame({key: pdf[key].astype("int64"), out: list(Kb)})

    return points.select(F.col(key).cast("long").alias(key), F.col(features).cast("array<double>")
                         .alias(features)).mapInPandas(fn, schema)


def cross_kernel_long(left: DataFrame, right: DataFrame, kernel: KernelSpec, key: str = "id",
                      features: str = "features") -> DataFrame:
    """K7: long form (i, j, k) of two tables of any size, on a grid of block pairs."""
    return grid.long_form(left, right, kernel.block, key, features)


def out_of_sample(test: DataFrame, train: DataFrame, chosen: DataFrame, kernel: KernelSpec,
                  key: str = "id", features: str = "features") -> DataFrame:
    """K8: kernel of test rows against chosen train rows (a semi-join picks them)."""
    centers = train.join(chosen.select(key), key, "left_semi")
    return kernel_block(test, centers, kernel, key, features)


# ---- K9: diagonal and trace ------------------------------------------------------------------

def diagonal(points: DataFrame, kernel: KernelSpec, key: str = "id", features: str = "features") -> DataFrame:
    x = F.col(features).cast("array<double>")
    return points.select(key, kernel.point(x, x).alias("diag"))


def trace(points: DataFrame, kernel: KernelSpec, key="id", features="features") -> DataFrame:
    return diagonal(points, kernel, key, features).agg(F.sum("diag").alias("trace"), F.count(F.lit(1)).alias("n"))


# ---- K10, K11: median heuristic ------------------------------------------------------------------

def distance_block(kernel: KernelSpec, X: np.ndarray, Y: np.ndarray) -> np.ndarray:
    return difference_sums(X, Y, np.abs) if kernel.metric == "l1" else np.sqrt(difference_sums(X, Y, np.square))


def median_bandwidth(points: DataFrame, kernel: KernelSpec, key: str = "id", features: str = "features",
                     include_self: bool = True) -> DataFrame:
    """Median of all ordered pairwise distances (diagonal included by default), at any number of rows.

    The rows are stored once and meet on a grid of block pairs. The median is selected on the
    bits of the distance (their order is that of the doubles): each of four passes counts 16 more
    bits of the distances that share the bits found so far, one count vector a task, so no pair is
    ever emitted. ``(bandwidth, n_pairs)``; both null without rows.
    """
    spark = points.sparkSession
    side = grid.stored_side(points, key, features)
    n, pairs = grid.self_cells(side)
    total = n * n if include_self else n * (n - 1)
    if not total:
        return spark.createDataFrame([(None, None)], "bandwidth double, n_pairs long")
    skip = 0 if include_self else n                        # the diagonal's zeros come first
    ranks = [skip + (total - 1) // 2, skip + total // 2]    # the two middle ones, equal if there is one
    found, below = [0, 0], [0, 0]                          # bits so far, pairs below them
    for shift in (48, 32, 16, 0):
        known = sorted(set(found))
        sent = spark.sparkContext.broadcast((known, shift))

        def part(batches):
            known, shift = sent.value
            acc = np.zeros((len(known), 1 << 16))
            for same, X, Y in grid.block_pairs(batches):
                bits = distance_block(kernel, X, Y).ravel().view(np.int64)
                for s, top in enumerate(known):
                    own = bits[(bits >> shift) >> 16 == top] if shift < 48 else bits
                    acc[s] += (1 if same else 2) * np.bincount((own >> shift) & 0xFFFF, minlength=1 << 16)
            yield emit(acc.ravel())

        counts = tree_sum(pairs.mapInArrow(lambda b: map(pa.RecordBatch.from_pandas, part(b)), PARTIAL), len(known) << 16).reshape(len(known), -1)
        for i, rank in enumerate(ranks):
            upto = below[i] + np.cumsum(counts[known.index(found[i])])
            at = int(np.searchsorted(upto, rank, side="right"))
            below[i] = int(upto[at - 1]) if at else below[i]
            ranks[i], found[i] = rank, found[i] << 16 | at
        sent.destroy()
    low, high = np.array(found, dtype=np.int64).view(np.float64)
    return spark.createDataFrame([(float(low + (high - low) * 0.5), int(total))], "bandwidth double, n_pairs long")


def pair_distance(pairs: DataFrame, points: DataFrame, kernel: KernelSpec, key: str = "id", features: str = "features") -> DataFrame:
    """(i, j, dist) of a caller's pairs by two equi-joins; any number of rows and pairs."""
    x = points.select(F.col(key), F.col(features).cast("array<double>").alias("_x"))
    j = pairs.select("i", "j").join(x.select(F.col(key).alias("i"), F.col("_x").alias("_a")), "i") \
        .join(x.select(F.col(key).alias("j"), F.col("_x").alias("_b")), "j")
    return j.select("i", "j", kernel.distance("_a", "_b").alias("dist"))


def median_of_pairs(pairs: DataFrame, points: DataFrame, kernel: KernelSpec, key: str = "id", features: str = "features") -> DataFrame:
    """K10 over a pair table: the exact median distance of the pairs, by bucketed ranks."""
    d = checkpoint_table(pair_distance(pairs, points, kernel, key, features), pairs.sparkSession, "pair-distances")
    q = exact_quantiles(d, [], "dist", [0.5], names=["bandwidth"])
    return q.crossJoin(d.agg(F.count(F.lit(1)).alias("n_pairs")))        # two one-row tables


def approx_median_bandwidth(points: DataFrame, kernel: KernelSpec, key: str = "id", features: str = "features",
                            m: int = 1000, seed: int = 42) -> DataFrame:
    """The median heuristic on m = min(1000, n) keyed-random rows."""
    s = prep.subsample(points.select(key, features), m, key, seed)
    return median_bandwidth(s, kernel, key, features)


def bandwidth_value(points: DataFrame, kernel: KernelSpec, **kw) -> float:
    return float(approx_median_bandwidth(points, kernel, **kw).first()["bandwidth"])


# ---- K12, K13, K15 ----------------------------------------------------------------------------------

def pivot_submatrix(pivots: DataFrame, kernel: KernelSpec, key: str = "id", features: str = "features",
                    rank: str = "rank") -> DataFrame:
    """K_PP in long form (i, j, v) for ranked pivots, symmetrised ½(K + Kᵀ)."""
    both = lambda X, Y: 0.5 * (kernel.block(X, Y) + kernel.block(Y, X).T)
    return grid.long_form(pivots, pivots, both, rank, features, ("i", "j", "v"))


def kernel_queries(n_rows: Column | int, n_pivots: Column | int) -> Column:
    """Kernel entries evaluated by a factor pass (rows × pivots + diagonal)."""
    r = n_rows if isinstance(n_rows, Column) else F.lit(int(n_rows))
    k = n_pivots if isinstance(n_pivots, Column) else F.lit(int(n_pivots))
    return (r * k + r).cast("long")


# ---- K16: user kernels ---------------------------------------------------------------------------

class UserKernel(KernelSpec):
    """A caller-supplied kernel: a Column function for pairs of array columns
    and a NumPy block function; the diagonal defaults to point(x, x)."""

    def __init__(self, point_fn: Callable[[Column, Column], Column],
                 block_fn: Callable[[np.ndarray, np.ndarray], np.ndarray], name: str = "user"):
        object.__setattr__(self, "name", "gaussian")   # passes validation; behaviour overridden below
        object.__setattr__(self, "bandwidth", 1.0)
        object.__setattr__(self, "nu", 0.5)
        object.__setattr__(self, "stable", True)
        object.__setattr__(self, "_point", point_fn)
        object.__setattr__(self, "_block", block_fn)
        object.__setattr__(self, "label", name)

    def point(self, a, b) -> Column:
        return self._point(A.col(a), A.col(b))

    def block(self, X, Y):
        return np.asarray(self._block(np.asarray(X, dtype=np.float64), np.asarray(Y, dtype=np.float64)))

    def quick_block(self, X, Y):
        return self.block(X, Y)

    def diag(self) -> Column:
        return None  # callers use point(x, x)

    def diag_np(self, X):
        X = np.asarray(X, dtype=np.float64)
        return np.array([float(self.block(x[None, :], x[None, :])[0, 0]) for x in X])

    def sql(self, a, b):
        raise ValueError("user kernels have no SQL form")


def kernel_diag_col(kernel: KernelSpec, x: Column) -> Column:
    d = kernel.diag()
    return kernel.point(x, x) if d is None else d


def point_kernel_col(kernel: KernelSpec, a, b: Sequence[float]) -> Column:
    """k(x, v) for a row column ``a`` and a driver vector ``v``."""
    return kernel.point(A.col(a), A.lit_vector(b))


class ResidualKernel(UserKernel):
    """k_res(z, z') = k(x, x') − F(x)·F(x') on rows z = [x (d values), F(x) (k values)].

    The conditional (residual) kernel left after a low-rank factor; used to
    factor a predictive covariance implicitly, never as a matrix (R5).
    """

    def __init__(self, base: KernelSpec, d: int):
        def blk(Z1, Z2):
            return base.block(Z1[:, :d], Z2[:, :d]) - Z1[:, d:] @ Z2[:, d:].T
        super().__init__(lambda a, b: None, blk, name="residual")
        object.__setattr__(self, "_base", base)
        object.__setattr__(self, "_d", d)

    def diag_np(self, X):
        X = np.asarray(X, dtype=np.float64)
        return np.maximum(self._base.diag_np(X[:, :self._d]) - (X[:, self._d:] ** 2).sum(1), 0.0)
