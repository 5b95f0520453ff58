"""Sampling, splitting and feature preparation.

Random choices come from the keyed uniform ``u01(id, draw, seed)``: a row's
fate depends on its id alone, so the result is the same for any partitioning,
retry or re-plan, and DuckDB can repeat it.

Exactly-m sampling uses ``orderBy(u).limit(m)``, which Spark plans as
TakeOrderedAndProject: each task keeps its local top m and only m × tasks
rows move, so it is safe for any N as long as m is a sample size (bounded by
the caller), never N itself.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rng
from .ordered import row_numbers
from .partials import SCHEMA as PARTIAL
from .partials import bounded_broadcast, emit, tree_qr, tree_sum

U = "_u"


def with_u(df: DataFrame, key: str = "id", seed: int = 42, draw="sample") -> DataFrame:
    return df.withColumn(U, rng.u01(F.col(key), draw, seed))


# ---- P1, P16: exactly m uniform rows, original order kept --------------------------

def subsample(df: DataFrame, m: int, key: str = "id", seed: int = 42) -> DataFrame:
    """M rows uniformly without replacement (all rows when m ≥ n), sorted by key."""
    s = with_u(df, key, seed).orderBy(F.col(U), F.col(key)).limit(int(m)).drop(U)
    return s.orderBy(key)


def inducing_points(df: DataFrame, m: int, key: str = "id", seed: int = 42) -> DataFrame:
    """m = min(m, n) random inducing points."""
    return subsample(df, m, key, seed)


# ---- P2, P3: stratified subsample ---------------------------------------------------------

def class_quota(n_max: int, ratio: float, min_each_side: bool = False) -> tuple[int, int]:
    """n_pos = max(1, round_half_even(n_max·ratio)), n_neg = n_max − n_pos."""
    n_pos = max(1, int(np.round(n_max * ratio)))
    n_neg = n_max - n_pos
    if min_each_side:
        n_neg = max(1, n_neg)
    return n_pos, n_neg


def stratified_subsample(df: DataFrame, n_max: int, label: str = "y", key: str = "id",
                         seed: int = 42, ratio: float | None = None) -> DataFrame:
    """Per-class quotas from the class ratio (or ``ratio``), capped by availability.

    Quotas: n_pos = max(1, bround(n_max · ratio)), n_neg = n_max − n_pos. Rows of
    each class are ranked by the keyed uniform (bucketed windows, no single
    task), and the first quota rows are kept.
    """
    counts = df.groupBy().agg(F.count(F.lit(1)).alias("n"),
                              F.count_if(F.col(label) == 1).alias("n1")).first()
    n, n1 = int(counts["n"]), int(counts["n1"])
    r = ratio if ratio is not None else (n1 / n if n else 0.0)
    n_pos, n_neg = class_quota(int(n_max), r)
    n_pos, n_neg = min(n_pos, n1), min(n_neg, n - n1)
    ranked = row_numbers(with_u(df, key, seed), [label], [U, key], out="_rk")
    keep = ((F.col(label) == 1) & (F.col("_rk") <= n_pos)) | ((F.col(label) != 1) & (F.col("_rk") <= n_neg))
    return ranked.filter(keep).drop(U, "_rk")


def stratified_or_uniform(df: DataFrame, n_max: int, label: str = "y", key: str = "id",
                          seed: int = 42, min_class: int = 2) -> DataFrame:
    """Stratified when both classes have at least ``min_class`` rows, else uniform."""
    c = df.groupBy().agg(F.count_if(F.col(label) == 1).alias("a"),
                         F.count_if(F.col(label) != 1).alias("b")).first()
    if min(int(c["a"]), int(c["b"])) >= min_class:
        return stratified_subsample(df, n_max, label, key, seed)
    return subsample(df, n_max, key, seed)


# ---- P4, P5: splits -----------------------------------------------------------------------

def train_test_split(df: DataFrame, n_train: int, n_test: int, key: str = "id", seed: int = 42) -> DataFrame:
    """Disjoint random train/test of exact sizes; other rows dropped.

    Rank by the keyed uniform with bucketed row numbers (parallel windows).
    """
    ranked = row_numbers(with_u(df, key, seed), [], [U, key], out="_rk")
    return ranked.filter(F.col("_rk") <= n_train + n_test).withColumn(
        "split", F.when(F.col("_rk") <= n_train, "train").otherwise("test")).drop(U, "_rk")


def head_tail_split(df: DataFrame, key: str = "id", frac: float = 0.8) -> DataFrame:
    """P5: the first int(frac·n) rows by key are train, the rest test."""
    ranked = row_numbers(df, [], [key], out="_rk")
    n = df.count()
    cut = int(frac * n)
    return ranked.withColumn("split", F.when(F.col("_rk") <= cut, "train").otherwise("test")).drop("_rk")


# ---- P6: standardise by train statistics --------------------------------------------------

def feature_moments(df: DataFrame, features: str = "features", where=None) -> DataFrame:
    """Per-dimension mean and population std (dim, mean, std): one vector of partial sums per
    partition, taken about the first row, so that large means don't cost precision."""
    spark = df.sparkSession
    schema = "dim int, mean double, std double"
    src = (df if where is None else df.filter(where)).select(F.col(features).cast("array<double>").alias("x")).filter("x IS NOT NULL")
    head = src.first()
    if head is None:
        return spark.createDataFrame([], schema)
    d = len(head["x"])
    origin = bounded_broadcast(spark, np.array(head["x"]), "first row")

    def part(batches):
        n, s, q = 0, np.zeros(d), np.zeros(d)
        for pdf in batches:
            if len(pdf):
                X = np.stack(pdf["x"].to_numpy()) - origin.value
                n, s, q = n + len(X), s + X.sum(0), q + (X * X).sum(0)
        if n:
            yield emit(np.concatenate([s, q, [float(n)]]))

    vec = tree_sum(src.mapInPandas(part, PARTIAL), 2 * d + 1)
    shift, var = vec[:d] / vec[-1], vec[d:2 * d] / vec[-1] - (vec[:d] / vec[-1]) ** 2
    std = np.sqrt(np.maximum(var, 0.0))
    return spark.createDataFrame(pd.DataFrame({"dim": np.arange(d, dtype=np.int32), "mean": np.array(head["x"]) + shift, "std": std}), schema)


def standardize(df: DataFrame, features: str = "features", split: str = "split", train_value: str = "train",
                min_std: float = 1e-6, out: str = "z") -> DataFrame:
    """(x − mean_train) / std_train per dimension; std < min_std → 1.

    The moments are d-sized (one row per dimension) and are folded into two
    array literals on the driver, so rows only see a per-row zip.
    """
    mom = feature_moments(df, features, F.col(split) == train_value).orderBy("dim").collect()
    mean = [float(r["mean"]) for r in mom]
    std = [float(r["std"]) if r["std"] is not None and r["std"] >= min_std else 1.0 for r in mom]
    mu = F.array(*[F.lit(v) for v in mean])
    sd = F.array(*[F.lit(v) for v in std])
    z = F.zip_with(F.zip_with(F.col(features).cast("array<double>"), mu, lambda x, m: x - m), sd,
                   lambda c, s: c / s)
    return df.withColumn(out, z)


# ---- P10, P11 ----------------------------------------------------------------------------------

def positive_class_weight(df: DataFrame, label: str = "y") -> DataFrame:
    """P10: one row, pos_weight = n_neg / n_pos, 1.0 when a class is empty."""
    a = df.agg(F.count_if(F.col(label) == 1).alias("n_pos"), F.count_if(F.col(label) == 0).alias("n_neg"))
    return a.select("n_pos", "n_neg", F.when((F.col("n_pos") == 0) | (F.col("n_neg") == 0), F.lit(1.0))
                    .otherwise(F.col("n_neg") / F.col("n_pos")).alias("pos_weight"))


def cell_budget_rows(max_n: int, cells: int, d: int) -> int:
    """min(max_n, max(1, cells // d))."""
    return min(int(max_n), max(1, int(cells) // int(d)))


# ---- P12, P13: token pooling and masking on array<array<float>> ----------------------------

def pool_tokens(tokens, mode: str = "cls"):
    """P12: 'cls' = token 0; 'mean' = mean of tokens 1.. (token 0 if only one)."""
    t = F.col(tokens) if isinstance(tokens, str) else tokens
    first = F.element_at(t, 1).cast("array<double>")
    if mode == "cls":
        return first
    rest = F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(1)))
    dim = F.size(first)
    summed = F.aggregate(rest, F.array_repeat(F.lit(0.0), dim),
                         lambda acc, x: F.zip_with(acc, x.cast("array<double>"), lambda a, b: a + b))
    mean = F.transform(summed, lambda v: v / (F.size(t) - 1))
    return F.when(F.size(t) > 1, mean).otherwise(first)


def mask_tokens(df: DataFrame, tokens: str, key: str = "id", ratio: float = 0.5, seed: int = 42) -> DataFrame:
    """Keep max(1, round_half_even(n·(1 − ratio))) tokens with the smallest keyed scores.

    Output: ``kept_idx`` (0-based positions in score order), ``kept`` (those
    tokens, same order) and ``dropped`` (boolean per position, true where dropped).
    """
    n = F.size(tokens)
    n_keep = F.greatest(F.lit(1), F.bround(n * F.lit(1.0 - ratio)).cast("int"))
    scored = F.transform(F.sequence(F.lit(0), n - 1),
                         lambda i: F.struct(rng.u01(F.col(key), F.concat(F.lit("tok"), i.cast("string")), seed)
                                            .alias("u"), i.alias("i")))
    chosen = F.slice(F.array_sort(scored), 1, n_keep)
    kept = F.transform(chosen, lambda s: s["i"])
    return df.withColumn("kept_idx", kept) \
        .withColumn("kept", F.transform(F.col("kept_idx"), lambda i: F.element_at(F.col(tokens), i + 1))) \
        .withColumn("dropped", F.transform(F.sequence(F.lit(0), n - 1), lambda i: ~F.array_contains(F.col("kept_idx"), i)))


# ---- P7–P9: PCA ------------------------------------------------------------------------------

def pca_fit(df: DataFrame, dim: int, features: str = "features", where=None):
    """Exact PCA on the (train) rows in one pass, by a tree of QR factorisations.

    The rows are [1, x − x₀] with x₀ the first row: in R = [[√n, √n·m], [0, R_c]] the block R_c
    is the triangle of the centred rows, so no product of means is subtracted from a Gram
    matrix, and the SVD of R_c gives components and variances.

    Returns (components k×d, mean d, explained_variance_ratio k).
    """
    src = (df if where is None else df.filter(where)).select(F.col(features).cast("array<double>").alias("x"))
    start = src.first()
    if start is None:
        raise ValueError("fewer rows than components")
    shift = np.array(start["x"], dtype=np.float64)
    d = len(shift)
    if not 1 <= dim <= d:
        raise ValueError(f"dim must be in [1, {d}]")

    def rows(pdf):
        X = np.stack(pdf["x"].to_numpy()) - shift
        return np.column_stack([np.ones(len(X)), X])

    R = tree_qr(src, d + 1, rows)
    n = round(R[0, 0] ** 2)
    if n < dim:
        raise ValueError("fewer rows than components")
    mean = shift + R[0, 1:] / R[0, 0]
    _, s, V = np.linalg.svd(R[1:, 1:])
    w, comps = s * s / max(n - 1, 1), V[:dim]
    # deterministic sign: largest-magnitude entry of each component positive
    signs = np.sign(comps[np.arange(dim), np.argmax(np.abs(comps), axis=1)])
    comps = comps * signs[:, None]
    ratio = w[:dim] / w.sum() if w.sum() > 0 else np.zeros(dim)
    return comps, mean, ratio


def pca_transform(df: DataFrame, components: np.ndarray, mean: np.ndarray, features: str = "features",
                  out: str = "projected") -> DataFrame:
    """(x − mean)·componentsᵀ per row: components and mean are broadcast, each Arrow
    batch is centred once and multiplied by BLAS. A null feature array projects to null."""
    W = bounded_broadcast(df.sparkSession, np.vstack([np.asarray(components, dtype=np.float64), np.asarray(mean, dtype=np.float64)]), "projection")

    @F.pandas_udf("array<double>")
    def project(x: pd.Series) -> pd.Series:
        ok = x.notna()
        res = pd.Series([None] * len(x), index=x.index, dtype=object)
        if ok.any():
            rows = (np.stack(x[ok].to_numpy()) - W.value[-1]) @ W.value[:-1].T
            res[ok] = pd.Series(list(rows), index=x.index[ok])
        return res

    return df.withColumn(out, project(F.col(features).cast("array<double>")))


# ---- P14, P15: batch feature extraction from binary rows -------------------------------------

def byte_histogram_model(bins: int = 16):
    """A toy pluggable model: normalised histogram of byte values (fixed output dim)."""
    def make():
        def predict(contents: np.ndarray) -> np.ndarray:
            out = np.zeros((len(contents), bins), dtype=np.float32)
            for i, c in enumerate(contents):
                b = np.frombuffer(bytes(c), dtype=np.uint8)
                if b.size:
                    h = np.bincount(b // (256 // bins), minlength=bins)[:bins]
                    out[i] = h / b.size
            return out
        return predict
    return make


def extract_features(df: DataFrame, content: str = "content", make_fn=None, dim: int = 16,
                     batch_size: int = 256, out: str = "features"):
    """Run a model over binary rows in Arrow batches (predict_batch_udf)."""
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import ArrayType, FloatType

    make_fn = make_fn or byte_histogram_model(dim)
    udf = predict_batch_udf(make_fn, return_type=ArrayType(FloatType()), batch_size=batch_size)
    return df.withColumn(out, udf(F.col(content)))


def pending_rows(src: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows not yet in the output (left anti join), so a rerun redoes only those."""
    return src.join(done.select(key), key, "left_anti")


# ---- L20: weighted draws --------------------------------------------------------------------

def weighted_sample(df: DataFrame, weight: str, k: int, key: str = "id", seed: int = 42,
                    replace: bool = False) -> DataFrame:
    """k draws with probability ∝ ``weight`` (rows with weight ≤ 0 never drawn).

    Without replacement: Gumbel top-k, i.e. ``orderBy(ln w + G(id)).limit(k)``
    (TakeOrdered: k rows per task move). With replacement: k independent
    Gumbel-max draws as k ``max_by`` aggregates in ONE pass (partial
    aggregation per task). Keys are md5-keyed, so the draw is repeatable and
    partition-independent.
    """
    w = F.col(weight).cast("double")
    src = df.filter(w > 0)
    if not replace:
        g = F.log(w) + rng.gumbel(F.col(key), "wor", seed)
        return src.select(key, weight, g.alias("_g")).orderBy(F.col("_g").desc(), F.col(key)).limit(int(k)) \
            .drop("_g")
    aggs = [F.max_by(F.col(key), F.log(w) + rng.gumbel(F.col(key), j, seed)).alias(f"d{j}") for j in range(int(k))]
    row = src.agg(*aggs)
    return row.select(F.explode(F.array(*[F.struct(F.lit(j).alias("draw"), F.col(f"d{j}").alias(key))
                                          for j in range(int(k))])).alias("_d")).select("_d.draw", f"_d.{key}")
