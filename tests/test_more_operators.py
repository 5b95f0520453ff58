"""Null-pivot skipping, weighted draw frequencies, manifest trim, float32 cache."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kernelspark.functions.kernels import KernelSpec
from kernelspark.operators import lowrank as L
from kernelspark.operators import prep as P
from kernelspark.operators import quality as Q


def test_uniform_skips_null_pivots(spark):
    # 6 distinct points, each duplicated: after a point is a pivot its twin has zero residual
    base = [[0.0], [1.0], [2.5], [4.0], [6.0], [9.0]]
    rows = [(i, base[i % 6]) for i in range(12)]
    pts = spark.createDataFrame(rows, "id long, features array<double>")
    fac = L.uniform_cholesky(pts, KernelSpec("gaussian", 1.0), 10)
    picked = [base[p.id % 6][0] for p in fac.pivots]
    assert len(picked) == 6 and len(set(picked)) == 6          # twins skipped, only 6 usable pivots
    assert fac.errors[-1] < 1e-10


def test_weighted_sample_frequencies(spark):
    w = [1.0, 2.0, 3.0, 4.0]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(w)], "id long, w double")
    counts = np.zeros(4)
    for seed in range(40):
        for r in P.weighted_sample(df, "w", 10, seed=seed, replace=True).collect():
            counts[r.id] += 1
    expected = 400 * np.array(w) / sum(w)
    assert ((counts - expected) ** 2 / expected).sum() < 16.27        # χ², 3 dof, p = 0.001
    wor = P.weighted_sample(df, "w", 3, seed=1).collect()
    assert len({r.id for r in wor}) == 3                               # without replacement: distinct


def test_trim_manifest(spark):
    m = spark.createDataFrame([(i, f"images/{i}.png") for i in range(8)], "row_idx long, image string")
    done = spark.createDataFrame([(5,)], "completed long")
    assert sorted(r.row_idx for r in Q.trim_manifest(m, done).collect()) == [0, 1, 2, 3, 4]


def test_float32_points_keep_their_type(spark):
    rng = np.random.default_rng(2)
    X = rng.standard_normal((50, 3)).astype(np.float32)
    pts = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(X)],
                                "id long, features array<float>")
    a = L.pivoted_cholesky(pts, KernelSpec("gaussian", 1.0), 6, "greedy")
    b = L.pivoted_cholesky(pts.select("id", F.col("features").cast("array<double>").alias("features")),
                           KernelSpec("gaussian", 1.0), 6, "greedy")
    assert str(a.points.schema["x"].dataType) == "ArrayType(FloatType(), True)"
    assert [p.id for p in a.pivots] == [p.id for p in b.pivots]
    assert a.errors == pytest.approx(b.errors, abs=1e-12)
