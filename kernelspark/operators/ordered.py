"""Running sums over an ordered key without a single-task global window.

A plain ``Window.orderBy(score)`` with no partition moves every row to one
task. Here the order column is first cut into ``n_buckets`` ranges from
approximate quantiles (one aggregate pass; boundaries only steer the layout,
so their accuracy never affects results). Each (group, bucket) runs its own
window in parallel, and the carried offset of all earlier buckets comes from
a per-bucket total table of at most groups × n_buckets rows.

Callers pass tables already aggregated to one row per distinct order value,
so a hot score value is a single row, never a hot partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BKT = "_bkt"


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner",
                   broadcast_right: bool = False) -> DataFrame:
    """Join on ``keys`` treating NULL = NULL (group keys may be null)."""
    keys = list(keys)
    if not keys:
        r = F.broadcast(right) if broadcast_right else right
        return left.crossJoin(r) if how == "inner" else left.join(r, how=how)
    r = right
    for k in keys:
        r = r.withColumnRenamed(k, f"__r_{k}")
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(r[f"__r_{k}"])
        cond = c if cond is None else cond & c
    if broadcast_right:
        r = F.broadcast(r)
    out = left.join(r, cond, how)
    return out.drop(*[f"__r_{k}" for k in keys])


TARGET_BUCKET_ROWS = 2_000_000     # rows per (group, bucket) window task, at most about this
MAX_BUCKETS = 1 << 17


def quantile_boundaries(df: DataFrame, order: str, n_buckets: int,
                        target_rows: int | None = None) -> list[float]:
    """Strictly increasing inner cut points.

    One aggregate returns the row count and ``n_buckets`` approximate
    quantiles. When that would leave more than ``target_rows`` rows per
    bucket, the bucket count grows with the data: finer cut points come from
    a bounded keyed sample (≈ 20 values per bucket), the same way a range
    partitioner picks its bounds. Cut points only steer layout, never results.
    """
    if n_buckets <= 1:
        return []
    target_rows = target_rows or TARGET_BUCKET_ROWS
    fr = [i / n_buckets for i in range(1, n_buckets)]
    col = F.col(order).cast("double")
    row = df.select(col.alias("_o")).agg(F.count("_o").alias("n"),
                                         F.percentile_approx("_o", fr, 10 * n_buckets + 100).alias("q")).first()
    if row is None or not row["n"]:
        return []
    n = int(row["n"])
    if n > n_buckets * target_rows:
        import numpy as np

        want = min(MAX_BUCKETS, -(-n // target_rows))
        frac = min(1.0, 20.0 * want / n)
        vals = np.array([r[0] for r in df.select(col.alias("_o")).filter(F.col("_o").isNotNull())
                         .sample(False, frac, seed=17).collect()], dtype=np.float64)   # ≈ 20·want values
        qs = list(np.quantile(vals, np.arange(1, want) / want)) if len(vals) else []
    else:
        qs = row["q"] or []
    out: list[float] = []
    for q in qs:
        if q is not None and (not out or q > out[-1]):
            out.append(float(q))
    return out


def bucketize(df: DataFrame, order: str, bounds: Sequence[float], out: str = BKT) -> DataFrame:
    """Bucket index = number of boundaries ≤ value (JVM binary search)."""
    if not bounds:
        return df.withColumn(out, F.lit(0))
    from pyspark.ml.feature import Bucketizer

    splits = [float("-inf")] + list(bounds) + [float("inf")]
    tmp = f"{out}_d"
    b = Bucketizer(splits=splits, inputCol=tmp, outputCol=out, handleInvalid="keep")
    return b.transform(df.withColumn(tmp, F.col(order).cast("double"))).drop(tmp) \
        .withColumn(out, F.col(out).cast("int"))


def prefix_sums(df: DataFrame, keys: Sequence[str], order: str, values: Sequence[str],
                descending: bool = True, n_buckets: int = 64,
                with_next: bool = False) -> DataFrame:
    """Add ``cum_<v>`` (inclusive running sum of v in the given order, per keys).

    With ``with_next`` also add ``next_<v>``: v of the following row in the
    order (null for the last row of a key).
    """
    keys = list(keys)
    values = list(values)
    bounds = quantile_boundaries(df, order, n_buckets)
    b = bucketize(df, order, bounds)
    bkt_order = F.col(BKT).desc() if descending else F.col(BKT).asc()
    row_order = F.col(order).desc() if descending else F.col(order).asc()

    aggs = [F.sum(v).alias(f"_t_{v}") for v in values]
    if with_next:
        # first row of each bucket in the traversal order
        pick = F.max_by if descending else F.min_by
        aggs += [pick(F.col(v), F.col(order)).alias(f"_f_{v}") for v in values]
    tot = b.groupBy(*keys, BKT).agg(*aggs)
    wb = Window.partitionBy(*keys).orderBy(bkt_order)
    sel = [F.col(k) for k in keys] + [F.col(BKT)]
    sel += [F.coalesce(F.sum(f"_t_{v}").over(wb.rowsBetween(Window.unboundedPreceding, -1)),
                       F.lit(0)).alias(f"_o_{v}") for v in values]
    if with_next:
        sel += [F.lead(f"_f_{v}").over(wb).alias(f"_n_{v}") for v in values]
    tot = tot.select(*sel)

    # groups × buckets rows; with no keys it is ≤ n_buckets rows, a proven bound
    j = join_null_safe(b, tot, keys + [BKT], broadcast_right=not keys)
    w = Window.partitionBy(*keys, BKT).orderBy(row_order)
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = j
    for v in values:
        out = out.withColumn(f"cum_{v}", F.col(f"_o_{v}") + F.sum(v).over(run))
        if with_next:
            out = out.withColumn(f"next_{v}", F.coalesce(F.lead(v).over(w), F.col(f"_n_{v}")))
    drop = [f"_o_{v}" for v in values] + ([f"_n_{v}" for v in values] if with_next else [])
    return out.drop(*drop, BKT)


def row_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "rn",
                n_buckets: int = 64) -> DataFrame:
    """``row_number()`` per keys over a (unique) composite order, bucketed.

    ``order`` columns must make rows unique within keys; the first order
    column drives the range buckets.
    """
    keys = list(keys)
    order = list(order)
    bounds = quantile_boundaries(df, order[0], n_buckets)
    b = bucketize(df, order[0], bounds)
    tot = b.groupBy(*keys, BKT).agg(F.count(F.lit(1)).alias("_t"))
    wb = Window.partitionBy(*keys).orderBy(BKT)
    tot = tot.select(*keys, BKT, F.coalesce(F.sum("_t").over(wb.rowsBetween(Window.unboundedPreceding, -1)),
                                             F.lit(0)).alias("_o"))
    j = join_null_safe(b, tot, keys + [BKT], broadcast_right=not keys)
    w = Window.partitionBy(*keys, BKT).orderBy(*[F.col(c) for c in order])
    return j.withColumn(out, F.col("_o") + F.row_number().over(w)).drop("_o", BKT)


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, qs: Sequence[float],
                    names: Sequence[str] | None = None, n_buckets: int = 64) -> DataFrame:
    """Exact linear-interpolation quantiles per keys (NumPy 'linear' / quantile_cont).

    No group is collected into one buffer: distinct values are counted first (a
    hot value is one row), their counts run through bucketed prefix sums, and the
    two values around each target rank are picked.
    """
    keys = list(keys)
    names = list(names) if names else [f"q{int(round(q * 100)):02d}" for q in qs]
    d = df.select(*keys, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    counted = d.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))   # a hot value is one row
    r = prefix_sums(counted, keys, "_v", ["_c"], descending=False, n_buckets=n_buckets)
    n = counted.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    j = join_null_safe(r, n, keys, broadcast_right=not keys)
    aggs = []
    for q, nm in zip(qs, names):
        h = (F.col("_n") - 1) * F.lit(float(q))
        for side, at in (("lo", F.floor(h)), ("hi", F.ceil(h))):
            aggs.append(F.max(F.when((F.col("cum__c") - F.col("_c") <= at) & (at < F.col("cum__c")), F.col("_v"))).alias(f"_{side}_{nm}"))
        aggs.append(F.max(h - F.floor(h)).alias(f"_fr_{nm}"))
    a = j.groupBy(*keys).agg(*aggs)
    return a.select(*keys, *[(F.col(f"_lo_{nm}") + (F.col(f"_hi_{nm}") - F.col(f"_lo_{nm}")) * F.col(f"_fr_{nm}"))
                             .alias(nm) for nm in names])
