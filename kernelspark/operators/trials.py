"""Benchmark trials, sweeps and the results log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import exact_quantiles


def trial_stats(df: DataFrame, keys=("method", "k"), value: str = "sec") -> DataFrame:
    """B1: mean and population std per configuration."""
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"),
                                 F.count(F.lit(1)).alias("n_trials"))


def trial_bands(df: DataFrame, keys=("method", "k"), value: str = "sec") -> DataFrame:
    """B2: median and 20/80 percentile band per configuration (exact, distributed)."""
    return exact_quantiles(df, list(keys), value, [0.2, 0.5, 0.8], ["q20", "median", "q80"])


def method_ratio(df: DataFrame, numerator: str, denominator: str, by: str = "k", method: str = "method",
                 value: str = "sec", metric: str = "ratio") -> DataFrame:
    """Per ``by``, pivot the methods' means and return num/den (NULL when den ≤ 0)."""
    p = df.groupBy(by).pivot(method, [numerator, denominator]).agg(F.avg(value))
    return p.select(by, F.col(f"`{numerator}`").alias("num_mean"), F.col(f"`{denominator}`").alias("den_mean"),
                    F.when(F.col(f"`{denominator}`") > 0, F.col(f"`{numerator}`") / F.col(f"`{denominator}`"))
                    .alias(metric))


def sweep_grid(sizes: DataFrame, methods: DataFrame, n: str = "n", method: str = "method",
               skip_method: str = "basic", skip_above: int = 10000, k_floor: int = 50, k_div: int = 50) -> DataFrame:
    """Sizes × methods with k = max(50, N // 50); the skipped method is dropped above N = 10000.

    Both sides are small parameter tables (one row per size / method); the
    methods side is broadcast.
    """
    g = sizes.select(n).join(F.broadcast(methods.select(method)), how="inner")
    g = g.filter(~((F.col(method) == skip_method) & (F.col(n) > skip_above)))
    return g.withColumn("k", F.greatest(F.lit(k_floor), F.floor(F.col(n) / k_div)).cast("long"))


def latest_results(log: DataFrame, keys: Sequence[str], ts: str = "run_timestamp_utc",
                   fields: Sequence[str] = (), tie: str | None = None) -> DataFrame:
    """The newest row per key; blank strings → NULL, numeric fields cast to double.

    A ``max_by`` aggregate (partial aggregation per task), not a window, so a
    key holding a third of the log is combined map-side, never sorted in one task.
    """
    order = F.struct(F.col(ts), *([F.col(tie)] if tie else []))
    payload = F.struct(F.col(ts).alias("_ts"), *[F.col(f).alias(f) for f in fields])
    r = log.groupBy(*keys).agg(F.max_by(payload, order).alias("_row"))
    return r.select(*keys, F.col("_row._ts").alias(ts),
                    *[F.nullif(F.trim(F.col(f"_row.{f}").cast("string")), F.lit("")).try_cast("double").alias(f)
                      for f in fields])
