"""Chain diagnostics (D1–D14): autocorrelation, integrated time, ESS, R-hat.

Chains are long tables ``(keys…, step, x)``: one row per (chain, dimension, step). A query
reads them once: steps are packed into stored segments of ``segment`` steps (one row each, with
count, mean and variance), and everything else works on segments. For a block of lags as wide
as a segment, a segment meets the two that lie that far ahead (overlap-save), and one FFT
product gives all lags of the block; a task holds three segments whatever the chain or lag.
Per-lag partial sums are then added across segments.

The integrated time (D3) needs the autocorrelation only up to its window
(m ≥ c·τ(m)); lags are computed in growing ranges until every key's
window is found or the chain length is reached, so the result is exact
without fixing a lag cap in advance.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint_table

# Fixed values that must equal the reference's.
TAU_WINDOW_C = 5.0                 # auto-window constant
SHORT_CHAIN_FACTOR = 50.0                # warn when n < 50 τ
VAR_FLOOR = 1e-12                  # ACF of a flat chain is 0
RHAT_PASS, RHAT_MARGINAL = 1.01, 1.05
ACCEPT_BANDS = {"rwm": (0.15, 0.35), "mala": (0.45, 0.70), "hmc": (0.70, 0.90)}
TAU_PREFIXES = (500, 1000, 2000, 3000, 5000)


def _k(keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def moments(df: DataFrame, keys, x: str = "x") -> DataFrame:
    return df.groupBy(*_k(keys)).agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean"),
                                     F.var_pop(x).alias("var"))


@dataclass
class Segments:
    """Stored segments (keys…, _seg, _t, _v) of chains and the (n, mean, var) of each key."""

    table: DataFrame
    moments: DataFrame
    keys: list
    size: int


def segments(df: DataFrame, keys, step: str = "step", x: str = "x", segment: int = 4096) -> Segments:
    """The one pass over the rows."""
    keys, B = _k(keys), int(segment)
    t = F.col(step).cast("long")
    cut = df.select(*keys, F.floor(t / B).cast("long").alias("_seg"), F.pmod(t, F.lit(B)).cast("int").alias("_t"), F.col(x).cast("double").alias("_v"))
    packed = cut.groupBy(*keys, "_seg").agg(F.collect_list(F.struct("_t", "_v")).alias("_r"), F.count(F.lit(1)).alias("_n"), F.avg("_v").alias("_m"), F.var_pop("_v").alias("_q"))
    raw = checkpoint_table(packed.select(*keys, "_seg", F.col("_r._t").alias("_t"), F.col("_r._v").alias("_v"), "_n", "_m", "_q"), df.sparkSession, "chain-segments")
    centre = raw.groupBy(*keys).agg(F.sum("_n").alias("n"), (F.sum(F.col("_n") * F.col("_m")) / F.sum("_n")).alias("mean"))
    gap = F.col("_m") - F.col("mean")
    mom = raw.select(*keys, "_n", "_m", "_q").join(centre, keys).groupBy(*keys).agg(
        F.first("n").alias("n"), F.first("mean").alias("mean"), (F.sum(F.col("_n") * (F.col("_q") + gap * gap)) / F.sum("_n")).alias("var"))
    return Segments(raw.select(*keys, "_seg", "_t", "_v"), mom, keys, B)     # moments: a row per segment is read


def _correlate(ahead: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Σ_i ahead[i + l]·base[i] for every l that fits; by FFT unless there are few."""
    width = len(ahead) - len(base) + 1
    if width <= 64:
        return np.correlate(ahead, base, "valid")
    m = 1 << (len(ahead) - 1).bit_length()        # lags that fit don't wrap round
    return np.fft.irfft(np.fft.rfft(ahead, m) * np.conj(np.fft.rfft(base, m)), m)[:width]


def segment_lag_sums(st: Segments, max_lag: int, lag_from: int = 0, only: DataFrame | None = None) -> DataFrame:
    """``lag_sums`` of stored segments, perhaps of some keys only."""
    keys, B, lo, hi = st.keys, st.size, int(lag_from), int(max_lag)
    table = st.table if only is None else st.table.join(only.select(*keys), keys, "left_semi")
    seg, blocks = F.col("_seg"), F.sequence(F.lit(lo // B), F.lit(hi // B)).cast("array<bigint>")

    def places(j):
        return F.array(*[F.struct(s.alias("_at"), j.alias("_blk"), F.lit(p).alias("_place")) for p, s in enumerate((seg, seg - j, seg - j - 1))])

    e = table.join(st.moments.select(*keys, "mean"), keys).select(
        *keys, "_t", F.transform("_v", lambda v: v - F.col("mean")).alias("_v"), F.explode(F.flatten(F.transform(blocks, places))).alias("_p")) \
        .select(*keys, "_t", "_v", "_p.*")
    key_fields = [f for f in table.schema.fields if f.name in keys]
    schema = T.StructType(key_fields + [T.StructField("lag", T.LongType()), T.StructField("s", T.DoubleType()),
                                        T.StructField("pairs", T.LongType())])
    names = [f.name for f in schema.fields]

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        blk = int(pdf["_blk"].iloc[0])
        width = min(B, hi - blk * B + 1)                     # lags of this block
        base, bm = np.zeros(B), np.zeros(B)
        ahead, am = np.zeros(2 * B), np.zeros(2 * B)
        for place, t, v in zip(pdf["_place"], pdf["_t"], pdf["_v"]):
            to, mark, shift = (base, bm, 0) if place == 0 else (ahead, am, B * (place - 1))
            to[np.asarray(t) + shift], mark[np.asarray(t) + shift] = v, 1.0
        ahead, am = ahead[:B + width - 1], am[:B + width - 1]
        lags = np.arange(blk * B, blk * B + width)
        pairs = np.full(width, B) if bm.all() and am.all() else np.rint(_correlate(am, bm)).astype(np.int64)
        out = pd.DataFrame({"lag": lags, "s": _correlate(ahead, base), "pairs": pairs})
        out = out[(out["pairs"] > 0) & (out["lag"] >= lo)]
        for k_ in keys:
            out[k_] = pdf[k_].iloc[0]
        return out[names]

    parts = e.groupBy(*keys, "_at", "_blk").applyInPandas(fn, schema)
    return parts.groupBy(*keys, "lag").agg(F.sum("s").alias("s"), F.sum("pairs").alias("pairs"))


def lag_sums(df: DataFrame, keys, step: str = "step", x: str = "x", max_lag: int = 200,
             segment: int = 4096, lag_from: int = 0) -> DataFrame:
    """Σ_t xc_t·xc_{t+lag} and pair counts for lag in [lag_from, max_lag], xc = x − mean.

    Output ``(keys…, lag, s, pairs)`` for the lags that have a pair.
    """
    return segment_lag_sums(segments(df, keys, step, x, segment), max_lag, lag_from)


def acf(df: DataFrame, keys, step: str = "step", x: str = "x", max_lag: int = 200, norm: str = "n-lag",
        segment: int = 4096, lag_from: int = 0) -> DataFrame:
    """D1 (norm='n-lag'): mean lagged product / population variance; zeros when var < 1e-12.
    D2 (norm='n'): Σ lagged products / Σ xc², i.e. normalised at lag 0. Lags without a pair
    (a chain shorter than the lag) have no row."""
    if norm not in ("n-lag", "n"):
        raise ValueError("norm must be 'n-lag' or 'n'")
    return segment_acf(segments(df, keys, step, x, segment), max_lag, norm, lag_from)


def segment_acf(st: Segments, max_lag: int, norm: str, lag_from: int = 0, only: DataFrame | None = None) -> DataFrame:
    j = segment_lag_sums(st, max_lag, lag_from, only).join(st.moments, st.keys)
    if norm == "n-lag":
        val = F.when(F.col("var") < VAR_FLOOR, F.lit(0.0)).otherwise((F.col("s") / F.col("pairs")) / F.col("var"))
    else:
        s0 = F.col("var") * F.col("n")
        val = F.when(s0 <= 0, F.lit(1.0)).otherwise(F.col("s") / s0)
    return j.select(*st.keys, "lag", val.alias("acf"))


#: How much further each range of lags reaches than the one before.
RANGE_GROWTH = 8


def _lag_ranges(df: DataFrame, keys: list[str], step: str, x: str, norm: str, segment: int, start_lag: int, judge):
    """Autocorrelation in growing lag ranges, each only for the keys that ``judge`` leaves open.

    ``judge(acf so far)`` returns one row per key with a boolean ``done``; the loop also
    ends for a key when its lags run out. Ranges are stored tables, verdicts follow from them.
    """
    spark, st = df.sparkSession, segments(df, keys, step, x, segment)
    n, open_ = st.moments.select(*keys, "n"), None
    lo, hi, so_far = 0, max(1, int(start_lag)), None
    while True:
        a = checkpoint_table(segment_acf(st, hi, norm, lo, open_), spark, "chain-acf")
        so_far = a if so_far is None else so_far.unionByName(a)
        found = n.join(judge(so_far), keys, "left")
        open_ = found.filter(~F.coalesce("done", F.lit(False)) & (F.col("n") - 1 > hi))
        if open_.isEmpty():
            return found
        lo, hi = hi + 1, RANGE_GROWTH * hi


def _tau_from_acf(a: DataFrame, keys: list[str], c: float) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("lag").rowsBetween(Window.unboundedPreceding, 0)
    t = a.withColumn("taus", F.lit(2.0) * F.sum("acf").over(w) - F.lit(1.0))
    hit = F.col("lag") >= F.lit(c) * F.col("taus")
    at = F.struct("lag", "taus")
    return t.groupBy(*keys).agg(F.min_by(at, F.when(hit, F.col("lag"))).alias("_w"), F.max_by(at, F.col("lag")).alias("_l"),
                                F.max(hit).alias("done"))


def integrated_time(df: DataFrame, keys, step: str = "step", x: str = "x", c: float = TAU_WINDOW_C,
                    start_lag: int = 64, segment: int = 4096) -> DataFrame:
    """D3: τ = max(2·Σ_{l≤m} acf(l) − 1, 1) at the first m with m ≥ c·τ(m).

    ``(keys…, tau, win_lag, n, warn)``; warn = n < 50·τ.
    """
    keys = _k(keys)
    r = _lag_ranges(df, keys, step, x, "n", segment, start_lag, lambda a: _tau_from_acf(a, keys, c))
    chosen = F.when(F.col("done"), F.col("_w")).otherwise(F.col("_l"))
    out = r.select(*keys, F.greatest(chosen["taus"], F.lit(1.0)).alias("tau"), chosen["lag"].alias("win_lag"), "n")
    return out.withColumn("warn", F.col("n") < F.lit(SHORT_CHAIN_FACTOR) * F.col("tau"))


def tau_summary(tau: DataFrame, group=()) -> DataFrame:
    """τ over dimensions: nan-mean, max finite, median, warning flag."""
    g = _k(group)
    fin = F.when(~F.isnan("tau"), F.col("tau"))
    return tau.groupBy(*g).agg(F.avg(fin).alias("tau_mean"), F.max(fin).alias("tau_max"),
                               F.percentile(fin, 0.5).alias("tau_median"), F.max(F.col("warn").cast("int"))
                               .cast("boolean").alias("any_warn"), F.count(F.lit(1)).alias("n_dims"))


def tau_by_prefix(df: DataFrame, dim: str, step: str = "step", x: str = "x",
                  prefixes: Sequence[int] = TAU_PREFIXES) -> DataFrame:
    """τ summary over chain prefixes that fit the chain (one run per prefix length)."""
    n = int(df.agg(F.countDistinct(step)).first()[0])
    rows = []
    out = None
    for p in [q for q in prefixes if q <= n]:
        t = integrated_time(df.filter(F.col(step) < p), [dim], step, x)
        s = tau_summary(t).select(F.lit(p).cast("long").alias("chain_length"), "*")
        out = s if out is None else out.unionByName(s)
    if out is None:
        raise ValueError("no prefix length fits the chain")
    return out.withColumn("short_chain_warning", F.col("any_warn") | ~(F.col("chain_length") >= F.lit(SHORT_CHAIN_FACTOR)
                                                                  * F.col("tau_mean")))


def ess(tau_col, steps, walkers=1):
    """steps·walkers/τ, NULL when τ ≤ 0."""
    t = F.col(tau_col) if isinstance(tau_col, str) else tau_col
    s = F.col(steps) if isinstance(steps, str) else F.lit(steps)
    w = F.col(walkers) if isinstance(walkers, str) else F.lit(walkers)
    return F.when(t > 0, s * w / t)


def geyer_ess(df: DataFrame, keys, step: str = "step", x: str = "x", start_lag: int = 512,
              segment: int = 4096) -> DataFrame:
    """τ = 1 + 2 Σ_{k≥1} (ρ(2k) + ρ(2k+1)) up to the first negative pair; ESS = n / τ.

    Lags are extended until a pair is negative or the chain has no further pair; then
    ``terminated`` is false and the ESS is a lower bound.
    """
    keys = _k(keys)

    def judge(a):
        g = a.filter(F.col("lag") >= 2).groupBy(*keys, F.floor(F.col("lag") / 2).alias("kk")) \
            .agg(F.sum("acf").alias("gamma"), F.count(F.lit(1)).alias("m")).filter("m = 2")
        w = Window.partitionBy(*keys).orderBy("kk").rowsBetween(Window.unboundedPreceding, 0)
        g = g.withColumn("neg", F.max(F.col("gamma") < 0).over(w))
        return g.groupBy(*keys).agg((F.lit(1.0) + F.lit(2.0) * F.coalesce(F.sum(F.when(~F.col("neg"), F.col("gamma"))), F.lit(0.0))).alias("tau"),
                                    F.max("neg").alias("done"))

    # ranges end at odd lags, so that no pair is cut
    r = _lag_ranges(df, keys, step, x, "n-lag", segment, start_lag | 1, judge)
    r = r.withColumn("tau", F.coalesce("tau", F.lit(1.0)))
    return r.select(*keys, "n", "tau", (F.col("n") / F.col("tau")).alias("ess"), F.coalesce("done", F.lit(False)).alias("terminated"))


def rhat(df: DataFrame, chain: str, dim=(), x: str = "x") -> DataFrame:
    """Basic Gelman–Rubin R-hat per dimension (two-level aggregate)."""
    d = _k(dim)
    per = df.groupBy(*d, chain).agg(F.avg(x).alias("m"), F.var_samp(x).alias("v"), F.count(F.lit(1)).alias("n"))
    a = per.groupBy(*d).agg(F.avg("v").alias("W"), F.var_samp("m").alias("B_over_n"), F.min("n").alias("n"),
                            F.count(F.lit(1)).alias("n_chains"))
    vh = (F.col("n") - 1) / F.col("n") * F.col("W") + F.col("B_over_n")
    return a.select(*d, "n_chains", "n", F.sqrt(vh / F.col("W")).alias("rhat"))


def rhat_verdict(rhat_df: DataFrame) -> DataFrame:
    """D9 summary: max/mean R-hat and PASS (<1.01) / MARGINAL (≤1.05) / FAIL."""
    a = rhat_df.agg(F.max("rhat").alias("rhat_max"), F.avg("rhat").alias("rhat_mean"))
    return a.withColumn("status", F.when(F.col("rhat_max") < RHAT_PASS, "PASS")
                        .when(F.col("rhat_max") <= RHAT_MARGINAL, "MARGINAL").otherwise("FAIL"))


def slowest_dims(tau: DataFrame, dim: str, top: int = 10) -> DataFrame:
    """The ``top`` dimensions with the largest τ (ties by dim)."""
    return tau.orderBy(F.col("tau").desc(), F.col(dim)).limit(top).select(dim, "tau")


def tau_quantiles(tau: DataFrame) -> DataFrame:
    """Mean, median, max, q90, q99 of τ over dimensions and max/mean ratio."""
    fin = F.when(~F.isnan("tau"), F.col("tau"))
    a = tau.agg(F.avg(fin).alias("tau_mean"), F.percentile(fin, 0.5).alias("tau_median"),
                F.max(fin).alias("tau_max"), F.percentile(fin, 0.9).alias("tau_q90"),
                F.percentile(fin, 0.99).alias("tau_q99"))
    return a.withColumn("tau_ratio", F.when(F.col("tau_mean") > 0, F.col("tau_max") / F.col("tau_mean")))


# Fixed values that must equal the reference's: limits and labels of the three ladders.
LENGTH_LIMITS, LENGTH_LABELS = (0.8, 1.2, 1.8), ("stable", "mild bias", "strong bias")
AGREEMENT_LABELS = ("chains agree", "borderline", "disagree")
SLOW_LIMITS, SLOW_LABELS = (3.0, 5.0), ("no slow direction", "mild", "hidden slow direction")
OVERALL_LABELS = ("tau values are reliable", "tau may be biased", "sampling has problems")


def verdicts(first_tau, last_tau, rhat_max, tau_ratio):
    """Stability / agreement / slow-direction ladders and the overall worst, as Columns."""
    ratio = last_tau / first_tau
    v1 = F.when(first_tau.isNull() | last_tau.isNull() | (first_tau <= 0), "unavailable") \
        .when((ratio >= LENGTH_LIMITS[0]) & (ratio <= LENGTH_LIMITS[1]), LENGTH_LABELS[0]) \
        .when(ratio <= LENGTH_LIMITS[2], LENGTH_LABELS[1]).otherwise(LENGTH_LABELS[2])
    v2 = F.when(rhat_max.isNull(), "unavailable").when(rhat_max < RHAT_PASS, AGREEMENT_LABELS[0]) \
        .when(rhat_max <= RHAT_MARGINAL, AGREEMENT_LABELS[1]).otherwise(AGREEMENT_LABELS[2])
    v3 = F.when(tau_ratio.isNull(), "unavailable").when(tau_ratio <= SLOW_LIMITS[0], SLOW_LABELS[0]) \
        .when(tau_ratio <= SLOW_LIMITS[1], SLOW_LABELS[1]).otherwise(SLOW_LABELS[2])
    flags = F.array(v1, v2, v3)
    ladders = (LENGTH_LABELS, AGREEMENT_LABELS, SLOW_LABELS)
    bad = F.arrays_overlap(flags, F.array(*[F.lit(s[2]) for s in ladders]))
    mild = F.arrays_overlap(flags, F.array(*[F.lit(s[1]) for s in ladders]))
    overall = F.when(bad, OVERALL_LABELS[2]).when(mild, OVERALL_LABELS[1]).otherwise(OVERALL_LABELS[0])
    return v1.alias("length_stability"), v2.alias("chain_agreement"), v3.alias("slow_direction"), overall.alias("overall")


def acceptance(df: DataFrame, sampler: str, accepted: str = "accepted", step: str = "step",
               warmup: int = 0, group=()) -> DataFrame:
    """Post-warm-up acceptance rate and its band check for the sampler."""
    g = _k(group)
    lo, hi = ACCEPT_BANDS[sampler]
    a = df.filter(F.col(step) >= warmup).groupBy(*g).agg(F.avg(F.col(accepted).cast("double")).alias("accept_rate"),
                                                          F.count(F.lit(1)).alias("n"))
    return a.withColumn("in_band", (F.col("accept_rate") >= lo) & (F.col("accept_rate") <= hi)) \
            .withColumn("band_lo", F.lit(lo)).withColumn("band_hi", F.lit(hi))


def thin(df: DataFrame, tau, step: str = "step") -> DataFrame:
    """Keep every ceil(τ)-th step (τ a driver number or a joined column)."""
    stride = F.ceil(F.col(tau)) if isinstance(tau, str) else F.lit(int(np.ceil(float(tau))))
    return df.filter(F.col(step) % F.greatest(stride, F.lit(1)) == 0)


def timing(df: DataFrame, step_time: str = "step_time", warm: str = "is_warmup", group=()) -> DataFrame:
    """Warm-up / sampling / total seconds and the mean per sampling step."""
    g = _k(group)
    t = F.col(step_time).cast("double")
    return df.groupBy(*g).agg(F.sum(F.when(F.col(warm), t)).alias("warmup_sec"),
                              F.sum(F.when(~F.col(warm), t)).alias("sampling_sec"),
                              F.sum(t).alias("total_sec"), F.avg(F.when(~F.col(warm), t)).alias("per_step_sec"))
