"""Named chain-diagnostic (D*) and trial (B*) queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chains as D
from ..operators import trials as B
from . import views as V
from .catalog import register

ACF_LAG = 20
TAU_LAG = 64        # oracle lag range; the Spark side doubles until the window closes

_C = V.CHAIN_SQL


def _lag_sql(src, max_lag, keys="chain"):
    return (f"c AS ({src}), m AS (SELECT {keys}, count(*) AS n, avg(x) AS mean, var_pop(x) AS var FROM c GROUP BY {keys}), "
            f"xc AS (SELECT c.{keys}, c.step, c.x - m.mean AS xc FROM c JOIN m USING ({keys})), "
            f"l AS (SELECT a.{keys}, b.step - a.step AS lag, sum(a.xc * b.xc) AS s, count(*) AS pairs FROM xc a "
            f"JOIN xc b ON a.{keys} = b.{keys} AND b.step - a.step BETWEEN 0 AND {max_lag} GROUP BY a.{keys}, b.step - a.step)")


_ACF_SQL = (f"WITH {_lag_sql(_C, ACF_LAG)} SELECT chain, lag, CASE WHEN var < 1e-12 THEN 0.0 "
            "ELSE (s / pairs) / var END AS acf FROM l JOIN m USING (chain)")


@register("acf", _ACF_SQL, ("acf",), ops=("D1",))
def q_acf(spark, sf):
    return D.acf(V.chain(spark, sf), ["chain"], max_lag=ACF_LAG, norm="n-lag", segment=512)


_ACF_N_SQL = (f"WITH {_lag_sql(_C, ACF_LAG)}, z AS (SELECT chain, s AS s0 FROM l WHERE lag = 0) "
              "SELECT chain, lag, CASE WHEN s0 <= 0 THEN 1.0 ELSE s / s0 END AS acf FROM l JOIN z USING (chain)")


@register("acf_fft_norm", _ACF_N_SQL, ("acf",), ops=("D2",))
def q_acf_n(spark, sf):
    return D.acf(V.chain(spark, sf), ["chain"], max_lag=ACF_LAG, norm="n", segment=512)


def _tau_sql(src, max_lag=TAU_LAG):
    return (f"{_lag_sql(src, max_lag)}, z AS (SELECT chain, s AS s0 FROM l WHERE lag = 0), "
            "a AS (SELECT chain, lag, CASE WHEN s0 <= 0 THEN 1.0 ELSE s / s0 END AS acf FROM l JOIN z USING (chain)), "
            "t AS (SELECT *, 2.0 * sum(acf) OVER (PARTITION BY chain ORDER BY lag ROWS BETWEEN UNBOUNDED PRECEDING "
            "AND CURRENT ROW) - 1.0 AS taus FROM a), "
            "w AS (SELECT chain, arg_min(taus, lag) AS taus_w, min(lag) AS win_lag FROM t WHERE lag >= 5.0 * taus "
            "GROUP BY chain), "
            "tau AS (SELECT chain, greatest(taus_w, 1.0) AS tau, win_lag, n, n < 50.0 * greatest(taus_w, 1.0) AS warn "
            "FROM w JOIN m USING (chain))")


@register("integrated_time", f"WITH {_tau_sql(_C)} SELECT * FROM tau", ("tau",), ops=("D3",))
def q_tau(spark, sf):
    return D.integrated_time(V.chain(spark, sf).select("chain", "step", "x"), ["chain"], segment=512)


_ESS_SQL = (f"WITH {_tau_sql(_C)} SELECT chain, tau, CASE WHEN tau > 0 THEN n * 1 / tau END AS ess, "
            "CASE WHEN tau > 0 THEN n * 1 / tau END / (SELECT sum(step_time) FROM c) AS ess_per_sec FROM tau")


@register("ess_from_tau", _ESS_SQL, ("tau", "ess", "ess_per_sec"), ops=("D6",))
def q_ess(spark, sf):
    ch = V.chain(spark, sf)
    t = D.integrated_time(ch.select("chain", "step", "x"), ["chain"], segment=512)
    total = ch.agg(F.sum("step_time").alias("_sec"))
    return t.crossJoin(F.broadcast(total)).select(   # total: one row
        "chain", "tau", D.ess("tau", "n", 1).alias("ess"), (D.ess("tau", "n", 1) / F.col("_sec")).alias("ess_per_sec"))


_TAU_SUM_SQL = (f"WITH {_tau_sql(_C)} SELECT avg(CASE WHEN NOT isnan(tau) THEN tau END) AS tau_mean, "
                "max(CASE WHEN NOT isnan(tau) THEN tau END) AS tau_max, quantile_cont(tau, 0.5) AS tau_median, "
                "bool_or(warn) AS any_warn, count(*) AS n_dims, arg_min(tau, chain) AS tau_first FROM tau")


@register("tau_summary", _TAU_SUM_SQL, ("tau_mean", "tau_max", "tau_median", "tau_first"), ops=("D4", "D8"))
def q_tau_summary(spark, sf):
    t = D.integrated_time(V.chain(spark, sf).select("chain", "step", "x"), ["chain"], segment=512)
    s = D.tau_summary(t)
    first = t.agg(F.min_by("tau", "chain").alias("tau_first"))
    return s.crossJoin(first)   # two one-row tables


def _prefix_sql():
    parts = []
    for p in D.TAU_PREFIXES:
        src = f"SELECT * FROM ({_C}) WHERE step < {p} AND (SELECT count(DISTINCT step) FROM ({_C})) >= {p}"
        parts.append(f"SELECT * FROM (SELECT CAST({p} AS BIGINT) AS chain_length, * FROM (WITH {_tau_sql(src)} "
                     "SELECT avg(tau) AS tau_mean, max(tau) AS tau_max, quantile_cont(tau, 0.5) AS tau_median, "
                     "bool_or(warn) AS any_warn, count(*) AS n_dims FROM tau)) WHERE n_dims > 0")
    u = " UNION ALL ".join(parts)
    return f"SELECT *, any_warn OR NOT (chain_length >= 50.0 * tau_mean) AS short_chain_warning FROM ({u})"


@register("tau_by_prefix", _prefix_sql(), ("tau_mean", "tau_max", "tau_median"), ops=("D5",))
def q_tau_prefix(spark, sf):
    return D.tau_by_prefix(V.chain(spark, sf).select("chain", "step", "x"), "chain")


# every lag of the chain; pairs of lags (2k, 2k + 1) that the chain has both of
_GEYER_SQL = (f"WITH {_lag_sql(_C, 1 << 40)}, a AS (SELECT chain, lag, CASE WHEN var < 1e-12 THEN 0.0 "
              "ELSE (s / pairs) / var END AS acf FROM l JOIN m USING (chain)), "
              "g AS (SELECT chain, lag // 2 AS kk, sum(acf) AS gamma FROM a WHERE lag >= 2 GROUP BY chain, lag // 2 "
              "HAVING count(*) = 2), "
              "h AS (SELECT *, max(CASE WHEN gamma < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY chain ORDER BY kk "
              "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS neg FROM g), "
              "t AS (SELECT chain, 1.0 + 2.0 * coalesce(sum(gamma) FILTER (WHERE neg = 0), 0.0) AS tau, max(neg) = 1 AS terminated "
              "FROM h GROUP BY chain) "
              "SELECT chain, n, coalesce(tau, 1.0) AS tau, n / coalesce(tau, 1.0) AS ess, coalesce(terminated, false) AS terminated "
              "FROM m LEFT JOIN t USING (chain)")


@register("geyer_ess", _GEYER_SQL, ("tau", "ess"), ops=("D7",))
def q_geyer(spark, sf):
    return D.geyer_ess(V.chain(spark, sf).select("chain", "step", "x"), ["chain"], start_lag=64, segment=512)


_RHAT_SQL = (f"WITH per AS (SELECT chain, avg(x) AS m, var_samp(x) AS v, count(*) AS n FROM ({_C}) GROUP BY chain), "
             "a AS (SELECT count(*) AS n_chains, min(n) AS n, avg(v) AS W, var_samp(m) AS bn FROM per), "
             "r AS (SELECT n_chains, n, sqrt(((n - 1) / n * W + bn) / W) AS rhat FROM a) "
             "SELECT *, rhat AS rhat_max, rhat AS rhat_mean, CASE WHEN rhat < 1.01 THEN 'PASS' WHEN rhat <= 1.05 "
             "THEN 'MARGINAL' ELSE 'FAIL' END AS status FROM r")


@register("rhat", _RHAT_SQL, ("rhat", "rhat_max", "rhat_mean"), ops=("D9", "M9"))
def q_rhat(spark, sf):
    r = D.rhat(V.chain(spark, sf), "chain")
    return r.crossJoin(D.rhat_verdict(r))   # one-row tables


_TOP_SQL = f"WITH {_tau_sql(_C)} SELECT chain, tau FROM tau ORDER BY tau DESC, chain LIMIT 10"


@register("slowest_dims", _TOP_SQL, ("tau",), ops=("D10",))
def q_slowest(spark, sf):
    t = D.integrated_time(V.chain(spark, sf).select("chain", "step", "x"), ["chain"], segment=512)
    return D.slowest_dims(t, "chain", 10)


_TQ_SQL = (f"WITH {_tau_sql(_C)} SELECT avg(tau) AS tau_mean, quantile_cont(tau, 0.5) AS tau_median, max(tau) AS tau_max, "
           "quantile_cont(tau, 0.9) AS tau_q90, quantile_cont(tau, 0.99) AS tau_q99, "
           "CASE WHEN avg(tau) > 0 THEN max(tau) / avg(tau) END AS tau_ratio FROM tau")


@register("tau_quantiles", _TQ_SQL, ("tau_mean", "tau_median", "tau_max", "tau_q90", "tau_q99", "tau_ratio"),
          ops=("D10",))
def q_tau_q(spark, sf):
    t = D.integrated_time(V.chain(spark, sf).select("chain", "step", "x"), ["chain"], segment=512)
    return D.tau_quantiles(t)


def _verdict_sql():
    def pref(p):
        src = f"SELECT * FROM ({_C}) WHERE step < {p}"
        return f"(WITH {_tau_sql(src)} SELECT avg(tau) FROM tau)"
    return (f"WITH ft AS (SELECT {pref(500)} AS first_tau, {pref(2000)} AS last_tau), "
            f"per AS (SELECT chain, avg(x) AS m, var_samp(x) AS v, count(*) AS n FROM ({_C}) GROUP BY chain), "
            "rh AS (SELECT max(sqrt(((n - 1) / n * W + bn) / W)) AS rhat_max FROM (SELECT min(n) AS n, avg(v) AS W, "
            "var_samp(m) AS bn FROM per)), "
            f"tq AS (SELECT * FROM ({_TQ_SQL})), "
            "j AS (SELECT first_tau, last_tau, rhat_max, tau_ratio, last_tau / first_tau AS ratio FROM ft, rh, tq), "
            "v AS (SELECT *, CASE WHEN first_tau IS NULL OR last_tau IS NULL OR first_tau <= 0 THEN 'unavailable' "
            "WHEN ratio >= 0.8 AND ratio <= 1.2 THEN 'stable' WHEN ratio <= 1.8 THEN 'mild bias' ELSE 'strong bias' END "
            "AS length_stability, CASE WHEN rhat_max IS NULL THEN 'unavailable' WHEN rhat_max < 1.01 THEN 'chains agree' "
            "WHEN rhat_max <= 1.05 THEN 'borderline' ELSE 'disagree' END AS chain_agreement, CASE WHEN tau_ratio IS NULL "
            "THEN 'unavailable' WHEN tau_ratio <= 3.0 THEN 'no slow direction' WHEN tau_ratio <= 5.0 THEN 'mild' "
            "ELSE 'hidden slow direction' END AS slow_direction FROM j) "
            "SELECT first_tau, last_tau, rhat_max, tau_ratio, length_stability, chain_agreement, slow_direction, "
            "CASE WHEN length_stability IN ('strong bias') OR chain_agreement IN ('disagree') OR slow_direction IN "
            "('hidden slow direction') THEN 'sampling has problems' WHEN length_stability IN ('mild bias') OR "
            "chain_agreement IN ('borderline') OR slow_direction IN ('mild') THEN 'tau may be biased' "
            "ELSE 'tau values are reliable' END AS overall FROM v")


@register("verdicts", _verdict_sql(), ("first_tau", "last_tau", "rhat_max", "tau_ratio"), ops=("D11",))
def q_verdicts(spark, sf):
    ch = V.chain(spark, sf).select("chain", "step", "x")
    pre = D.tau_by_prefix(ch, "chain", prefixes=(500, 2000))
    ft = pre.agg(F.min_by("tau_mean", "chain_length").alias("first_tau"),
                 F.max_by("tau_mean", "chain_length").alias("last_tau"))
    rh = D.rhat_verdict(D.rhat(ch, "chain"))
    tq = D.tau_quantiles(D.integrated_time(ch, ["chain"], segment=512))
    j = ft.crossJoin(rh).crossJoin(tq)   # one-row tables
    return j.select("first_tau", "last_tau", "rhat_max", "tau_ratio",
                    *D.verdicts(F.col("first_tau"), F.col("last_tau"), F.col("rhat_max"), F.col("tau_ratio")))


_ACC_SQL = (f"SELECT chain, avg(CAST(accepted AS DOUBLE)) AS accept_rate, count(*) AS n, "
            "avg(CAST(accepted AS DOUBLE)) BETWEEN 0.70 AND 0.90 AS in_band, CAST(0.70 AS DOUBLE) AS band_lo, CAST(0.90 AS DOUBLE) AS band_hi "
            f"FROM ({_C}) WHERE step >= {V.WARMUP} GROUP BY chain")


@register("acceptance", _ACC_SQL, ("accept_rate", "band_lo", "band_hi"), ops=("D12",))
def q_acceptance(spark, sf):
    return D.acceptance(V.chain(spark, sf), "hmc", warmup=V.WARMUP, group=["chain"])


_THIN_SQL = (f"WITH {_tau_sql(_C)} SELECT c.chain, count(*) AS kept, sum(c.x) AS sum_x FROM c JOIN tau USING (chain) "
             "WHERE c.step % greatest(CAST(ceil(tau.tau) AS BIGINT), 1) = 0 GROUP BY c.chain")


@register("thin", _THIN_SQL, ("sum_x",), ops=("D13",))
def q_thin(spark, sf):
    ch = V.chain(spark, sf)
    t = D.integrated_time(ch.select("chain", "step", "x"), ["chain"], segment=512).select("chain", "tau")
    th = D.thin(ch.join(t, "chain"), "tau")
    return th.groupBy("chain").agg(F.count(F.lit(1)).alias("kept"), F.sum("x").alias("sum_x"))


_TIME_SQL = (f"SELECT chain, sum(CASE WHEN is_warmup THEN step_time END) AS warmup_sec, "
             "sum(CASE WHEN NOT is_warmup THEN step_time END) AS sampling_sec, sum(step_time) AS total_sec, "
             f"avg(CASE WHEN NOT is_warmup THEN step_time END) AS per_step_sec FROM ({_C}) GROUP BY chain")


@register("timing", _TIME_SQL, ("warmup_sec", "sampling_sec", "total_sec", "per_step_sec"), ops=("D14",))
def q_timing(spark, sf):
    return D.timing(V.chain(spark, sf), group=["chain"])


# ---------------------------------------------------------------- B1–B6 -----

_T = V.TRIALS_SQL


@register("trial_stats", f"SELECT method, k, avg(sec) AS mean, stddev_pop(sec) AS std, count(*) AS n_trials "
          f"FROM ({_T}) GROUP BY method, k", ("mean", "std"), ops=("B1",))
def q_trial_stats(spark, sf):
    return B.trial_stats(V.trials(spark, sf))


@register("trial_bands", f"SELECT method, k, quantile_cont(sec, 0.2) AS q20, quantile_cont(sec, 0.5) AS median, "
          f"quantile_cont(sec, 0.8) AS q80 FROM ({_T}) GROUP BY method, k", ("q20", "median", "q80"), ops=("B2",))
def q_trial_bands(spark, sf):
    return B.trial_bands(V.trials(spark, sf))


_RATIO_SQL = (f"WITH a AS (SELECT k, avg(CASE WHEN method = '1-URGENT' THEN sec END) AS num_mean, "
              f"avg(CASE WHEN method = '2-HIGH' THEN sec END) AS den_mean FROM ({_T}) GROUP BY k) "
              "SELECT k, num_mean, den_mean, CASE WHEN den_mean > 0 THEN num_mean / den_mean END AS speedup FROM a")


@register("method_ratio", _RATIO_SQL, ("num_mean", "den_mean", "speedup"), ops=("B3",))
def q_method_ratio(spark, sf):
    return B.method_ratio(V.trials(spark, sf), "1-URGENT", "2-HIGH", metric="speedup")


_GRID_SQL = (f"WITH s AS (SELECT count(*) * 10 AS n FROM orders GROUP BY o_orderpriority), "
             "m AS (SELECT * FROM (VALUES ('basic'), ('block'), ('accelerated')) t(method)) "
             "SELECT n, method, CAST(greatest(50, floor(n / 50)) AS BIGINT) AS k FROM s, m "
             "WHERE NOT (method = 'basic' AND n > 10000)")


@register("sweep_grid", _GRID_SQL, (), ops=("B4",))
def q_sweep(spark, sf):
    o = V.table(spark, sf, "orders")
    sizes = o.groupBy("o_orderpriority").agg((F.count(F.lit(1)) * 10).alias("n"))
    methods = spark.createDataFrame([("basic",), ("block",), ("accelerated",)], "method string")
    return B.sweep_grid(sizes, methods)


_LATEST_SQL = ("SELECT o_orderstatus AS experiment, o_orderpriority AS method, o_custkey % 5 AS k, "
               "epoch_us(o_orderdate) AS run_ts_us, TRY_CAST(nullif(trim(CAST(o_totalprice AS VARCHAR)), '') AS DOUBLE) "
               "AS o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority, "
               "o_custkey % 5 ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")


@register("latest_results", _LATEST_SQL, ("o_totalprice",), ops=("B6",))
def q_latest(spark, sf):
    o = V.table(spark, sf, "orders").select(
        F.col("o_orderstatus").alias("experiment"), F.col("o_orderpriority").alias("method"),
        (F.col("o_custkey") % 5).alias("k"), F.col("o_orderdate").alias("run_timestamp_utc"), "o_orderkey",
        "o_totalprice")
    r = B.latest_results(o, ["experiment", "method", "k"], fields=["o_totalprice"], tie="o_orderkey")
    return r.select("experiment", "method", "k", F.unix_micros(F.col("run_timestamp_utc").cast("timestamp"))
                    .alias("run_ts_us"), "o_totalprice")
