"""Named evaluation queries (E1–E27, R6) over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rng
from ..operators import metrics as M
from ..operators import predict as R
from . import sql_metrics as S
from . import views as V
from .catalog import register

# ---------------------------------------------------------------- E16 ---------


@register("binary_report", S.report_sql(V.PREDS_SQL, []), S.REPORT_DOUBLES, ops=("E16", "E1", "E2", "E3",
          "E5", "E6", "E7", "E10", "E13", "E14"))
def q_binary_report(spark, sf):
    """Flagship evaluation: one-row report over all of lineitem-as-predictions."""
    return M.binary_report(V.preds(spark, sf))


@register("binary_report_by_status", S.report_sql(V.PREDS_SQL, ["grp"]), S.REPORT_DOUBLES, ops=("E16",))
def q_binary_report_by_status(spark, sf):
    return M.binary_report(V.preds(spark, sf), group_by=["grp"])


@register("binary_report_events", S.report_sql(V.PREDS2_SQL, []), S.REPORT_DOUBLES, ops=("E16",))
def q_binary_report_events(spark, sf):
    return M.binary_report(V.preds2(spark, sf))


# ---------------------------------------------------------------- E1–E7 -------

@register("confusion_by_source", S.confusion_sql(V.PREDS_SQL, ["source"], 0.5), S.CONF_DOUBLES,
          ops=("E1", "E2", "E3", "E5", "E6", "E7"))
def q_confusion(spark, sf):
    return M.confusion(V.preds(spark, sf), group_by=["source"])


@register("confusion_threshold_03", S.confusion_sql(V.PREDS2_SQL, [], 0.3), S.CONF_DOUBLES, ops=("E1", "E2"))
def q_confusion_03(spark, sf):
    return M.confusion(V.preds2(spark, sf), threshold=0.3)


_PR_SQL = (f"WITH d AS ({S.prepared(V.PREDS_SQL, ['grp'])}) SELECT grp, count(*) AS n, "
           "CASE WHEN count_if(_p >= 0.5) > 0 THEN count_if(_p >= 0.5 AND _y = 1) / count_if(_p >= 0.5) ELSE 0.0 END AS precision, "
           "CASE WHEN count_if(_y = 1) > 0 THEN count_if(_p >= 0.5 AND _y = 1) / count_if(_y = 1) ELSE 0.0 END AS recall, "
           "count_if(_p >= 0.5) / count(*) AS positive_rate, count_if(_y = 1) / count(*) AS target_positive_rate "
           "FROM d GROUP BY grp")


@register("precision_recall", _PR_SQL, ("precision", "recall", "positive_rate", "target_positive_rate"),
          ops=("E4",))
def q_precision_recall(spark, sf):
    return M.precision_recall(V.preds(spark, sf), group_by=["grp"])


# ---------------------------------------------------------------- E10–E12 -----

@register("ece_left", S.ece_sql(V.PREDS_SQL, ["grp"], 15, "left"), ("ece",), ops=("E10",))
def q_ece_left(spark, sf):
    return M.ece(V.preds(spark, sf), group_by=["grp"], n_bins=15, edges="left")


@register("ece_right", S.ece_sql(V.PREDS2_SQL, [], 10, "right"), ("ece",), ops=("E11",))
def q_ece_right(spark, sf):
    return M.ece(V.preds2(spark, sf), n_bins=10, edges="right")


_REL_SQL = (f"WITH d AS (SELECT grp, CAST(y AS INTEGER) AS _y, CAST(p AS DOUBLE) AS _p FROM ({V.PREDS_SQL})), "
            f"b AS ({S.bins_cte(['grp'], 15, 'right')}), "
            "grid AS (SELECT grp, CAST(bin AS INTEGER) AS bin FROM (SELECT DISTINCT grp FROM d), range(0, 15) r(bin)) "
            "SELECT grp, bin, bin / 15.0 AS lo, (bin + 1) / 15.0 AS hi, CAST(coalesce(count, 0) AS BIGINT) AS count, "
            "sum_y / count AS accuracy, coalesce(sum_p / count, (bin + 0.5) / 15.0) AS confidence "
            "FROM grid LEFT JOIN b USING (grp, bin)")


@register("reliability_table", _REL_SQL, ("lo", "hi", "accuracy", "confidence"), ops=("E12",))
def q_reliability(spark, sf):
    return M.reliability_table(V.preds(spark, sf), group_by=["grp"], n_bins=15, edges="right")


# ---------------------------------------------------------------- E13–E15 -----

@register("ranking_ties", S.ranking_sql(V.PREDS_SQL, ["grp"]), ("auroc", "auprc"), ops=("E13", "E14"))
def q_ranking_ties(spark, sf):
    return M.ranking(V.preds(spark, sf), group_by=["grp"])


@register("ranking_by_user", S.ranking_sql(V.PREDS2_SQL, ["grp"]), ("auroc", "auprc"), ops=("E13", "E14"))
def q_ranking_by_user(spark, sf):
    """Many small groups, some with a single class (NULL AUROC)."""
    return M.ranking(V.preds2(spark, sf), group_by=["grp"])


_ROC_SQL = (f"WITH d AS (SELECT grp, CAST(y AS INTEGER) AS _y, CAST(p AS DOUBLE) AS _p FROM ({V.PREDS_SQL})), "
            "s AS (SELECT grp, _p, sum(_y) AS pos, sum(1 - _y) AS neg FROM d GROUP BY grp, _p), "
            "c AS (SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn, "
            "lead(pos) OVER w2 AS np, lead(neg) OVER w2 AS nn, "
            "sum(pos) OVER (PARTITION BY grp) AS tp_all, sum(neg) OVER (PARTITION BY grp) AS tn_all FROM s "
            "WINDOW w AS (PARTITION BY grp ORDER BY _p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), "
            "w2 AS (PARTITION BY grp ORDER BY _p DESC)) "
            "SELECT grp, _p AS threshold, CASE WHEN tn_all > 0 THEN cn / tn_all END AS fpr, "
            "CASE WHEN tp_all > 0 THEN cp / tp_all END AS tpr FROM c "
            "WHERE np IS NULL OR np <> pos OR nn <> neg OR (cp = pos AND cn = neg) "
            "UNION ALL SELECT grp, NULL::DOUBLE AS threshold, CASE WHEN sum(neg) > 0 THEN 0.0 END AS fpr, "
            "CASE WHEN sum(pos) > 0 THEN 0.0 END AS tpr FROM s GROUP BY grp")


@register("roc_curve", _ROC_SQL, ("threshold", "fpr", "tpr"), ops=("E15",))
def q_roc_curve(spark, sf):
    return M.roc_curve(V.preds(spark, sf), group_by=["grp"])


# ---------------------------------------------------------------- E20, E21 ----

_E20_SRC = (f"SELECT * FROM ({V.PREDS2_SQL}) WHERE grp IN (SELECT grp FROM ({V.PREDS2_SQL}) "
            "GROUP BY grp HAVING count(*) >= 10 AND count(DISTINCT y) = 2)")


@register("per_group_report", S.report_sql(_E20_SRC, ["grp"]), S.REPORT_DOUBLES, ops=("E20",))
def q_per_group(spark, sf):
    return M.per_group_report(V.preds2(spark, sf), "grp", min_n=10)


_E21_SRC = (f"SELECT y, p, CAST(source AS VARCHAR) AS source FROM ({V.PREDS_SQL}) "
            f"UNION ALL SELECT y, p, 'ALL' AS source FROM ({V.PREDS_SQL})")


@register("report_with_total", S.report_sql(_E21_SRC, ["source"]), S.REPORT_DOUBLES, ops=("E21",))
def q_report_total(spark, sf):
    return M.report_with_total(V.preds(spark, sf), "source", total_label="ALL")


# ---------------------------------------------------------------- E8, E9 ------

_PELL_SQL = (f"WITH d AS (SELECT draw, y, greatest(least(p, 1.0 - {S.EPS}), {S.EPS}) AS _p FROM ({V.DRAWS_SQL})), "
             f"pd AS (SELECT draw, sum(CASE WHEN y = 1 THEN ln(_p) ELSE ln(1.0 - _p) END) AS ll, count(*) AS n "
             "FROM d GROUP BY draw), a AS (SELECT avg(ll) AS pell, max(n) AS n_obs FROM pd) "
             "SELECT pell, pell / n_obs AS pell_mean, -pell / n_obs AS posterior_log_loss_mean, "
             "-pell AS posterior_total_log_loss FROM a")


@register("pell_draws", _PELL_SQL, ("pell", "pell_mean", "posterior_log_loss_mean", "posterior_total_log_loss"),
          ops=("E8",))
def q_pell(spark, sf):
    return M.pell(V.draws(spark, sf))


_LOGEXPIT = "(-ln(1 + exp(-abs({f}))) + least({f}, 0.0))"
_PELL_LAT_SQL = (f"WITH pd AS (SELECT draw, sum(CASE WHEN y = 1 THEN {_LOGEXPIT.format(f='latent')} "
                 f"ELSE {_LOGEXPIT.format(f='(-latent)')} END) AS ll, count(*) AS n FROM ({V.DRAWS_SQL}) GROUP BY draw), "
                 "a AS (SELECT avg(ll) AS pell, max(n) AS n_obs FROM pd) SELECT pell, pell / n_obs AS pell_mean FROM a")


@register("pell_latent", _PELL_LAT_SQL, ("pell", "pell_mean"), ops=("E9",))
def q_pell_latent(spark, sf):
    return M.pell_latent(V.draws(spark, sf))


# ---------------------------------------------------------------- R6, E17, E18 --

def _summary_sql(draws_sql):
    parts = []
    for v, pre in (("p", "prob"), ("latent", "latent")):
        parts.append(f"avg({v}) AS {pre}_mean, var_samp({v}) AS {pre}_variance, stddev_samp({v}) AS {pre}_std, "
                     f"quantile_cont({v}, 0.05) AS {pre}_q05, quantile_cont({v}, 0.5) AS {pre}_q50, "
                     f"quantile_cont({v}, 0.95) AS {pre}_q95, "
                     f"quantile_cont({v}, 0.95) - quantile_cont({v}, 0.05) AS {pre}_central_90_width")
    return f"SELECT id, {', '.join(parts)} FROM ({draws_sql}) GROUP BY id"


SUMMARY_SQL = _summary_sql(V.DRAWS_SQL)


@register("posterior_summary", SUMMARY_SQL, tuple(R.SUMMARY_OUT), ops=("R6",))
def q_posterior_summary(spark, sf):
    return R.summarize_draws(V.draws(spark, sf))


_STATS_COLS = ["prob_mean", "prob_variance", "latent_mean", "latent_variance"]
_STATS_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS column, avg({c}) AS mean, stddev_pop({c}) AS std, min({c}) AS min, max({c}) AS max, "
    f"count({c}) AS n_finite FROM ({SUMMARY_SQL})" for c in _STATS_COLS)


@register("posterior_array_stats", _STATS_SQL, ("mean", "std", "min", "max"), ops=("E17",))
def q_array_stats(spark, sf):
    return M.array_stats(R.summarize_draws(V.draws(spark, sf)), _STATS_COLS)


def draws_alt(spark, sf):
    """A second method's draws: the same rows and draw count, another seed."""
    d = V.draws(spark, sf).select("id", "y", "draw")
    p = rng.u01_open(F.col("id"), F.col("draw"), 7)
    return d.select("id", "y", "draw", p.alias("p"), F.log(p / (F.lit(1.0) - p)).alias("latent"))


DRAWS_ALT_SQL = V.DRAWS_SQL.replace("CAST(42 AS VARCHAR)", "CAST(7 AS VARCHAR)")

_CMP_COLS = ["prob_mean", "prob_variance", "prob_q05", "prob_q50", "prob_q95",
             "latent_mean", "latent_variance", "latent_q05", "latent_q50", "latent_q95"]
_CMP_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS column, avg(abs(b.{c} - a.{c})) AS mae, sqrt(avg((b.{c} - a.{c}) * (b.{c} - a.{c}))) AS rmse "
    f"FROM ({SUMMARY_SQL}) a JOIN ({_summary_sql(DRAWS_ALT_SQL)}) b USING (id)" for c in _CMP_COLS)


@register("compare_summaries", _CMP_SQL, ("mae", "rmse"), ops=("E18",))
def q_compare_summaries(spark, sf):
    a = R.summarize_draws(V.draws(spark, sf))
    b = R.summarize_draws(draws_alt(spark, sf))
    return M.compare_summaries(a, b)


_METHODS_CMP_SQL = (f"WITH m AS ({V.METHODS_SQL}), r AS (SELECT id, p AS rp FROM m WHERE method = 'model_a') "
                    "SELECT method, count(*) AS n, avg(abs(p - rp)) AS mae, sqrt(avg((p - rp) * (p - rp))) AS rmse, "
                    "max(abs(p - rp)) AS max_abs_diff FROM m JOIN r USING (id) WHERE method <> 'model_a' GROUP BY method")


@register("compare_methods", _METHODS_CMP_SQL, ("mae", "rmse", "max_abs_diff"), ops=("E19",))
def q_compare_methods(spark, sf):
    return M.compare_methods(V.methods(spark, sf), "model_a")


# ---------------------------------------------------------------- E22–E24 -----

def _pair_sql():
    m = V.METHODS_SQL
    j = (f"SELECT a.id, a.y, a.p AS p_a, b.p AS p_b FROM (SELECT * FROM ({m}) WHERE method = 'model_a') a "
         f"JOIN (SELECT * FROM ({m}) WHERE method = 'model_b') b USING (id)")
    ra = S.report_sql(f"SELECT y, p_a AS p FROM ({j})", [])
    rb = S.report_sql(f"SELECT y, p_b AS p FROM ({j})", [])
    return (f"WITH j AS ({j}), s AS (SELECT avg(abs(p_a - p_b)) AS mean_abs_diff, max(abs(p_a - p_b)) AS max_abs_diff, "
            "corr(p_a, p_b) AS pearson_r, count(*) AS n FROM j), "
            f"ra AS (SELECT nll AS nll_a, brier AS brier_a, auroc AS auroc_a FROM ({ra})), "
            f"rb AS (SELECT nll AS nll_b, brier AS brier_b, auroc AS auroc_b FROM ({rb})) "
            "SELECT *, nll_b - nll_a AS delta_nll, brier_b - brier_a AS delta_brier, auroc_b - auroc_a AS delta_auroc "
            "FROM s, ra, rb")


@register("method_pair", _pair_sql(), ("mean_abs_diff", "max_abs_diff", "pearson_r", "nll_a", "brier_a", "auroc_a",
                                       "nll_b", "brier_b", "auroc_b", "delta_nll", "delta_brier", "delta_auroc"),
          ops=("E22",))
def q_method_pair(spark, sf):
    m = V.methods(spark, sf)
    return M.method_pair(m.filter("method = 'model_a'"), m.filter("method = 'model_b'"))


_W1_SQL = (f"WITH a AS (SELECT id, p AS va, row_number() OVER (PARTITION BY id ORDER BY p) AS r FROM ({V.DRAWS_SQL})), "
           f"b AS (SELECT id, p AS vb, row_number() OVER (PARTITION BY id ORDER BY p) AS r FROM ({DRAWS_ALT_SQL})), "
           "per AS (SELECT id, avg(abs(va - vb)) AS w1 FROM a JOIN b USING (id, r) GROUP BY id) "
           "SELECT avg(w1) AS mean_w1, max(w1) AS max_w1, count(*) AS n FROM per")


@register("wasserstein_draws", _W1_SQL, ("mean_w1", "max_w1"), ops=("E23",))
def q_wasserstein(spark, sf):
    return M.wasserstein_draws(V.draws(spark, sf), draws_alt(spark, sf))


# ---------------------------------------------------------------- E25–E27 -----

_REG_SQL = (f"SELECT grp, avg((y_true - y_pred) * (y_true - y_pred)) AS mse, avg(abs(y_true - y_pred)) AS mae, "
            "avg(CASE WHEN abs(y_true) + abs(y_pred) = 0 THEN NULL "
            "ELSE abs(y_true - y_pred) / ((abs(y_true) + abs(y_pred)) / 2.0) END) "
            f"AS smape FROM ({V.REGRESS_SQL}) GROUP BY grp")


@register("regression_metrics", _REG_SQL, ("mse", "mae", "smape"), ops=("E25",))
def q_regression(spark, sf):
    return M.regression_metrics(V.regress(spark, sf), "y_true", "y_pred", group_by=["grp"])


_BEST_SQL = (f"WITH h AS (SELECT run, CAST(row_number() OVER (PARTITION BY run ORDER BY epoch_key) AS INTEGER) AS epoch, "
             f"score FROM ({V.HISTORY_SQL})), "
             "b AS (SELECT *, max(score) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM h), "
             "c AS (SELECT *, max(CASE WHEN prev IS NULL OR score > prev THEN epoch END) OVER (PARTITION BY run ORDER BY epoch "
             "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS li FROM b), "
             "s AS (SELECT *, min(CASE WHEN epoch - li >= 3 THEN epoch END) OVER (PARTITION BY run) AS stop FROM c) "
             "SELECT run, arg_min(epoch, (-score, epoch)) FILTER (WHERE stop IS NULL OR epoch <= stop) AS best_epoch, "
             "max(score) FILTER (WHERE stop IS NULL OR epoch <= stop) AS best_score, min(stop) AS stop_epoch, count(*) AS n_epochs "
             "FROM s GROUP BY run")


@register("best_epoch", _BEST_SQL, ("best_score",), ops=("E26",))
def q_best_epoch(spark, sf):
    from pyspark.sql import Window
    h = V.history(spark, sf)
    h = h.withColumn("epoch", F.row_number().over(Window.partitionBy("run").orderBy("epoch_key")))
    return M.best_epoch(h, run="run", epoch="epoch", score="score", patience=3)


_BCE_SQL = (f"WITH d AS ({S.prepared(V.PREDS_SQL, ['grp'])}), w AS (SELECT CASE WHEN count_if(_y = 1) = 0 OR count_if(_y = 0) = 0 "
            "THEN 1.0 ELSE count_if(_y = 0) / count_if(_y = 1) END AS pw FROM d) "
            "SELECT grp, avg(-(pw * _y * ln(_p) + (1 - _y) * ln(1.0 - _p))) AS bce, count(*) AS n FROM d, w GROUP BY grp")


@register("weighted_bce", _BCE_SQL, ("bce",), ops=("E27", "P10"))
def q_weighted_bce(spark, sf):
    from ..operators import prep as P
    d = V.preds(spark, sf)
    w = P.positive_class_weight(d, "y")
    term = M.bce_with_pos_weight(F.col("y"), F.col("p"), F.col("pos_weight"))
    per = d.crossJoin(F.broadcast(w)).select("grp", term.alias("loss"))  # w: one row
    return per.groupBy("grp").agg(F.avg("loss").alias("bce"), F.count(F.lit(1)).alias("n"))


_WL_SQL = (f"WITH b AS (SELECT source, grp, avg(CASE WHEN y = 1 THEN -ln(greatest(least(p, 1.0 - {S.EPS}), {S.EPS})) "
           f"ELSE -ln(1.0 - greatest(least(p, 1.0 - {S.EPS}), {S.EPS})) END) AS loss, count(*) AS n FROM ({V.PREDS_SQL}) "
           "GROUP BY source, grp) SELECT source, sum(loss * n) / sum(n) AS mean_loss FROM b GROUP BY source")


@register("weighted_loss", _WL_SQL, ("mean_loss",), ops=("E27",))
def q_weighted_loss(spark, sf):
    d = V.preds(spark, sf)
    lt = -M.log_term(F.col("y"), M.clip_p(F.col("p")))
    batches = d.groupBy("source", "grp").agg(F.avg(lt).alias("loss"), F.count(F.lit(1)).alias("n"))
    return M.weighted_loss(batches, group_by=["source"])


# ---------------------------------------------------------------- E24 -------------

_DIAG_SQL = (f"WITH d AS (SELECT id, y, p, CAST(p >= 0.5 AS INTEGER) = y AS correct, abs(p - 0.5) AS conf "
             f"FROM ({V.PREDS2_SQL})), "
             "c AS (SELECT *, row_number() OVER (ORDER BY conf, id) AS rk, count(*) OVER () AS nc FROM d WHERE correct), "
             "a AS (SELECT 0 AS slot, 'highest-confidence correct' AS role, id, y, p, conf FROM (SELECT * FROM d "
             "WHERE correct ORDER BY conf DESC, id LIMIT 1) "
             "UNION ALL SELECT 1, 'highest-confidence incorrect', id, y, p, conf FROM (SELECT * FROM d WHERE NOT correct "
             "ORDER BY conf DESC, id LIMIT 1) "
             "UNION ALL SELECT 2, 'most uncertain', id, y, p, conf FROM (SELECT * FROM d ORDER BY conf ASC, id LIMIT 1) "
             "UNION ALL SELECT 3, 'median-uncertainty correct', id, y, p, conf FROM c WHERE rk = nc // 2 + 1), "
             "ch AS (SELECT CAST(row_number() OVER (ORDER BY slot) AS INTEGER) AS pos, role, id, y, p FROM a), "
             "fb AS (SELECT id, y, p, row_number() OVER (ORDER BY conf, id) AS fr FROM d WHERE id NOT IN (SELECT id FROM a)) "
             "SELECT * FROM ch UNION ALL SELECT CAST((SELECT count(*) FROM ch) + fr AS INTEGER) AS pos, "
             "'fallback point ' || CAST((SELECT count(*) FROM ch) + fr AS VARCHAR) AS role, id, y, p FROM fb "
             "WHERE fr <= 4 - (SELECT count(*) FROM ch)")


@register("diagnostic_points", _DIAG_SQL, ("p",), ops=("E24",))
def q_diag_points(spark, sf):
    return M.diagnostic_points(V.preds2(spark, sf), "id", "y", "p")


# ---------------------------------------------------------------- E2 (alternative policy) --

_MAX1_SQL = (f"WITH d AS ({S.prepared(V.PREDS2_SQL, ['grp'])}), c AS ({S.counts_cte(['grp'], 0.5)}) "
             "SELECT grp, tp, fp, tn, fn, CAST(tp AS DOUBLE) / greatest(tp + fn, 1) AS tpr, "
             "1.0 - CAST(tp AS DOUBLE) / greatest(tp + fn, 1) AS fnr, CAST(tn AS DOUBLE) / greatest(tn + fp, 1) AS tnr, "
             "1.0 - CAST(tn AS DOUBLE) / greatest(tn + fp, 1) AS fpr FROM c")


@register("rates_zero_policy_max1", _MAX1_SQL, ("tpr", "fnr", "tnr", "fpr"), ops=("E2",))
def q_rates_max1(spark, sf):
    """The alternative zero-denominator policy: divide by max(·, 1) (per user, some one-class)."""
    c = M.confusion(V.preds2(spark, sf), group_by=["grp"], zero_policy="max1")
    return c.select("grp", "tp", "fp", "tn", "fn", "tpr", "fnr", "tnr", "fpr")
