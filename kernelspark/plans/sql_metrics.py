"""DuckDB text of the evaluation metrics (oracle side).

Written independently of the Spark operators: plain global windows and
group-bys, no bucketing.
"""

from __future__ import annotations

EPS = 1e-12


def _gsel(g):
    return "".join(f"{c}, " for c in g)


def _gby(g):
    return f"GROUP BY {', '.join(g)}" if g else ""


def _using(g):
    return f"USING ({', '.join(g)})" if g else "ON TRUE"


def prepared(src: str, g, y="y", p="p") -> str:
    return (f"SELECT {_gsel(g)}CAST({y} AS INTEGER) AS _y, "
            f"greatest(least(CAST({p} AS DOUBLE), 1.0 - {EPS}), {EPS}) AS _p FROM ({src})")


def logterm(y="_y", p="_p"):
    return f"CASE WHEN {y} = 1 THEN ln({p}) ELSE ln(1.0 - {p}) END"


def counts_cte(g, threshold=0.5):
    t = threshold
    return (f"SELECT {_gsel(g)}count(*) AS n, "
            f"count_if(_p >= {t} AND _y = 1) AS tp, count_if(_p >= {t} AND _y <> 1) AS fp, "
            f"count_if(_p < {t} AND _y <> 1) AS tn, count_if(_p < {t} AND _y = 1) AS fn, "
            f"avg((_p - _y) * (_p - _y)) AS brier, sum({logterm()}) AS elpd, avg({logterm()}) AS elpd_mean "
            f"FROM d {_gby(g)}")


RATES = ("fp + fn AS number_errors, CAST(tp + tn AS DOUBLE) / n AS accuracy, "
         "CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) END AS tpr, "
         "CASE WHEN tp + fn > 0 THEN CAST(fn AS DOUBLE) / (tp + fn) END AS fnr, "
         "CASE WHEN tn + fp > 0 THEN CAST(tn AS DOUBLE) / (tn + fp) END AS tnr, "
         "CASE WHEN tn + fp > 0 THEN CAST(fp AS DOUBLE) / (tn + fp) END AS fpr, "
         "-elpd_mean AS nll, elpd_mean AS log_likelihood_mean, exp(elpd_mean) AS predictive_likelihood")

CONF_DOUBLES = ("brier", "elpd", "elpd_mean", "accuracy", "tpr", "fnr", "tnr", "fpr", "nll",
                "log_likelihood_mean", "predictive_likelihood")


def confusion_sql(src, g, threshold=0.5):
    return (f"WITH d AS ({prepared(src, g)}), c AS ({counts_cte(g, threshold)}) "
            f"SELECT *, {RATES} FROM c")


def bin_expr(n_bins, edges):
    if edges == "left":
        return f"CAST(least(floor(_p * {n_bins}), {n_bins - 1}) AS INTEGER)"
    return f"CAST(ceil(_p * {n_bins}) - 1 AS INTEGER)"


def bins_cte(g, n_bins=15, edges="left"):
    where = "" if edges == "left" else "WHERE _p > 0"
    gb = ", ".join(list(g) + ["bin"])
    return (f"SELECT {_gsel(g)}bin, count(*) AS count, sum(_p) AS sum_p, sum(_y) AS sum_y FROM "
            f"(SELECT *, {bin_expr(n_bins, edges)} AS bin FROM d {where}) GROUP BY {gb}")


def ece_sql(src, g, n_bins=15, edges="left", clip=True):
    d = prepared(src, g) if clip else prepared(src, g).replace(
        f"greatest(least(CAST(p AS DOUBLE), 1.0 - {EPS}), {EPS})", "CAST(p AS DOUBLE)")
    return (f"WITH d AS ({d}), b AS ({bins_cte(g, n_bins, edges)}), "
            f"n AS (SELECT {_gsel(g)}count(*) AS n FROM d {_gby(g)}), "
            f"e AS (SELECT {_gsel(g)}sum(abs(sum_y - sum_p)) AS num FROM b {_gby(g)}) "
            f"SELECT {_gsel(g)}coalesce(num, 0.0) / n AS ece FROM n LEFT JOIN e {_using(g)}")


def ranking_ctes(g):
    part = f"PARTITION BY {', '.join(g)} " if g else ""
    return (f"s AS (SELECT {_gsel(g)}_p, CAST(sum(_y) AS BIGINT) AS pos, CAST(sum(1 - _y) AS BIGINT) AS neg "
            f"FROM d GROUP BY {', '.join(list(g) + ['_p'])}), "
            f"c AS (SELECT *, sum(pos) OVER ({part}ORDER BY _p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cp, "
            f"sum(neg) OVER ({part}ORDER BY _p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cn FROM s), "
            f"r AS (SELECT {_gsel(g)}CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg, "
            f"sum(pos * cn) AS a1, sum(pos * neg) AS a2, sum(pos * cp / (cp + cn)) AS ap FROM c {_gby(g)})")


AUC = ("CASE WHEN n_pos > 0 AND n_neg > 0 THEN 1.0 - (a1 - 0.5 * a2) / (CAST(n_pos AS DOUBLE) * n_neg) END AS auroc, "
       "CASE WHEN n_pos > 0 THEN ap / n_pos END AS auprc")


def ranking_sql(src, g):
    return f"WITH d AS ({prepared(src, g)}), {ranking_ctes(g)} SELECT {_gsel(g)}n_pos, n_neg, {AUC} FROM r"


REPORT_COLUMNS = [
    "n", "n_pos", "tp", "fp", "tn", "fn", "number_errors", "accuracy", "tpr", "fnr", "tnr", "fpr",
    "brier", "nll", "log_likelihood_mean", "elpd", "elpd_mean", "predictive_likelihood",
    "ece", "auroc", "auprc",
]
REPORT_DOUBLES = CONF_DOUBLES + ("ece", "auroc", "auprc")


def report_sql(src, g, threshold=0.5, n_bins=15, edges="left"):
    cols = ", ".join(REPORT_COLUMNS)
    return (f"WITH d AS ({prepared(src, g)}), cnt AS ({counts_cte(g, threshold)}), "
            f"cr AS (SELECT *, {RATES} FROM cnt), b AS ({bins_cte(g, n_bins, edges)}), "
            f"e AS (SELECT {_gsel(g)}sum(abs(sum_y - sum_p)) AS ece_num FROM b {_gby(g)}), {ranking_ctes(g)}, "
            f"j AS (SELECT * FROM cr LEFT JOIN e {_using(g)} LEFT JOIN r {_using(g)}) "
            f"SELECT {_gsel(g)}{cols.replace('ece', 'coalesce(ece_num, 0.0) / n AS ece', 1).replace('auroc, auprc', AUC)} FROM j")
