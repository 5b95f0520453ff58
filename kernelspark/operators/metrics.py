"""Evaluation of probabilistic binary predictions.

Every operator takes ``group_by`` so overall, per-group and per-source metrics
are the same code. Inputs are columns ``y`` (0/1) and ``p`` (probability);
probabilities are clipped to [1e-12, 1 − 1e-12] first, as the reference does.
Undefined metrics are SQL NULL, never NaN.

Shuffle budget of ``binary_report``: one scan and one map-side-combined
shuffle of the input into the distinct-score table; every metric is then a
sum over that table, plus bucketed windows over distinct scores for the
ranking metrics (see ``ordered.prefix_sums``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_table
from .ordered import exact_quantiles, join_null_safe, prefix_sums

# Fixed values that must equal the reference's for equal results.
EPS = 1e-12            # probability clip
DEFAULT_BINS = 15      # ECE bins
DEFAULT_THRESHOLD = 0.5


def _g(group_by) -> list[str]:
    if group_by is None:
        return []
    if isinstance(group_by, str):
        return [group_by]
    return list(group_by)


def clip_p(p: Column, eps: float = EPS) -> Column:
    return F.greatest(F.least(p.cast("double"), F.lit(1.0 - eps)), F.lit(eps))


def prepare(df: DataFrame, y: str = "y", p: str = "p", group_by=(), clip: bool = True) -> DataFrame:
    g = _g(group_by)
    pc = clip_p(F.col(p)) if clip else F.col(p).cast("double")
    return df.select(*g, F.col(y).cast("int").alias("_y"), pc.alias("_p"))


def log_term(y: Column, p: Column) -> Column:
    """y·ln p + (1 − y)·ln(1 − p) on clipped p."""
    return F.when(y == 1, F.log(p)).otherwise(F.log(F.lit(1.0) - p))


# ---------------------------------------------------------------- E1–E7 -------

def _div(num: Column, den: Column, zero_policy: str) -> Column:
    if zero_policy == "max1":
        return num.cast("double") / F.greatest(den, F.lit(1)).cast("double")
    return F.when(den > 0, num.cast("double") / den.cast("double"))


def count_aggs(threshold: float = DEFAULT_THRESHOLD) -> list[Column]:
    yh = F.col("_p") >= F.lit(threshold)
    y1 = F.col("_y") == 1
    lt = log_term(F.col("_y"), F.col("_p"))
    return [
        F.count(F.lit(1)).alias("n"),
        F.count_if(yh & y1).alias("tp"),
        F.count_if(yh & ~y1).alias("fp"),
        F.count_if(~yh & ~y1).alias("tn"),
        F.count_if(~yh & y1).alias("fn"),
        F.avg((F.col("_p") - F.col("_y")) * (F.col("_p") - F.col("_y"))).alias("brier"),
        F.sum(lt).alias("elpd"),
        F.avg(lt).alias("elpd_mean"),
    ]


def derived_rates(zero_policy: str = "null") -> list[Column]:
    tp, fp, tn, fn, n = (F.col(c) for c in ("tp", "fp", "tn", "fn", "n"))
    return [
        (fp + fn).alias("number_errors"),
        ((tp + tn).cast("double") / n.cast("double")).alias("accuracy"),
        _div(tp, tp + fn, zero_policy).alias("tpr"),
        (_div(fn, tp + fn, zero_policy) if zero_policy == "null"
         else (F.lit(1.0) - _div(tp, tp + fn, zero_policy))).alias("fnr"),
        _div(tn, tn + fp, zero_policy).alias("tnr"),
        (_div(fp, tn + fp, zero_policy) if zero_policy == "null"
         else (F.lit(1.0) - _div(tn, tn + fp, zero_policy))).alias("fpr"),
        (-F.col("elpd_mean")).alias("nll"),
        F.col("elpd_mean").alias("log_likelihood_mean"),
        F.exp(F.col("elpd_mean")).alias("predictive_likelihood"),
    ]


def confusion(df: DataFrame, y="y", p="p", group_by=(), threshold=DEFAULT_THRESHOLD,
              zero_policy: str = "null") -> DataFrame:
    """Counts, rates, accuracy, Brier and likelihood summaries."""
    g = _g(group_by)
    d = prepare(df, y, p, g)
    base = d.groupBy(*g).agg(*count_aggs(threshold))
    return base.select("*", *derived_rates(zero_policy))


def precision_recall(df: DataFrame, y="y", p="p", group_by=(), threshold=DEFAULT_THRESHOLD) -> DataFrame:
    """Precision and recall (0 when undefined), predicted and target positive rates."""
    g = _g(group_by)
    d = prepare(df, y, p, g)
    yh = F.col("_p") >= F.lit(threshold)
    y1 = F.col("_y") == 1
    a = d.groupBy(*g).agg(F.count(F.lit(1)).alias("n"), F.count_if(yh & y1).alias("tp"),
                          F.count_if(yh).alias("pred_pos"), F.count_if(y1).alias("true_pos"))
    return a.select(
        *g, "n",
        F.when(F.col("pred_pos") > 0, F.col("tp") / F.col("pred_pos")).otherwise(F.lit(0.0)).alias("precision"),
        F.when(F.col("true_pos") > 0, F.col("tp") / F.col("true_pos")).otherwise(F.lit(0.0)).alias("recall"),
        (F.col("pred_pos") / F.col("n")).alias("positive_rate"),
        (F.col("true_pos") / F.col("n")).alias("target_positive_rate"),
    )


# ---------------------------------------------------------------- E10–E12 -----

def _bin_col(n_bins: int, edges: str) -> Column:
    if edges == "left":     # [lo, hi), last bin closed
        return F.least(F.floor(F.col("_p") * F.lit(n_bins)), F.lit(n_bins - 1)).cast("int")
    if edges == "right":    # (lo, hi]; p = 0 belongs to no bin
        return (F.ceil(F.col("_p") * F.lit(n_bins)) - F.lit(1)).cast("int")
    raise ValueError("edges must be 'left' or 'right'")


def calibration_bins(d: DataFrame, g: list[str], n_bins: int, edges: str) -> DataFrame:
    dd = d if edges == "left" else d.filter(F.col("_p") > 0)
    return dd.withColumn("bin", _bin_col(n_bins, edges)).groupBy(*g, "bin").agg(
        F.count(F.lit(1)).alias("count"), F.sum("_p").alias("sum_p"), F.sum("_y").alias("sum_y"))


def ece(df: DataFrame, y="y", p="p", group_by=(), n_bins=DEFAULT_BINS, edges="left",
        clip: bool = True) -> DataFrame:
    """E10 (edges='left') / E11 (edges='right'): Σ_b |Σy − Σp| / n per group."""
    g = _g(group_by)
    d = prepare(df, y, p, g, clip=clip)
    n = d.groupBy(*g).agg(F.count(F.lit(1)).alias("n"))
    b = calibration_bins(d, g, n_bins, edges).groupBy(*g).agg(
        F.sum(F.abs(F.col("sum_y") - F.col("sum_p"))).alias("_num"))
    return join_null_safe(n, b, g, "left").select(
        *g, (F.coalesce(F.col("_num"), F.lit(0.0)) / F.col("n")).alias("ece"))


def reliability_table(df: DataFrame, y="y", p="p", group_by=(), n_bins=DEFAULT_BINS,
                      edges="right") -> DataFrame:
    """Every bin of every group, empty bins kept with mid-point confidence."""
    g = _g(group_by)
    d = prepare(df, y, p, g, clip=False)
    stats = calibration_bins(d, g, n_bins, edges)
    every_bin = F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))).alias("bin")
    grid = d.select(*g).distinct().select(*g, every_bin) if g else \
        df.sparkSession.range(n_bins).select(F.col("id").cast("int").alias("bin"))
    t = join_null_safe(grid, stats, g + ["bin"], "left")
    return t.select(
        *g, "bin",
        (F.col("bin") / F.lit(float(n_bins))).alias("lo"),
        ((F.col("bin") + 1) / F.lit(float(n_bins))).alias("hi"),
        F.coalesce(F.col("count"), F.lit(0)).alias("count"),
        (F.col("sum_y") / F.col("count")).alias("accuracy"),
        F.coalesce(F.col("sum_p") / F.col("count"),
                   (F.col("bin") + F.lit(0.5)) / F.lit(float(n_bins))).alias("confidence"),
    )


# ---------------------------------------------------------------- E13–E15 -----

def score_table(d: DataFrame, g: list[str]) -> DataFrame:
    """One row per (group, distinct score): positives and negatives at that score."""
    return d.groupBy(*g, "_p").agg(F.sum("_y").cast("long").alias("pos"),
                                   F.sum(F.lit(1) - F.col("_y")).cast("long").alias("neg"))


def rank_sums() -> list[Column]:
    """Sums over the score table behind AUROC and AUPRC. Pair counts pass 2**63 from about
    3e9 rows a class, so products and sums are doubles."""
    pos, neg, cum_pos = (F.col(c).cast("double") for c in ("pos", "neg", "cum_pos"))
    return [F.sum(pos * F.col("cum_neg")).alias("_a1"), F.sum(pos * neg).alias("_a2"),
            F.sum(pos * cum_pos / (F.col("cum_pos") + F.col("cum_neg"))).alias("_ap")]


def ranking(df: DataFrame, y="y", p="p", group_by=(), n_buckets: int = 64, clip: bool = True) -> DataFrame:
    """E13 AUROC (average ranks with ties) and E14 AUPRC (average precision)."""
    g = _g(group_by)
    d = prepare(df, y, p, g, clip=clip)
    s = prefix_sums(score_table(d, g), g, "_p", ["pos", "neg"], descending=True, n_buckets=n_buckets)
    a = s.groupBy(*g).agg(
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"),
        *rank_sums())
    pn = F.col("n_pos").cast("double") * F.col("n_neg").cast("double")
    return a.select(
        *g, "n_pos", "n_neg",
        F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0),
               F.lit(1.0) - (F.col("_a1") - F.lit(0.5) * F.col("_a2")) / pn).alias("auroc"),
        F.when(F.col("n_pos") > 0, F.col("_ap") / F.col("n_pos")).alias("auprc"),
    )


def roc_curve(df: DataFrame, y="y", p="p", group_by=(), drop_intermediate: bool = True,
              n_buckets: int = 64) -> DataFrame:
    """(fpr, tpr, threshold) at every distinct threshold plus the origin.

    The origin row has a NULL threshold (the reference's library uses +inf).
    ``drop_intermediate`` removes points collinear with both neighbours.
    """
    g = _g(group_by)
    d = prepare(df, y, p, g, clip=False)
    s = prefix_sums(score_table(d, g), g, "_p", ["pos", "neg"], descending=True,
                    n_buckets=n_buckets, with_next=True)
    tot = s.groupBy(*g).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    s = join_null_safe(s, tot, g, broadcast_right=not g)
    pts = s.select(*g, F.col("_p").alias("threshold"), "cum_pos", "cum_neg", "pos", "neg",
                   "next_pos", "next_neg", "P", "N")
    if drop_intermediate:
        # second differences of the cumulative counts: next − current increments
        keep = (F.col("next_pos").isNull() | (F.col("next_pos") != F.col("pos"))
                | (F.col("next_neg") != F.col("neg")))
        # the first point (highest threshold) is always kept
        first = (F.col("cum_pos") == F.col("pos")) & (F.col("cum_neg") == F.col("neg"))
        pts = pts.filter(keep | first)
    curve = pts.select(
        *g, "threshold",
        F.when(F.col("N") > 0, F.col("cum_neg") / F.col("N")).alias("fpr"),
        F.when(F.col("P") > 0, F.col("cum_pos") / F.col("P")).alias("tpr"))
    origin = tot.select(*g, F.lit(None).cast("double").alias("threshold"),
                        F.when(F.col("N") > 0, F.lit(0.0)).alias("fpr"),
                        F.when(F.col("P") > 0, F.lit(0.0)).alias("tpr"))
    return curve.unionByName(origin)


# ---------------------------------------------------------------- E16 ---------

REPORT_COLUMNS = [
    "n", "n_pos", "tp", "fp", "tn", "fn", "number_errors", "accuracy", "tpr", "fnr", "tnr", "fpr",
    "brier", "nll", "log_likelihood_mean", "elpd", "elpd_mean", "predictive_likelihood",
    "ece", "auroc", "auprc",
]


def binary_report(df: DataFrame, y="y", p="p", group_by=(), threshold=DEFAULT_THRESHOLD,
                  n_bins=DEFAULT_BINS, edges="left", zero_policy="null",
                  n_buckets: int = 64, draws: DataFrame | None = None) -> DataFrame:
    """One row per group with E1–E7, E10, E13, E14 (and E8 when ``draws`` given).

    ONE scan and ONE shuffle of the input: rows are combined map-side into the
    distinct-score table (group, p, positives, negatives). Counts, Brier,
    likelihood, calibration bins and the ranking metrics are all sums over
    that table, which has one row per distinct score (11 per group for the
    tie-heavy driver table, at most one per row for continuous scores).

    ``draws`` (optional): columns ``draw``, ``y``, ``p`` (+ group columns) of
    posterior predictive probability samples, for PELL.
    """
    g = _g(group_by)
    out = report_of_scores(checkpoint_table(score_table(prepare(df, y, p, g), g), df.sparkSession, "score-table"), g,
                           threshold, n_bins, edges, zero_policy, n_buckets)
    if draws is not None:
        out = join_null_safe(out, pell(draws, group_by=g), g, "left")
    return out


def report_of_scores(s: DataFrame, g: list[str], threshold=DEFAULT_THRESHOLD, n_bins=DEFAULT_BINS, edges="left",
                     zero_policy="null", n_buckets: int = 64) -> DataFrame:
    """The report over a score table (groups, _p, pos, neg)."""
    P_, pos, neg = F.col("_p"), F.col("pos"), F.col("neg")
    cnt = pos + neg
    hi = P_ >= F.lit(threshold)
    base = s.groupBy(*g).agg(
        F.sum(cnt).alias("n"), F.sum(pos).alias("n_pos"), F.sum(neg).alias("_n_neg"),
        F.sum(F.when(hi, pos).otherwise(0)).alias("tp"), F.sum(F.when(hi, neg).otherwise(0)).alias("fp"),
        F.sum(F.when(~hi, neg).otherwise(0)).alias("tn"), F.sum(F.when(~hi, pos).otherwise(0)).alias("fn"),
        F.sum(pos * (P_ - 1) * (P_ - 1) + neg * P_ * P_).alias("_sq"),
        F.sum(pos * F.log(P_) + neg * F.log(F.lit(1.0) - P_)).alias("elpd"))
    base = base.withColumn("brier", F.col("_sq") / F.col("n")).withColumn("elpd_mean", F.col("elpd") / F.col("n"))
    base = base.select("*", *derived_rates(zero_policy))
    binned = (s if edges == "left" else s.filter(P_ > 0)).withColumn("bin", _bin_col(n_bins, edges))
    bins = binned.groupBy(*g, "bin").agg(F.sum(pos).alias("sum_y"), F.sum(cnt * P_).alias("sum_p")) \
        .groupBy(*g).agg(F.sum(F.abs(F.col("sum_y") - F.col("sum_p"))).alias("_ece_num"))
    ps = prefix_sums(s, g, "_p", ["pos", "neg"], descending=True, n_buckets=n_buckets)
    rk = ps.groupBy(*g).agg(
        *rank_sums())
    r = join_null_safe(join_null_safe(base, bins, g, "left"), rk, g, "left")
    pn = F.col("n_pos").cast("double") * F.col("_n_neg").cast("double")
    r = r.withColumn("ece", F.coalesce(F.col("_ece_num"), F.lit(0.0)) / F.col("n")) \
         .withColumn("auroc", F.when((F.col("n_pos") > 0) & (F.col("_n_neg") > 0),
                                     F.lit(1.0) - (F.col("_a1") - F.lit(0.5) * F.col("_a2")) / pn)) \
         .withColumn("auprc", F.when(F.col("n_pos") > 0, F.col("_ap") / F.col("n_pos")))
    return r.select(*g, *REPORT_COLUMNS)


# ---------------------------------------------------------------- E8, E9 ------

def pell(draws: DataFrame, y="y", p="p", draw="draw", group_by=()) -> DataFrame:
    """Posterior expected log likelihood from probability draws.

    pell = mean over draws of Σ_i log p(y_i | draw); also per-observation forms.
    """
    g = _g(group_by)
    lt = log_term(F.col(y).cast("int"), clip_p(F.col(p)))
    return pell_of_draws(draws.groupBy(*g, draw).agg(F.sum(lt).alias("ll"), F.count(F.lit(1)).alias("n")), g)


def pell_of_draws(per_draw: DataFrame, group_by=()) -> DataFrame:
    """E8 from (draw, ll, n): the log likelihood and row count of each draw."""
    g = _g(group_by)
    per_draw = per_draw.withColumnsRenamed({"ll": "_ll", "n": "_n"})
    a = per_draw.groupBy(*g).agg(F.avg("_ll").alias("pell"), F.max("_n").alias("_n_obs"))
    return a.select(*g, "pell",
                    (F.col("pell") / F.col("_n_obs")).alias("pell_mean"),
                    (-F.col("pell") / F.col("_n_obs")).alias("posterior_log_loss_mean"),
                    (-F.col("pell")).alias("posterior_total_log_loss"))


def log_expit(f: Column) -> Column:
    """Stable log σ(f) = −log1p(exp(−|f|)) + min(f, 0)."""
    return -F.log1p(F.exp(-F.abs(f))) + F.least(f, F.lit(0.0))


def pell_latent(draws: DataFrame, y="y", latent="latent", draw="draw", group_by=()) -> DataFrame:
    """PELL from latent draws: log p(y|f) = log σ(f) if y=1 else log σ(−f)."""
    g = _g(group_by)
    f = F.col(latent).cast("double")
    lt = F.when(F.col(y) == 1, log_expit(f)).otherwise(log_expit(-f))
    per_draw = draws.groupBy(*g, draw).agg(F.sum(lt).alias("ll"), F.count(F.lit(1)).alias("n"))
    return pell_of_draws(per_draw, g).select(*g, "pell", "pell_mean")


# ---------------------------------------------------------------- E17–E19 -----

def array_stats(df: DataFrame, columns: Sequence[str], group_by=()) -> DataFrame:
    """NaN-aware mean / population std / min / max for each named column (long form)."""
    g = _g(group_by)
    stack = F.explode(F.array(*[F.struct(F.lit(c).alias("column"),
                                         F.nanvl(F.col(c).cast("double"), F.lit(None)).alias("v"))
                                for c in columns])).alias("_kv")
    long = df.select(*g, stack).select(*g, "_kv.column", "_kv.v")
    return long.groupBy(*g, "column").agg(
        F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"),
        F.min("v").alias("min"), F.max("v").alias("max"), F.count("v").alias("n_finite"))


SUMMARY_COLUMNS = ["prob_mean", "prob_variance", "prob_q05", "prob_q50", "prob_q95",
                   "latent_mean", "latent_variance", "latent_q05", "latent_q50", "latent_q95"]


def compare_summaries(reference: DataFrame, candidate: DataFrame, key: str = "id",
                      columns: Sequence[str] | None = None, group_by=()) -> DataFrame:
    """MAE and RMSE per summary column shared by both sides (long form).

    Raises when no column is comparable, like the reference.
    """
    g = _g(group_by)
    cols = [c for c in (columns or SUMMARY_COLUMNS) if c in reference.columns and c in candidate.columns]
    if not cols:
        raise ValueError("no comparable summary columns between reference and candidate")
    r = reference.select(key, *g, *[F.col(c).alias(f"r_{c}") for c in cols])
    c_ = candidate.select(key, *[F.col(c).alias(f"c_{c}") for c in cols])
    j = r.join(c_, key)
    diffs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"),
                                         (F.col(f"c_{c}") - F.col(f"r_{c}")).cast("double").alias("d"))
                                for c in cols])).alias("_kv")
    long = j.select(*g, diffs).select(*g, "_kv.column", "_kv.d")
    return long.groupBy(*g, "column").agg(F.avg(F.abs("d")).alias("mae"),
                                          F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rmse"))


def compare_methods(methods: DataFrame, reference_method: str, key="id", method="method",
                    value="p") -> DataFrame:
    """Every method against one reference method: MAE, RMSE, max abs diff, n."""
    ref = methods.filter(F.col(method) == reference_method).select(key, F.col(value).alias("_ref"))
    others = methods.filter(F.col(method) != reference_method)
    j = others.join(ref, key)
    d = F.col(value).cast("double") - F.col("_ref").cast("double")
    return j.groupBy(method).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(d)).alias("mae"),
                                 F.sqrt(F.avg(d * d)).alias("rmse"), F.max(F.abs(d)).alias("max_abs_diff"))


# ---------------------------------------------------------------- E20, E21 ----

def eligible_groups(df: DataFrame, group: str, y="y", min_n: int = 10) -> DataFrame:
    """E20 filter: groups with at least ``min_n`` rows and both classes."""
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"), F.countDistinct(y).alias("_k")) \
        .filter((F.col("_n") >= min_n) & (F.col("_k") == 2)).select(group)


def per_group_report(df: DataFrame, group: str, y="y", p="p", min_n: int = 10, **kw) -> DataFrame:
    """binary_report for each eligible group."""
    ok = eligible_groups(df, group, y, min_n)
    return binary_report(df.join(ok, group, "left_semi"), y, p, group_by=[group], **kw)


def report_with_total(df: DataFrame, group: str, y="y", p="p", total_label: str = "ALL", **kw) -> DataFrame:
    """Per-group rows plus a combined row, which carries ``total_label`` in the group column.

    Both levels are reports over one stored score table (group, score, positives,
    negatives), so the input is read and shuffled once, and a real group of the same name
    stays a row of its own.
    """
    spark = df.sparkSession
    scores = checkpoint_table(score_table(prepare(df, y, p, [group]), [group]), spark, "score-table")
    label = F.col(group).cast("string")
    per = report_of_scores(scores.withColumn(group, label), [group], **kw)
    total = report_of_scores(scores.groupBy("_p").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")), [], **kw)
    return per.unionByName(total.select(F.lit(total_label).alias(group), "*"))


# ---------------------------------------------------------------- E22–E24 -----

def method_pair(a: DataFrame, b: DataFrame, key="id", y="y", p="p") -> DataFrame:
    """left/right metrics of two methods on the same rows, and their differences."""
    j = a.select(key, F.col(y).alias("y"), F.col(p).cast("double").alias("p_a")).join(
        b.select(key, F.col(p).cast("double").alias("p_b")), key)
    diff = F.abs(F.col("p_a") - F.col("p_b"))
    s = j.agg(F.avg(diff).alias("mean_abs_diff"), F.max(diff).alias("max_abs_diff"),
              F.corr("p_a", "p_b").alias("pearson_r"), F.count(F.lit(1)).alias("n"))
    ra = binary_report(j, "y", "p_a").select(*[F.col(c).alias(f"{c}_a") for c in ("nll", "brier", "auroc")])
    rb = binary_report(j, "y", "p_b").select(*[F.col(c).alias(f"{c}_b") for c in ("nll", "brier", "auroc")])
    out = s.crossJoin(ra).crossJoin(rb)  # three one-row tables
    return out.select("*", *[(F.col(f"{c}_b") - F.col(f"{c}_a")).alias(f"delta_{c}")
                             for c in ("nll", "brier", "auroc")])


def wasserstein_draws(draws_a: DataFrame, draws_b: DataFrame, key="id", value="p") -> DataFrame:
    """Per-key W1 between equal-size draw sets (sorted difference), then the mean."""
    w = Window.partitionBy(key).orderBy(value)
    ra = draws_a.select(key, F.col(value).cast("double").alias("va"), F.row_number().over(
        Window.partitionBy(key).orderBy(value)).alias("r"))
    rb = draws_b.select(key, F.col(value).cast("double").alias("vb"), F.row_number().over(w).alias("r"))
    per = ra.join(rb, [key, "r"]).groupBy(key).agg(F.avg(F.abs(F.col("va") - F.col("vb"))).alias("w1"))
    return per.agg(F.avg("w1").alias("mean_w1"), F.max("w1").alias("max_w1"), F.count(F.lit(1)).alias("n"))


# Fixed values that must equal the reference's: the diagnostic roles, in order.
DIAGNOSTIC_ROLES = ["highest-confidence correct", "highest-confidence incorrect", "most uncertain",
                    "median-uncertainty correct"]


def _middle(rows: DataFrame, key: str) -> DataFrame:
    """The row at position ⌊n/2⌋ by (conf, key): first its confidence, from counted
    confidences, then its key among the rows with that confidence, from counted keys."""
    def at(counted: DataFrame, order: str, position: DataFrame) -> DataFrame:
        run = prefix_sums(counted, [], order, ["_c"], descending=False).crossJoin(F.broadcast(position))  # one row
        before = F.col("cum__c") - F.col("_c")
        return run.filter((before <= F.col("_pos")) & (F.col("_pos") < F.col("cum__c"))) \
                  .select(F.col(order).alias("_at"), (F.col("_pos") - before).alias("_pos"))

    by_conf = rows.groupBy("conf").agg(F.count(F.lit(1)).alias("_c"))
    conf = at(by_conf, "conf", by_conf.agg(F.floor(F.sum("_c") / 2).alias("_pos")))
    same = rows.join(F.broadcast(conf), F.col("conf") == F.col("_at")).drop("_at", "_pos")
    by_key = same.groupBy(key).agg(F.count(F.lit(1)).alias("_c"))
    found = at(by_key, key, conf.select("_pos"))
    return same.join(F.broadcast(found.select("_at")), F.col(key) == F.col("_at")).drop("_at").orderBy("y", "p").limit(1)


def diagnostic_points(df: DataFrame, key="id", y="y", p="p", threshold=0.5, n_points: int = 4) -> DataFrame:
    """Up to four illustrative rows (a report, hence the limits).

    Highest-confidence correct and incorrect rows, the most uncertain row, the
    correct row at position ⌊n/2⌋ of the correct rows sorted by confidence, then
    fallback rows in ascending confidence until four are chosen. Ties go to the
    lowest key. ``pos`` is the 1-based position in the chosen list.
    """
    d = df.select(key, F.col(y).cast("int").alias("y"), F.col(p).cast("double").alias("p"))
    d = d.withColumn("correct", (F.col("p") >= threshold).cast("int") == F.col("y")) \
         .withColumn("conf", F.abs(F.col("p") - F.lit(0.5)))
    corr = d.filter("correct")
    picks = [(0, d.filter("correct").orderBy(F.col("conf").desc(), F.col(key)).limit(1)),
             (1, d.filter(~F.col("correct")).orderBy(F.col("conf").desc(), F.col(key)).limit(1)),
             (2, d.orderBy(F.col("conf").asc(), F.col(key)).limit(1))]
    picks.append((3, _middle(corr, key)))
    chosen = None
    for slot, src in picks:
        part = src.select(F.lit(slot).alias("_slot"), F.lit(DIAGNOSTIC_ROLES[slot]).alias("role"), key, "y", "p", "conf")
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = chosen.orderBy("_slot").collect()                          # ≤ 4 rows
    spark = df.sparkSession
    out = [(i + 1, r["role"], r[key], r["y"], r["p"]) for i, r in enumerate(rows)]
    need = n_points - len(out)
    if need > 0:
        used = [r[key] for r in rows]
        rest = d.filter(~F.col(key).isin(used)) if used else d
        for r in rest.orderBy(F.col("conf").asc(), F.col(key)).limit(need).collect():
            out.append((len(out) + 1, f"fallback point {len(out) + 1}", r[key], r["y"], r["p"]))
    key_type = df.schema[key].dataType.simpleString()
    return spark.createDataFrame(out[:n_points], f"pos int, role string, {key} {key_type}, y int, p double")


# ---------------------------------------------------------------- E25–E27 -----

def regression_metrics(df: DataFrame, true="true", pred="pred", group_by=()) -> DataFrame:
    """MSE, MAE and SMAPE = mean(|t − p| / ((|t| + |p|) / 2)); a 0/0 row is NULL."""
    g = _g(group_by)
    t, p = F.col(true).cast("double"), F.col(pred).cast("double")
    term = F.try_divide(F.abs(t - p), (F.abs(t) + F.abs(p)) / F.lit(2.0))
    return df.groupBy(*g).agg(F.avg((t - p) * (t - p)).alias("mse"), F.avg(F.abs(t - p)).alias("mae"),
                              F.avg(term).alias("smape"))


def weighted_loss(df: DataFrame, loss="loss", n="n", group_by=()) -> DataFrame:
    """Sample-weighted mean of per-batch losses."""
    g = _g(group_by)
    return df.groupBy(*g).agg((F.sum(F.col(loss) * F.col(n)) / F.sum(n)).alias("mean_loss"))


def bce_with_pos_weight(y: Column, p: Column, pos_weight: float | Column) -> Column:
    """−(w·y·ln p + (1 − y)·ln(1 − p)) on clipped p."""
    w = pos_weight if isinstance(pos_weight, Column) else F.lit(float(pos_weight))
    pc = clip_p(p)
    return -(w * y * F.log(pc) + (F.lit(1) - y) * F.log(F.lit(1.0) - pc))


def best_epoch(history: DataFrame, run="run", epoch="epoch", score="score", loss=None,
               patience: int = 5) -> DataFrame:
    """Per run, the best epoch (max score, first wins; −loss when score is null)
    and the epoch where patience stops training; epochs after that stop don't count."""
    key = F.coalesce(F.col(score).cast("double"),
                     -F.col(loss).cast("double") if loss else F.lit(None).cast("double"))
    h = history.withColumn("_key", key)
    w = Window.partitionBy(run).orderBy(epoch).rowsBetween(Window.unboundedPreceding, -1)
    h = h.withColumn("_prev_best", F.max("_key").over(w))
    h = h.withColumn("_improved", F.col("_prev_best").isNull() | (F.col("_key") > F.col("_prev_best")))
    w2 = Window.partitionBy(run).orderBy(epoch).rowsBetween(Window.unboundedPreceding, 0)
    h = h.withColumn("_last_improve", F.max(F.when(F.col("_improved"), F.col(epoch))).over(w2))
    h = h.withColumn("_stale", F.col(epoch) - F.col("_last_improve"))
    h = h.withColumn("_stop", F.min(F.when(F.col("_stale") >= patience, F.col(epoch))).over(Window.partitionBy(run)))
    ran = F.col("_stop").isNull() | (F.col(epoch) <= F.col("_stop"))
    return h.groupBy(run).agg(
        F.min_by(F.col(epoch), F.when(ran, F.struct(-F.col("_key"), F.col(epoch)))).alias("best_epoch"),
        F.max(F.when(ran, F.col("_key"))).alias("best_score"),
        F.min("_stop").alias("stop_epoch"),
        F.count(F.lit(1)).alias("n_epochs"))
