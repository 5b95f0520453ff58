"""Named sampling / preparation queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import rng
from ..operators import prep as P
from . import views as V
from .catalog import register

_E = V.EMB_SQL


def _u(key, draw="'sample'"):
    return rng.u01_sql(key, draw, "42")


@register("uniform_subsample", f"SELECT id, y FROM ({_E}) ORDER BY {_u('id')}, id LIMIT 100", ops=("P1", "P16"))
def q_subsample(spark, sf):
    return P.subsample(V.emb(spark, sf).select("id", "y"), 100)


def _strat_sql(n_max_expr):
    return (f"WITH m AS ({V.MANIFEST_SQL}), c AS (SELECT count(*) AS n, count_if(label = 1) AS n1 FROM m), "
            f"q AS (SELECT n, n1, least(greatest(1, CAST(round_even(({n_max_expr}) * n1 / n, 0) AS BIGINT)), n1) AS qp, "
            f"least(({n_max_expr}) - greatest(1, CAST(round_even(({n_max_expr}) * n1 / n, 0) AS BIGINT)), n - n1) AS qn "
            "FROM c), r AS (SELECT m.*, row_number() OVER (PARTITION BY label ORDER BY "
            f"{_u('doc_id')}, doc_id) AS rk FROM m) "
            "SELECT doc_id, label FROM r, q WHERE (label = 1 AND rk <= qp) OR (label <> 1 AND rk <= qn)")


@register("stratified_subsample", _strat_sql("least(60, greatest(1, 3200 // 64))"), ops=("P2", "P3", "P11"))
def q_stratified(spark, sf):
    """Cell budget 3200 over d = 64 caps 60 requested rows to 50 (P11), then class quotas."""
    n_max = P.cell_budget_rows(60, 3200, 64)
    m = V.manifest(spark, sf).select("doc_id", "label")
    return P.stratified_or_uniform(m, n_max, label="label", key="doc_id").select("doc_id", "label")


_SPLIT_SQL = (f"WITH r AS (SELECT id, row_number() OVER (ORDER BY {_u('id')}, id) AS rk FROM ({_E})) "
              "SELECT id, CASE WHEN rk <= 300 THEN 'train' ELSE 'test' END AS split FROM r WHERE rk <= 400")


@register("train_test_split", _SPLIT_SQL, ops=("P4",))
def q_split(spark, sf):
    return P.train_test_split(V.emb(spark, sf).select("id"), 300, 100)


_HT_SQL = (f"WITH r AS (SELECT id, row_number() OVER (ORDER BY id) AS rk, count(*) OVER () AS n FROM ({_E})) "
           "SELECT id, CASE WHEN rk <= CAST(floor(0.8 * n) AS BIGINT) THEN 'train' ELSE 'test' END AS split FROM r")


@register("head_tail_split", _HT_SQL, ops=("P5",))
def q_head_tail(spark, sf):
    return P.head_tail_split(V.emb(spark, sf).select("id"), "id", 0.8)


_STD_SQL = (f"WITH e AS ({_E}), l AS (SELECT id, split, generate_subscripts(features, 1) - 1 AS dim, "
            "unnest(features) AS v FROM e), "
            "m AS (SELECT dim, avg(v) AS mean, stddev_pop(v) AS std FROM l WHERE split = 'train' GROUP BY dim) "
            "SELECT id, CAST(dim AS INTEGER) AS dim, (v - mean) / CASE WHEN std >= 1e-6 THEN std ELSE 1.0 END AS z "
            "FROM l JOIN m USING (dim)")


@register("standardize", _STD_SQL, ("z",), ops=("P6",))
def q_standardize(spark, sf):
    e = P.standardize(V.emb(spark, sf), "features", "split", "train")
    return e.select("id", F.posexplode("z").alias("dim", "z"))


@register("positive_class_weight", "SELECT count_if(label = 1) AS n_pos, count_if(label = 0) AS n_neg, "
          "CASE WHEN count_if(label = 1) = 0 OR count_if(label = 0) = 0 THEN 1.0 ELSE "
          f"count_if(label = 0) / count_if(label = 1) END AS pos_weight FROM ({V.MANIFEST_SQL})",
          ("pos_weight",), ops=("P10",))
def q_pos_weight(spark, sf):
    return P.positive_class_weight(V.manifest(spark, sf), "label")


def _tokens_col():
    e = F.col("features")
    return F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice(e, i * 8 + 1, 8))


_POOL_SQL = (f"WITH t AS (SELECT id, [features[i * 8 + 1: i * 8 + 8] FOR i IN range(0, 8)] AS tok FROM ({_E})), "
             "d AS (SELECT id, tok, unnest(range(0, 8)) AS dim FROM t) "
             "SELECT id, CAST(dim AS INTEGER) AS dim, tok[1][dim + 1] AS cls, "
             "(tok[2][dim + 1] + tok[3][dim + 1] + tok[4][dim + 1] + tok[5][dim + 1] + tok[6][dim + 1] + "
             "tok[7][dim + 1] + tok[8][dim + 1]) / 7 AS mean FROM d")


@register("token_pooling", _POOL_SQL, ("cls", "mean"), ops=("P12",))
def q_pool(spark, sf):
    e = V.emb(spark, sf).select("id", _tokens_col().alias("tok"))
    p = e.select("id", P.pool_tokens("tok", "cls").alias("cls"), P.pool_tokens("tok", "mean").alias("mean"))
    return p.select("id", F.posexplode(F.arrays_zip("cls", "mean")).alias("dim", "z")) \
        .select("id", "dim", F.col("z.cls").alias("cls"), F.col("z.mean").alias("mean"))


_MASK_SQL = (f"WITH p AS (SELECT id, unnest(range(0, 8)) AS i FROM ({_E})), "
             f"s AS (SELECT id, i, row_number() OVER (PARTITION BY id ORDER BY {rng.u01_sql('id', chr(39) + 'tok' + chr(39) + ' || CAST(i AS VARCHAR)', '42')}, i) AS rk FROM p) "
             "SELECT id, CAST(i AS INTEGER) AS kept_pos FROM s WHERE rk <= greatest(1, CAST(round_even(8 * (1 - 0.5), 0) AS INTEGER))")


@register("token_masking", _MASK_SQL, ops=("P13",))
def q_mask(spark, sf):
    e = V.emb(spark, sf).select("id", _tokens_col().alias("tok"))
    m = P.mask_tokens(e, "tok", "id", ratio=0.5)
    return m.select("id", F.explode("kept_idx").alias("kept_pos"))


@register("pca_fit", None, ops=("P7",))
def q_pca_fit(spark, sf):
    comps, mean, ratio = P.pca_fit(V.emb(spark, sf), 8, where=F.col("split") == "train")
    return spark.createDataFrame([(i, float(r), [float(v) for v in c]) for i, (r, c) in enumerate(zip(ratio, comps))],
                                 "component int, explained_variance_ratio double, loading array<double>")


@register("pca_project", None, ops=("P8", "P9"))
def q_pca_project(spark, sf):
    e = V.emb(spark, sf)
    comps, mean, _ = P.pca_fit(e, 2, where=F.col("split") == "train")
    pr = P.pca_transform(e, comps, mean)
    return pr.select("id", "split", F.col("projected")[0].alias("pc1"), F.col("projected")[1].alias("pc2"))


# the two largest axes of a 2 × 2 covariance; each axis has its larger entry positive
_PLANE_SQL = (f"WITH e AS (SELECT id, split, features[1] AS x, features[2] AS y FROM ({V.EMB_SQL})), "
              "m AS (SELECT avg(x) AS mx, avg(y) AS my, var_samp(x) AS a, covar_samp(x, y) AS b, var_samp(y) AS c FROM e WHERE split = 'train'), "
              "l AS (SELECT *, (a + c) / 2 + sqrt((a - c) * (a - c) / 4 + b * b) AS l1, (a + c) / 2 - sqrt((a - c) * (a - c) / 4 + b * b) AS l2 FROM m), "
              "u AS (SELECT *, CASE WHEN a >= c THEN l1 - c ELSE b END AS ux, CASE WHEN a >= c THEN b ELSE l1 - a END AS uy FROM l), "
              "n AS (SELECT *, ux / sqrt(ux * ux + uy * uy) AS px, uy / sqrt(ux * ux + uy * uy) AS py FROM u), "
              "s AS (SELECT *, CASE WHEN abs(px) >= abs(py) THEN sign(px) ELSE sign(py) END AS s1, CASE WHEN abs(py) >= abs(px) THEN sign(-py) ELSE sign(px) END AS s2 FROM n) "
              "SELECT id, ((x - mx) * px + (y - my) * py) * s1 AS pc1, ((y - my) * px - (x - mx) * py) * s2 AS pc2, l1 / (l1 + l2) AS ratio1, l2 / (l1 + l2) AS ratio2 FROM e, s")


@register("pca_plane", _PLANE_SQL, ("pc1", "pc2", "ratio1", "ratio2"), ops=("P7", "P8", "P9"))
def q_pca_plane(spark, sf):
    """PCA of the first two features, fitted on train rows and applied to all; SQL has the 2 × 2 eigenvectors."""
    e = V.emb(spark, sf).select("id", "split", F.slice("features", 1, 2).alias("features"))
    comps, mean, ratio = P.pca_fit(e, 2, where=F.col("split") == "train")
    pr = P.pca_transform(e, comps, mean)
    return pr.select("id", F.col("projected")[0].alias("pc1"), F.col("projected")[1].alias("pc2"), F.lit(float(ratio[0])).alias("ratio1"), F.lit(float(ratio[1])).alias("ratio2"))


@register("feature_extraction", None, ops=("P14", "U1"))
def q_extract(spark, sf):
    pages = V.table(spark, sf, "pages").select("page_id", F.encode("html", "UTF-8").alias("content"))
    f = P.extract_features(pages, "content", dim=16)
    return f.select("page_id", F.size("features").alias("dim"), F.aggregate("features", F.lit(0.0),
                                                                             lambda a, v: a + v).alias("mass"))


@register("pending_rows", "SELECT page_id, url FROM pages WHERE " + rng.u01_sql("page_id", "'done'", "42") + " >= 0.5",
          ops=("P15",))
def q_pending(spark, sf):
    """Rows of pages whose features are not yet in the output (half marked done)."""
    pages = V.table(spark, sf, "pages").select("page_id", "url")
    done = pages.filter(rng.u01(F.col("page_id"), "done", 42) < 0.5).select("page_id")
    return P.pending_rows(pages, done, "page_id")


def _wsample_sql(replace: bool, k: int = 20):
    if not replace:
        g = rng.gumbel_sql("o_orderkey", "'wor'", "42")
        return (f"SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 0 "
                f"ORDER BY ln(o_totalprice) + {g} DESC, o_orderkey LIMIT {k}")
    parts = [f"SELECT CAST({j} AS INTEGER) AS draw, arg_max(o_orderkey, ln(o_totalprice) + "
             f"{rng.gumbel_sql('o_orderkey', str(j), '42')}) AS o_orderkey FROM orders WHERE o_totalprice > 0"
             for j in range(k)]
    return " UNION ALL ".join(parts)


@register("weighted_sample_without_replacement", _wsample_sql(False), ("o_totalprice",), ops=("L20", "P1"))
def q_wor(spark, sf):
    """20 orders drawn ∝ total price without replacement (Gumbel top-k)."""
    o = V.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return P.weighted_sample(o, "o_totalprice", 20, key="o_orderkey")


@register("weighted_sample_with_replacement", _wsample_sql(True), ops=("L20",))
def q_wr(spark, sf):
    """20 independent draws ∝ total price (with replacement), one pass of 20 max_by aggregates."""
    o = V.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return P.weighted_sample(o, "o_totalprice", 20, key="o_orderkey", replace=True) \
        .select(F.col("draw").cast("int").alias("draw"), "o_orderkey")
