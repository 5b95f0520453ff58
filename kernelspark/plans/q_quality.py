"""Named manifest / quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import quality as Q
from . import views as V
from .catalog import register

_M, _F, _S = V.MANIFEST_SQL, V.FILES_SQL, V.EMB_FILES_SQL
_BASE = "regexp_extract({c}, '([^/]*)$', 1)"


def _audit_sql():
    b = _BASE.format(c="r._ref")
    return (f"m AS ({_M}), f AS (SELECT DISTINCT path FROM ({_F})), "
            f"bb AS (SELECT {_BASE.format(c='path')} AS base, min(path) AS bpath FROM f GROUP BY 1), "
            f"s AS (SELECT DISTINCT stem FROM ({_S})), "
            "r AS (SELECT m.*, trim(coalesce(ref, '')) AS _ref FROM m), "
            "t AS (SELECT r.*, f1.path AS p1, f2.path AS p2, b3.bpath AS p3, b4.bpath AS p4 FROM r "
            "LEFT JOIN f f1 ON f1.path = r._ref LEFT JOIN f f2 ON f2.path = r._ref || '.png' "
            f"LEFT JOIN bb b3 ON b3.base = {b} "
            f"LEFT JOIN bb b4 ON b4.base = {b} || '.png' AND NOT suffix({b}, '.png')), "
            "u AS (SELECT *, CASE WHEN _ref = '' THEN NULL ELSE coalesce(p1, p2, p3, p4) END AS resolved, "
            "CAST(CASE WHEN _ref = '' THEN NULL WHEN p1 IS NOT NULL THEN 1 WHEN p2 IS NOT NULL THEN 2 "
            "WHEN p3 IS NOT NULL THEN 3 WHEN p4 IS NOT NULL THEN 4 END AS INTEGER) AS tier FROM t), "
            "a AS (SELECT u.*, CASE WHEN resolved IS NULL THEN 'MISSING_IMG' WHEN s.stem IS NULL THEN 'MISSING_EMB' "
            "ELSE 'OK' END AS status FROM u LEFT JOIN s ON s.stem = regexp_replace(u.resolved, '\\.[^./]*$', ''))")


def _audited(spark, sf):
    return Q.audit(V.manifest(spark, sf), V.files(spark, sf), V.emb_files(spark, sf), ref="ref")


@register("manifest_audit", f"WITH {_audit_sql()} SELECT row_idx, doc_id, ref, resolved, tier, status FROM a",
          ops=("Q1", "S4"))
def q_audit(spark, sf):
    return _audited(spark, sf).select("row_idx", "doc_id", "ref", "resolved", "tier", "status")


@register("orphan_files", f"WITH {_audit_sql()} SELECT path FROM f WHERE (lower(path) LIKE '%.png' OR "
          "lower(path) LIKE '%.jpg' OR lower(path) LIKE '%.jpeg' OR lower(path) LIKE '%.tif' OR "
          "lower(path) LIKE '%.tiff') AND path NOT IN (SELECT resolved FROM a WHERE resolved IS NOT NULL)",
          ops=("Q2",))
def q_orphans(spark, sf):
    return Q.orphans(_audited(spark, sf), V.files(spark, sf))


@register("clean_manifest", f"WITH {_audit_sql()} SELECT row_idx, doc_id, label FROM a WHERE status = 'OK'",
          ops=("Q3",))
def q_clean(spark, sf):
    return Q.clean_manifest(_audited(spark, sf)).select("row_idx", "doc_id", "label")


_SUMMARY_SQL = (f"WITH {_audit_sql()}, fs AS ({_F}), "
                "o AS (SELECT path FROM f WHERE path NOT IN (SELECT resolved FROM a WHERE resolved IS NOT NULL)), "
                "x AS (SELECT split, count(*) AS rows_total, count_if(status = 'OK') AS rows_ok, "
                "count_if(status = 'MISSING_IMG') AS rows_missing_image, count_if(status = 'MISSING_EMB') AS "
                "rows_missing_embedding FROM a GROUP BY split), "
                "d AS (SELECT split, count(DISTINCT path) AS images_on_disk FROM fs GROUP BY split), "
                "oo AS (SELECT fs.split, count(*) AS orphan_images FROM o JOIN (SELECT DISTINCT path, split FROM fs) fs "
                "USING (path) GROUP BY fs.split) "
                "SELECT coalesce(x.split, d.split) AS split, coalesce(rows_total, 0) AS rows_total, "
                "coalesce(rows_ok, 0) AS rows_ok, coalesce(rows_missing_image, 0) AS rows_missing_image, "
                "coalesce(rows_missing_embedding, 0) AS rows_missing_embedding, coalesce(images_on_disk, 0) AS "
                "images_on_disk, coalesce(orphan_images, 0) AS orphan_images FROM x FULL JOIN d ON x.split = d.split "
                "LEFT JOIN oo ON oo.split = coalesce(x.split, d.split)")


@register("audit_summary", _SUMMARY_SQL, ops=("Q4",))
def q_audit_summary(spark, sf):
    return Q.audit_summary(_audited(spark, sf), V.files(spark, sf))


_REPAIR_SQL = (f"m AS ({_M}), f AS (SELECT DISTINCT path FROM ({_F})), "
               "r AS (SELECT m.row_idx, m.doc_id, CASE WHEN e.path IS NOT NULL THEN m.image WHEN a.path IS NOT NULL "
               "THEN 'images/' || CAST(m.row_idx + 1 AS VARCHAR) || '.png' END AS image_fixed, "
               "e.path IS NULL AND a.path IS NOT NULL AS repaired, e.path IS NULL AND a.path IS NULL AS unrepairable "
               "FROM m LEFT JOIN f e ON e.path = m.image "
               "LEFT JOIN f a ON a.path = 'images/' || CAST(m.row_idx + 1 AS VARCHAR) || '.png')")


@register("path_repair", f"WITH {_REPAIR_SQL} SELECT * FROM r", ops=("Q5",))
def q_repair(spark, sf):
    r = Q.repair_paths(V.manifest(spark, sf), V.files(spark, sf))
    return r.select("row_idx", "doc_id", "image_fixed", "repaired", "unrepairable")


@register("contiguous_prefix", f"WITH {_REPAIR_SQL} SELECT row_idx, doc_id, image_fixed FROM r WHERE "
          "(SELECT min(row_idx) FROM r WHERE unrepairable) IS NULL OR row_idx < (SELECT min(row_idx) FROM r WHERE "
          "unrepairable)", ops=("Q6",))
def q_prefix(spark, sf):
    r = Q.repair_paths(V.manifest(spark, sf), V.files(spark, sf))
    return Q.contiguous_prefix(r).select("row_idx", "doc_id", "image_fixed")


_SKIP_SQL = (f"WITH m AS ({_M}), f AS (SELECT DISTINCT path FROM ({_F})) SELECT "
             "count_if(image IN (SELECT path FROM f)) AS kept, count_if(image NOT IN (SELECT path FROM f)) AS missing "
             "FROM m")


@register("skip_missing", _SKIP_SQL, ops=("Q7",))
def q_skip(spark, sf):
    kept, missing = Q.skip_missing(V.manifest(spark, sf), V.files(spark, sf))
    return kept.agg(F.count(F.lit(1)).alias("kept")).withColumn("missing", F.lit(missing).cast("long"))


_ALIGN_SQL = (f"SELECT e.id, e.y, m.label, m.doc_id FROM ({V.EMB_SQL}) e JOIN ({_M}) m ON m.row_idx = e.id")


@register("row_alignment", _ALIGN_SQL, ops=("Q8",))
def q_align(spark, sf):
    e = V.emb(spark, sf).select("id", "y")
    m = V.manifest(spark, sf).select(F.col("row_idx").alias("id"), "label", "doc_id")
    return Q.align(e, m, "id")


_CAST_SQL = ("SELECT doc_id, CAST(quality AS BIGINT) AS label_i64, CAST(CASE WHEN toxic > 0 THEN 1 ELSE -1 END AS "
             "INTEGER) AS toxic_pm1, CAST(quality AS FLOAT) AS label_f32 FROM labels")


@register("label_cast", _CAST_SQL, ("label_f32",), ops=("Q9",))
def q_cast(spark, sf):
    lb = V.table(spark, sf, "labels")
    return lb.select("doc_id", Q.cast_labels(lb, "quality", "int64").alias("label_i64"),
                     Q.cast_labels(lb, "toxic", "int32", signed=True).alias("toxic_pm1"),
                     Q.cast_labels(lb, "quality", "float32").alias("label_f32"))


@register("non_binary_labels", "SELECT DISTINCT label FROM embeddings WHERE label NOT IN (0, 1) OR label IS NULL "
          "ORDER BY label LIMIT 20", ops=("Q10",))
def q_nonbinary(spark, sf):
    return Q.non_binary_values(V.table(spark, sf, "embeddings"), "label")


_RESUME_SQL = (f"WITH f AS (SELECT DISTINCT CAST(regexp_extract(path, '([0-9]+)\\.png$', 1) AS BIGINT) AS v FROM ({_F})), "
               "r AS (SELECT v, row_number() OVER (ORDER BY v) AS rn FROM f WHERE v >= 1), "
               "c AS (SELECT coalesce(min(CASE WHEN v <> rn THEN rn END) - 1, count(*)) AS contiguous_images FROM r) "
               "SELECT (SELECT count(*) FROM labels) AS label_rows, CAST(contiguous_images AS BIGINT) AS contiguous_images, "
               "least((SELECT count(*) FROM labels), CAST(contiguous_images AS BIGINT)) AS completed, "
               f"(SELECT count(*) FROM ({_M}) WHERE row_idx < least((SELECT count(*) FROM labels), "
               "CAST(contiguous_images AS BIGINT))) AS kept_rows FROM c")


@register("resume_point", _RESUME_SQL, ops=("Q11",))
def q_resume(spark, sf):
    nums = V.files(spark, sf).select(F.regexp_extract("path", r"([0-9]+)\.png$", 1).cast("long").alias("v"))
    rp = Q.resume_point(V.table(spark, sf, "labels"), nums, "v")
    kept = Q.trim_manifest(V.manifest(spark, sf), rp).agg(F.count(F.lit(1)).alias("kept_rows"))
    return rp.crossJoin(kept)   # one-row tables


_TOTALS_SQL = (f"WITH {_audit_sql()}, g AS (SELECT split, count(*) AS expected, count(resolved) AS on_disk FROM a "
               "GROUP BY ROLLUP (split)) SELECT coalesce(split, 'TOTAL') AS split, CAST(expected AS BIGINT) AS expected, "
               "CAST(on_disk AS BIGINT) AS on_disk, CAST(expected - on_disk AS BIGINT) AS missing FROM g")


@register("export_totals", _TOTALS_SQL, ops=("Q12",))
def q_totals(spark, sf):
    a = _audited(spark, sf).select("split", F.lit(1).alias("e"), F.col("resolved").isNotNull().cast("int").alias("o"))
    r = Q.totals_with_all(a, "split", "e", "o")
    return r.select("split", *[F.col(c).cast("long").alias(c) for c in ("expected", "on_disk", "missing")])


_CONTRACT_SQL = ("WITH e AS (SELECT doc_id, 'quality' AS field, CAST(quality AS VARCHAR) AS expected FROM labels UNION ALL "
                 "SELECT doc_id, 'toxic', CAST(toxic AS VARCHAR) FROM labels), "
                 "x AS (SELECT doc_id, 'quality' AS field, CAST(CAST(n_chars > 2000 AS INTEGER) AS VARCHAR) AS actual "
                 "FROM documents UNION ALL SELECT doc_id, 'toxic', CAST(CAST(lang = 'de' AS INTEGER) AS VARCHAR) "
                 "FROM documents) SELECT coalesce(e.doc_id, x.doc_id) AS doc_id, coalesce(e.field, x.field) AS field, "
                 "expected, actual, CASE WHEN expected IS NULL AND actual IS NOT NULL THEN 'unexpected' WHEN actual IS "
                 "NULL AND expected IS NOT NULL THEN 'missing' ELSE 'mismatch' END AS status FROM e FULL JOIN x "
                 "ON e.doc_id = x.doc_id AND e.field = x.field WHERE expected IS DISTINCT FROM actual")


@register("contract_diff", _CONTRACT_SQL, ops=("Q13",))
def q_contract(spark, sf):
    exp = V.table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    d = V.table(spark, sf, "documents")
    act = d.select("doc_id", (F.col("n_chars") > 2000).cast("int").alias("quality"),
                   (F.col("lang") == "de").cast("int").alias("toxic"))
    return Q.contract_diff(exp, act, ["doc_id"], ["quality", "toxic"])


def _log_sql():
    from . import sql_metrics as S
    rep = S.report_sql(V.PREDS2_SQL, ["grp"])
    return (f"WITH l AS (SELECT 'user-' || CAST(grp AS VARCHAR) AS record_id, tp, tn, fp, fn, n AS n_test, fnr "
            f"FROM ({rep})) SELECT record_id, 'duplicate_record_id' AS violation FROM l GROUP BY record_id "
            "HAVING count(*) > 1 UNION ALL SELECT record_id, 'confusion_total' FROM l WHERE tp + tn + fp + fn <> n_test "
            "UNION ALL SELECT record_id, 'fnr' FROM l WHERE tp + fn > 0 AND abs(fnr - fn / (tp + fn)) > 1e-9")


@register("log_invariants", _log_sql(), ops=("Q16",))
def q_log(spark, sf):
    r = M.binary_report(V.preds2(spark, sf), group_by=["grp"])
    log = r.select(F.concat(F.lit("user-"), F.col("grp").cast("string")).alias("record_id"), "tp", "tn", "fp", "fn",
                   F.col("n").alias("n_test"), "fnr")
    return Q.log_invariants(log)


_UNION_SQL = ("WITH u AS (SELECT *, 'customer' AS dataset_source FROM customer UNION ALL BY NAME "
              "SELECT *, 'supplier' AS dataset_source FROM supplier) SELECT dataset_source, count(*) AS n, "
              "count_if(c_mktsegment IS NULL) AS n_without_segment, sum(coalesce(c_acctbal, s_acctbal)) AS acctbal "
              "FROM u GROUP BY dataset_source")


@register("tagged_union", _UNION_SQL, ("acctbal",), ops=("Q17",))
def q_union(spark, sf):
    u = Q.tag_union({"customer": V.table(spark, sf, "customer"), "supplier": V.table(spark, sf, "supplier")})
    return u.groupBy("dataset_source").agg(F.count(F.lit(1)).alias("n"),
                                           F.count_if(F.col("c_mktsegment").isNull()).alias("n_without_segment"),
                                           F.sum(Q.first_available(u, ["c_acctbal", "s_acctbal"], "_a")).alias("acctbal"))


def _layouts_sql():
    from .q_metrics import SUMMARY_SQL
    return (f"WITH s AS ({SUMMARY_SQL}), a AS (SELECT id, 'with_variance' AS layout, prob_variance AS var FROM s), "
            "b AS (SELECT id, 'std_only' AS layout, pow(prob_std, 2) AS var FROM s) "
            "SELECT * FROM a UNION ALL SELECT * FROM b")


@register("layout_coalesce", _layouts_sql(), ("var",), ops=("Q18",))
def q_layouts(spark, sf):
    from ..operators import predict as R
    s = R.summarize_draws(V.draws(spark, sf))
    a = s.select("id", "prob_variance")
    b = s.select("id", "prob_std")
    la = a.select("id", F.lit("with_variance").alias("layout"), Q.variance_or_std2(a, "prob_variance", "prob_std", "var"))
    lb = b.select("id", F.lit("std_only").alias("layout"), Q.variance_or_std2(b, "prob_variance", "prob_std", "var"))
    return la.unionByName(lb)


def _norm_sql():
    from ..functions import rng
    u = rng.u01_sql("id", "'alias'", "42")
    raw = f"CASE WHEN split = 'valid' THEN CASE WHEN {u} < 0.5 THEN 'val' ELSE 'Validation' END ELSE split END"
    norm = (f"CASE WHEN lower(trim(raw)) = 'validation' THEN 'valid' WHEN lower(trim(raw)) = 'val' THEN 'valid' "
            "ELSE lower(trim(raw)) END")
    return (f"WITH e AS (SELECT id, klass AS hospital, {raw} AS raw FROM ({V.EMB_SQL})) "
            f"SELECT id, raw, {norm} AS split, CAST(coalesce(hospital, 0) AS BIGINT) AS \"group\" FROM e")


@register("normalize_split_group", _norm_sql(), ops=("Q19",))
def q_norm(spark, sf):
    from ..functions import rng
    e = V.emb(spark, sf).select("id", F.col("klass").alias("hospital"), "split")
    u = rng.u01(F.col("id"), "alias", 42)
    e = e.withColumn("raw", F.when(F.col("split") == "valid", F.when(u < 0.5, "val").otherwise("Validation"))
                     .otherwise(F.col("split")))
    return e.select("id", "raw", Q.normalize_split(F.col("raw")).alias("split"), Q.group_column(e, "group"))
