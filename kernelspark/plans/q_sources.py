"""Source / sink round trips (S1–S15, Q14) and incremental runs.

Each query writes a driver table through a sink into a fresh folder under the
session's checkpoint directory (the shared folder on a cluster), reads it
back through the matching source, and returns something the oracle can
compute from the original table.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import rng
from ..functions.kernels import KernelSpec
from ..operators import lowrank as L
from ..operators import metrics as M
from ..session import ensure_checkpoint_dir
from ..sources import readers as RD
from ..sources import sinks as SK
from ..streaming import incremental as INC
from . import sql_metrics as S
from . import views as V
from .catalog import register


def scratch(spark, name: str) -> str:
    base = ensure_checkpoint_dir(spark)
    if base.startswith("file:"):
        base = base[5:]
    return f"{base.rstrip('/')}/scratch/{name}-{uuid.uuid4().hex[:10]}"


# ---- S1 ------------------------------------------------------------------------------------------

@register("embedding_layouts", f"SELECT id, y AS label, len(features) AS dim FROM ({V.EMB_SQL}) WHERE split = 'valid'",
          ops=("S1",))
def q_layouts(spark, sf):
    root = scratch(spark, "emb")
    e = V.emb(spark, sf)
    for sp in ("train", "valid", "test"):
        part = e.filter(F.col("split") == sp)
        part.select("id", "features").write.parquet(f"{root}/patches-hg/{sp}/embeddings/projected_512")
        part.select("id", F.col("y").alias("label")).write.parquet(f"{root}/patches-hg/{sp}/embeddings/y_embeddings")
    got = RD.load_embeddings(spark, root, "patches", "val")
    return got.select("id", "label", F.size("features").alias("dim"))


# ---- S2 ------------------------------------------------------------------------------------------

@register("npy_roundtrip", "SELECT vec_id AS id, list_sum(CAST(embedding AS DOUBLE[])) AS total FROM embeddings",
          ("total",), ops=("S2",))
def q_npy(spark, sf):
    import os
    path = scratch(spark, "npy") + ".npy"
    os.makedirs(os.path.dirname(path), exist_ok=True)
    e = V.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("features"))
    n = e.count()
    d = len(e.first()["features"])
    RD.write_npy(e, path, n, d)
    back = RD.read_npy(spark, path, rows_per_task=128)
    return back.select("id", F.aggregate(F.col("features").cast("array<double>"), F.lit(0.0),
                                         lambda a, v: a + v).alias("total"))


# ---- S3 ------------------------------------------------------------------------------------------

_S3_SQL = ("SELECT policy, count(*) AS n, CAST(sum(label) AS BIGINT) AS positives FROM ("
           "SELECT 'label_y_first' AS policy, quality AS label FROM labels UNION ALL "
           "SELECT 'named_last', quality FROM labels UNION ALL SELECT 'numeric_last', toxic FROM labels) GROUP BY policy")


@register("labels_csv_policies", _S3_SQL, ops=("S3", "S4"))
def q_label_csv(spark, sf):
    path = scratch(spark, "labels_csv")
    lb = V.table(spark, sf, "labels")
    # layouts the three policies meet: 'label' present; 'target' present; no known name
    lb.select(F.col("doc_id").alias("id"), F.col("quality").alias("label"), "toxic").write.option("header", True) \
        .csv(f"{path}/a")
    lb.select(F.col("doc_id").alias("id"), F.col("quality").alias("target"), F.lit("x").alias("note")) \
        .write.option("header", True).csv(f"{path}/b")
    lb.select(F.col("doc_id").alias("id"), F.col("quality").alias("Quality_Score"), F.col("toxic").alias("Toxic"),
              F.lit("n/a").alias("comment")).write.option("header", True).csv(f"{path}/c")
    a = RD.read_labels_csv(spark, f"{path}/a", "label_y_first", key="id").withColumn("policy", F.lit("label_y_first"))
    b = RD.read_labels_csv(spark, f"{path}/b", "named_last", key="id").withColumn("policy", F.lit("named_last"))
    c = RD.read_labels_csv(spark, f"{path}/c", "numeric_last", key="id").withColumn("policy", F.lit("numeric_last"))
    u = a.unionByName(b).unionByName(c)
    return u.groupBy("policy").agg(F.count(F.lit(1)).alias("n"), F.sum("label").cast("long").alias("positives"))


# ---- S5, S8, S9 ------------------------------------------------------------------------------------

@register("export_and_list", "SELECT count(*) AS files, CAST(sum(octet_length(encode(html))) AS BIGINT) AS bytes "
          "FROM pages WHERE octet_length(encode(html)) > 0", ops=("S9", "S5"))
def q_export_list(spark, sf):
    out = scratch(spark, "pages")
    pages = V.table(spark, sf, "pages").select("page_id", F.encode("html", "UTF-8").alias("content"), "url")
    man = SK.export_rows(pages, out, "page_id", "content", ext=".html", meta_cols=["url"])
    ok = man.filter("status = 'OK'").count()
    listing = RD.list_files(spark, out, "*.html")
    return listing.agg(F.count(F.lit(1)).alias("files"), F.sum("length").cast("long").alias("bytes")) \
        .withColumn("files", F.when(F.lit(ok) == F.col("files"), F.col("files")))


def _md5_sql():
    u = rng.u01_sql("page_id", "'md5'", "42")
    return ("WITH m AS (SELECT CAST(page_id AS VARCHAR) || '.html' AS name, "
            f"CASE WHEN {u} < 0.1 THEN 'deadbeef' ELSE md5(html) END AS md5 FROM pages UNION ALL "
            "SELECT 'absent.html', '00') "
            "SELECT CASE WHEN name = 'absent.html' THEN 'MISSING' WHEN md5 = 'deadbeef' THEN 'MISMATCH' ELSE 'OK' END "
            "AS status, count(*) AS n FROM m GROUP BY 1")


@register("md5_manifest", _md5_sql(), ops=("S8",))
def q_md5(spark, sf):
    out = scratch(spark, "md5")
    pages = V.table(spark, sf, "pages")
    SK.export_rows(pages.select("page_id", F.encode("html", "UTF-8").alias("content")), out, "page_id", "content",
                   ext=".html").count()
    u = rng.u01(F.col("page_id"), "md5", 42)
    man = pages.select(F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("name"),
                       F.when(u < 0.1, F.lit("deadbeef")).otherwise(F.md5(F.encode("html", "UTF-8"))).alias("md5"))
    man = man.unionByName(spark.createDataFrame([("absent.html", "00")], "name string, md5 string"))
    return RD.md5_check(spark, out, man).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


# ---- S6 ----------------------------------------------------------------------------------------------

def _shard_prefix_col():
    u = rng.u01(F.col("l_orderkey"), "shard", 42)
    return F.when(u < 0.6, "train").when(u < 0.8, "validation").when(u < 0.95, "test").otherwise("junk")


def _shard_sql():
    u = rng.u01_sql("l_orderkey", "'shard'", "42")
    return (f"SELECT CASE WHEN {u} < 0.6 THEN 'train' WHEN {u} < 0.8 THEN 'valid' ELSE 'test' END AS split, "
            f"count(*) AS rows, CAST(11 AS INTEGER) AS columns FROM lineitem WHERE {u} < 0.95 GROUP BY 1")


@register("shard_routing", _shard_sql(), ops=("S6",))
def q_shards(spark, sf):
    out = scratch(spark, "shards")
    SK.write_shards(V.table(spark, sf, "lineitem").withColumn("_prefix", _shard_prefix_col()), out, "_prefix").count()
    r = RD.route_shards(spark, out, {"train-": "train", "validation-": "valid", "test-": "test"})
    return r.select("split", "rows", F.col("columns").cast("int").alias("columns"))


# ---- S7 ----------------------------------------------------------------------------------------------

@register("numeric_csv", "SELECT count(*) AS n, CAST(sum(p_partkey + p_size) AS DOUBLE) AS feature_sum, sum(p_retailprice) AS "
          "target_sum FROM part", ("feature_sum", "target_sum"), ops=("S7",))
def q_numeric_csv(spark, sf):
    path = scratch(spark, "numcsv")
    V.table(spark, sf, "part").write.option("header", True).csv(path)
    d = RD.read_numeric_csv(spark, path)
    return d.agg(F.count(F.lit(1)).alias("n"),
                 F.sum(F.aggregate("features", F.lit(0.0), lambda a, v: a + v)).alias("feature_sum"),
                 F.sum("target").alias("target_sum"))


# ---- S10, Q14, Q15 ------------------------------------------------------------------------------------

@register("factor_bundle", None, ops=("S10", "Q14", "Q15"))
def q_factor_bundle(spark, sf):
    path = scratch(spark, "bundle")
    e = V.emb(spark, sf).select("id", "features")
    ker = KernelSpec("gaussian", 1.0)
    fac = L.pivoted_cholesky(e, ker, 8, method="greedy")
    kpp = fac.kpp()
    SK.write_factor_bundle(spark, path, "run-1", fac.factor_df().select("id", "f"), fac.pivots_df(spark)
                           .select("rank", F.col("pivot_id").alias("id")), kpp,
                           {"k": fac.k, "n": fac.n, "rel_trace_error": fac.errors[-1]})
    b = SK.read_factor_bundle(spark, path, "run-1")
    checks = SK.verify_factor_bundle(b)
    # Q15: F_P F_Pᵀ against K_PP on the pivot rows only (k × k)
    fp = b["factor"].join(b["pivots"], "id").select("rank", "f")
    fpa = fp.select(F.col("rank").alias("i"), F.col("f").alias("fa"))
    fpb = fp.select(F.col("rank").alias("j"), F.col("f").alias("fb"))
    kk = b["kpp"].select((F.col("i") + 1).alias("i"), (F.col("j") + 1).alias("j"), "v")
    prod = fpa.join(F.broadcast(fpb), how="inner").join(kk, ["i", "j"])   # k² rows
    err = prod.select(F.abs(F.aggregate(F.zip_with("fa", "fb", lambda a, c: a * c), F.lit(0.0),
                                        lambda s, v: s + v) - F.col("v")).alias("ae"), F.abs("v").alias("av"))
    cons = err.agg(F.max("ae").alias("max_abs_err"), (F.max("ae") / F.max("av")).alias("rel_err"))
    cons = cons.select(F.lit("pivot_consistency").alias("check"), (F.col("rel_err") <= 1e-3).alias("ok"),
                       F.format_string("max abs %.3g rel %.3g", "max_abs_err", "rel_err").alias("detail"))
    return checks.unionByName(cons)


# ---- S11 ----------------------------------------------------------------------------------------------

_S11_SQL = (f"SELECT CAST(p >= 0.5 AS INTEGER) AS prediction, count(*) AS n, sum(p) AS prob_sum "
            f"FROM ({V.PREDS2_SQL}) GROUP BY 1")


@register("predictions_sink", _S11_SQL, ("prob_sum",), ops=("S11",))
def q_pred_sink(spark, sf):
    path = scratch(spark, "preds")
    p = V.preds2(spark, sf).select(F.concat(F.lit("img-"), F.col("id").cast("string")).alias("image"),
                                   F.col("y").alias("label"), F.col("p").alias("probability"), "grp")
    SK.write_predictions(p, path, fmt="csv", source="grp")
    back = spark.read.option("header", True).option("inferSchema", True).csv(path)
    return back.groupBy(F.col("prediction").cast("int").alias("prediction")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("probability").alias("prob_sum"))


# ---- S12, S13 -------------------------------------------------------------------------------------------

_S12_SQL = (f"SELECT 'grp-' || grp AS record_id, 'binary_report' AS experiment, CAST(tp AS BIGINT) AS tp, "
            f"auroc FROM ({S.report_sql(V.PREDS_SQL, ['grp'])})")


@register("results_log", _S12_SQL, ("auroc",), ops=("S12",))
def q_results_log(spark, sf):
    path = scratch(spark, "results")
    rep = M.binary_report(V.preds(spark, sf), group_by=["grp"])
    rows = rep.select(F.concat(F.lit("grp-"), F.col("grp")).alias("record_id"), "tp", "auroc", "ece",
                      F.array("tp", "fp").alias("artifacts"))
    SK.append_results(rows, path, defaults={"experiment": "binary_report", "job_id": "local"})
    back = SK.read_results(spark, path)
    return back.select("record_id", "experiment", F.col("tp").try_cast("bigint").alias("tp"),
                       F.nullif(F.col("auroc"), F.lit("")).try_cast("double").alias("auroc"))


_S13_SQL = f"SELECT grp, n, auroc, ece FROM ({S.report_sql(V.PREDS2_SQL, ['grp'])})"


@register("json_metrics", _S13_SQL, ("auroc", "ece"), ops=("S13",))
def q_json(spark, sf):
    path = scratch(spark, "json")
    rep = M.binary_report(V.preds2(spark, sf), group_by=["grp"]).select(
        "grp", "n", F.coalesce("auroc", F.lit(float("nan"))).alias("auroc"), "ece")
    SK.write_json_metrics(rep, path)
    back = spark.read.schema("grp long, n long, auroc double, ece double").json(path)
    return back


# ---- S14, S15 --------------------------------------------------------------------------------------------

@register("chain_tsv", None, ops=("S14",))
def q_chain_tsv(spark, sf):
    from ..operators import posterior as PO
    path = scratch(spark, "chain")
    e = V.emb(spark, sf).select(F.col("features").alias("f"), "y")
    ch = PO.run_sampler(e, "rwm", n_steps=30, n_warmup=10, n_chains=2, step_size=0.1)["chain"]
    k = SK.write_chain(ch, path, warmup=10)
    return SK.read_chain(spark, path, k)


@register("result_bundle", f"SELECT count(*) AS n, sum(prob_mean) AS prob_mean_sum FROM ({V.DRAWS_SQL}) "
          "d JOIN (SELECT id, avg(p) AS prob_mean FROM (" + V.DRAWS_SQL + ") GROUP BY id) s USING (id) WHERE d.draw = 0",
          ("prob_mean_sum",), ops=("S15",))
def q_result_bundle(spark, sf):
    from ..operators import predict as R
    path = scratch(spark, "rbundle")
    s = R.summarize_draws(V.draws(spark, sf))
    scal = s.agg(F.count(F.lit(1)).alias("n"), F.avg("prob_mean").alias("mean_prob"))
    SK.write_result_bundle(path, "run-7", s, scal)
    rows, scalars = SK.read_result_bundle(spark, path, "run-7")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum("prob_mean").alias("prob_mean_sum"))


# ---- T1, T2 ----------------------------------------------------------------------------------------------

_T1_SQL = ("SELECT event_type, count(*) AS n, sum(value) AS total, count(DISTINCT user_id) AS users FROM events "
           "GROUP BY event_type")


def _land_slices(spark, sf, src, n_slices=4):
    ev = V.table(spark, sf, "events")
    u = rng.u01(F.col("event_id"), "slice", 42)
    sl = F.least(F.floor(u * n_slices), F.lit(n_slices - 1)).cast("int")
    ev = ev.withColumn("_slice", sl)
    return ev, [ev.filter(F.col("_slice") == i).drop("_slice") for i in range(n_slices)]


@register("incremental_stream", _T1_SQL, ("total",), ops=("T1", "P15"))
def q_stream(spark, sf):
    root = scratch(spark, "stream")
    src, out, ck = f"{root}/landing", f"{root}/out", f"{root}/ckpt"
    ev, slices = _land_slices(spark, sf, src)
    schema = slices[0].schema
    slices[0].write.parquet(f"{src}/s0")
    slices[1].write.parquet(f"{src}/s1")

    def per_batch(df):   # partial aggregates of the new rows, one row per (type, user)
        return df.groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))

    INC.run_incremental(spark, f"{src}/*", schema, out, ck, per_batch)
    slices[2].write.parquet(f"{src}/s2")
    slices[3].write.parquet(f"{src}/s3")
    INC.run_incremental(spark, f"{src}/*", schema, out, ck, per_batch)   # only the new files
    res = spark.read.parquet(out)
    return res.groupBy("event_type").agg(F.sum("n").alias("n"), F.sum("total").alias("total"),
                                         F.countDistinct("user_id").alias("users"))


_T2_SQL = (f"SELECT 'user-' || CAST(grp AS VARCHAR) AS record_id, CAST(n AS BIGINT) AS n_test FROM "
           f"({S.report_sql(V.PREDS2_SQL, ['grp'])})")


@register("results_log_stream", _T2_SQL, ops=("T2",))
def q_log_stream(spark, sf):
    root = scratch(spark, "logstream")
    src, log, ck = f"{root}/runs", f"{root}/log", f"{root}/ckpt"
    rep = M.binary_report(V.preds2(spark, sf), group_by=["grp"])
    u = rng.u01(F.col("grp"), "batch", 42)
    rep.filter(u < 0.5).write.parquet(f"{src}/a")
    schema = rep.schema
    to_rows = (lambda df: df.select(F.concat(F.lit("user-"), F.col("grp").cast("string")).alias("record_id"),
                                    F.col("n").alias("n_test"), "auroc", "tp", "tn", "fp", "fn"))
    INC.run_results_log(spark, f"{src}/*", schema, log, ck, to_rows, {"experiment": "per_user"})
    rep.filter(u >= 0.5).write.parquet(f"{src}/b")
    INC.run_results_log(spark, f"{src}/*", schema, log, ck, to_rows, {"experiment": "per_user"})
    back = SK.read_results(spark, log)
    return back.select("record_id", F.col("n_test").try_cast("bigint").alias("n_test"))


# ---- S4 --------------------------------------------------------------------------------------------

_S4_SQL = ("SELECT layout, image_column, n, n_distinct FROM (VALUES ('A', 'Image_Path'), ('B', 'patch'), "
           "('C', 'ref_name')) t(layout, image_column), "
           "(SELECT count(*) AS n, count(DISTINCT doc_id) AS n_distinct FROM labels)")


@register("image_column_detection", _S4_SQL, ops=("S4",))
def q_detect(spark, sf):
    """Manifests written with three headers; the image column is detected from each header."""
    from ..operators import quality as Q
    path = scratch(spark, "detect")
    lb = V.table(spark, sf, "labels")
    img = F.concat(F.lit("images/"), F.col("doc_id").cast("string"), F.lit(".png"))
    layouts = {"A": lb.select(img.alias("Image_Path"), F.col("quality").alias("label")),
               "B": lb.select(F.col("doc_id").alias("id"), img.alias("patch"), F.col("quality").alias("label")),
               "C": lb.select(img.alias("ref_name"), F.col("quality").alias("label"))}
    out = None
    for name, df in layouts.items():
        df.write.option("header", True).csv(f"{path}/{name}")
        raw = spark.read.option("header", True).csv(f"{path}/{name}")
        col = Q.detect_image_column(raw.columns)
        r = raw.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.col(col)).alias("n_distinct")) \
            .select(F.lit(name).alias("layout"), F.lit(col).alias("image_column"), "n", "n_distinct")
        out = r if out is None else out.unionByName(r)
    return out
