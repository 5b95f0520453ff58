"""Driver tables mapped onto the operators' inputs (FIXTURES.md §2).

Each view has a Spark builder ``<name>(spark, sf_dir)`` and a DuckDB text
``<NAME>_SQL`` over the pre-registered table views. Both read the whole table.
Random choices (splits, simulated missing files, draws) use the keyed md5
uniform of ``functions.rng`` so both engines pick the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rng
from ..operators.ordered import row_numbers

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ---- preds: lineitem as predictions with many ties (E1–E16, E20, E21) -----------

def preds(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select((F.col("l_returnflag") == "R").cast("int").alias("y"),
                     (F.lit(0.05) + F.lit(8) * F.col("l_discount")).alias("p"),
                     F.col("l_linestatus").alias("grp"),
                     F.col("l_returnflag").alias("source"))


PREDS_SQL = ("SELECT CAST(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS INTEGER) AS y, "
             "0.05 + 8 * l_discount AS p, l_linestatus AS grp, l_returnflag AS source FROM lineitem")


# ---- preds2: events as predictions with few ties -----------------------------------

def preds2(spark, sf_dir) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select(F.col("event_id").alias("id"),
                     (F.col("event_type") == "purchase").cast("int").alias("y"),
                     (F.col("value") / (F.col("value") + F.lit(20.0))).alias("p"),
                     F.col("user_id").alias("grp"))


PREDS2_SQL = ("SELECT event_id AS id, CAST(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS INTEGER) AS y, "
              "value / (value + 20.0) AS p, user_id AS grp FROM events")


# ---- methods: two methods' probabilities per event, long form -------------------------

def methods(spark, sf_dir) -> DataFrame:
    p2 = preds2(spark, sf_dir)
    both = F.explode(F.array(
        F.struct(F.lit("model_a").alias("method"), F.col("p").alias("p")),
        F.struct(F.lit("model_b").alias("method"), rng.u01(F.col("id"), 1, 42).alias("p"))))
    return p2.select("id", "y", "grp", both.alias("m")).select("id", "y", "grp", "m.method", "m.p")


METHODS_SQL = (f"SELECT id, y, grp, 'model_a' AS method, p FROM ({PREDS2_SQL}) UNION ALL "
               f"SELECT id, y, grp, 'model_b' AS method, {rng.u01_sql('id', '1', '42')} AS p FROM ({PREDS2_SQL})")


# ---- emb: embeddings with a binary label and a keyed split ------------------------------

def emb(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    u = rng.u01(F.col("vec_id"), "split", 42)
    return e.select(F.col("vec_id").alias("id"),
                    F.col("embedding").cast("array<double>").alias("features"),
                    (F.col("label") >= 5).cast("int").alias("y"),
                    F.col("label").alias("klass"),
                    F.when(u < 0.2, "test").when(u < 0.4, "valid").otherwise("train").alias("split"))


EMB_SQL = ("SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS features, "
           "CAST(CASE WHEN label >= 5 THEN 1 ELSE 0 END AS INTEGER) AS y, label AS klass, "
           f"CASE WHEN {rng.u01_sql('vec_id', chr(39) + 'split' + chr(39), '42')} < 0.2 THEN 'test' "
           f"WHEN {rng.u01_sql('vec_id', chr(39) + 'split' + chr(39), '42')} < 0.4 THEN 'valid' "
           "ELSE 'train' END AS split FROM embeddings")


# ---- draws: 20 posterior predictive draws per embedding row ----------------------------

N_DRAWS = 20


def draws(spark, sf_dir) -> DataFrame:
    e = emb(spark, sf_dir).select("id", "y")
    d = e.select("id", "y", F.explode(F.sequence(F.lit(0), F.lit(N_DRAWS - 1))).alias("draw"))
    p = rng.u01_open(F.col("id"), F.col("draw"), 42)
    return d.select("id", "y", "draw", p.alias("p"), F.log(p / (F.lit(1.0) - p)).alias("latent"))


def _draws_sql() -> str:
    u = rng.u01_open_sql("id", "draw", "42")
    return (f"SELECT id, y, draw, p, ln(p / (1.0 - p)) AS latent FROM ("
            f"SELECT id, y, CAST(draw AS INTEGER) AS draw, {u} AS p FROM ({EMB_SQL}) e, "
            f"range(0, {N_DRAWS}) r(draw))")


DRAWS_SQL = _draws_sql()


# ---- chain: events reshaped as 4 chains ordered by step --------------------------------

N_CHAINS = 4


def chain(spark, sf_dir) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    step = F.expr(f"event_id div {N_CHAINS}")
    return ev.select((F.col("event_id") % N_CHAINS).cast("int").alias("chain"), step.alias("step"),
                     F.col("value").alias("x"), (F.col("event_type") != "error").alias("accepted"),
                     (F.col("value") / F.lit(1000.0)).alias("step_time"), (step < WARMUP).alias("is_warmup"))


WARMUP = 100
CHAIN_SQL = (f"SELECT CAST(event_id % {N_CHAINS} AS INTEGER) AS chain, event_id // {N_CHAINS} AS step, "
             "value AS x, event_type <> 'error' AS accepted, value / 1000.0 AS step_time, "
             f"event_id // {N_CHAINS} < {WARMUP} AS is_warmup FROM events")


# ---- trials: orders as benchmark trials -----------------------------------------------------

def trials(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderpriority").alias("method"), (F.col("o_custkey") % 5).alias("k"),
                    F.col("o_totalprice").alias("sec"), F.col("o_orderkey").alias("trial"),
                    F.col("o_orderstatus").alias("status"))


TRIALS_SQL = ("SELECT o_orderpriority AS method, o_custkey % 5 AS k, o_totalprice AS sec, "
              "o_orderkey AS trial, o_orderstatus AS status FROM orders")


# ---- manifest / files: labels as an image manifest, documents as the files on disk ----------

def _split_col(key):
    u = rng.u01(F.col(key), "split", 42)
    return F.when(u < 0.2, "test").when(u < 0.4, "valid").otherwise("train")


def _split_sql(key):
    u = rng.u01_sql(key, "'split'", "42")
    return f"CASE WHEN {u} < 0.2 THEN 'test' WHEN {u} < 0.4 THEN 'valid' ELSE 'train' END"


def _ref_col():
    """The manifest's free-form reference: empty, without extension, other folder, or canonical."""
    u = rng.u01(F.col("doc_id"), "ref", 42)
    d = F.col("doc_id").cast("string")
    return (F.when(u < 0.05, F.lit("")).when(u < 0.2, F.concat(F.lit("images/"), d))
            .when(u < 0.3, F.concat(F.lit("other/"), d, F.lit(".png")))
            .when(u < 0.4, F.concat(F.lit("other/"), d)).otherwise(F.concat(F.lit("images/"), d, F.lit(".png"))))


def _ref_sql():
    u = rng.u01_sql("doc_id", "'ref'", "42")
    d = "CAST(doc_id AS VARCHAR)"
    return (f"CASE WHEN {u} < 0.05 THEN '' WHEN {u} < 0.2 THEN 'images/' || {d} "
            f"WHEN {u} < 0.3 THEN 'other/' || {d} || '.png' WHEN {u} < 0.4 THEN 'other/' || {d} "
            f"ELSE 'images/' || {d} || '.png' END")


def manifest(spark, sf_dir) -> DataFrame:
    lb = table(spark, sf_dir, "labels")
    m = lb.select("doc_id", F.concat(F.lit("images/"), F.col("doc_id").cast("string"), F.lit(".png")).alias("image"),
                  _ref_col().alias("ref"), F.col("quality").alias("label"), F.col("toxic").alias("toxic"),
                  _split_col("doc_id").alias("split"))
    m = row_numbers(m, [], ["doc_id"], out="rn")
    return m.select((F.col("rn") - 1).cast("long").alias("row_idx"), "doc_id", "image", "ref", "label", "toxic",
                    "split")


MANIFEST_SQL = ("SELECT CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS row_idx, doc_id, "
                f"'images/' || CAST(doc_id AS VARCHAR) || '.png' AS image, {_ref_sql()} AS ref, quality AS label, "
                f"toxic, {_split_sql('doc_id')} AS split FROM labels")

# Simulated absence: a document's image file is missing when its keyed uniform
# is below 0.15, its embedding file when below 0.10. Every row is still read.
FILE_MISSING, EMB_MISSING = 0.15, 0.10


def files(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    keep = rng.u01(F.col("doc_id"), "file", 42) >= FILE_MISSING
    return d.filter(keep).select(
        F.concat(F.lit("images/"), F.col("doc_id").cast("string"), F.lit(".png")).alias("path"),
        F.col("n_chars").alias("length"), F.col("source").alias("source"), _split_col("doc_id").alias("split"))


FILES_SQL = (f"SELECT 'images/' || CAST(doc_id AS VARCHAR) || '.png' AS path, n_chars AS length, source, "
             f"{_split_sql('doc_id')} AS split FROM documents WHERE {rng.u01_sql('doc_id', chr(39) + 'file' + chr(39), '42')} >= {FILE_MISSING}")


def emb_files(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    keep = rng.u01(F.col("doc_id"), "emb", 42) >= EMB_MISSING
    return d.filter(keep).select(F.concat(F.lit("images/"), F.col("doc_id").cast("string")).alias("stem"))


EMB_FILES_SQL = (f"SELECT 'images/' || CAST(doc_id AS VARCHAR) AS stem FROM documents "
                 f"WHERE {rng.u01_sql('doc_id', chr(39) + 'emb' + chr(39), '42')} >= {EMB_MISSING}")


# ---- regress / history ------------------------------------------------------------------------

def regress(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_extendedprice").alias("y_true"), (F.col("l_quantity") * 1500).alias("y_pred"),
                     F.col("l_returnflag").alias("grp"))


REGRESS_SQL = "SELECT l_extendedprice AS y_true, l_quantity * 1500 AS y_pred, l_returnflag AS grp FROM lineitem"


def history(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("epoch_key"),
                    F.col("o_totalprice").alias("score"))


HISTORY_SQL = "SELECT o_custkey AS run, o_orderkey AS epoch_key, o_totalprice AS score FROM orders"
