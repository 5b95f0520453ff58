"""Writers: binary exports, factor / result bundles, predictions, results log, JSON, chains."""

from __future__ import annotations

import socket
from collections.abc import Sequence
from datetime import datetime, timezone

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import storage

# Fixed values that must equal the reference's: the canonical results-log header, in order.
RESULT_COLUMNS = [
    "record_id", "experiment", "script_path", "job_id", "account_partition", "hostname", "node_gpu", "code_ref",
    "run_timestamp_utc", "conda_env", "notes", "artifacts", "dataset", "data_generator", "data_seed", "seed",
    "kernel", "kernel_bandwidth", "synthetic_d", "fixed_n", "n", "n_train", "n_val", "n_test", "k", "k_list",
    "trials", "block_size_b", "n_values", "n_samples", "n_warmup", "rp_k_values", "arpcholesky_b", "rwm_seed",
    "jitter", "sampler", "n_walkers", "step_size", "n_leapfrog", "hmc_leapfrog", "num_inducing", "method_name",
    "model_architecture", "encoder", "embedding_source", "embedding_root", "embedding_variant", "feature_dim",
    "skip_embed", "threshold", "max_train_samples", "max_valid_samples", "max_test_samples", "epochs", "patience",
    "batch_size", "lr", "learning_rate", "weight_decay", "hidden_dim", "num_layers", "dropout",
    "trainable_parameters", "base_channels", "image_size", "num_workers", "predict_chunk_size", "device",
    "tabpfn_version", "timing_scope", "mean_time_sec", "std_time_sec", "data_loading_time_sec",
    "embedding_time_sec", "factor_time_sec", "warmup_time_sec", "sampling_time_sec", "per_step_time_sec",
    "total_mcmc_time_sec", "fit_predict_time_sec", "fit_or_train_time_sec", "inference_time_sec",
    "evaluation_time_sec", "total_pipeline_time_sec", "accept_rate", "final_step_size", "approx_error_fro_rel",
    "ess_logp", "ess_per_sec", "tau", "train_loss", "val_loss", "elpd", "elpd_mean", "pell", "pell_mean",
    "predictive_likelihood", "posterior_expected_log_loss", "posterior_log_loss_mean", "posterior_total_log_loss",
    "auroc", "auprc", "accuracy", "precision", "recall", "sensitivity_tpr", "specificity_tnr",
    "false_positive_rate", "false_negative_rate", "brier", "ece", "tp", "tn", "fp", "fn", "unavailable_reason",
]


# ---- S9: one file per row ---------------------------------------------------------------------

def export_rows(df: DataFrame, out_dir: str, key: str, content: str, ext: str = ".bin",
                meta_cols: Sequence[str] = ()) -> DataFrame:
    """Write each row's binary content to ``out_dir/<key><ext>``; the returned
    manifest ``(key, path, bytes, status, meta…)`` is the writers' output (checked lengths)."""
    storage.make_dir(out_dir)
    fields = [T.StructField(key, T.LongType()), T.StructField("path", T.StringType()),
              T.StructField("bytes", T.LongType()), T.StructField("status", T.StringType())]
    fields += [T.StructField(m, T.StringType()) for m in meta_cols]
    schema = T.StructType(fields)

    def fn(batches):
        for pdf in batches:
            out = []
            for _, r in pdf.iterrows():
                p = f"{out_dir.rstrip('/')}/{int(r[key])}{ext}"
                data = bytes(r[content]) if r[content] is not None else b""
                ok = storage.write_bytes(p, data) == len(data) and len(data) > 0
                out.append([int(r[key]), p, len(data), "OK" if ok else "EMPTY"] +
                           [None if r[m] is None else str(r[m]) for m in meta_cols])
            if out:
                yield pd.DataFrame(out, columns=[f.name for f in fields])

    return df.select(F.col(key).cast("long").alias(key), content, *meta_cols).mapInPandas(fn, schema)


def write_shards(df: DataFrame, out_dir: str, prefix: str) -> DataFrame:
    """Parquet shards ``out_dir/<prefix>-<partition>.parquet`` of the other columns: (file, rows), a job's output.

    Each task streams the rows it reads into one open file a prefix, so nothing is shuffled and
    a task's share is a partition of ``df``; a repeated task writes the same names again.
    """
    import pyarrow as pa
    import pyarrow.compute as pc
    import pyarrow.parquet as pq
    from pyspark import TaskContext

    storage.make_dir(out_dir)

    def fn(batches):
        number, files, rows = TaskContext.get().partitionId(), {}, {}
        try:
            for got in batches:
                table = pa.Table.from_batches([got])
                for pre in pc.unique(table[prefix]).to_pylist():
                    some = table.filter(pc.equal(table[prefix], pre)).drop_columns(prefix)
                    path = f"{out_dir.rstrip('/')}/{pre}-{number:06d}.parquet"
                    if path not in files:
                        fs, at = storage.resolve(path)
                        files[path] = pq.ParquetWriter(at, some.schema, filesystem=fs, coerce_timestamps="us", allow_truncated_timestamps=True)
                    files[path].write_table(some)
                    rows[path] = rows.get(path, 0) + some.num_rows
        finally:
            for file in files.values():
                file.close()
        yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.string()), pa.array(list(rows.values()), pa.int64())], ["file", "rows"])

    return df.mapInArrow(fn, "file string, rows long")


# ---- S10, S15: bundles keyed by run_id ----------------------------------------------------------

def write_factor_bundle(spark: SparkSession, path: str, run_id: str, factor: DataFrame, pivots: DataFrame,
                        kpp: np.ndarray, summary: dict) -> None:
    """Factor rows, pivots, K_PP (long), one-row summary under ``path/<table>/run_id=…``."""
    base = path.rstrip("/")
    factor.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(f"{base}/factor")
    pivots.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(f"{base}/pivots")
    k = kpp.shape[0]
    spark.createDataFrame([(i, j, float(kpp[i, j])) for i in range(k) for j in range(k)],
                          "i int, j int, v double").withColumn("run_id", F.lit(run_id)) \
        .write.mode("append").partitionBy("run_id").parquet(f"{base}/kpp")
    spark.createDataFrame([tuple(summary.values())], list(summary.keys())).withColumn("run_id", F.lit(run_id)) \
        .write.mode("append").partitionBy("run_id").parquet(f"{base}/summary")


def read_factor_bundle(spark: SparkSession, path: str, run_id: str) -> dict[str, DataFrame]:
    base = path.rstrip("/")
    return {t: spark.read.parquet(f"{base}/{t}").filter(F.col("run_id") == run_id).drop("run_id")
            for t in ("factor", "pivots", "kpp", "summary")}


def verify_factor_bundle(b: dict[str, DataFrame]) -> DataFrame:
    """Q14: N rows × k, k pivots, K_PP k×k doubles — one error row per broken check."""
    s = b["summary"].first()
    k, n = int(s["k"]), int(s["n"])
    f = b["factor"].agg(F.count(F.lit(1)).alias("rows"), F.min(F.size("f")).alias("kmin"),
                        F.max(F.size("f")).alias("kmax")).first()
    piv = b["pivots"].count()
    kp = b["kpp"].agg(F.count(F.lit(1)).alias("c"), F.max("i").alias("mi"), F.max("j").alias("mj")).first()
    checks = [("factor_rows", f["rows"] == n, f"{f['rows']} != {n}"),
              ("factor_width", f["kmin"] == k and f["kmax"] == k, f"{f['kmin']}..{f['kmax']} != {k}"),
              ("pivots", piv == k, f"{piv} != {k}"),
              ("kpp_shape", kp["c"] == k * k and kp["mi"] == k - 1 and kp["mj"] == k - 1, f"{kp['c']} != {k * k}")]
    spark = b["factor"].sparkSession
    return spark.createDataFrame([(name, bool(ok), "" if ok else msg) for name, ok, msg in checks],
                                 "check string, ok boolean, detail string")


def write_result_bundle(path: str, run_id: str, rows: DataFrame, scalars: DataFrame) -> None:
    """Per-row posterior columns and one-row scalars/metrics, keyed by run_id."""
    base = path.rstrip("/")
    rows.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(f"{base}/rows")
    scalars.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(f"{base}/scalars")


def read_result_bundle(spark: SparkSession, path: str, run_id: str):
    base = path.rstrip("/")
    rows = spark.read.parquet(f"{base}/rows").filter(F.col("run_id") == run_id).drop("run_id")
    sc = spark.read.parquet(f"{base}/scalars").filter(F.col("run_id") == run_id).drop("run_id").first()
    return rows, (sc.asDict() if sc is not None else {})


# ---- S11, S13: predictions and JSON metrics ----------------------------------------------------------

def write_predictions(df: DataFrame, path: str, fmt: str = "parquet", threshold: float = 0.5,
                      key: str = "image", label: str = "label", p: str = "probability",
                      source: str | None = None) -> None:
    """(image, label, probability, prediction[, dataset_source])."""
    cols = [key, label, F.col(p).cast("double").alias("probability"),
            (F.col(p) >= threshold).cast("int").alias("prediction")]
    if source:
        cols.append(F.col(source).alias("dataset_source"))
    w = df.select(*cols).write.mode("overwrite")
    (w.option("header", True).csv(path) if fmt == "csv" else w.parquet(path))


def finite_or_null(c: Column) -> Column:
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(None)).otherwise(c)


def write_json_metrics(df: DataFrame, path: str) -> None:
    """NaN and ±Inf written as null."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(finite_or_null(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name).cast("string") if isinstance(f.dataType, T.DateType) else F.col(f.name))
    df.select(*cols).write.mode("overwrite").option("ignoreNullFields", False).json(path)


# ---- S12, T2: results log ---------------------------------------------------------------------------------

def to_result_rows(df: DataFrame, defaults: dict | None = None, columns: Sequence[str] = RESULT_COLUMNS) -> DataFrame:
    """The canonical schema: known keys only, missing → '', complex → JSON text,
    default metadata, generated record_id when absent."""
    defaults = defaults or {}
    present = set(df.columns)
    out = []
    for c in columns:
        if c in present:
            dt = df.schema[c].dataType
            if isinstance(dt, (T.ArrayType, T.MapType, T.StructType)):
                v = F.to_json(F.col(c))
            else:
                v = F.col(c).cast("string")
            v = F.coalesce(v, F.lit(""))
        elif c in defaults:
            v = F.lit(str(defaults[c]))
        else:
            v = F.lit("")
        out.append(v.alias(c))
    rows = df.select(*out)
    content = F.hex(F.xxhash64(*[F.col(c) for c in columns]))       # two rows of a run get two ids
    gen = F.concat_ws("-", *[F.when(F.col(c) != "", F.col(c)) for c in
                             ("run_timestamp_utc", "job_id", "experiment", "method_name", "dataset")], content)
    return rows.withColumn("record_id", F.when(F.col("record_id") == "", gen).otherwise(F.col("record_id")))


def run_metadata(spark: SparkSession) -> dict[str, str]:
    """Default metadata of a run: UTC time stamp, job (application) id and host."""
    return {"run_timestamp_utc": datetime.now(timezone.utc).isoformat(timespec="seconds"),
            "job_id": spark.sparkContext.applicationId, "hostname": socket.gethostname()}


def append_results(df: DataFrame, path: str, defaults: dict | None = None) -> None:
    rows = to_result_rows(df, run_metadata(df.sparkSession) | (defaults or {}))
    rows.write.mode("append").option("header", True).csv(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType([T.StructField(c, T.StringType()) for c in RESULT_COLUMNS])
    return spark.read.option("header", True).schema(schema).csv(path).na.fill("")


# ---- S14: chain TSV ------------------------------------------------------------------------------------------

def write_chain(chain: DataFrame, path: str, warmup: int, chain_id: int = 0) -> int:
    """Accepted post-warm-up draws only: accepted_idx, post_warmup_idx, logp, nu_0… (TSV).

    accepted_idx comes from bucketed row numbers and the rows are written where they are;
    the index, not the file order, gives the order of the draws.
    """
    from ..operators.ordered import row_numbers

    c = chain.filter((F.col("chain") == chain_id) & (F.col("step") >= warmup) & F.col("accepted"))
    k = len(chain.select("nu").first()["nu"])
    out = row_numbers(c, [], ["step"], out="_rn").select(
        (F.col("_rn") - 1).alias("accepted_idx"), (F.col("step") - warmup).alias("post_warmup_idx"),
        "logp", *[F.col("nu")[j].alias(f"nu_{j}") for j in range(k)])
    out.write.mode("overwrite").option("header", True).option("sep", "\t").csv(path)
    return k


def read_chain(spark: SparkSession, path: str, k: int) -> DataFrame:
    df = spark.read.option("header", True).option("sep", "\t").option("inferSchema", True).csv(path)
    dims = [c for c in df.columns if c.startswith("nu_")]
    if len(dims) != k:
        raise ValueError(f"chain file has {len(dims)} dimensions, expected {k}")
    return df
