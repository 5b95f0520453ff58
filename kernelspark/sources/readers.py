"""Readers: embedding layouts, .npy matrices, label CSVs, file listings, shards."""

from __future__ import annotations

import ast
import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import storage

# Fixed values that must equal the reference's.
EMB_FILE_CANDIDATES = ["projected_512", "embeddings"]
LABEL_FILE_CANDIDATES = ["y_embeddings", "labels"]
LABEL_NAMES_LAST = ["label", "labels", "y", "target", "tumor"]
SPLIT_DIR = {"val": "valid"}


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(p))


# ---- S1 ----------------------------------------------------------------------------------

def embedding_candidates(root: str, dataset: str, split: str) -> list[tuple[str, str | None]]:
    """(features path, labels path or None) in lookup order."""
    root = root.rstrip("/")
    out = [(f"{root}/{dataset}_{split}_embeddings", f"{root}/{dataset}_{split}_labels")]
    sd = SPLIT_DIR.get(split, split)
    for ds_root in (f"{root}/{dataset}-hg", f"{root}/{dataset}", root):
        for emb in EMB_FILE_CANDIDATES:
            for lbl in LABEL_FILE_CANDIDATES:
                out.append((f"{ds_root}/{sd}/embeddings/{emb}", f"{ds_root}/{sd}/embeddings/{lbl}"))
            out.append((f"{ds_root}/{sd}/embeddings/{emb}", f"{ds_root}/{sd}/labels.csv"))
    return out


def load_embeddings(spark: SparkSession, root: str, dataset: str, split: str) -> DataFrame:
    """The first existing (features, labels) pair; Parquet tables keyed by ``id``.

    Features ``(id, features)`` and labels ``(id, label)`` are joined on id
    (never by position). A labels.csv needs an ``id`` column and a label
    column chosen by the 'label → y → first' policy.
    """
    for fp, lp in embedding_candidates(root, dataset, split):
        if exists(spark, fp) and exists(spark, lp):
            feats = spark.read.parquet(fp)
            if lp.endswith(".csv"):
                lab = read_labels_csv(spark, lp, policy="label_y_first", key="id")
            else:
                lab = spark.read.parquet(lp)
            return feats.join(lab.select("id", "label"), "id").withColumn("source_path", F.lit(fp))
    raise FileNotFoundError(f"no embeddings for dataset={dataset!r} split={split!r} under {root}")


# ---- S2: .npy matrices as a distributed read -------------------------------------------------

HEADER_BYTES = 1 << 16


def npy_header(spark: SparkSession, path: str):
    """Parse the .npy header (first bytes only): (shape, dtype, data offset)."""
    head = storage.read_at(path, 0, HEADER_BYTES)
    if head[:6] != b"\x93NUMPY":
        raise ValueError("not an .npy file")
    start = 10 if head[6] == 1 else 12
    offset = start + int.from_bytes(head[8:start], "little")
    header = ast.literal_eval(head[start:offset].decode("latin1"))
    if header.get("fortran_order"):
        raise ValueError("Fortran-ordered .npy is not supported")
    return tuple(header["shape"]), np.dtype(header["descr"]), offset


def read_npy(spark: SparkSession, path: str, rows_per_task: int = 65536, id_offset: int = 0) -> DataFrame:
    """``(id, features array<float>)`` — each task reads the byte range of its own rows."""
    shape, dtype, offset = npy_header(spark, path)
    n = shape[0]
    d = int(np.prod(shape[1:])) if len(shape) > 1 else 1
    chunks = max(1, (n + rows_per_task - 1) // rows_per_task)
    row = d * dtype.itemsize

    def fn(batches):
        for pdf in batches:
            for c in pdf["id"].to_numpy():
                lo, hi = int(c) * rows_per_task, min(n, (int(c) + 1) * rows_per_task)
                if lo >= hi:
                    continue
                raw = storage.read_at(path, offset + lo * row, (hi - lo) * row)
                block = np.frombuffer(raw, dtype=dtype).reshape(hi - lo, d).astype(np.float32)
                yield pd.DataFrame({"id": np.arange(lo, hi, dtype=np.int64) + id_offset, "features": list(block)})

    return spark.range(chunks, numPartitions=chunks).mapInPandas(fn, "id long, features array<float>")


def write_npy(df: DataFrame, path: str, n: int, d: int, key: str = "id", features: str = "features") -> int:
    """Distributed .npy writer on a shared POSIX mount: the driver writes the header, each
    task writes its rows at offset id·row_bytes of the one file. Ids must be 0 to n−1, each
    once; that is checked before anything is written (an object store can't take writes at
    an offset: write Parquet there)."""
    from numpy.lib import format as npf

    fs, path = storage.resolve(path)
    if fs.type_name != "local":
        raise ValueError("an .npy file is written at offsets, which needs a POSIX path")
    seen = df.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(key).alias("u"), F.min(key).alias("lo"), F.max(key).alias("hi")).first()
    if n and (seen["n"], seen["u"], seen["lo"], seen["hi"]) != (n, n, 0, n - 1):
        raise ValueError(f"ids must be 0 to {n - 1}, each once")
    header = {"descr": npf.dtype_to_descr(np.dtype("<f4")), "fortran_order": False, "shape": (int(n), int(d))}
    with open(path, "wb") as fh:
        npf.write_array_header_1_0(fh, header)
        off = fh.tell()
        fh.truncate(off + n * d * 4)

    def fn(batches):
        import os
        fd = os.open(path, os.O_WRONLY)
        wrote = 0
        try:
            for pdf in batches:
                for i, v in zip(pdf[key].to_numpy(), pdf[features].to_numpy()):
                    os.pwrite(fd, np.asarray(v, dtype="<f4").tobytes(), off + int(i) * d * 4)
                    wrote += 1
        finally:
            os.close(fd)
        yield pd.DataFrame({"written": [wrote]})

    return int(df.select(key, features).mapInPandas(fn, "written long").agg(F.sum("written")).first()[0] or 0)


# ---- S3, S4, S7: CSV readers ----------------------------------------------------------------------

def choose_label_column(columns: Sequence[str], policy: str, numeric: Sequence[str] = ()) -> str:
    """S3 policies: 'label_y_first' (label → y → first column), 'named_last' (first of
    label/labels/y/target/tumor → last column), 'numeric_last' (case-insensitive names →
    last numeric column)."""
    cols = list(columns)
    if policy == "label_y_first":
        for c in ("label", "y"):
            if c in cols:
                return c
        return cols[0]
    if policy == "named_last":
        for c in LABEL_NAMES_LAST:
            if c in cols:
                return c
        return cols[-1]
    if policy == "numeric_last":
        lower = {c.lower(): c for c in cols}
        for c in LABEL_NAMES_LAST:
            if c in lower:
                return lower[c]
        if not numeric:
            raise ValueError("no numeric column for the label")
        return list(numeric)[-1]
    raise ValueError(policy)


def read_labels_csv(spark: SparkSession, path: str, policy: str = "label_y_first", key: str | None = None) -> DataFrame:
    """S3: header CSV; the label column picked by ``policy``; numeric test per column is
    ``count_if(try_cast(c as double) is null) = 0`` (one pass over all columns)."""
    raw = spark.read.option("header", True).csv(path)
    cols = [c for c in raw.columns if c != key]
    numeric = []
    if policy == "numeric_last":
        agg = raw.agg(*[F.count_if(F.col(f"`{c}`").try_cast("double").isNull() & F.col(f"`{c}`").isNotNull())
                        .alias(c) for c in cols]).first()
        numeric = [c for c in cols if agg[c] == 0]
    lab = choose_label_column(cols, policy, numeric)
    out = [F.col(f"`{lab}`").try_cast("double").cast("int").alias("label")]
    if key:
        out.insert(0, F.col(key).cast("long").alias(key))
    return raw.select(*out)


def read_numeric_csv(spark: SparkSession, path: str) -> DataFrame:
    """Keep numeric columns; the last is the target, the rest form ``features``."""
    raw = spark.read.option("header", True).option("inferSchema", True).csv(path)
    num = [f.name for f in raw.schema.fields if isinstance(f.dataType, T.NumericType)]
    if len(num) < 2:
        raise ValueError("need at least one feature and a target")
    return raw.select(F.array(*[F.col(f"`{c}`").cast("double") for c in num[:-1]]).alias("features"),
                      F.col(f"`{num[-1]}`").cast("double").alias("target"))


# ---- S5, S6, S8: file listings -------------------------------------------------------------------

def list_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """Recursive listing (path, length); content is pruned away by the select."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true") \
        .option("pathGlobFilter", glob).load(root)
    return df.select("path", "length")


def route_shards(spark: SparkSession, root: str, prefixes: dict[str, str]) -> DataFrame:
    """Rows of Parquet shards routed to splits by file-name prefix; unknown shards skipped.

    Returns per split: shards, rows, columns.
    """
    df = spark.read.option("recursiveFileLookup", "true").parquet(root)
    fname = F.col("_metadata.file_name")
    split = None
    for pre, sp in prefixes.items():
        c = F.when(fname.startswith(pre), F.lit(sp))
        split = c if split is None else split.when(fname.startswith(pre), F.lit(sp))
    t = df.select(split.alias("split"), fname.alias("file")).filter(F.col("split").isNotNull())
    return t.groupBy("split").agg(F.countDistinct("file").alias("shards"), F.count(F.lit(1)).alias("rows")) \
        .withColumn("columns", F.lit(len(df.columns)))


def md5_check(spark: SparkSession, root: str, manifest: DataFrame, name: str = "name",
              expected: str = "md5") -> DataFrame:
    """md5 of every file's content against an expected manifest: OK / MISMATCH / MISSING.

    The listing reads paths only; each file is then hashed block by block in the task that
    has its path, so its size doesn't matter.
    """
    paths = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")

    def fn(batches):
        for pdf in batches:
            rows = []
            for path in pdf["path"]:
                digest = hashlib.md5()
                for block in storage.blocks(path):
                    digest.update(block)
                rows.append((path.rsplit("/", 1)[-1], digest.hexdigest()))
            yield pd.DataFrame(rows, columns=[name, "_actual"])

    j = manifest.select(name, expected).join(paths.mapInPandas(fn, f"`{name}` string, _actual string"), name, "left")
    st = F.when(F.col("_actual").isNull(), "MISSING").when(F.col("_actual") == F.col(expected), "OK") \
        .otherwise("MISMATCH")
    return j.select(name, expected, F.col("_actual").alias("actual"), st.alias("status"))
