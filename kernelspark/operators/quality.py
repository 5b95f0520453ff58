"""Manifest audit, repair, alignment and contract checks (Q1–Q19).

Manifests are tables of rows that reference files; file listings are tables
of paths. Every lookup is an equi-join on a derived key. Listings are first
reduced to one row per key (min path per basename), so a join never fans out,
and a hot basename is one row, not a hot partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_table

from .ordered import row_numbers

# Fixed values that must equal the reference's.
IMAGE_COLUMN_CANDIDATES = ["image", "image_path", "img", "img_path", "filename", "file", "path", "patch"]
IMAGE_EXTS = [".png", ".jpg", ".jpeg", ".tif", ".tiff"]
SPLIT_ALIASES = {"val": "valid", "validation": "valid"}
GROUP_COLUMN_ORDER = ["center", "hospital"]


def detect_image_column(columns: Sequence[str]) -> str:
    """First candidate present (case-insensitive), else the first column."""
    lower = {c.lower(): c for c in columns}
    for c in IMAGE_COLUMN_CANDIDATES:
        if c in lower:
            return lower[c]
    return list(columns)[0]


def basename(c: Column) -> Column:
    return F.regexp_extract(c, r"([^/]*)$", 1)


def strip_ext(c: Column) -> Column:
    return F.regexp_replace(c, r"\.[^./]*$", "")


# ---- Q1–Q4 --------------------------------------------------------------------------------

def _salt() -> Column:
    """A per-row key that matches nothing (paths never start with NUL): rows without a
    usable key keep a spread-out join key instead of one hot NULL key."""
    return F.concat(F.lit("\u0000"), F.monotonically_increasing_id().cast("string"))


def resolve_images(manifest: DataFrame, files: DataFrame, ref: str = "image", path: str = "path",
                   ext: str | None = ".png") -> DataFrame:
    """Q1 tiers: exact path, path + ext, basename, basename + ext (first hit wins).

    Adds ``resolved`` (the matched path or NULL) and ``tier`` (1–4). Distinct references
    are exploded to their keys of all tiers and joined once with the listing's paths and
    basenames; the lowest tier of each is then joined back to the manifest, which is
    shuffled once. Empty references get salted keys, so they don't share one partition.
    """
    r = F.trim(F.coalesce(F.col(ref).cast("string"), F.lit("")))
    refs = manifest.select(r.alias("_ref")).filter("_ref <> ''").distinct()
    base_ref = basename(F.col("_ref"))
    tiers = [F.struct(F.lit(1).alias("t"), F.lit("path").alias("by"), F.col("_ref").alias("k")),
             F.struct(F.lit(3).alias("t"), F.lit("base").alias("by"), base_ref.alias("k"))]
    if ext:
        tiers.insert(1, F.struct(F.lit(2).alias("t"), F.lit("path").alias("by"), F.concat("_ref", F.lit(ext)).alias("k")))
        tiers.append(F.struct(F.lit(4).alias("t"), F.lit("base").alias("by"),
                              F.when(~base_ref.endswith(ext), F.concat(base_ref, F.lit(ext))).alias("k")))
    keys = refs.select("_ref", F.explode(F.array(*tiers)).alias("x")).select("_ref", "x.*").filter("k IS NOT NULL")
    p = files.select(F.col(path).alias("_path")).distinct()
    listing = p.select(F.lit("path").alias("by"), F.col("_path").alias("k"), "_path").unionByName(
        p.groupBy(F.lit("base").alias("by"), basename(F.col("_path")).alias("k")).agg(F.min("_path").alias("_path")))
    found = keys.join(listing, ["by", "k"]).groupBy("_ref").agg(F.min(F.struct("t", "_path")).alias("_hit"))
    m = manifest.withColumn("_key", F.when(r == "", _salt()).otherwise(r))
    m = m.join(found.withColumnRenamed("_ref", "_key"), "_key", "left")
    return m.select(*manifest.columns, F.col("_hit._path").alias("resolved"), F.col("_hit.t").cast("int").alias("tier"))


def audit(manifest: DataFrame, files: DataFrame, emb_stems: DataFrame, ref: str = "image",
          path: str = "path", stem: str = "stem", ext: str | None = ".png") -> DataFrame:
    """Q1: status per row: OK / MISSING_IMG / MISSING_EMB (embedding = resolved path without extension)."""
    r = resolve_images(manifest, files, ref, path, ext)
    stems = emb_stems.select(F.col(stem).alias("_k5")).distinct().withColumn("_hit", F.lit(True))
    k5 = F.when(F.col("resolved").isNull(), _salt()).otherwise(strip_ext(F.col("resolved")))
    j = r.withColumn("_k5", k5).join(stems, "_k5", "left")
    status = F.when(F.col("resolved").isNull(), "MISSING_IMG").when(F.col("_hit").isNull(), "MISSING_EMB") \
        .otherwise("OK")
    return j.select(*r.columns, status.alias("status"))


def orphans(audited: DataFrame, files: DataFrame, path: str = "path", exts: Sequence[str] = IMAGE_EXTS) -> DataFrame:
    """Q2: image files on disk referenced by no manifest row (left anti join)."""
    lower = F.lower(F.col(path))
    is_img = None
    for e in exts:
        c = lower.endswith(e)
        is_img = c if is_img is None else is_img | c
    on_disk = files.filter(is_img).select(path).distinct()
    seen = audited.filter(F.col("resolved").isNotNull()).select(F.col("resolved").alias(path)).distinct()
    return on_disk.join(seen, path, "left_anti")


def clean_manifest(audited: DataFrame) -> DataFrame:
    """Q3: rows whose image and embedding both exist."""
    return audited.filter(F.col("status") == "OK")


def audit_summary(audited: DataFrame, files: DataFrame, split: str = "split", path: str = "path") -> DataFrame:
    """Q4: per split: rows_total, rows_ok, rows_missing_image, rows_missing_embedding,
    images_on_disk, orphan_images.

    The audited manifest feeds three branches, so it is stored once
    (manifest-sized) instead of re-running its joins per branch.
    """
    audited = checkpoint_table(audited, audited.sparkSession, "audited")
    a = audited.groupBy(split).agg(
        F.count(F.lit(1)).alias("rows_total"), F.count_if(F.col("status") == "OK").alias("rows_ok"),
        F.count_if(F.col("status") == "MISSING_IMG").alias("rows_missing_image"),
        F.count_if(F.col("status") == "MISSING_EMB").alias("rows_missing_embedding"))
    disk = files.groupBy(split).agg(F.countDistinct(path).alias("images_on_disk"))
    orph = orphans(audited, files, path).join(files.select(path, split).distinct(), path) \
        .groupBy(split).agg(F.count(F.lit(1)).alias("orphan_images"))
    out = a.join(disk, split, "full").join(orph, split, "left")
    return out.select(split, *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in (
        "rows_total", "rows_ok", "rows_missing_image", "rows_missing_embedding", "images_on_disk", "orphan_images")])


# ---- Q5–Q7, Q11 -------------------------------------------------------------------------------

def repair_paths(manifest: DataFrame, files: DataFrame, ref: str = "image", row_idx: str = "row_idx",
                 path: str = "path", pattern: str = "images/{n}.png") -> DataFrame:
    """Q5: a missing image falls back to images/<row+1>.png when that exists.

    Adds ``image_fixed``, ``repaired`` and ``unrepairable`` flags.
    """
    p = files.select(F.col(path).alias("_p")).distinct()
    pre, post = pattern.split("{n}")
    alt = F.concat(F.lit(pre), (F.col(row_idx) + 1).cast("string"), F.lit(post))
    m = manifest.join(p.select(F.col("_p").alias("_e")), manifest[ref] == F.col("_e"), "left")
    m = m.withColumn("_alt", alt)
    m = m.join(p.select(F.col("_p").alias("_a")), m["_alt"] == F.col("_a"), "left")
    ok = F.col("_e").isNotNull()
    return m.select(*manifest.columns,
                    F.when(ok, F.col(ref)).when(F.col("_a").isNotNull(), F.col("_alt")).alias("image_fixed"),
                    (~ok & F.col("_a").isNotNull()).alias("repaired"),
                    (~ok & F.col("_a").isNull()).alias("unrepairable"))


def contiguous_prefix(repaired: DataFrame, row_idx: str = "row_idx") -> DataFrame:
    """Q6: keep rows before the first unrepairable one (one scalar aggregate, then a filter)."""
    m = repaired.agg(F.min(F.when(F.col("unrepairable"), F.col(row_idx))).alias("_cut"))
    j = repaired.crossJoin(F.broadcast(m))   # one-row scalar
    return j.filter(F.col("_cut").isNull() | (F.col(row_idx) < F.col("_cut"))).drop("_cut")


def skip_missing(manifest: DataFrame, files: DataFrame, ref: str = "image", path: str = "path"):
    """Q7: keep rows whose image exists; returns (kept DataFrame, missing count). Raises if none kept."""
    p = files.select(F.col(path).alias(ref)).distinct()
    kept = manifest.join(p, ref, "left_semi")
    c = manifest.join(p, ref, "left_anti").count()
    if kept.limit(1).count() == 0:
        raise RuntimeError("no rows left after skipping missing images")
    return kept, c


def contiguous_count(numbers: DataFrame, col: str) -> DataFrame:
    """Q11 helper: largest n such that 1..n are all present (distinct numbers, bucketed ranks)."""
    d = numbers.select(F.col(col).cast("long").alias("_v")).filter(F.col("_v") >= 1).distinct()
    r = row_numbers(d, [], ["_v"], out="_rn")
    gap = r.agg(F.min(F.when(F.col("_v") != F.col("_rn"), F.col("_rn"))).alias("_g"),
                F.count(F.lit(1)).alias("_n"))
    return gap.select(F.coalesce(F.col("_g") - 1, F.col("_n")).cast("long").alias("contiguous"))


def resume_point(label_rows: DataFrame, image_numbers: DataFrame, col: str) -> DataFrame:
    """Q11: completed = min(label rows, contiguous images 1..n)."""
    n_lab = label_rows.agg(F.count(F.lit(1)).alias("label_rows"))
    n_img = contiguous_count(image_numbers, col).withColumnRenamed("contiguous", "contiguous_images")
    j = n_lab.crossJoin(n_img)   # one-row tables
    return j.withColumn("completed", F.least("label_rows", "contiguous_images"))


# ---- Q8–Q10 --------------------------------------------------------------------------------------

def trim_manifest(manifest: DataFrame, completed: DataFrame, row_idx: str = "row_idx") -> DataFrame:
    """Q11: keep the first ``completed`` rows (a one-row scalar, broadcast)."""
    c = completed.select(F.col("completed").alias("_c"))
    return manifest.crossJoin(F.broadcast(c)).filter(F.col(row_idx) < F.col("_c")).drop("_c")


def align(features: DataFrame, labels: DataFrame, key: str = "id", strict: bool = False) -> DataFrame:
    """Q8: pair rows by explicit id; strict mode asserts both sides cover the same ids."""
    if strict:
        bad = features.select(key).join(labels.select(key), key, "full_outer") \
            .join(features.select(key).withColumn("_l", F.lit(1)), key, "left") \
            .join(labels.select(key).withColumn("_r", F.lit(1)), key, "left") \
            .filter(F.col("_l").isNull() | F.col("_r").isNull()).count()
        if bad:
            raise AssertionError(f"{bad} ids are present on one side only")
    return features.join(labels, key, "inner")


def cast_labels(df: DataFrame, label: str = "label", dtype: str = "int64", signed: bool = False) -> Column:
    """Q9: label as int64/int32/float32 (bool → int); ``signed`` maps 0/1 to ±1."""
    c = F.col(label)
    c = F.when(c.cast("string").isin("true", "True"), F.lit(1)).when(c.cast("string").isin("false", "False"),
                                                                     F.lit(0)).otherwise(c)
    t = {"int64": "bigint", "int32": "int", "float32": "float"}[dtype]
    c = c.cast(t)
    if signed:
        c = F.when(c > 0, F.lit(1)).otherwise(F.lit(-1)).cast(t)
    return c


def non_binary_values(df: DataFrame, label: str = "label", limit: int = 20) -> DataFrame:
    """Q10: up to ``limit`` distinct offending label values (a report, not a filter of results)."""
    return df.filter(~F.col(label).isin(0, 1) | F.col(label).isNull()).select(label).distinct() \
        .orderBy(label).limit(limit)


# ---- Q12, Q13, Q16–Q19 ---------------------------------------------------------------------------

def totals_with_all(df: DataFrame, split: str, expected: str, on_disk: str, total_label: str = "TOTAL") -> DataFrame:
    """Q12: per-split sums plus a TOTAL row (rollup) and missing = expected − on_disk."""
    r = df.rollup(split).agg(F.sum(expected).alias("expected"), F.sum(on_disk).alias("on_disk"),
                             F.grouping(split).alias("_g"))
    return r.select(F.when(F.col("_g") == 1, F.lit(total_label)).otherwise(F.col(split)).alias(split),
                    "expected", "on_disk", (F.col("expected") - F.col("on_disk")).alias("missing"))


def contract_diff(expected: DataFrame, actual: DataFrame, keys: Sequence[str], value_cols: Sequence[str]) -> DataFrame:
    """Q13: unpivot both sides to (keys, field, value), full outer join, keep disagreements."""
    def longf(df, nm):
        st = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("v"))
                                 for c in value_cols]))
        return df.select(*keys, st.alias("_kv")).select(*keys, "_kv.field", F.col("_kv.v").alias(nm))
    e, a = longf(expected, "expected"), longf(actual, "actual")
    j = e.join(a, list(keys) + ["field"], "full_outer")
    status = F.when(F.col("expected").isNull() & F.col("actual").isNotNull(), "unexpected") \
        .when(F.col("actual").isNull() & F.col("expected").isNotNull(), "missing").otherwise("mismatch")
    return j.filter(~F.col("expected").eqNullSafe(F.col("actual"))).withColumn("status", status)


def log_invariants(log: DataFrame, record_id: str = "record_id", tol: float = 1e-9) -> DataFrame:
    """Q16: duplicate record ids and rows breaking tp+tn+fp+fn = n_test or fnr = fn/(tp+fn)."""
    dup = log.groupBy(record_id).agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1") \
        .select(record_id, F.lit("duplicate_record_id").alias("violation"))
    cnt = log.filter(F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn") != F.col("n_test")) \
        .select(record_id, F.lit("confusion_total").alias("violation"))
    fnr = log.filter((F.col("tp") + F.col("fn") > 0) &
                     (F.abs(F.col("fnr") - F.col("fn") / (F.col("tp") + F.col("fn"))) > tol)) \
        .select(record_id, F.lit("fnr").alias("violation"))
    return dup.unionByName(cnt).unionByName(fnr)


def tag_union(frames: dict[str, DataFrame], tag: str = "dataset_source") -> DataFrame:
    """Q17: tag each frame with its source name and union by column name."""
    out = None
    for name, df in frames.items():
        t = df.withColumn(tag, F.lit(name))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    return out


def first_available(df: DataFrame, candidates: Sequence[str], out: str) -> Column:
    """Q18: coalesce over the candidate columns that exist in this layout."""
    have = [F.col(c) for c in candidates if c in df.columns]
    return (F.coalesce(*have) if have else F.lit(None)).alias(out)


def variance_or_std2(df: DataFrame, var: str, std: str, out: str) -> Column:
    """Q18: variance column, else std² when only the std exists."""
    if var in df.columns and std in df.columns:
        return F.coalesce(F.col(var), F.pow(F.col(std), 2)).alias(out)
    if var in df.columns:
        return F.col(var).alias(out)
    if std in df.columns:
        return F.pow(F.col(std), 2).alias(out)
    return F.lit(None).cast("double").alias(out)


def normalize_split(c: Column) -> Column:
    """Q19: val / validation → valid (lower-cased), other names kept."""
    low = F.lower(F.trim(c))
    expr = low
    for a, b in SPLIT_ALIASES.items():
        expr = F.when(low == a, F.lit(b)).otherwise(expr)
    return expr


def group_column(df: DataFrame, out: str = "group") -> Column:
    """Q19: center, else hospital, else 0."""
    have = [F.col(c).cast("long") for c in GROUP_COLUMN_ORDER if c in df.columns]
    return F.coalesce(*have, F.lit(0).cast("long")).alias(out)
