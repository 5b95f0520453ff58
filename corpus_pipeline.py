"""Corpus pipeline: five stages from documents to training sequences.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; ``run``
writes each result as Parquet in the shared folder and reads it again. The first four
return the columns of documents, the last the pieces of the packed sequences.

language     documents whose text is null or has no letter (language ``und``) go; which language
             a text has decides nothing, so if none could be learned (lang null throughout, or
             only in held-out rows), the same documents stay
near_dups    of each SimHash group the document with the smallest id stays
dedup        strings of 50 bytes that an earlier document has go from the text; a character
             cut in two goes whole, and a document of which nothing is left goes
benchmark    documents with a hit of a benchmark window go
packing      what is left becomes sequences of 1024 tokens

An empty table passes through every stage. Repeated rows: the near-duplicate stage keeps
one row of a group. Rows without doc_id pass as the last of their group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kernelspark.llm import decontamination, language, packing, simhash, suffix_dedup
from kernelspark.llm.common import checkpoint_table, fresh, read, ship_package


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    pred, score = fresh(docs.columns, "lang_pred"), fresh(docs.columns, "lang_score")
    models = language.learn(docs) or [("", [])]  # nothing learned: one language without a name has every text with a letter
    found = language.identify(docs, models, pred=pred, score=score)
    return found.where(F.col(pred) != language.UNKNOWN).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group: the smallest doc_id (rows without one last), then the smallest row hash."""
    ship_package(spark)
    row = fresh([*docs.columns, "fp", "root", "component"], "__row")
    keyed = docs.withColumn(row, F.xxhash64(*docs.columns))
    groups = simhash.group(keyed.select("doc_id", row, "text"))
    best = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", row)).alias("best")).select("best.*").alias("b")
    same = (F.col(f"d.{row}") == F.col(f"b.{row}")) & F.col("d.doc_id").eqNullSafe(F.col("b.doc_id"))
    kept = keyed.alias("d").join(best, same, "left_semi")
    return kept.dropDuplicates(["doc_id", row]).select(*docs.columns)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    found = suffix_dedup.dedup(docs)
    whole = F.col("n_removed") == 0
    out = found.where(whole | (F.length("kept_text") > 0))
    changed = {"text": F.when(whole, F.col("text")).otherwise(F.col("kept_text"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(whole, F.col("n_chars")).otherwise(F.length("kept_text")).cast(docs.schema["n_chars"].dataType)
    return out.withColumns(changed).select(*docs.columns)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    found = decontamination.scan(docs, read(spark, sf_dir, "benchmark"))
    return found.where("n_hit = 0").select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return packing.pack(docs.select("doc_id", "text"))


STAGES = [("language", language_stage), ("near_dups", near_duplicate_stage), ("dedup", dedup_stage), ("benchmark", benchmark_stage), ("packing", packing_stage)]
#: Automata, permutations of curves and run-length indexes have no SQL; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = checkpoint_table(stage(spark, docs, sf_dir), spark, f"pipeline-{name}")
    return docs
