import importlib.util
import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)

from test_decontamination import brute as brute_hits  # noqa: E402
from test_simhash import brute_fp, brute_roots  # noqa: E402

import corpus_pipeline as C  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, rows, docs, tmp_path_factory):
    at = tmp_path_factory.mktemp("corpus")
    texts = {i: t for i, t in rows if i is not None}
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, texts[8]), (2, texts[20])], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def key(r):
    return (r.doc_id, r.text)


def test_every_stage_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in C.STAGES:
        before = docs.collect()
        docs = stage(spark, docs, folder)
        if name != "packing":
            assert docs.schema.simpleString() == spark.read.parquet(f"{folder}/documents.parquet").schema.simpleString()
        after = docs.collect()
        if name == "language":
            expected = [key(r) for r in before if any(c.isalpha() for c in r.text or "")]
        elif name == "near_dups":
            roots = brute_roots([brute_fp(r.text) for r in before])
            groups = {}
            for g, r in zip(roots, before):
                groups.setdefault(g, []).append(r)
            assert len(after) == len(groups)
            expected = None
            least = [min((r.doc_id is None, r.doc_id or 0) for r in v) for v in groups.values()]
            assert sorted((r.doc_id is None, r.doc_id or 0) for r in after) == sorted(least)
            assert {key(r) for r in after} <= {key(r) for r in before}
        elif name == "dedup":
            expected = dedup_brute(before)
            assert all(r.n_chars == len(r.text) for r in after)
        elif name == "benchmark":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
            clean = [x[0] for x in brute_hits([(i, r.text) for i, r in enumerate(before)], items) if x[2] == 0]
            expected = [key(before[i]) for i in clean]
            assert len(clean) < len(before)
        else:
            assert sum(r.length for r in after) == sum({(r.doc_id, r.doc_tokens): r.doc_tokens for r in after}.values())
            expected = None
        if expected is not None:
            assert sorted(map(key, after), key=str) == sorted(expected, key=str)
        docs = spark.createDataFrame(after, docs.schema) if after else docs


@pytest.mark.parametrize("labelled", ["none", "held out"])
def test_texts_with_letters_stay_when_no_language_is_learned(spark, docs, folder, labelled):
    from pyspark.sql import functions as F

    from kernelspark.llm import language as L

    table = docs.withColumn("lang", F.when(L.held(), F.lit("en")) if labelled == "held out" else F.lit(None).cast("string"))
    assert L.learn(table) == [] and (labelled == "none" or table.where("lang is not null").count())
    after = C.language_stage(spark, table, folder)
    assert after.schema.simpleString() == docs.schema.simpleString()
    expected = [key(r) for r in docs.collect() if any(c.isalpha() for c in r.text or "")]
    assert expected and sorted(map(key, after.collect()), key=str) == sorted(expected, key=str)


def dedup_brute(before, length=50):
    big = 1 << 62
    first, out = {}, []
    raws = [(big if r.doc_id is None else r.doc_id, r, r.text.encode()) for r in before]
    for i, _, t in raws:
        for p in range(len(t) - length + 1):
            first[t[p:p + length]] = min(first.get(t[p:p + length], big + 1), i)
    for i, r, t in raws:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if first[t[p:p + length]] < i:
                gone[p:p + length] = b"\1" * length
        left = bytes(b for b, g in zip(t, gone) if not g).decode("utf-8", "ignore")
        if left or not any(gone):
            out.append((r.doc_id, left))
    return out


def test_run_on_an_empty_table(spark, no_docs, tmp_path):
    no_docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert C.run(spark, str(tmp_path)).collect() == []


def test_entry_registers_the_queries():
    spec = importlib.util.spec_from_file_location("spark_entry_llm", os.path.join(ROOT, "__spark_entry__.py"))
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)
    names = entry.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))
    assert "op2_decontamination" in entry.oracle_sql()
