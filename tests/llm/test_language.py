import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kernelspark.llm import language as L


def greedy(raw, samples):
    n = at = 0
    while at < len(raw):
        k = 1
        while at + k < len(raw) and any(raw[at:at + k + 1] in s for s in samples):
            k += 1
        at += k
        n += 1
    return n


def cut(raw):
    return [raw[i:i + L.STRETCH] for i in range(0, len(raw), L.STRETCH)]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text("abc", max_size=30).map(str.encode), min_size=1, max_size=4), st.lists(st.text("abcd", max_size=40).map(str.encode), min_size=1, max_size=5))
def test_phrases_are_greedy_longest_matches(samples, raws):
    got = L.parse(raws, [L.suffix_automaton(samples)])[:, 0].tolist()
    assert got == [sum(greedy(p, samples) for p in cut(r)) for r in raws]


def test_long_texts_are_parsed_whole():
    rng = random.Random(4)
    raw = bytes(rng.choice(b"abcd") for _ in range(3000))
    samples = [raw[100:400], raw[900:950]]
    assert L.parse([raw], [L.suffix_automaton(samples)])[0, 0] == sum(greedy(p, samples) for p in cut(raw))


@pytest.fixture(scope="module")
def table(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def test_held_out_accuracy_and_brute_force_winner(spark, table):
    models = L.learn(table)
    got = {r.doc_id: r for r in L.identify(table.select("doc_id", "text"), models).withColumn("held", L.held()).collect()}
    rows = table.collect()
    assert all(got[r.doc_id].held == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if got[r.doc_id].held]
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) > 0.98 * len(held)
    assert all(0 <= g.score <= 1 for g in got.values())
    for r in rows[:25]:
        raw = L.normal(r.text)
        n = [(sum(greedy(p, s) for p in cut(raw)), name) for name, s in models]
        assert got[r.doc_id].lang_pred == min(n)[1]


def test_sample_is_bounded_and_does_not_depend_on_the_layout(table):
    a = L.learn(table)
    assert a == L.learn(table.repartition(9)) and [n for n, _ in a] == ["de", "en", "es", "fr"]
    assert all(len(v) <= L.TRAIN_ROWS and all(len(x) <= L.SLICE for x in v) for _, v in a)


def test_numerals_and_marks_are_no_letters(spark):
    texts = ["½ ② 5²", "①②③", "Ⅷ ⅷ", "x²", "ª", "日"]
    got = L.identify(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), [("a", [b"the of and"])]).orderBy("i").collect()
    assert [r.lang_pred == "und" for r in got] == [not any(c.isalpha() for c in t) for t in texts] == [True, True, True, False, False, False]


def test_copies_are_learned_once(spark, table):
    from pyspark.sql import functions as F

    one = table.where("lang = 'en'").orderBy("doc_id").limit(1).drop("doc_id")
    copies = spark.range(10**6, 10**6 + 3000).withColumnRenamed("id", "doc_id").crossJoin(one).select(*table.columns)
    models = dict(L.learn(table.unionByName(copies.withColumn("text", F.upper("text")))))
    assert len(models["en"]) == L.TRAIN_ROWS == len(set(models["en"])) and all(len(set(v)) == len(v) for v in models.values())


def test_awkward_rows(docs, no_docs, rows):
    models = [("a", [b"the of and"]), ("b", [b"eau que ment"])]
    got = L.identify(docs, models).collect()
    und = sorted(str(r.doc_id) for r in got if r.lang_pred == "und")
    assert und == sorted(str(i) for i, t in rows if not any(c.isalpha() for c in t or ""))
    assert len(got) == len(rows) and all(r.score == 0 for r in got if r.lang_pred == "und")
    assert L.identify(no_docs, models).collect() == []
    assert {r.lang_pred for r in L.identify(docs, L.learn(no_docs)).collect()} == {"und"}
    with pytest.raises(ValueError):
        L.identify(docs.withColumnRenamed("n_chars", "SCORE"), models)
