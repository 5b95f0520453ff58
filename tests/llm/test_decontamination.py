import hashlib
import re

import pytest
from pyspark.sql import functions as F

from kernelspark.llm import decontamination as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return t.translate({c: c + 32 for c in range(65, 91)})


def brute(rows, items, size=10):
    found = []
    for i, t in items:
        w = WORD.findall(lower(t or ""))
        k = min(size, len(w))
        found += [(i, tuple(w[p:p + k])) for p in range(len(w) - k + 1)] if k else []
    out = []
    for doc, t in rows:
        w = WORD.findall(lower(t or ""))
        hit, who = set(), set()
        for i, g in found:
            for p in range(len(w) - len(g) + 1):
                if tuple(w[p:p + len(g)]) == g:
                    hit.update(range(p, p + len(g)))
                    who.add(str(i))
        out.append((doc, len(w), len(hit), len(who), hashlib.sha256(",".join(sorted(who)).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def items(rows):
    texts = {i: t for i, t in rows if i is not None}
    return [(1, texts[8]), (2, " ".join(texts[9].split()[3:20])), (10, texts[8].upper()), (3, "x y"), (4, None), (5, ""), (6, "ab AB, ab!"), (7, "日本語" * 40), (7, "a b")]


@pytest.mark.parametrize("block", [1 << 20, 300])
def test_against_brute_force(spark, docs, rows, items, block):
    table = spark.createDataFrame(items, "item_id long, text string")
    got = D.scan(docs.select("doc_id", "text", "n_chars"), table, block_bytes=block)
    shown = got.select("doc_id", "n_words", "n_hit", F.size("items").alias("n"), F.sha2(F.concat_ws(",", "items"), 256).alias("h")).collect()
    assert sorted((tuple(r) for r in shown), key=str) == brute(rows, items)
    assert "n_chars" in got.columns


def test_spans_are_offsets_of_the_original(spark):
    made = D.automaton([("a", b"one TWO three")], 2)
    raw = "É one,  Two! three. Four one two".encode()
    n, covered, _ = D.hits(raw, made)
    assert n == 7 and [raw[s["start"]:s["stop"]].decode() for s in D.spans(raw, covered)] == ["one,  Two! three", "one two"]


def test_empty_tables_and_clashes(spark, docs, no_docs, items):
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.scan(docs, none).where("n_hit > 0").count() == 0
    assert D.scan(no_docs, spark.createDataFrame(items, "item_id long, text string")).collect() == []
    with pytest.raises(ValueError):
        D.scan(docs.withColumnRenamed("n_chars", "N_HIT"), none)


@pytest.mark.parametrize("nodes,chunk", [(480, 1), (480, 2000), (9000, 1 << 28), (1, 1 << 28)])
def test_several_automata_against_brute_force(spark, docs, rows, items, nodes, chunk):
    table = spark.createDataFrame(items, "item_id long, text string")
    got = D.scan(docs.select("doc_id", "text"), table, nodes=nodes, chunk_bytes=chunk)
    shown = got.select("doc_id", "n_words", "n_hit", F.size("items").alias("n"), F.sha2(F.concat_ws(",", "items"), 256).alias("h")).collect()
    assert sorted((tuple(r) for r in shown), key=str) == brute(rows, items)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


@pytest.mark.parametrize("limit", [1, 30, 900, 30000])
def test_each_window_of_an_item_is_in_a_piece(spark, items, limit):
    table = spark.createDataFrame(items, "item_id long, text string")
    cut = D.pieces(table, "item_id", "text", 10, limit).collect()
    whole, parts = {}, {}
    for i, t in items:
        whole.setdefault(str(i), set()).update(D.windows(tuple(D.words((t or "").encode())), 10))
    for r in cut:
        found = D.windows(tuple(D.words(bytes(r.raw))), 10)
        parts.setdefault(r.item, set()).update(found)
        size = len(D.words(bytes(r.raw)))
        assert r.nodes == max(3 * sum(map(len, found)), 16 * size) and (r.nodes <= limit or len(found) == 1)
    assert parts == {i: w for i, w in whole.items() if w}


def test_blocks_keep_their_bounds(spark):
    many = spark.createDataFrame([(i, " ".join(f"w{i * k % 997}" for k in range(1, 41))) for i in range(400)], "item_id long, text string")
    cut = D.pieces(many, "item_id", "text", 10, 700)
    sent = list(D.blocks_of(cut, 12_000, 20_000))
    assert sum(len(block) for blocks in sent for block in blocks) == cut.count()
    for blocks in sent:
        assert sum(len(raw) + 64 for block in blocks for _, raw in block) <= 20_000
        for block in blocks:
            assert sum(len(w) for _, raw in block for w in D.windows(tuple(D.words(raw)), 10)) <= 4000
            assert D.automaton(block, 10).trie.get_stats()["nodes_count"] <= 12_001
    assert [len(b) for b in D.blocks_of(cut, 1 << 30, 1 << 30)] == [1]


@pytest.mark.parametrize("places", [1, 2, 3])
def test_codes_are_distinct(places):
    made = {D.code(n, places) for n in range(D.BASE ** places)}
    assert len(made) == D.BASE ** places and all(len(c) == places and D._OTHER not in c for c in made)


def test_many_words(spark):
    text = " ".join(f"w{i}" for i in range(70_000))           # codes of three places
    made = D.automaton([("a", text.encode()), (None, b"w1 w2"), ("b", b"w69990 w69991 w69992 w69993 w69994 w69995 w69996 w69997 w69998 w69999")], 10)
    n, covered, owners = D.hits(b"x " + text.encode(), made)
    assert n == 70_001 and covered.sum() == 70_000 and owners == {"a", "b"}
    n, covered, owners = D.hits(b"w0 w2 w1 w2 w4", made)
    assert covered.tolist() == [False, False, True, True, False] and owners == set()
    with pytest.raises(ValueError):
        D.scan(spark.createDataFrame([], "text string"), spark.createDataFrame([], "item_id long, text string"), nodes=D.NODES + 1)
