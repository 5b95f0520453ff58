import numpy as np
import pytest
import xxhash

from kernelspark.llm import simhash as S


def brute_fp(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    if not w:
        return 0
    grams = [" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_roots(fps, budget=4):
    n = len(fps)
    up = list(range(n))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(n):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= budget:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("cell", [4096, 4])
def test_against_brute_force(docs, rows, cell):
    got = S.group(docs.select("doc_id", "text"), cell=cell).collect()
    fps = [brute_fp(t) for _, t in rows]
    roots = brute_roots(fps)
    least = {}
    for r, (i, _) in zip(roots, rows):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    expected = sorted(((i, fp - (1 << 64) if fp >> 63 else fp, least.get(r)) for (i, _), fp, r in zip(rows, fps, roots)), key=str)
    assert sorted(((r.doc_id, r.fp, r.component) for r in got), key=str) == expected


def test_fingerprint_agrees_with_spark_hash(spark):
    from pyspark.sql import functions as F

    word = "é one two three"
    h = spark.range(1).select(F.xxhash64(F.lit(word))).first()[0]
    assert S.fingerprint(word.encode()) == h % (1 << 64) == brute_fp(word)


@pytest.mark.parametrize("cell,n", [(4096, 400), (16, 300)])
def test_links_of_clustered_fingerprints(spark, cell, n):
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    fps = {int(c) for c in centres}
    while len(fps) < n:
        x = int(rng.choice(centres))
        for b in rng.integers(0, 64, rng.integers(1, 9)):
            x ^= 1 << int(b)
        fps.add(x)
    fps = sorted(fps)
    nodes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    found = S.star_components(spark, S.links(nodes, "fp", 4, n, cell)).collect()
    root = {r.node % (1 << 64): r.root % (1 << 64) for r in found}
    groups, expected = {}, {}
    for f, r in zip(fps, brute_roots(fps)):
        groups.setdefault(root.get(f, f), set()).add(f)
        expected.setdefault(r, set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_trie_walk_finds_exactly_the_near_pairs():
    rng = np.random.default_rng(2)
    fp = np.unique(rng.integers(0, 1 << 12, 3000, dtype=np.uint64) << np.uint64(50))[:900]
    label = S.linked(np.zeros(len(fp), np.int64), np.full(len(fp), 2), fp, 1)
    assert label.tolist() == brute_roots([int(x) for x in fp], 1)


def test_more_blocks_agree_when_there_are_more_fingerprints():
    assert S.choice(1000, 4) == 1 and S.choice(10**9, 4) > 1
    for m in (1, 2, 3):
        assert all(x.bit_count() >= 64 * m // (4 + m) - m for x in S.masks(4, m))


def test_star_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    assert {(r.node, r.root) for r in S.star_components(spark, edges).collect()} == {(i, 0) for i in range(1, 61)} | {(101, 100)}


def test_empty_and_clash(spark, no_docs, docs):
    assert S.group(no_docs.select("doc_id", "text")).collect() == []
    with pytest.raises(ValueError):
        S.group(docs.withColumnRenamed("source", "ROOT"))
