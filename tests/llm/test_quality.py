import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kernelspark.llm import label_model as M
from kernelspark.llm import quality_classifier as Q
from kernelspark.llm import quality_rules as R
from kernelspark.llm import text_stats as X

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = SPLIT.findall(text)
    lines, dup = [], 0
    for x in text.split("\n"):
        if SPLIT.search(x):
            dup += x in lines
            lines.append(x)
    grams = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    many = {g for g in set(grams) if grams.count(g) > 1} if len(grams) < 500 else None
    if many is None:
        seen = {}
        for g in grams:
            seen[g] = seen.get(g, 0) + 1
        many = {g for g, n in seen.items() if n > 1}
    hit = {i + j for i, g in enumerate(grams) if g in many for j in range(8)}
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)]


@settings(max_examples=150, deadline=None)
@given(st.text("ab \n\t#é", max_size=120))
def test_counts(text):
    assert X.stats(text.encode())[:5] == brute(text)


def test_rules_against_brute_force(docs, rows):
    got = R.judge(docs.select("doc_id", "text")).collect()
    expected = [(i, *brute(t)) for i, t in rows]
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got), key=str) == sorted(expected, key=str)
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert r.kept == (not r.base_failed and r.quality >= R.LEAST)
    cast = R.judge(docs.select("doc_id", "text")).select(*(v.alias(k) for k, v in R.rules().items())).collect()
    v = np.array([list(r) for r in cast], float)
    patterns, counts = np.unique(v, axis=0, return_counts=True)
    shares, share = plain_em(v.astype(int).tolist(), 5)
    found = M.fit(patterns, counts.astype(float), 5)
    assert np.allclose(found[0], shares, atol=1e-9) and np.allclose(found[1], share, atol=1e-9)
    assert np.allclose(sorted(r.quality for r in got), sorted(M.posterior(v, *M.fit(patterns, counts.astype(float)))), atol=1e-9)


def plain_em(votes, rounds):
    """The same model row by row, without patterns."""
    m, n = len(votes[0]), len(votes)
    first = [[list(M.ON_GOOD if k == 0 else M.ON_OWN if k == j + 1 else M.ON_OTHER) for j in range(m)] for k in range(m + 1)]
    begin = list(M.start(m)[1])
    shares, share = first, begin
    for _ in range(rounds):
        of = []
        for row in votes:
            p = [share[k] * np.prod([shares[k][j][v + 1] for j, v in enumerate(row)]) for k in range(m + 1)]
            of.append([x / sum(p) for x in p])
        now = []
        for k in range(m + 1):
            per = []
            for j in range(m):
                mass = [sum(o[k] for o, row in zip(of, votes) if row[j] == v) + M.PULL * n * begin[k] * first[k][j][v + 1] for v in (-1, 0, 1)]
                per.append([x / sum(mass) for x in mass])
            now.append(per)
        shares = now
        share = [(sum(o[k] for o in of) + M.PULL * n * begin[k]) / (n * (1 + M.PULL)) for k in range(m + 1)]
    return shares, share


def test_em_finds_accuracies():
    rng = np.random.default_rng(0)
    true = np.array([[[0.01, 0.29, 0.70], [0.0, 0.0, 1.0], [0.03, 0.17, 0.80]],      # good rows
                     [[0.80, 0.10, 0.10], [0.0, 0.0, 1.0], [0.30, 0.20, 0.50]]])     # bad by voter 0
    kind = (rng.random(20000) < 0.3).astype(int)
    votes = (rng.random((20000, 3))[:, :, None] > np.cumsum(true, 2)[kind]).sum(2) - 1
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    shares, share = M.fit(patterns.astype(float), counts.astype(float))
    assert abs(share[0] - 0.7) < 0.08 and np.abs(shares[0] - true[0]).max() < 0.12
    good = M.posterior(votes, shares, share) >= 0.5
    assert good[kind == 0].mean() > 0.95 and good[kind == 1].mean() < 0.3
    assert M.fit(np.zeros((0, 3)), np.zeros(0))[1][0] == M.START_SHARE


def test_classifier_against_hand_labels(spark):
    from kernelspark.llm.queries import QUERIES

    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = QUERIES["op9_quality_classifier"](spark, "/root/testdata/sf0.01").join(labels, "doc_id").collect()
    good = [r.kept for r in got if r.quality == 1]
    bad = [r.kept for r in got if r.quality == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.6


def test_hashed_features_are_unit_vectors_and_training_separates():
    made = Q.Hasher()
    rows = [(*map(list, made(t)), y) for t, y in [(b"plain words here.", 1.0), (b"$$ ## %% && **", 0.0), (b"", 0.0)] * 5]
    w = Q.train(rows)
    for at, value, y in rows:
        assert abs(np.linalg.norm(value) - 1) < 1e-9 and (np.dot(w[at], value) + w[Q.DIMS] > 0) == (y > 0.5)
    assert not Q.train([]).any()


def test_long_words_are_hashed_whole():
    start = b"https://a.b-c.d/e-1/f-2/g-3/"
    assert len({Q.Hasher().feature(start + end) for end in (b"", b"x", b"7", b"?k=v&", b"x/9.html", b"A+/=")}) == 6


def test_equal_texts_get_equal_scores_and_empty_tables(spark, docs, no_docs, rows):
    weights = Q.learn(docs)
    got = Q.score(docs, weights).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.text or "", set()).add(round(r.score, 12))
    assert all(len(v) == 1 for v in by.values())
    assert Q.score(no_docs, Q.learn(no_docs)).collect() == [] and R.judge(no_docs).collect() == []
    for fails in (lambda: Q.score(docs.withColumnRenamed("n_chars", "Score"), weights), lambda: R.judge(docs.withColumnRenamed("n_chars", "KEPT")), lambda: M.weigh(docs, dict.fromkeys(map(str, range(11))), "x")):
        with pytest.raises(ValueError):
            fails()
