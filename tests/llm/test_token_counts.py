import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kernelspark.llm import token_counts as C


def greedy(word, pieces):
    """Longest piece first; a character that starts no piece costs its bytes."""
    n = at = 0
    while at < len(word):
        k = max((k for k in range(1, len(word) - at + 1) if word[at:at + k] in pieces), default=0)
        n += 1 if k else len(word[at].encode())
        at += k or 1
    return n


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text("abé", min_size=1, max_size=6), max_size=12), st.text("abéz", max_size=25))
def test_counts_are_those_of_greedy_pieces(pieces, word):
    assert C.Matcher(sorted(pieces)).count(word) == greedy(word, pieces)


def test_public_vocabulary(docs, rows):
    import public_tokenizers

    pieces = C.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    got = sorted(((r.doc_id, r.n_words, r.n_tokens, r.max_word_tokens) for r in C.count_tokens(docs.select("doc_id", "text"), pieces).collect()), key=str)
    known, out = set(pieces), []
    for i, t in rows:
        words = [w.decode() for w in (t or "").encode().split()]
        each = [greedy(C.START + w, known) if len(w) < 300 else C.Matcher(pieces).count(C.START + w) for w in words]
        out.append((i, len(words), sum(each), max(each, default=0)))
    assert got == sorted(out, key=str)


def test_empty_clash_and_bound(no_docs, docs):
    assert C.count_tokens(no_docs, ["a"]).collect() == []
    with pytest.raises(ValueError):
        C.count_tokens(docs.withColumnRenamed("n_chars", "N_tokens"), ["a"])
    with pytest.raises(ValueError):
        C.count_tokens(docs, ["a"] * (C.MAX_PIECES + 1))
