import zlib

import numpy as np
import pytest

from kernelspark.llm import packing as P


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    made.encode_special_tokens = True
    return made


def test_word_by_word_ids_are_the_tokenizers(reference, rows):
    words = P.Words()
    extra = ["a  b\n\n c", " lead", "tail ", "tabs\t x \t y", "x y  z", "it's we'll  'quoted'", "<|endoftext|> a", "1 22 333", "\x1c \x1d a \x85 b", "😀 😀  😀"]
    for t in [t or "" for _, t in rows] + extra:
        assert np.frombuffer(words.ids(t), "<u2").tolist() == reference.encode(t, add_special_tokens=False).ids


def test_added_token_is_the_tokenizers(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = ["end of page <|endoftext|> next page", "<|endoftext|>", "<|endoftext|><|endoftext|> a", "a <|endoftext|>\n\nb  <|endoftext|>  c", "x<|endoftext|>y", "<|endoftext|", "<|endof<|endoftext|>text|>", "none", ""]
    ids = [plain.encode(t, add_special_tokens=False).ids for t in rows]
    assert sum(x.count(P.SPECIAL_ID) for x in ids) == 8
    words = P.Words()
    assert [np.frombuffer(words.whole(t), "<u2").tolist() for t in rows] == ids
    got = {r.doc_id: r for r in P.pack(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert all(got[i].doc_tokens == len(x) + 1 and got[i].ids_crc32 == zlib.crc32(np.array([*x, 0], "<u4").tobytes()) for i, x in enumerate(ids))


@pytest.mark.parametrize("length,ranges", [(64, 3000), (1024, 10**6)])
def test_pieces_give_back_every_document(docs, rows, reference, length, ranges):
    got = P.pack(docs.select("doc_id", "text", "source"), length=length, range_tokens=ranges).collect()
    streams = sorted((len(x), zlib.crc32(x.tobytes())) for x in (np.array(reference.encode(t or "", add_special_tokens=False).ids + [0], "<u4") for _, t in rows))
    by_seq, whole = {}, []
    for r in got:
        by_seq.setdefault(r.sequence_id, []).append(r)
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at and p.source == "s"
            at += p.length
        assert at <= length
    assert sorted(by_seq) == list(range(len(by_seq)))
    total = sum(r.length for r in got)
    assert total == sum(n for n, _ in streams)
    assert sum(1 for p in by_seq.values() if sum(x.length for x in p) < length) <= -(-total // ranges) + 1
    unique = [i for i in {i for i, _ in rows} if i is not None and sum(j == i for j, _ in rows) == 1]
    ids = {i: np.array(reference.encode(t or "", add_special_tokens=False).ids + [0], "<u4") for i, t in rows if i in unique}
    for r in got:
        if r.doc_id in ids:
            assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start:r.start + r.length].tobytes())
            whole.append((r.doc_id, r.start, r.length))
    for i in unique:
        at = 0
        for _, start, n in sorted(x for x in whole if x[0] == i):
            assert start == at
            at += n
        assert at == len(ids[i])


def test_hilbert_curve_visits_every_cell_in_steps_of_one():
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        key = P.hilbert(grid, bits)
        assert sorted(key) == list(range(len(grid)))
        assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(1) == 1).all()


def test_empty_and_clash(no_docs, docs):
    assert P.pack(no_docs.select("doc_id", "text")).collect() == []
    with pytest.raises(ValueError):
        P.pack(docs.withColumnRenamed("n_chars", "Offset"))


def test_a_worker_keeps_what_it_learned():
    own = P._words()
    before = len(own.young) + len(own.old)
    assert own.whole("a word seenbyonetask") == P.Words().whole("a word seenbyonetask")
    assert P._words() is own and len(own.young) + len(own.old) > before


def test_different_parts_of_a_block_are_encoded_once(monkeypatch):
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [None, "", "two  words <|endoftext|> \n x", " lead", "a <|endoftext|>  b", "<|endof", "text|>　 c\x1c \x1c", "日本 語 é"] + ["the same words again and again"] * 500
    words, encoded = P.Words(), []
    inner = words.encode
    monkeypatch.setattr(words, "encode", lambda t: encoded.append(t) or inner(t))
    for size, most in ((P.BLOCK_BYTES, 200), (40, 10**9)):
        encoded.clear()
        monkeypatch.setattr(P, "BLOCK_BYTES", size)
        got = []
        for _, raw, at in P.blocks(pa.RecordBatch.from_arrays([pa.array(rows)], ["text"]), 0):
            ids, end = words.block(raw, at)
            got += [ids[a:b].tolist() for a, b in zip(end, end[1:])]
        assert got == [plain.encode(t or "", add_special_tokens=False).ids for t in rows]
        assert sum(map(len, encoded)) < most
