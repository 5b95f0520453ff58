"""Benchmark decontamination: Aho-Corasick over normalised benchmark windows.

Text is normalised to lower-case words. Every window of ``window`` consecutive item words
(a shorter item is one window) goes into one automaton, in which a word is a code of one to
three symbols, however long it is. (One symbol a word would give the root as many branches
as there are words, and the automaton looks for a branch one by one.) Each document is scanned once; a match ends
at a word and covers the words before it, and the number of a word gives its byte offsets
in the original text.

The automaton is built in each Python worker from broadcast item texts, and its size is
bounded by nodes, not by the benchmark: items are cut into pieces that overlap by a window
less one word, and pieces are packed into blocks of at most ``nodes`` nodes. With one block
(the usual case) a worker builds it once and streams. With more it gathers ``chunk_bytes`` of
documents, builds one block's automaton after the other over them, and holds one at a time.
A broadcast holds at most ``block_bytes`` of item text; what is beyond goes in further
passes, each over the written result of the one before. Documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import chain, groupby, repeat
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint_table, fresh, read, texts

#: Bytes to normalised bytes: A-Z lower-cased, other ASCII than 0-9 and a-z to space.
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
OUTPUT = "n_words long, n_hit long, items array<string>, spans array<struct<start: long, stop: long>>"
#: Symbols of a place of a code, and places at most: 2^18 words.
BASE, PLACES = 64, 3
#: Nodes of an automaton, about 50 bytes each; the most there may be, since a piece counts as 16 nodes a word at least.
NODES = 16 * BASE ** PLACES
#: Symbol of words that no item has.
_OTHER = "\0"
#: Bytes of document text that a worker gathers when there are several automata: a scan of them outweighs a build.
CHUNK_BYTES = 256 << 20
#: The words of an item as Java's regular expressions find them (case is lowered later).
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Pieces are at most this part of a block, hash bins this part on average, so that blocks fill well.
_PIECES, _BINS = 16, 64
_KINDS = {"n_words": pa.int64(), "n_hit": pa.int64(), "items": pa.list_(pa.string()), "spans": pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))}


def words(raw: bytes) -> list[bytes]:
    return raw.translate(_NORMAL).split()


def windows(found: Sequence, size: int) -> list[Sequence]:
    return [found[i:i + size] for i in range(max(len(found) - size, 0) + 1)] if found else []


def code(n: int, places: int) -> str:
    """Symbols of the n-th word; each place has its own, so that a match starts and ends at words."""
    return "".join(chr(1 + BASE * p + n // BASE ** p % BASE) for p in range(places))


class Matcher(NamedTuple):
    trie: ahocorasick.Automaton
    codes: dict[bytes, str]
    places: int
    groups: list[tuple[int, tuple[str, ...]]]


def automaton(items: list[tuple[str | None, bytes]], size: int) -> Matcher | None:
    """Automaton over the codes of words; a match gives (number of words, item ids). None if no item has a word."""
    found = [words(raw) for _, raw in items]
    known = dict.fromkeys(chain.from_iterable(found))
    if not known:
        return None
    places = next(p for p in range(1, PLACES + 1) if len(known) <= BASE ** p)
    codes = {w: code(n, places) for n, w in enumerate(known)}
    trie = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    groups: dict[tuple[int, tuple[str, ...]], int] = {}
    named: list[tuple[int, tuple[str, ...]]] = []
    for (item, _), has in zip(items, found, strict=True):
        own = () if item is None else (item,)
        for w in map("".join, windows([codes[x] for x in has], size)):
            before = trie.get(w, -1)
            key = (len(w) // places, own if before < 0 else tuple(sorted({*named[before][1], *own})))
            at = groups.setdefault(key, len(named))
            if at == len(named):
                named.append(key)
            if at != before:
                trie.add_word(w, at)
    trie.make_automaton()
    return Matcher(trie, codes, places, named)


def hits(raw: bytes, made: Matcher | None, covered: np.ndarray | None = None) -> tuple[int, np.ndarray | None, set[str]]:
    """Number of words, which words are hit (None: none) and the items that occur."""
    found = words(raw)
    edge, owners = None, set()
    if made is not None and found:
        for end, at in made.trie.iter("".join(map(made.codes.get, found, repeat(_OTHER * made.places)))):
            if edge is None:
                edge = np.zeros(len(found) + 1, np.int64)
            n, ids = made.groups[at]
            last = (end + 1) // made.places
            edge[last - n] += 1
            edge[last] -= 1
            owners.update(ids)
    if edge is not None:
        own = np.cumsum(edge[:-1]) > 0
        covered = own if covered is None else covered | own
    return len(found), covered, owners


def spans(raw: bytes, covered: np.ndarray) -> list[dict]:
    """Byte offsets in the original text of the runs of hit words."""
    on = np.frombuffer(raw.translate(_NORMAL), np.uint8) != 32
    step = np.flatnonzero(np.diff(np.concatenate(([0], on.view(np.int8), [0]))))
    start, stop = step[::2], step[1::2]
    runs = np.flatnonzero(np.diff(np.concatenate(([0], covered.view(np.int8), [0]))))
    return [{"start": int(start[a]), "stop": int(stop[b - 1])} for a, b in zip(runs[::2], runs[1::2], strict=True)]


def pieces(items: DataFrame, item_id: str, item_text: str, window: int, limit: int) -> DataFrame:
    """(item, raw, nodes): items with words, cut so that a piece needs at most ``limit`` nodes, or what one window needs.

    A piece starts ``step`` words after the one before and holds ``step`` windows, so each window of an item is
    in one piece. Equal pieces of an item are kept once.
    """
    step = max(1, limit // (PLACES * window) - window)       # a piece of step windows has step + window - 1 words
    found = items.where(F.col(item_text).isNotNull()).select(F.col(item_id).cast("string").alias("item"), F.regexp_extract_all(F.col(item_text), F.lit(_WORD), F.lit(0)).alias("w")).where(F.size("w") > 0)
    starts = F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)), F.lit(step)))
    cut = found.select("item", "w", starts.alias("start")).select("item", F.slice("w", F.col("start") + 1, F.lit(step + window - 1)).alias("w"))
    nodes = PLACES * F.greatest(F.size("w") - window + 1, F.lit(1)) * F.least(F.size("w"), F.lit(window))
    needs = F.greatest(nodes, NODES // BASE ** PLACES * F.size("w"))
    return cut.select("item", F.encode(F.concat_ws(" ", "w"), "utf-8").alias("raw"), needs.cast("long").alias("nodes")).distinct()


def blocks_of(cut: DataFrame, nodes: int, block_bytes: int) -> Iterator[list[list[tuple[str | None, bytes]]]]:
    """Pieces for one broadcast after the other, each a list of blocks for one automaton.

    Pieces fall into hash bins, of which only the sizes are gathered; neighbouring bins become
    blocks of at most ``nodes`` nodes and neighbouring blocks broadcasts of at most ``block_bytes``
    (a bin that is larger by itself is a block by itself).
    """
    cost = F.octet_length("raw") + 64
    all_nodes, all_bytes = cut.agg(F.sum("nodes"), F.sum(cost)).first()
    if not all_nodes:
        return
    bins = 1 if all_nodes <= nodes and all_bytes <= block_bytes else _BINS * (1 + max(all_nodes // nodes, all_bytes // block_bytes))
    dealt = cut.withColumn("bin", F.pmod(F.xxhash64("item", "raw"), F.lit(bins)))
    sent = at = held = size = 0
    plan = []                                   # (broadcast, block, bin)
    for b, n, c in dealt.groupBy("bin").agg(F.sum("nodes"), F.sum(cost)).orderBy("bin").collect():
        if plan and size + c > block_bytes:
            sent, at, held, size = sent + 1, at + 1, 0, 0
        elif plan and held + n > nodes:
            at, held = at + 1, 0
        plan.append((sent, at, b))
        held, size = held + n, size + c
    for _, part in groupby(plan, key=lambda p: p[0]):
        block = {b: k for _, k, b in part}
        got: dict[int, list] = {}
        for r in dealt.where(F.col("bin").between(min(block), max(block))).select("item", "raw", "bin").toLocalIterator():
            got.setdefault(block[r.bin], []).append((r.item, bytes(r.raw)))
        yield list(got.values())


def scan(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
         window: int = 10, block_bytes: int = 64 << 20, nodes: int = NODES, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """docs with n_words, n_hit, items (ids as sorted strings) and spans (byte offsets).

    A null text has no words. A null item text has no window; the hits of an item whose
    id is null count, but it can't be named in ``items``. Repeated items and documents
    are taken as they come; empty tables give empty or clean results. Columns of docs
    that clash with the four names raise ValueError. ``nodes`` bounds the automaton of a
    worker, ``chunk_bytes`` the documents it holds when there are several automata and
    ``block_bytes`` what is broadcast; rows don't depend on any of them.
    """
    if clash := {"n_words", "n_hit", "items", "spans"} & {c.lower() for c in docs.columns}:
        raise ValueError(f"columns exist already: {sorted(clash)}")
    if not 1 <= nodes <= NODES:
        raise ValueError(f"nodes must be from 1 to {NODES}")
    spark = docs.sparkSession
    cut = pieces(items, item_id, item_text, window, nodes // _PIECES)
    carried = fresh(docs.columns, "__covered")
    out, first = docs, True
    for blocks in blocks_of(cut, nodes, block_bytes):
        if not first:
            out = checkpoint_table(out, spark, "decontamination")
        out, first = _through(out, spark.sparkContext.broadcast(blocks), text, window, carried, first, chunk_bytes), False
    if first:
        out = _through(out, spark.sparkContext.broadcast([[]]), text, window, carried, first, chunk_bytes)
    return out.drop(carried)


def chunks(batches, at: int, size: int):
    """Record batches gathered to ``size`` bytes of text."""
    held, total = [], 0
    for got in batches:
        held.append(got)
        total += got.column(at).nbytes
        if total >= size:
            yield held
            held, total = [], 0
    if held:
        yield held


def _through(docs: DataFrame, sent, text: str, window: int, carried: str, first: bool, chunk_bytes: int) -> DataFrame:
    base = [c for c in docs.columns if first or c not in (carried, "n_words", "n_hit", "items", "spans")]
    types = T.StructType([docs.schema[c] for c in base])
    extra = T._parse_datatype_string(f"{OUTPUT}, `{carried}` binary")
    at = docs.columns.index(text)
    docs_columns = list(docs.columns)

    def run(batches):
        blocks = sent.value
        only = automaton(blocks[0], window) if len(blocks) == 1 else None
        for held in chunks(batches, at, 1 if len(blocks) == 1 else chunk_bytes):
            state = []                          # per batch: number of words, hit words and items of each row
            for got in held:
                old = repeat(None) if first else got.column(docs_columns.index(carried)).to_pylist()
                named = repeat(()) if first else got.column(docs_columns.index("items")).to_pylist()
                state.append([[0, np.frombuffer(o, np.bool_) if o else None, set(n)] for o, n, _ in zip(old, named, range(got.num_rows))])
            for block in blocks:
                made = only if len(blocks) == 1 else automaton(block, window)
                for got, rows in zip(held, state, strict=True):
                    for row, raw in zip(rows, texts(got.column(at)), strict=True):
                        n, covered, owners = hits(raw, made, row[1])
                        row[0], row[1] = n, covered
                        row[2] |= owners
                made = None                     # freed before the next one is built
            for got, rows in zip(held, state, strict=True):
                cols = {
                    "n_words": [n for n, *_ in rows],
                    "n_hit": [0 if c is None else int(c.sum()) for _, c, _ in rows],
                    "items": [sorted(o) for *_, o in rows],
                    "spans": [[] if c is None else spans(raw, c) for (_, c, _), raw in zip(rows, texts(got.column(at)), strict=True)],
                    carried: [None if c is None else c.tobytes() for _, c, _ in rows],
                }
                yield pa.RecordBatch.from_arrays([got.column(docs_columns.index(c)) for c in base] + [pa.array(cols[k], _KINDS.get(k, pa.binary())) for k in cols], [*base, *cols])

    return docs.mapInArrow(run, T.StructType(types.fields + extra.fields))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items, windows of 10 words."""
    found = scan(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP2_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT DISTINCT item, least(10, len(w)) AS k, array_to_string(w[p:p + least(10, len(w)) - 1], ' ') AS s
       FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT r, p, k, array_to_string(w[p:p + k - 1], ' ') AS s
       FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, ks WHERE len(w) >= k)),
m AS (SELECT r, p, dw.k AS k, item FROM dw JOIN bw ON dw.s = bw.s AND dw.k = bw.k),
h AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + k)) AS q FROM m) GROUP BY r),
i AS (SELECT r, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS named FROM m GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(named, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN i USING (r)
"""
