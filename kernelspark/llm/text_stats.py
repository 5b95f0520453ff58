"""Counts of a text that quality rules and labellers use, in one pass over all documents."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import texts

WINDOW = 8
_SYMBOLS = b"#*$%&|<>"
#: A word of letters (any byte outside ASCII counts as one), perhaps with a closing mark.
_PLAIN = re.compile(rb"(?<![^ \t-\r])[A-Za-z\x80-\xff]+[.,;:!?]?(?![^ \t-\r])")
_UPPER, _DIGITS, _ENDS = (bytes(range(65, 91)), bytes(range(48, 58)), b".!?")
NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "n_upper", "n_digits", "n_ends", "longest_word", "n_plain_words"]


def repeats(words: list[bytes], window: int = WINDOW) -> int:
    """Words in windows of ``window`` words that the text has twice or more, the first included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    own: dict[bytes, int] = {}
    ids = np.fromiter((own.setdefault(w, len(own)) for w in words), np.int64, len(words))
    # Windows are ranked by doubling (pairs, fours, ...), so that equal ranks are equal windows.
    rank, done = ids, 1
    while done < window:
        step = min(done, window - done)
        key = rank[:len(rank) - step] * (int(rank.max()) + 1) + rank[step:]
        _, rank = np.unique(key, return_inverse=True)
        done += step
    many = np.bincount(rank)[rank] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(many)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def stats(raw: bytes) -> list[int]:
    words = raw.split()
    joined = b"".join(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    without = lambda chars: len(raw) - len(raw.translate(None, chars))
    distinct = len(set(words))
    return [len(words), len(joined.decode("utf-8", "replace")), without(_SYMBOLS), len(lines) - len(set(lines)),
            repeats(words) if distinct < len(words) else 0, len(lines), distinct,
            without(_UPPER), without(_DIGITS), without(_ENDS), max(map(len, words), default=0), len(_PLAIN.findall(raw))]


def with_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without the text, with the columns NAMES (long); null is an empty text."""
    if clash := set(NAMES) & {c.lower() for c in docs.columns if c != text}:
        raise ValueError(f"columns exist already: {sorted(clash)}")
    keep = [c for c in docs.columns if c != text]
    at, place = [docs.columns.index(c) for c in keep], docs.columns.index(text)

    def run(batches):
        for got in batches:
            found = np.array([stats(raw) for raw in texts(got.column(place))], np.int64).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([got.column(i) for i in at] + [pa.array(found[:, i]) for i in range(len(NAMES))], [*keep, *NAMES])

    return docs.mapInArrow(run, T.StructType([docs.schema[c] for c in keep] + [T.StructField(c, T.LongType()) for c in NAMES]))
