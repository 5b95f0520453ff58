"""Language ID by cross-parsing: the language whose text explains a document in the fewest phrases.

For each language a suffix automaton of labelled text recognises all its substrings. A
document is parsed greedily into longest matches against each automaton; fewer phrases per
letter mean a smaller cross entropy, and the smallest wins.

Training text is a bounded sample (TRAIN_ROWS slices a language, SLICE bytes each), chosen by
a hash of the slice, so that copies count once, combined within each partition before the
shuffle. Automata are tables
of next states, rebuilt in each worker from the broadcast sample. Documents are cut into
stretches of STRETCH bytes that are all parsed side by side; every byte is parsed.
"""

from __future__ import annotations

import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read, texts

#: Bound of the training sample: distinct slices a language, and bytes of each (taken from a row's middle).
TRAIN_ROWS, SLICE = 48, 512
STRETCH = 256
#: Bytes of a batch that are parsed at once.
AT_ONCE = 4 << 20
#: ASCII other than letters to space; the text is in lower case already.
_PLAIN = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
UNKNOWN = "und"


def normal(text: str) -> bytes:
    """Lower case, ASCII other than letters to single spaces; empty if there is no letter."""
    if not any(map(str.isalpha, text)):
        return b""
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_PLAIN).split())


def suffix_automaton(samples: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(class of each byte, next state by state * classes + class); state 0 is the start, -1 is none.

    The samples are added one after the other, each from the start state, so that no match
    crosses from one into the next.
    """
    used = sorted(set(b"".join(samples)))
    kind = np.zeros(256, np.int32)  # class 0: a byte that the samples don't have
    kind[used] = np.arange(1, len(used) + 1)
    follow: list[dict[int, int]] = [{}]
    link, longest = [-1], [0]
    for sample in samples:
        last = 0
        for c in kind[np.frombuffer(sample, np.uint8)].tolist():
            known = follow[last].get(c)
            if known is not None and longest[known] == longest[last] + 1:
                last = known
                continue
            if known is None:
                made = len(follow)
                follow.append({})
                longest.append(longest[last] + 1)
                link.append(0)
                p = last
                while p >= 0 and c not in follow[p]:
                    follow[p][c] = made
                    p = link[p]
                last = made
                if p < 0:
                    continue
                target = follow[p][c]
            else:
                p, target, made = last, known, None
            if longest[target] != longest[p] + 1:
                copy = len(follow)
                follow.append(dict(follow[target]))
                longest.append(longest[p] + 1)
                link.append(link[target])
                link[target] = copy
                while p >= 0 and follow[p].get(c) == target:
                    follow[p][c] = copy
                    p = link[p]
                target = copy
            if made is None:
                last = target
            else:
                link[made] = target
    wide = len(used) + 1
    table = np.full(len(follow) * wide, -1, np.int32)
    for s, moves in enumerate(follow):
        for c, t in moves.items():
            table[s * wide + c] = t
    return kind, table


def phrases(stretches: np.ndarray, lengths: np.ndarray, kind: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Number of greedy longest matches of each row, the rows sorted from long to short.

    ``stretches`` is (positions, rows). A byte that the samples lack is a phrase by itself.
    """
    wide = int(kind.max()) + 1
    first = np.maximum(table[:wide], 0)
    state, count = np.zeros(len(lengths), np.int32), np.zeros(len(lengths), np.int32)
    live = np.searchsorted(-lengths, -np.arange(len(stretches)), side="left")  # rows longer than the position
    for at, n in enumerate(live.tolist()):
        c, now = kind[stretches[at, :n]], state[:n]
        went = table[now * wide + c]
        count[:n] += (went < 0) | (now == 0)  # a phrase starts here
        state[:n] = np.where(went < 0, first[c], went)
    return count


def parse(raws: list[bytes], automata: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """(documents, languages): phrases of each whole text."""
    owner = np.repeat(np.arange(len(raws)), [-(-len(r) // STRETCH) for r in raws])
    out = np.zeros((len(raws), len(automata)), np.int64)
    if not len(owner):
        return out
    pieces = [r[i:i + STRETCH] for r in raws for i in range(0, len(r), STRETCH)]
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    order = np.argsort(-lengths, kind="stable")
    grid = np.frombuffer(b"".join(p.ljust(STRETCH, b" ") for p in pieces), np.uint8).reshape(-1, STRETCH)[order].T.copy()
    for k, (kind, table) in enumerate(automata):
        np.add.at(out[:, k], owner[order], phrases(grid, lengths[order], kind, table))
    return out


def sample(labelled: DataFrame, text: str, lang: str, rows: int = TRAIN_ROWS, size: int = SLICE) -> list[tuple[str, list[bytes]]]:
    """At most ``rows`` distinct slices of ``size`` bytes for each language: those of smallest hash.

    Each partition keeps its smallest ranks of each language before the shuffle, so what is
    gathered is bounded by partitions * languages * rows.
    """
    def smallest(groups):
        return {k: set(heapq.nsmallest(rows, v)) for k, v in groups.items()}

    def run(batches):
        kept: dict[str, set] = {}
        for got in batches:
            for name, raw in zip(got.column(0).to_pylist(), texts(got.column(1)), strict=True):
                plain = normal(raw.decode("utf-8", "replace"))
                if plain:
                    from_ = max(0, (len(plain) - size) // 2)
                    part = plain[from_:from_ + size]
                    rank = int.from_bytes(hashlib.blake2b(part, digest_size=8).digest(), "little", signed=True)
                    kept.setdefault(name, set()).add((rank, part))
            kept = smallest(kept)
        flat = [(k, *x) for k, v in kept.items() for x in v]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in flat], t) for i, t in enumerate((pa.string(), pa.int64(), pa.binary()))], ["lang", "rank", "part"])

    local = labelled.select(F.col(lang).cast("string"), text).mapInArrow(run, "lang string, rank long, part binary").distinct()
    top = local.groupBy("lang").applyInArrow(lambda t: t.sort_by([("rank", "ascending"), ("part", "ascending")]).slice(0, rows), "lang string, rank long, part binary")
    found: dict[str, list[bytes]] = {}
    for r in top.orderBy("lang", "rank", "part").collect():  # at most rows * languages
        found.setdefault(r.lang, []).append(bytes(r.part))
    return sorted(found.items())


def identify(docs: DataFrame, models: list[tuple[str, list[bytes]]], text: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the predicted language and a score from 0 to 1.

    The score is how many phrases the winner saves against the second, as a share; 1 if
    only one language was learned, 0 for ``und``. Ties go to the first name. A null text,
    a text without a letter, and every text when nothing was learned, is ``und``.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(models)
    place, cols = docs.columns.index(text), list(docs.columns)
    if clash := {pred.lower(), score.lower()} & {c.lower() for c in cols}:
        raise ValueError(f"columns exist already: {sorted(clash)}")

    def run(batches):
        names = [k for k, _ in sent.value]
        automata = [suffix_automaton(v) for _, v in sent.value]

        def judge(raws):
            n = parse(raws, automata)
            for i, raw in enumerate(raws):
                if not raw or not names:
                    yield UNKNOWN, 0.0
                    continue
                best = int(np.argmin(n[i]))
                rest = np.delete(n[i], best)
                yield names[best], float(1 - n[i, best] / rest.min()) if len(rest) else 1.0

        for got in batches:
            found, held, size = [], [], 0
            for raw in texts(got.column(place)):
                held.append(normal(raw.decode("utf-8", "replace")))
                size += len(held[-1])
                if size > AT_ONCE:
                    found += judge(held)
                    held, size = [], 0
            found += judge(held)
            yield pa.RecordBatch.from_arrays([*got.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], [*cols, pred, score])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())]))


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id", held_out: bool = True) -> list[tuple[str, list[bytes]]]:
    """Training slices from rows with a language, without the held-out fold (crc32 of the id mod 4 is 2)."""
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    if held_out:
        known = known.where(~held(id_col))
    return sample(known, text, lang)


def held(id_col: str = "doc_id"):
    """Whether a row is in the held-out fold; a null id is not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from text and lang of the rows that aren't held out."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text"), learn(docs))
    return found.select("doc_id", held().alias("held_out"), "lang_pred", "score")
