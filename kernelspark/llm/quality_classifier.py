"""Quality classifier without hand labels: heuristic labellers, a label model, a hashed linear scorer.

1. Overlapping heuristics vote on every document or abstain; expectation-maximisation over
   all documents' votes estimates their accuracies and gives each document a posterior label.
2. A logistic scorer over hashed word shapes learns the posteriors from a bounded sample
   (TRAIN_ROWS rows of smallest hash). It sees what the labellers do not count.
3. Every document is scored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint_table, fresh, read, texts
from .label_model import vote, weigh
from .text_stats import with_stats

#: Bound of the training sample, and size of the hashed feature space.
TRAIN_ROWS, DIMS = 4_000, 2_048
ROUNDS, RATE, DECAY = 400, 4.0, 1e-4
REMEMBERED = 200_000
#: ASCII to its shape: capitals A, small letters a, digits 0, others themselves; other bytes u.
_SHAPE = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 else 48 if 48 <= b <= 57 else 117 if b >= 128 else b for b in range(256))
_RUN = re.compile(rb"(.)\1+", re.S)


def labellers() -> dict[str, Column]:
    words, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "short": vote(F.col("n_words") >= 40, F.col("n_words") < 10),
        "symbols": vote(F.col("n_symbols") * 20 <= words, F.col("n_symbols") * 4 > words),
        "repeats": vote(F.col("n_repeat_words") * 10 <= words, F.col("n_repeat_words") * 3 > words),
        "dup_lines": vote(F.col("n_dup_lines") * 10 <= lines, F.col("n_dup_lines") * 3 > lines),
        "capitals": vote(F.col("n_upper") * 6 <= chars, F.col("n_upper") * 2 > chars),
        "digits": vote(F.col("n_digits") * 25 <= chars, F.col("n_digits") * 5 > chars),
        "ends": vote(F.col("n_ends") * 50 >= words, F.col("n_ends") * 200 < words),
        "plain": vote(F.col("n_plain_words") * 10 >= words * 7, F.col("n_plain_words") * 2 < words),
        "long_word": vote(F.col("longest_word") <= 40, F.col("longest_word") > 100),
    }


class Hasher:
    """Hashed shape features of a text, their counts damped and scaled to length one."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def feature(self, word: bytes) -> int:
        return zlib.crc32(_RUN.sub(rb"\1\1", word.translate(_SHAPE))) % DIMS

    def __call__(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        known, words = self.known, raw.split()
        if len(known) > REMEMBERED:
            known.clear()
        ids = []
        for w in words:
            f = known.get(w)
            if f is None:
                f = self.feature(w)
                if len(w) < 64:
                    known[w] = f
            ids.append(f)
        at, many = np.unique(np.array(ids, np.int64), return_counts=True)
        value = np.log1p(many)
        # How much of the text is said again, as a feature of its own.
        again = np.array([zlib.crc32(b"again %d" % int(10 * (1 - len(set(words)) / max(1, len(words))))) % DIMS])
        at, value = np.concatenate((at, again)), np.concatenate((value, [max(1.0, float(np.linalg.norm(value)))]))
        return at, value / np.linalg.norm(value)


def train(rows: list[tuple[list[int], list[float], float]]) -> np.ndarray:
    """Weights (the last is the bias) of a logistic scorer fitted to posterior labels by gradient descent."""
    x = np.zeros((len(rows), DIMS + 1))
    for i, (at, value, _) in enumerate(rows):
        np.add.at(x[i], at, value)
    x[:, DIMS] = 1
    y, w = np.array([r[2] for r in rows], float), np.zeros(DIMS + 1)
    for _ in range(ROUNDS if len(rows) else 0):
        w -= RATE * (x.T @ (1 / (1 + np.exp(-x @ w)) - y) / len(rows) + DECAY * w)
    return w


def _features(docs: DataFrame, text: str, at: str, value: str) -> DataFrame:
    keep = [c for c in docs.columns if c != text]
    place, kept = docs.columns.index(text), [docs.columns.index(c) for c in keep]

    def run(batches):
        made = Hasher()
        for got in batches:
            found = [made(raw) for raw in texts(got.column(place))]
            yield pa.RecordBatch.from_arrays([got.column(i) for i in kept] + [pa.array([f[0] for f in found], pa.list_(pa.int64())), pa.array([f[1] for f in found], pa.list_(pa.float64()))], [*keep, at, value])

    extra = [T.StructField(at, T.ArrayType(T.LongType())), T.StructField(value, T.ArrayType(T.DoubleType()))]
    return docs.mapInArrow(run, T.StructType([docs.schema[c] for c in keep] + extra))


def learn(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Weights learned from all documents' votes and a bounded sample's posterior labels."""
    rank = fresh([text], "rank")
    ranked = docs.select(F.xxhash64(text).alias(rank), text)
    stored = checkpoint_table(with_stats(ranked, text), docs.sparkSession, "classifier-counts")
    labelled = weigh(stored, labellers(), "label").select(rank, "label")
    chosen = labelled.groupBy(rank).agg(F.first("label").alias("label")).orderBy(rank).limit(TRAIN_ROWS)
    chosen = checkpoint_table(chosen, docs.sparkSession, "classifier-sample")  # at most TRAIN_ROWS rows
    hashed = _features(ranked.join(F.broadcast(chosen), rank), text, "at", "value").dropDuplicates([rank]).orderBy(rank)
    return train([(r["at"], r["value"], r["label"]) for r in hashed.collect()])


def score(docs: DataFrame, weights: np.ndarray, text: str = "text", out: str = "score") -> DataFrame:
    """docs with the scorer's probability of good quality; the text column stays."""
    if out.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"column exists already: {out}")
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    place, cols = docs.columns.index(text), list(docs.columns)

    def run(batches):
        made, w = Hasher(), sent.value
        for got in batches:
            odds = np.array([w[f[0]] @ f[1] + w[DIMS] for f in map(made, texts(got.column(place)))], float)
            yield pa.RecordBatch.from_arrays([*got.columns, pa.array(1 / (1 + np.exp(-odds)))], [*cols, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document and whether it is kept (0.5 or more).

    A null or empty text has no word and the scorer's score of an empty text. Equal texts
    get equal scores. An empty table gives an empty result.
    """
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = score(docs, learn(docs))
    return found.select("doc_id", F.round("score", 6).alias("score"), (F.col("score") >= 0.5).alias("kept"))
