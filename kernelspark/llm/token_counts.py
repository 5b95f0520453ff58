"""Token counts by linear longest match: a vocabulary trie with failure links and popped counts.

Greedy longest-match pieces of a word are counted in one walk over its characters. Each
trie node knows where matching goes on when the next character does not fit (its failure
link) and how many tokens are complete by then (its popped count), so no piece is built
and no character is read twice.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import read, texts

#: The mark that a vocabulary piece at the start of a word begins with.
START = "▁"
#: Words whose counts a worker remembers; emptied when full (counts don't depend on it).
REMEMBERED = 300_000
#: Largest vocabulary that is broadcast.
MAX_PIECES = 1_000_000


class Matcher:
    """Longest-match token counts over ``pieces``.

    A character that is no piece by itself costs its UTF-8 bytes (byte fallback), also
    within a word.
    """

    def __init__(self, pieces):
        self.child: list[dict[str, int]] = [{}]
        cost: list[int | None] = [None]
        single = {c for p in pieces for c in p}
        priced = dict.fromkeys((p for p in pieces if p), 1)
        for c in single:
            priced.setdefault(c, len(c.encode("utf-8", "surrogatepass")))
        parent = [(0, "")]
        for piece, price in priced.items():
            node = 0
            for c in piece:
                to = self.child[node].get(c)
                if to is None:
                    to = self.child[node][c] = len(self.child)
                    self.child.append({})
                    cost.append(None)
                    parent.append((node, c))
                node = to
            cost[node] = price
        self.fail, self.popped = [-1] * len(cost), [0] * len(cost)
        level = [0]
        while level:  # parents before children
            after = []
            for node in level:
                if node:
                    self._link(node, *parent[node], cost[node])
                after.extend(self.child[node].values())
            level = after
        self.known: dict[bytes, int] = {}

    def _link(self, node: int, parent: int, c: str, price: int | None) -> None:
        if price is not None:
            self.fail[node], self.popped[node] = 0, price
            return
        done, at = self.popped[parent], self.fail[parent]
        while c not in self.child[at]:  # every character of a piece is at the root
            done += self.popped[at]
            at = self.fail[at]
        self.fail[node], self.popped[node] = self.child[at][c], done

    def count(self, word: str) -> int:
        child, fail, popped = self.child, self.fail, self.popped
        node = total = 0
        for c in word:
            to = child[node].get(c)
            while to is None and node:
                total += popped[node]
                node = fail[node]
                to = child[node].get(c)
            if to is None:
                total += len(c.encode("utf-8", "surrogatepass"))
            else:
                node = to
        while node:
            total += popped[node]
            node = fail[node]
        return total

    def text(self, raw: bytes) -> tuple[int, int, int]:
        """(words, tokens, tokens of the longest word) of a text; words are split at ASCII white space."""
        words, known, total, most = raw.split(), self.known, 0, 0
        if len(known) > REMEMBERED:
            known.clear()
        for w in words:
            n = known.get(w)
            if n is None:
                n = self.count(START + w.decode("utf-8", "replace"))
                if len(w) < 64:
                    known[w] = n
            total += n
            if n > most:
                most = n
        return len(words), total, most


def vocabulary(path: str) -> list[str]:
    """Ordinary pieces of a sentencepiece model (no control, unknown or byte pieces)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]


def count_tokens(docs: DataFrame, pieces: list[str], text: str = "text") -> DataFrame:
    """docs with n_words, n_tokens and max_word_tokens (long); the text column stays.

    A null or empty text has none of them. Repeated rows are counted one by one; an empty
    table gives an empty result. Columns of docs with these names raise ValueError, as
    does a vocabulary of more than MAX_PIECES pieces.
    """
    made = ["n_words", "n_tokens", "max_word_tokens"]
    if clash := set(made) & {c.lower() for c in docs.columns}:
        raise ValueError(f"columns exist already: {sorted(clash)}")
    if len(pieces) > MAX_PIECES:
        raise ValueError("the vocabulary is too large to broadcast")
    sent = docs.sparkSession.sparkContext.broadcast(pieces)
    place, cols = docs.columns.index(text), list(docs.columns)

    def run(batches):
        matcher = Matcher(sent.value)
        for got in batches:
            found = [matcher.text(raw) for raw in texts(got.column(place))]
            yield pa.RecordBatch.from_arrays([*got.columns, *(pa.array([x[i] for x in found], pa.int64()) for i in range(3))], [*cols, *made])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *(T.StructField(c, T.LongType()) for c in made)]))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word pieces of every document by the 32,000-piece public vocabulary."""
    import public_tokenizers

    pieces = vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    return count_tokens(read(spark, sf_dir, "documents").select("doc_id", "text"), pieces).select("doc_id", "n_words", "n_tokens", "max_word_tokens")
