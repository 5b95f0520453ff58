"""Packing along a space-filling curve: neighbouring documents share sequences.

Each document's token counts are hashed into a short vector, projected to a few dimensions
and put on a Hilbert curve. Documents are range-sorted by their key (then id), and the
tokens of each range are cut into sequences of ``length``: only the last sequence of a
range is shorter, under 0.1 % of padding at the default range size.

Token ids are written once (zstd-compressed, two bytes an id) and read again by the range
shuffle, so no text is encoded twice. Ranges come from the exact token counts of 2**CELL
stretches of the curve, not from a sample, so equal input gives equal ranges; a stretch
with more tokens than a range (copies share a key) is split by a hash of the row.
"""

from __future__ import annotations

import base64
import functools
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint_table, fresh, read, texts

#: Hashed vector, dimensions of the projection, bits of each dimension on the curve.
BUCKETS, DIMS, BITS, SEED = 256, 4, 8, 42
RANGE_TOKENS = 2_000_000
#: Bits of the curve's stretches whose tokens are counted (65,536 counts at most).
CELL = 16
#: Parts at the start of a text whose ids a worker remembers, in two generations: when the younger
#: one is full it becomes the older one (ids don't depend on it); bytes of the longest of them.
REMEMBERED, LONGEST = 300_000, 64
#: Bytes of text (one text at least) and rows whose parts are encoded together.
BLOCK_BYTES, BLOCK_ROWS = 8 << 20, 4096
#: Bytes that begin a character which is certainly no white space.
_SAFE = np.zeros(256, bool)
_SAFE[0x21:0x7F] = _SAFE[0xC3:0xE0] = _SAFE[0xE4:0xF5] = True
#: The tokenizer's added token, which it takes out of a text before anything else, and its id.
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50_256
_SPECIAL = SPECIAL.encode()


@functools.cache
def _encoding():
    """The byte-level BPE of ``byte_bpe_50k.json`` by its rank file: the same ids, without the added token (see SPECIAL)."""
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.cache
def _widths() -> np.ndarray:
    """Bytes of each id."""
    made = _encoding()
    return np.array([len(made.decode_single_token_bytes(i)) for i in range(made.n_vocab)])


class Words:
    """Ids of texts as little-endian uint16, a block of texts at a time.

    The tokenizer never joins across a space that a non-space follows (such a space always
    begins a token), so a text's ids are those of its parts, cut before such spaces, and
    parts repeat. The different parts of a block are encoded together and told apart by the
    bytes of their ids; the ids of the texts are gathered from those of the parts. Parts that
    begin a text are encoded alone and remembered.
    """

    def __init__(self):
        self.encode = _encoding().encode_to_numpy
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _alone(self, part: bytes) -> bytes:
        got = self.young.get(part)
        if got is None:
            got = self.old.get(part)
            if got is None:
                got = self.encode(part.decode()).astype("<u2").tobytes()
            if len(part) <= LONGEST:
                if len(self.young) >= REMEMBERED:
                    self.old, self.young = self.young, {}
                self.young[part] = got
        return got

    def _different(self, parts: pa.Array, special: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Different parts' ids in some order, where each part's begin and how many they are."""
        n = len(parts)
        at = np.frombuffer(parts.buffers()[1], np.int32)[:n + 1].astype(np.int64)
        data = np.frombuffer(parts.buffers()[2], np.uint8)
        width = np.diff(at)
        after = data[np.minimum(at[:-1] + 1, len(data) - 1)]
        joins = (width > 1) & (data[at[:-1]] == 32) & _SAFE[after]
        together = self.encode(data[np.repeat(joins, width)].tobytes().decode()).astype("<u2")
        last = np.searchsorted(np.cumsum(_widths()[together]), np.cumsum(width[joins])) + 1
        size, first = np.zeros(n, np.int64), np.zeros(n, np.int64)
        size[joins] = np.diff(last, prepend=0)
        token = np.array([SPECIAL_ID], "<u2").tobytes()
        alone = [token if special and p == _SPECIAL else self._alone(p) for p in parts.filter(pa.array(~joins)).to_pylist()]
        size[~joins] = np.fromiter(map(len, alone), np.int64, len(alone)) // 2
        for own, base in ((joins, 0), (~joins, len(together))):
            first[own] = base + np.cumsum(size[own]) - size[own]
        return np.concatenate([together, np.frombuffer(b"".join(alone), "<u2")]), first, size

    def block(self, raw: bytes, at: np.ndarray, special: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts raw[at[i]:at[i + 1]], one after the other, and where each text's begin and the last's end.

        ``special``: the tokenizer's added token is taken out first, else it is plain text.
        """
        data = np.frombuffer(raw, np.uint8)
        if not len(data):
            return np.zeros(0, "<u2"), np.zeros(len(at), np.int64)
        cut = np.zeros(len(data) + 1, bool)
        cut[:-2] = (data[:-1] == 32) & _SAFE[data[1:]]
        if special and _SPECIAL in raw:
            first = np.array([m.start() for m in re.finditer(re.escape(_SPECIAL), raw)], np.int64)
            last = first + len(_SPECIAL)
            inside = np.searchsorted(at, first, "right") == np.searchsorted(at, last, "left")
            first, last = first[inside], last[inside]
            cut[first[first > 0] - 1] = False  # a space before the token is followed by nothing
            cut[first] = cut[last] = True
        cut[at] = True
        place = np.flatnonzero(cut)  # from 0 to the end
        parts = pa.Array.from_buffers(pa.binary(), len(place) - 1, [None, pa.py_buffer(place.astype(np.int32)), pa.py_buffer(raw)]).dictionary_encode()
        of = parts.indices.to_numpy()
        ids, first, size = self._different(parts.dictionary, special)
        own = size[of]
        end = np.concatenate([[0], np.cumsum(own)])
        take = np.repeat((first[of] - end[:-1]).astype(np.int32), own)
        take += np.arange(len(take), dtype=np.int32)
        return ids[take], end[np.searchsorted(place, at)]

    def ids(self, text: str) -> bytes:
        raw = text.encode()
        return self.block(raw, np.array([0, len(raw)]), special=False)[0].tobytes()

    def whole(self, text: str) -> bytes:
        """The tokenizer's ids with its added token, which ``ids`` takes for plain text."""
        raw = text.encode()
        return self.block(raw, np.array([0, len(raw)]))[0].tobytes()


@functools.cache
def _words() -> Words:
    """The worker's own: what its earlier tasks learned serves the later ones."""
    return Words()


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of integer points (n, dims), each coordinate below 2**bits.

    The axes are turned into the curve's transposed index one bit plane at a time (the
    published transform of Skilling), for all points at once.
    """
    x = points.T.astype(np.int64).copy()
    dims = len(x)
    for plane in range(bits - 1, 0, -1):
        top, low = 1 << plane, (1 << plane) - 1
        for i in range(dims):
            set_ = (x[i] & top) != 0
            swap = np.where(set_, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(set_, low, swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for plane in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] & (1 << plane), (1 << plane) - 1, 0)
    x ^= turn
    key = np.zeros_like(x[0])
    for plane in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | (x[i] >> plane & 1)
    return key


def keys(vectors: np.ndarray) -> np.ndarray:
    """Hilbert keys of hashed count vectors: damped, scaled to length one, projected, spread over the grid."""
    v = np.log1p(vectors)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    y = v @ np.random.default_rng(SEED).standard_normal((BUCKETS, DIMS))
    grid = (1 << BITS) / (1 + np.exp(-1.702 * y))  # the normal distribution's shape, nearly
    return hilbert(np.clip(grid, 0, (1 << BITS) - 1).astype(np.int64), BITS)


def blocks(got: pa.RecordBatch, place: int):
    """(rows, their texts joined as valid UTF-8, where each begins and the last ends) of a batch, BLOCK_BYTES and BLOCK_ROWS at most."""
    column = got.column(place)
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    end, lo = np.cumsum(size), 0
    while lo < len(size):
        most = int(np.searchsorted(end, (end[lo - 1] if lo else 0) + BLOCK_BYTES, "right"))
        hi = min(max(lo + 1, most), lo + BLOCK_ROWS)
        own = texts(column.slice(lo, hi - lo))
        raw = b"".join(own)
        try:
            for t in own:
                if not t.isascii():
                    t.decode()
        except UnicodeDecodeError:
            own = [t.decode("utf-8", "replace").encode() for t in own]
            raw = b"".join(own)
        yield got.slice(lo, hi - lo), raw, np.concatenate([[0], np.cumsum(np.fromiter(map(len, own), np.int64, len(own)))])
        lo = hi


def tokens(docs: DataFrame, text: str, curve: str, count: str, ids: str, row: str) -> DataFrame:
    """docs without the text, with Hilbert key, number of ids (end id included), packed ids and a row number."""
    keep = [c for c in docs.columns if c != text]
    at, place = [docs.columns.index(c) for c in keep], docs.columns.index(text)

    def run(batches):
        words, squeeze, n = _words(), zstandard.ZstdCompressor(level=1), TaskContext.get().partitionId() << 33
        bucket = (np.arange(1 << 16, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(56)).astype(np.intp)
        for got in batches:
            for part, raw, starts in blocks(got, place):
                found, starts = words.block(raw, starts)
                vectors, packed = np.zeros((part.num_rows, BUCKETS)), []
                for i, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist())):
                    vectors[i] = np.bincount(bucket[found[a:b]], minlength=BUCKETS)
                    packed.append(squeeze.compress(found[a:b].tobytes() + b"\0\0"))
                counts = np.diff(starts) + 1
                yield pa.RecordBatch.from_arrays(
                    [part.column(i) for i in at] + [pa.array(keys(vectors)), pa.array(counts, pa.int64()), pa.array(packed, pa.binary()), pa.array(np.arange(n, n + part.num_rows))],
                    [*keep, curve, count, ids, row])
                n += part.num_rows

    longs = [T.StructField(c, T.LongType()) for c in (curve, count, row)]
    return docs.mapInArrow(run, T.StructType([docs.schema[c] for c in keep] + [longs[0], longs[1], T.StructField(ids, T.BinaryType()), longs[2]]))


def pack(docs: DataFrame, text: str = "text", id_col: str = "doc_id", length: int = 1024, range_tokens: int = RANGE_TOKENS) -> DataFrame:
    """One row per piece: docs' other columns, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null text is empty and has the end id alone; so every document has a piece. Rows
    with equal or null ids are packed apart. An empty table gives an empty result.
    Columns of docs with the names of the result raise ValueError.
    """
    made = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    if clash := set(made) & {c.lower() for c in docs.columns}:
        raise ValueError(f"columns exist already: {sorted(clash)}")
    spark, keep = docs.sparkSession, [c for c in docs.columns if c != text]
    curve, count, ids, row, part = (fresh([*docs.columns, *made], f"__{x}") for x in ("curve", "count", "ids", "row", "part"))
    stored = checkpoint_table(tokens(docs, text, curve, count, ids, row), spark, "packing-ids")
    ranges = _with_ranges(stored, curve, count, part, range_tokens, F.xxhash64(id_col, row))
    many = (ranges.agg(F.max(part)).first()[0] or 0) + 1
    ranges = ranges.repartition(many, part).sortWithinPartitions(part, curve, id_col, row)
    at = [ranges.columns.index(c) for c in keep]
    ids_at, count_at, part_at = (ranges.columns.index(c) for c in (ids, count, part))

    def run(batches):
        open_, number, used = zstandard.ZstdDecompressor(), None, 0
        for got in batches:
            for lo in range(0, got.num_rows, 512):
                block = got.slice(lo, 512)
                rows = {c: [] for c in ("doc", part, *made)}
                for i, (raw, n, own) in enumerate(zip(*(block.column(j).to_pylist() for j in (ids_at, count_at, part_at)), strict=True)):
                    if own != number:
                        number, used = own, 0
                    found = np.frombuffer(open_.decompress(raw), "<u2").astype("<u4")
                    start = 0
                    while start < n:
                        take = min(n - start, length - used % length)
                        for c, v in zip(rows, (i, own, start, take, zlib.crc32(found[start:start + take]), n, used // length, used % length), strict=True):
                            rows[c].append(v)
                        start += take
                        used += take
                pick = pa.array(rows.pop("doc"), pa.int64())
                yield pa.RecordBatch.from_arrays([block.column(j).take(pick) for j in at] + [pa.array(v, pa.int64()) for v in rows.values()], [*keep, part, *made])

    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(c, T.LongType()) for c in (part, *made)])
    pieces = checkpoint_table(ranges.mapInArrow(run, schema), spark, "packing-pieces")
    base = fresh([*keep, *made, part], "__base")
    counted = pieces.groupBy(part).agg((F.max("sequence_id") + 1).alias(base))
    counted = counted.select(part, (F.sum(base).over(Window.orderBy(part)) - F.col(base)).alias(base))  # one row per range
    return pieces.join(counted, part).select(*keep, "start", "length", "ids_crc32", "doc_tokens", (F.col(base) + F.col("sequence_id")).alias("sequence_id"), "offset")


def _with_ranges(stored: DataFrame, curve: str, count: str, part: str, range_tokens: int, row_hash) -> DataFrame:
    """stored with the number of its range: stretches of the curve in order, about range_tokens each."""
    cell = F.shiftright(curve, DIMS * BITS - CELL)
    order = Window.orderBy("cell")                                                        # at most 2**CELL rows
    held = stored.groupBy(cell.alias("cell")).agg(F.sum(count).alias("held"))
    held = held.withColumn("range", F.call_function("div", F.sum("held").over(order) - F.col("held"), F.lit(range_tokens).cast("long")))
    held = held.withColumn("splits", F.ceil(F.col("held") / range_tokens))
    before = F.lag(F.struct("range", "splits")).over(order)
    opens = before.isNull() | (before["splits"] > 1) | (before["range"] != F.col("range"))
    held = held.withColumn("opens", F.when(F.col("splits") > 1, F.col("splits")).when(opens, 1).otherwise(0))
    held = held.select("cell", "splits", (F.sum("opens").over(order) - F.col("splits")).alias("first"))
    names = held.select(*(F.col(c).alias(f"{part}{c}") for c in held.columns))
    joined = stored.join(F.broadcast(names), cell == F.col(f"{part}cell"))
    return joined.select(*stored.columns, (F.col(f"{part}first") + F.pmod(row_hash, F.col(f"{part}splits"))).cast("long").alias(part))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into sequences of 1024 tokens; ids of the byte-level BPE with its added token, then id 0."""
    return pack(read(spark, sf_dir, "documents").select("doc_id", "text"))
