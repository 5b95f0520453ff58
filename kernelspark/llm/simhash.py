"""SimHash near-duplicates: binary trie self-join of 64-bit fingerprints within a bit budget.

1. Fingerprints: word shingles hashed by XXH64; bit i is set if over half the hashes have it.
2. Distinct fingerprints only go on, so a group of copies is one node.
3. Two fingerprints at most d bits apart agree on m of d + m equal bit blocks. Each is sent
   once for every choice of m blocks, keyed by those blocks' bits; m grows with the number
   of distinct fingerprints so that the expected size of a key stays bounded. Keys with
   more rows than CELL_ROWS (near copies agree on most bits) are dealt by hash into blocks,
   and each pair of blocks is a cell of its own: no task gets an unbounded key.
4. Each cell walks pairs of trie nodes together, adds up differing bits and drops a pair
   once they exceed the budget; it also drops a pair whose points are linked already. A
   task returns one link per point to the smallest linked point, never all pairs.
5. Links are joined over the cluster by alternating star contraction, cut by written tables.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint_table, components, parts_of, read, texts

#: Rows of a cell; a larger key is split into pairs of blocks of about this size.
CELL_ROWS = 4_096
#: Points a task holds at once, and pairs of points it compares at once.
HELD, AT_ONCE = 1 << 16, 1 << 20
#: Node pairs with so many pairs of points are compared point by point.
SMALL = 256
_DIFFER = np.array([[(a ^ b).bit_count() for b in range(16)] for a in range(16)], np.int8)


def fingerprint(raw: bytes, k: int = 4, seed: int = 42) -> int:
    """Fingerprint of one UTF-8 text; no word: 0."""
    found = raw.lower().split()
    if not found:
        return 0
    line = b" ".join(found)
    stop = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    if len(found) <= k:
        hashes = [xxhash.xxh64_intdigest(line, seed)]
    else:
        first = np.concatenate(([0], stop[:-k] + 1)).tolist()
        hashed = xxhash.xxh64_intdigest
        hashes = [hashed(line[a:b], seed) for a, b in zip(first, stop[k - 1:].tolist(), strict=True)]
    total, count = len(hashes), np.zeros(64, np.int64)
    for i in range(0, total, AT_ONCE):
        bits = np.array(hashes[i:i + AT_ONCE], "<u8").view(np.uint8).reshape(-1, 8)
        count += np.unpackbits(bits, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * count > total).tolist()))


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fp", k: int = 4) -> DataFrame:
    """docs without the text, with the fingerprint as a long (its 64 bits)."""
    keep = [c for c in docs.columns if c != text]
    at = [docs.columns.index(c) for c in keep]
    place = docs.columns.index(text)

    def run(batches):
        for got in batches:
            fps = np.array([fingerprint(t, k) for t in texts(got.column(place))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([got.column(i) for i in at] + [pa.array(fps)], [*keep, out])

    return docs.mapInArrow(run, T.StructType([docs.schema[c] for c in keep] + [T.StructField(out, T.LongType())]))


def choice(n: int, budget: int, cell: int = CELL_ROWS) -> int:
    """m: how many of budget + m blocks must agree, so that n random fingerprints meet in cells of a tenth of ``cell``."""
    m = 1
    while n / 2.0 ** (64 * m // (budget + m)) > cell / 10 and m < 6:
        m += 1
    return m


def masks(budget: int, m: int) -> list[int]:
    edges = [round(64 * i / (budget + m)) for i in range(budget + m + 1)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(blocks, m)]


def linked(cell: np.ndarray, side: np.ndarray, fp: np.ndarray, budget: int) -> np.ndarray:
    """Smallest linked index per point, the points sorted by (cell, side, fp).

    Side 0 and 1: points are compared across sides; side 2: with all others of the cell.
    """
    n = len(fp)
    group = np.concatenate(([True], (cell[1:] != cell[:-1]) | (side[1:] != side[:-1])))
    start = np.flatnonzero(group)
    stop = np.append(start[1:], n)
    runs = []  # per level of four bits: the child node of each point, and where child nodes start
    cut = group
    for level in range(16):
        high = fp >> np.uint64(60 - 4 * level)
        cut = cut | np.concatenate(([True], high[1:] != high[:-1]))
        runs.append((np.cumsum(cut) - 1, np.append(np.flatnonzero(cut), n)))
    own = np.flatnonzero(side[start] == 2)
    left = np.flatnonzero((side[start] == 0) & np.append((cell[start[1:]] == cell[start[:-1]]), False)) if len(start) else own
    todo = [(0, np.concatenate((start[own], start[left])), np.concatenate((stop[own], stop[left])),
             np.concatenate((start[own], start[left + 1])), np.concatenate((stop[own], stop[left + 1])), np.zeros(len(own) + len(left), np.int8))]
    label = np.arange(n)
    while todo:
        level, a, b, c, d, used = todo.pop()
        if len(a) > AT_ONCE // SMALL:
            half = len(a) // 2
            todo.append((level, *(x[half:] for x in (a, b, c, d, used))))
            todo.append((level, *(x[:half] for x in (a, b, c, d, used))))
            continue
        same = np.cumsum(np.concatenate(([0], label[1:] != label[:-1])))  # runs of one label
        open_ = ~((same[a] == same[b - 1]) & (same[c] == same[d - 1]) & (label[a] == label[c]))
        a, b, c, d, used = a[open_], b[open_], c[open_], d[open_], used[open_]
        few = ((b - a) * (d - c) <= SMALL) | (level == 16)
        if few.any():
            x, y = _pairs(a[few], b[few], c[few], d[few])
            near = np.bitwise_count(fp[x] ^ fp[y]) <= budget
            near &= label[x] != label[y]
            if near.any():
                label = components(n, x[near], y[near], label)
        a, b, c, d, used = a[~few], b[~few], c[~few], d[~few], used[~few]
        if not len(a):
            continue
        child, at = runs[level]
        x, y = _pairs(child[a], child[b - 1] + 1, child[c], child[d - 1] + 1)
        parent = np.repeat(np.arange(len(a)), (child[b - 1] + 1 - child[a]) * (child[d - 1] + 1 - child[c]))
        once = (x <= y) | (a != c)[parent]
        x, y, parent = x[once], y[once], parent[once]
        shift = np.uint64(60 - 4 * level)
        used = used[parent] + _DIFFER[(fp[at[x]] >> shift & np.uint64(15)).astype(np.intp), (fp[at[y]] >> shift & np.uint64(15)).astype(np.intp)]
        fits = used <= budget
        x, y, used = x[fits], y[fits], used[fits]
        if len(x):
            near_last = np.argsort(used, kind="stable")[::-1]  # the last are taken first: near nodes link early
            x, y, used = x[near_last], y[near_last], used[near_last]
            step = AT_ONCE // SMALL
            todo += [(level + 1, at[x[i:i + step]], at[x[i:i + step] + 1], at[y[i:i + step]], at[y[i:i + step] + 1], used[i:i + step]) for i in range(0, len(x), step)]
    return label


def _pairs(a, b, c, d):
    """All (i, j) with i in [a, b) and j in [c, d), for each row of ranges."""
    wide = d - c
    many = (b - a) * wide
    row = np.repeat(np.arange(len(a)), many)
    k = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    return a[row] + k // wide[row], c[row] + k % wide[row]


def links(nodes: DataFrame, fp: str, budget: int, n: int, cell: int = CELL_ROWS) -> DataFrame:
    """(a, b): links whose components are those of all pairs at most ``budget`` bits apart."""
    spark = nodes.sparkSession
    keyed = nodes.select(F.col(fp).alias("fp"), F.explode(F.array(*(F.struct(F.lit(t).alias("t"), F.col(fp).bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m).cast("long")).alias("key"))
                                                         for t, m in enumerate(masks(budget, choice(n, budget, cell)))))).alias("s")).select("fp", "s.*")
    large = keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("many")).where(F.col("many") > cell)
    large = checkpoint_table(large, spark, "simhash-large")
    if large.isEmpty():
        cells = keyed.select("fp", "t", "key", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(2).alias("side"))
    else:
        keyed = keyed.join(large, ["t", "key"], "left").withColumn("many", F.coalesce(F.ceil(F.col("many") / F.lit(cell)), F.lit(1)).cast("int"))
        keyed = keyed.withColumn("own", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("many")).cast("int"))
        cells = keyed.select("fp", "t", "key", "own", F.explode(F.sequence(F.lit(0), F.col("many") - 1)).alias("other"))
        cells = cells.select("fp", "t", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                             F.when(F.col("own") == F.col("other"), 2).otherwise((F.col("own") > F.col("other")).cast("int")).alias("side"))
    cells = cells.select(F.xxhash64("t", "key", "i", "j").alias("cell"), "side", "fp")
    dealt = cells.repartition(parts_of(spark), "cell").sortWithinPartitions("cell", "side")

    def walk(table: pa.Table):
        cell_, side, fps = (table.column(k).to_numpy() for k in ("cell", "side", "fp"))
        fps = fps.view(np.uint64)
        order = np.lexsort((fps, side, cell_))
        cell_, side, fps = cell_[order], side[order], fps[order]
        label = linked(cell_, side, fps, budget)
        tied = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([pa.array(fps[tied].view(np.int64)), pa.array(fps[label[tied]].view(np.int64))], ["a", "b"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        for got in batches:
            held.append(got)
            table = pa.Table.from_batches(held)
            if len(table) < HELD:
                continue
            ids = table.column("cell").to_numpy()
            whole = int(np.flatnonzero(ids == ids[-1])[0])  # the last cell may go on
            if whole:
                yield walk(table.slice(0, whole))
            held = table.slice(whole).combine_chunks().to_batches()
        if held and sum(x.num_rows for x in held):
            yield walk(pa.Table.from_batches(held))

    return dealt.mapInArrow(run, "a long, b long")


def star_components(spark: SparkSession, pairs: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node of the component; only nodes that aren't roots.

    Alternating large and small stars: each round's table is written and reread. Minima are
    aggregated before the shuffle; a node with very many links is split by the skew join.
    """
    edges = checkpoint_table(pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), spark, "star")

    def state(df):
        return df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()

    seen = state(edges)
    while seen[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = checkpoint_table(large, spark, "star")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        edges = checkpoint_table(small.where("a <> b").distinct(), spark, "star")
        now = state(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def group(docs: DataFrame, id_col: str = "doc_id", text: str = "text", budget: int = 4, k: int = 4, cell: int = CELL_ROWS) -> DataFrame:
    """docs without the text, with fp (long), root (the smallest fingerprint linked) and component (the smallest id reachable).

    One row per row of docs. A null text is an empty one: fingerprint zero, linked like any
    other. Null ids never name a component that has another id. Repeated rows stay; an
    empty table gives none. Columns of docs with the three names raise ValueError.
    """
    if clash := {"fp", "root", "component"} & {c.lower() for c in docs.columns}:
        raise ValueError(f"columns exist already: {sorted(clash)}")
    spark = docs.sparkSession
    each = checkpoint_table(fingerprints(docs, text, "fp", k), spark, "simhash-fp")
    nodes = checkpoint_table(each.groupBy("fp").agg(F.min(id_col).alias("low")), spark, "simhash-nodes")
    pairs = links(nodes, "fp", budget, nodes.count(), cell)
    roots = star_components(spark, pairs).withColumnRenamed("node", "fp")
    roots = nodes.join(roots, "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lows = roots.groupBy("root").agg(F.min("low").alias("component"))
    named = roots.join(lows, "root").select("fp", "root", "component")
    return each.join(named, "fp", "left").select(*[c for c in docs.columns if c != text], "fp", "root", "component")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: 4-word shingles, links at 4 or fewer differing bits."""
    found = group(read(spark, sf_dir, "documents").select("doc_id", "text"), budget=4, k=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))

