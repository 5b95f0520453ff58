"""Hard-negative mining: exact inner-product search in cover trees over norm-augmented candidates.

Every vector x gets one more component, sqrt(M^2 - |x|^2) with M the longest norm, and
queries get 0 there: all candidates then have one length and the order of inner products
is the order of distances. If all points of a node lie within r of its centre c, their
products with q lie within |q| r of q c.

The upper levels of the tree are centres chosen farthest-first from a bounded sample; every
row goes to its nearest centre, and a centre's rows are dealt into blocks of bounded size by
hash. Each block holds a cover tree: a node's points split into balls of half its radius
around points farther apart than that, until few or equal points are left. Radii are those of
the points held. Tree and descent are exact whatever the sample was; it only decides how
much can be skipped.

A search takes chunks of anchors of one centre to the blocks whose bounds meet a window of
some anchor. Chunks meet by slices of anchors and blocks by shelves, both of bounded size: a
tree is sent once to a slice that wants it, not to each of its chunks, and an anchor once to
a shelf. There a search goes down a tree level by level, skips nodes outside all windows of an
anchor, visits the leaves that are left best first in growing rounds, verifies them
exactly, and narrows the windows to the best found, for the next tree of the shelf too.
Positives are searched at the home centre first; their least score bounds the search
elsewhere, and their scores are the windows of the negatives.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint_table, read

#: Rows of the sample that the centres are chosen from, centres at most, rows of a block, anchors of a chunk, points of a leaf.
SAMPLE, CENTERS, BLOCK, CHUNK, LEAF = 4096, 1024, 2048, 256, 32
#: Anchors of a slice, and bytes of the vectors of a shelf of blocks (eight for a component).
SLICE, SHELF = 2048, 8 << 20
#: Stands for a null id, which comes last among ties.
NO_ID = (1 << 63) - 1
_POINT = "id long, label string, v array<long>, copies long, h long"


# -------------------------------------------------------------- trees ---

def augmented(V: np.ndarray, longest2: float) -> np.ndarray:
    V = V.astype(np.float64)
    return np.column_stack([V, np.sqrt(np.maximum(longest2 - np.einsum("ij,ij->i", V, V), 0))])


def distances(A: np.ndarray, B: np.ndarray) -> np.ndarray:
    d2 = np.einsum("ij,ij->i", A, A)[:, None] + np.einsum("ij,ij->i", B, B) - 2 * (A @ B.T)
    return np.sqrt(np.maximum(d2, 0))


def farthest_first(A: np.ndarray, k: int) -> np.ndarray:
    """Positions of k points, each the farthest from those before; distinct points only."""
    chosen, gap = [0], distances(A, A[:1])[:, 0]
    while len(chosen) < min(k, len(A)):
        at = int(gap.argmax())
        if gap[at] <= 0:
            break
        chosen.append(at)
        gap = np.minimum(gap, distances(A, A[at:at + 1])[:, 0])
    return np.array(chosen)


def cover_tree(A: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, nodes): points so that each node's are neighbours, and nodes (centre, radius, parent, lo, hi, leaf, level)."""
    D, order, nodes = distances(A, A), [], []

    def leaf(members, centre, parent, level):
        nodes.append([centre, D[centre, members].max(), parent, len(order), len(order) + len(members), 1, level])
        order.extend(members)

    todo = [(np.arange(len(A)), 0, -1, 0, None)]
    while todo:
        members, centre, parent, level, end_of = todo.pop()
        if end_of is not None:
            nodes[end_of][4] = len(order)
            continue
        radius = D[centre, members].max()
        if len(members) <= LEAF or radius <= 0:
            leaf(members, centre, parent, level)
            continue
        me = len(nodes)
        nodes.append([centre, radius, parent, len(order), 0, 0, level])
        todo.append((None, 0, 0, 0, me))
        rest, own, few = members, centre, []
        while len(rest):
            near = D[own, rest] <= radius / 2
            near[rest == own] = True
            group, rest = rest[near], rest[~near]
            if len(group) < 4:                     # too few for a node: kept in one leaf around this node's centre
                few.append(group)
            else:
                todo.append((group, own, me, level + 1, None))
            own = rest[0] if len(rest) else own
        if few:
            leaf(np.concatenate(few), centre, me, level + 1)
    return np.array(order), np.array(nodes, np.float64)


@dataclass
class Tree:
    """A block: points in the tree's order."""

    V: np.ndarray
    ids: np.ndarray
    labels: list
    copies: np.ndarray
    hashes: np.ndarray
    order: np.ndarray
    nodes: np.ndarray

    def centre_rows(self, which: np.ndarray) -> np.ndarray:
        return self.V[self.place[self.nodes[which, 0].astype(np.int64)]]

    def __post_init__(self):
        self.place = np.empty(len(self.order), np.int64)
        self.place[self.order] = np.arange(len(self.order))
        self.norm = float(np.sqrt((self.V.astype(np.float64) ** 2).sum(1).max(initial=0)))


def products(Q: np.ndarray, V: np.ndarray) -> np.ndarray:
    """Integer inner products, by floating-point BLAS where that is exact."""
    if len(Q) and len(V) and float(np.abs(Q).max()) * float(np.abs(V).max()) * Q.shape[1] < 2.0 ** 53:
        return np.rint(Q.astype(np.float64) @ V.astype(np.float64).T).astype(np.int64)
    return Q.astype(np.int64) @ V.astype(np.int64).T


def open_pairs(top: np.ndarray, low: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Which (anchor, node) meet a window of the anchor: top and low are bounds, lo and hi (anchors, windows)."""
    out = np.zeros(top.shape, bool)
    for w in range(lo.shape[1]):
        out |= (top >= lo[:, w:w + 1]) & (low <= hi[:, w:w + 1])
    return out


def descend(tree: Tree, Q: np.ndarray, qn: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leaves that anchors reach, level by level: (anchor, leaf, upper bound)."""
    nodes, slack = tree.nodes, qn[:, None] * (1e-6 * tree.norm + 1e-3)
    reached, found = {-1: np.ones(len(Q), bool)}, []
    for level in range(int(nodes[:, 6].max()) + 1):
        at = np.array([i for i in np.flatnonzero(nodes[:, 6] == level) if int(nodes[i, 2]) in reached], np.int64)
        if not len(at):
            break
        S, reach = products(Q, tree.centre_rows(at)), qn[:, None] * nodes[at, 1] * (1 + 1e-9) + slack
        ok = open_pairs(S + reach, S - reach, lo, hi)
        for j, i in enumerate(at):
            ok[:, j] &= reached[int(nodes[i, 2])]
            if ok[:, j].any():
                if nodes[i, 5]:
                    who = np.flatnonzero(ok[:, j])
                    found.append((who, np.full(len(who), i), S[who, j] + reach[who, j]))
                else:
                    reached[int(i)] = ok[:, j]
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def best(group: np.ndarray, score: np.ndarray, ident: np.ndarray, h: np.ndarray, copies: np.ndarray, k: int) -> np.ndarray:
    """Positions of the first k of each group, copies counted; higher scores first, ties by id."""
    order = np.lexsort((h, ident, -score, group))
    g, c = group[order], copies[order]
    total = np.cumsum(c) - c
    first = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1]))) if len(g) else np.empty(0, np.int64)
    start = np.repeat(total[first], np.diff(np.append(first, len(g))))
    return order[total - start < k]


def narrowed(lo: np.ndarray, group: np.ndarray, score: np.ndarray, copies: np.ndarray, k: int) -> np.ndarray:
    """Lower ends of windows (anchors, windows), raised to the k-th score where k are held; scores fall within a group."""
    full = np.bincount(group, np.minimum(copies, k), lo.size) >= k
    least = np.full(lo.size, -np.inf)
    least[group] = score                                             # by falling score: the last one stays
    return np.maximum(lo, np.where(full, least, -np.inf).reshape(lo.shape))


def search(tree: Tree, Q, labels, ids, hashes, lo, hi, same: bool, k: int) -> dict[str, np.ndarray]:
    """For each (anchor, window) its first k points of the same (or another) label with lo <= score <= hi.

    Returns anchor, window, row and score. An anchor's own row stays out, its copies don't.
    """
    qn, lo, windows = np.sqrt((Q.astype(np.float64) ** 2).sum(1)), lo.astype(np.float64).copy(), lo.shape[1]
    codes = {x: i for i, x in enumerate(dict.fromkeys([*labels, *tree.labels]))}
    mine, theirs = np.array([codes[x] for x in labels]), np.array([codes[x] for x in tree.labels])
    who, leaf, top = descend(tree, Q, qn, lo, hi)
    order = np.lexsort((-top, who))
    who, leaf, top = who[order], leaf[order], top[order]
    rank = np.arange(len(who)) - np.searchsorted(who, who)
    held = {c: np.empty(0, np.int64) for c in ("group", "row", "score", "copies")}
    begin, size = 0, 1
    while begin <= rank.max(initial=-1):
        now = np.flatnonzero((rank >= begin) & (rank < begin + size))
        now = now[(top[now, None] >= lo[who[now]]).any(1)]           # windows may be narrower by now
        fresh = {c: [held[c]] for c in held}
        for node in np.unique(leaf[now]):
            a = who[now[leaf[now] == node]]
            rows = np.arange(int(tree.nodes[node, 3]), int(tree.nodes[node, 4]))
            S = products(Q[a], tree.V[rows])
            copies = np.broadcast_to(tree.copies[rows], S.shape).copy()
            itself = (ids[a][:, None] == tree.ids[rows]) & (hashes[a][:, None] == tree.hashes[rows])
            copies[itself] -= 1
            fits = ((mine[a][:, None] == theirs[rows]) == same) & (copies > 0)
            for w in range(windows):
                i, j = np.nonzero(fits & (S >= lo[a, w][:, None]) & (S <= hi[a, w][:, None]))
                fresh["group"].append(a[i] * windows + w)
                fresh["row"].append(rows[j])
                fresh["score"].append(S[i, j])
                fresh["copies"].append(copies[i, j])
        new = {c: np.concatenate(x) for c, x in fresh.items()}
        keep = best(new["group"], new["score"], tree.ids[new["row"]], tree.hashes[new["row"]], new["copies"], k)
        held = {c: x[keep] for c, x in new.items()}
        lo = narrowed(lo, held["group"], held["score"], held["copies"], k)
        begin, size = begin + size, size * 4
    return {"anchor": held["group"] // windows, "window": held["group"] % windows, "row": held["row"], "score": held["score"], "copies": held["copies"]}


# ------------------------------------------------------------- on Spark ---

def points(rows: DataFrame, ident: Column, label: Column, vector: Column, scale: float) -> DataFrame:
    """(id, label, v, copies, h): rows that take part, rows alike counted; v is floor(scale * x)."""
    x = rows.select(ident.cast("long").alias("id"), label.cast("string").alias("label"), vector.alias("x"))
    bad = F.exists("x", lambda e: e.isNull() | F.isnan(e.cast("double")) | (F.abs(e.cast("double")) == float("inf")))
    kept = x.where("label IS NOT NULL AND x IS NOT NULL").where(~bad)
    v = F.transform("x", lambda e: F.floor(F.lit(float(scale)) * e.cast("double")).cast("long"))
    return (kept.select(F.coalesce("id", F.lit(NO_ID)).alias("id"), "label", v.alias("v"))
            .groupBy("id", "label", "v").agg(F.count(F.lit(1)).alias("copies")).withColumn("h", F.xxhash64("label", "v")))


@dataclass
class Forest:
    """Indexed candidates: points with their centre, trees by number (a centre's blocks follow each other), and at most ``CENTERS`` centres."""

    points: DataFrame
    trees: DataFrame
    centers: np.ndarray
    radii: np.ndarray
    blocks: np.ndarray
    longest2: float
    width: int


#: A tree's components are stored in the first of these that holds them.
_KINDS = (np.int16, np.int32, np.int64)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, width)


def index(found: DataFrame, name: str = "negatives") -> Forest | None:
    """Cover trees over points; None if there are none."""
    spark = found.sparkSession
    stored = checkpoint_table(found, spark, f"{name}-points")
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double"))
    n, longest2, width = stored.agg(F.count(F.lit(1)), F.max(norm2), F.max(F.size("v"))).first()
    if not n:
        return None
    width, longest2 = max(1, width), float(longest2)
    stored = stored.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("v"))))
    sample = stored.orderBy(F.xxhash64("id", "h"), "id", "h").limit(SAMPLE).select("v").collect()
    S = augmented(np.array([r.v for r in sample], np.int64).reshape(-1, width), longest2)
    C = S[farthest_first(S, int(min(CENTERS, max(1, n // BLOCK))))]
    sent = spark.sparkContext.broadcast(C)
    names, at = stored.columns, stored.columns.index("v")

    def nearest(batches):
        for got in (b.slice(i, BLOCK) for b in batches for i in range(0, b.num_rows, BLOCK)):
            A = augmented(_matrix(got.column(at), width), longest2)
            D = distances(A, sent.value)
            own = D.argmin(1)
            yield pa.RecordBatch.from_arrays([*got.columns, pa.array(own.astype(np.int32)), pa.array(D[np.arange(len(A)), own])], [*names, "center", "far"])

    placed = checkpoint_table(stored.mapInArrow(nearest, f"{_POINT}, center int, far double"), spark, f"{name}-placed")
    sizes = placed.groupBy("center").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect()
    radii, blocks = np.zeros(len(C)), np.zeros(len(C), np.int64)
    for r in sizes:
        radii[r.center], blocks[r.center] = r.far, -(-r.n // BLOCK)
    parts = F.create_map(*[F.lit(int(x)) for r in sizes for x in (r.center, blocks[r.center])])
    before = np.cumsum(blocks) - blocks
    dealt = placed.withColumn("block", F.pmod(F.xxhash64("h", "id"), parts[F.col("center")]).cast("int"))

    def build(key, table):
        V = _matrix(table.column("v").combine_chunks(), width)
        order, nodes = cover_tree(augmented(V, longest2))
        put = lambda c: np.asarray(table.column(c))[order].astype(np.int64).tobytes()
        kind = next(t for t in _KINDS if np.iinfo(t).min <= V.min(initial=0) and V.max(initial=0) <= np.iinfo(t).max)
        rows = {"number": [int(before[key[0].as_py()]) + key[1].as_py()], "vectors": [V[order].astype(kind).tobytes()], "ids": [put("id")], "labels": [table.column("label").take(pa.array(order)).to_pylist()],
                "copies": [put("copies")], "hashes": [put("h")], "places": [order.astype(np.int64).tobytes()], "nodes": [nodes.tobytes()]}
        return pa.table(rows, schema=pa.schema([("number", pa.int64()), *[(c, pa.binary()) for c in ("vectors", "ids")], ("labels", pa.list_(pa.string())), *[(c, pa.binary()) for c in ("copies", "hashes", "places", "nodes")]]))

    made = dealt.groupBy("center", "block").applyInArrow(build, "number long, vectors binary, ids binary, labels array<string>, copies binary, hashes binary, places binary, nodes binary")
    return Forest(placed, checkpoint_table(made, spark, f"{name}-trees"), C, radii, blocks, longest2, width)


def _read_tree(got: dict, width: int) -> Tree:
    ints = lambda c: np.frombuffer(got[c], np.int64)
    kind = np.dtype(f"i{8 * len(got['vectors']) // (len(got['ids']) * width)}")
    return Tree(np.frombuffer(got["vectors"], kind).reshape(-1, width).astype(np.int64), ints("ids"), got["labels"], ints("copies"), ints("hashes"), ints("places"), np.frombuffer(got["nodes"], np.float64).reshape(-1, 7))


def chunks(anchors: DataFrame, windows: int) -> DataFrame:
    """Anchors (id, h, label, v, center, lo, hi) in rows of about ``CHUNK`` of one centre, in slices of about ``SLICE`` anchors."""
    before = F.sum("n").over(Window.orderBy("center")) - F.col("n")
    counts = anchors.groupBy("center").agg(F.count(F.lit(1)).alias("n")).select("center", "n", before.alias("before"), F.ceil(F.col("n") / CHUNK).cast("int").alias("parts"))
    dealt = anchors.join(F.broadcast(counts), "center").withColumn("chunk", F.pmod(F.xxhash64("id", "h"), F.col("parts")).cast("int"))
    part = F.floor((F.col("before") + F.col("chunk") * F.col("n") / F.col("parts")) / SLICE).cast("int")
    pad = lambda c, x: F.concat(c, F.array_repeat(F.lit(x), F.lit(windows) - F.size(c)))
    one = F.struct("id", "h", "label", "v", pad("lo", float("inf")).alias("lo"), pad("hi", float("-inf")).alias("hi"))
    return dealt.groupBy(F.col("center").alias("home"), "chunk", part.alias("part")).agg(F.collect_list(one).alias("anchors"))


def _anchors(own: pa.StructArray, width: int, windows: int):
    flat = dict(zip([f.name for f in own.type], own.flatten(), strict=True))
    return (_matrix(flat["v"], width), flat["label"].to_pylist(), np.asarray(flat["id"]), np.asarray(flat["h"]), _matrix(flat["lo"], windows), _matrix(flat["hi"], windows))


FOUND = "id long, h long, window int, near_id long, near_h long, score long, copies long"
_FOUND = pa.schema([(c, pa.int32() if c == "window" else pa.int64()) for c in ("id", "h", "window", "near_id", "near_h", "score", "copies")])


def look(forest: Forest, dealt: DataFrame, same: bool, k: int, windows: int, where: str) -> DataFrame:
    """The first k of each (anchor, window) in each shelf of blocks that its chunk visits: of ``home``, ``away`` or ``all`` centres."""
    spark = dealt.sparkSession
    sent = spark.sparkContext.broadcast((forest.centers, forest.radii, forest.blocks, float(np.sqrt(forest.longest2))))
    width, kinds, at_once = forest.width, dealt.schema["anchors"].dataType.simpleString(), CHUNK
    per_shelf = max(1, SHELF // (BLOCK * width * 8))

    def visits(batches):
        """(part, anchors, numbers of the trees to visit) for each chunk."""
        C, radii, blocks, longest = sent.value
        before = np.cumsum(blocks) - blocks
        for got in batches:
            for home, part, own in zip(got.column("home").to_pylist(), got.column("part").to_pylist(), got.column("anchors"), strict=True):
                if where == "home":
                    meet = np.array([home])
                else:
                    Q, _, _, _, lo, hi = _anchors(own.values, width, windows)
                    Q = Q.astype(np.float64)
                    qn = np.sqrt(np.einsum("ij,ij->i", Q, Q))[:, None]
                    S, reach = Q @ C[:, :-1].T, qn * (radii * (1 + 1e-9) + 1e-6 * longest + 1e-3)
                    meet = np.flatnonzero(open_pairs(S + reach, S - reach, lo, hi).any(0))
                    meet = meet if where == "all" else meet[meet != home]
                numbers = np.concatenate([np.arange(blocks[c]) + before[c] for c in meet] or [np.empty(0, np.int64)])
                yield part, own, numbers

    def shelves(batches):
        for part, own, numbers in visits(batches):
            shelf = numbers // per_shelf
            cut = np.flatnonzero(np.diff(shelf, prepend=-1, append=-1)) if len(shelf) else np.zeros(1, np.int64)
            cells = pa.StructArray.from_arrays([pa.array(shelf[cut[:-1]]), pa.ListArray.from_arrays(cut.astype(np.int32), pa.array(numbers))], ["shelf", "trees"])
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([own], own.type), pa.ListArray.from_arrays(np.array([0, len(cells)], np.int32), cells)], ["part", "anchors", "cells"])

    def wanted(batches):
        met = {}
        for part, _, numbers in visits(batches):
            met.setdefault(part, set()).update(numbers.tolist())
        for part, numbers in met.items():
            yield pa.RecordBatch.from_arrays([pa.array(sorted(numbers), pa.int64()), pa.array([part] * len(numbers), pa.int32())], ["number", "part"])

    cells = dealt.mapInArrow(shelves, f"part int, anchors {kinds}, cells array<struct<shelf: long, trees: array<long>>>").select("part", "anchors", F.explode("cells").alias("cell")).select("part", "cell.*", "anchors")
    parts = dealt.mapInArrow(wanted, "number long, part int").groupBy("number").agg(F.collect_set("part").alias("parts"))
    trees = forest.trees.join(parts.hint("merge"), "number").withColumn("shelf", F.floor(F.col("number") / per_shelf)).withColumn("part", F.explode("parts")).drop("parts")
    stored = [c for c in trees.columns if c not in ("shelf", "part", "number")]

    def run(cells, trees):
        held = {c: np.empty(0, np.int64) for c in ("group", "near_id", "near_h", "score", "copies")}
        if not cells.num_rows or not trees.num_rows:
            return _FOUND.empty_table()
        own, met = cells.column("anchors").combine_chunks(), cells.column("trees").combine_chunks()
        chunk, meets, numbers = np.repeat(np.arange(len(own)), own.value_lengths()), np.repeat(np.arange(len(met)), met.value_lengths()), np.asarray(met.flatten())
        Q, labels, ids, hashes, lo, hi = _anchors(own.flatten(), width, windows)
        for i, number in enumerate(trees.column("number").to_pylist()):
            tree = _read_tree({c: trees.column(c)[i].as_py() for c in stored}, width)
            visitors, fresh = np.flatnonzero(np.isin(chunk, meets[numbers == number])), {c: [held[c]] for c in held}
            for begin in range(0, len(visitors), at_once):
                who = visitors[begin:begin + at_once]
                f = search(tree, Q[who], [labels[a] for a in who], ids[who], hashes[who], lo[who], hi[who], same, k)
                for c, x in (("group", who[f["anchor"]] * windows + f["window"]), ("near_id", tree.ids[f["row"]]), ("near_h", tree.hashes[f["row"]]), ("score", f["score"]), ("copies", f["copies"])):
                    fresh[c].append(x)
            new = {c: np.concatenate(x) for c, x in fresh.items()}
            keep = best(new["group"], new["score"], new["near_id"], new["near_h"], new["copies"], k)
            held = {c: x[keep] for c, x in new.items()}
            lo = narrowed(lo, held["group"], held["score"], held["copies"], k)
        anchor, window = held["group"] // windows, held["group"] % windows
        return pa.table([ids[anchor], hashes[anchor], window.astype(np.int32), *(held[c] for c in ("near_id", "near_h", "score", "copies"))], schema=_FOUND)

    return cells.groupBy("shelf", "part").cogroup(trees.groupBy("shelf", "part")).applyInArrow(run, FOUND)


def first(found: DataFrame, k: int) -> DataFrame:
    """The first k of each (anchor, window) with ``rank`` from 1; copies take a rank each."""
    each = found.withColumn("nth", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(k)).cast("int"))))
    order = Window.partitionBy("id", "h", "window").orderBy(F.desc("score"), "near_id", "near_h", "nth")
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("nth", "copies")


_RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(rows: DataFrame, is_anchor: Column, ident: str = "vec_id", label: str = "label", vector: str = "embedding", scale: float = 256.0,
         n_positive: int = 5, n_negative: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Positives of an anchor: the first n_positive other rows of its label. Negatives of each:
    the first n_negative rows of other labels with low * positive <= 100 * negative <= high *
    positive. Higher integer inner products come first, then smaller ids.

    Rows with a null label or vector, or a null or non-finite component, take no part; shorter
    vectors count as if filled up with zeros. Copies are rows of their own: each is an anchor,
    a positive (of its copies too) and a negative. A null id comes last among ties and is null in the result;
    rows of one id are told apart by label and vector. Scores must fit a long. Other columns
    don't matter, whatever their names. No anchors or candidates: an empty result.
    """
    spark = rows.sparkSession
    given = rows.select(F.col(ident).alias("id"), F.col(label).alias("label"), F.col(vector).alias("x"), is_anchor.alias("anchor"))
    return _mine(spark, points(given, F.col("id"), F.col("label"), F.col("x"), scale), points(given.where("anchor"), F.col("id"), F.col("label"), F.col("x"), scale).select("id", "h", F.lit(True).alias("anchor")),
                 n_positive, n_negative, low, high)


def _mine(spark: SparkSession, found: DataFrame, wanted: DataFrame, n_positive: int, n_negative: int, low: int, high: int) -> DataFrame:
    # joins with vectors or trees are merges: files of few distinct vectors are far smaller than their rows, and Spark would broadcast those
    forest = index(found)
    if forest is None:
        return spark.createDataFrame([], _RESULT)
    key = ["id", "h"]
    anchors = checkpoint_table(forest.points.join(wanted.hint("merge"), key).select(*key, "label", "v", "copies", "center"), spark, "negatives-anchors")
    no_bound = lambda x: F.array(F.lit(float(x)))
    open_ = anchors.withColumns({"lo": no_bound("-inf"), "hi": no_bound("inf")})
    home = checkpoint_table(look(forest, chunks(open_, 1), True, n_positive, 1, "home"), spark, "negatives-home")
    bound = first(home, n_positive).groupBy(*key).agg(F.min("score").cast("double").alias("least"), F.count(F.lit(1)).alias("n"))
    least = F.when(F.col("n") >= n_positive, F.col("least")).otherwise(F.lit(float("-inf")))
    bounded = anchors.join(bound, key, "left").select(*anchors.columns, F.array(F.coalesce(least, F.lit(float("-inf")))).alias("lo"), no_bound("inf").alias("hi"))
    away = look(forest, chunks(bounded, 1), True, n_positive, 1, "away")
    positives = checkpoint_table(first(home.unionByName(away), n_positive).withColumnsRenamed({"rank": "nth", "score": "positive_score", "near_id": "positive_id"}).select(*key, "nth", "positive_id", "positive_score"), spark, "negatives-positives")
    # window w of an anchor belongs to its w-th positive; negative positives have no negatives
    edge = F.sort_array(F.collect_list(F.struct("nth", F.ceil(F.col("positive_score") * low / 100.0).cast("double").alias("lo"), F.floor(F.col("positive_score") * high / 100.0).cast("double").alias("hi"))))
    windows = positives.groupBy(*key).agg(edge.alias("w")).select(*key, F.col("w.lo").alias("lo"), F.col("w.hi").alias("hi"))
    sought = look(forest, chunks(anchors.join(windows.hint("merge"), key), n_positive), False, n_negative, n_positive, "all")
    negatives = first(sought, n_negative).withColumnRenamed("score", "negative_score")
    pairs = negatives.withColumn("nth", F.col("window") + 1).join(positives, [*key, "nth"]).join(anchors.select(*key, "copies"), key)
    each = pairs.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    shown = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return each.select(shown("id").alias("anchor_id"), shown("positive_id").alias("positive_id"), F.col("rank").cast("int").alias("rank"), shown("near_id").alias("negative_id"), "positive_score", "negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth embedding among all of them; every seventh has the next label."""
    given = read(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(given.select("vec_id", label.alias("label"), "embedding"), F.col("vec_id") % 100 == 0)
