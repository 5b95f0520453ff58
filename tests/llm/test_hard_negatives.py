import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kernelspark.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, h int, CENTER string"


def brute(rows, every=100):
    """The contract over (vec_id, embedding, label), in plain Python."""
    part = []
    for n, (i, x, label) in enumerate(rows):
        if label is None or x is None or any(e is None or not math.isfinite(e) for e in x):
            continue
        v = [math.floor(256 * float(np.float32(e))) for e in x]
        part.append((n, math.inf if i is None else i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, v))
    out = []
    for n, i, label, q in part:
        if i == math.inf or i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, v)), j, m, other) for m, j, other, v in part if m != n)
        for p, pid, _, _ in [s for s in scored if s[3] == label][:5]:
            own = [s for s in scored if s[3] != label and 80 * -p <= 100 * -s[0] <= 100 * -p][:5]
            out += [(i, None if pid == math.inf else pid, r, None if s[1] == math.inf else s[1], -p, -s[0]) for r, s in enumerate(own, 1)]
    return sorted(out, key=str)


def table(rng, n, d=6, clusters=5):
    mid = [[rng.gauss(0, 1) for _ in range(d)] for _ in range(clusters)]
    rows = []
    for i in range(n):
        c = rng.randrange(clusters)
        spread = rng.choice([0.0, 0.05, 0.3])
        rows.append((i, [m + rng.gauss(0, spread) if spread else m for m in mid[c]], rng.randrange(4)))
    return rows


def run(spark, rows, path):
    spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(4).write.mode("overwrite").parquet(f"{path}/embeddings.parquet")
    return sorted((tuple(r) for r in H.op11_hard_negatives(spark, str(path)).collect()), key=str)


@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(spark, tmp_path, monkeypatch, small):
    if small:
        for name, x in (("BLOCK", 40), ("CHUNK", 2), ("LEAF", 4), ("SAMPLE", 64)):
            monkeypatch.setattr(H, name, x)
    rows = table(random.Random(2), 900)
    assert run(spark, rows, tmp_path) == brute(rows)


def test_awkward_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(H, "BLOCK", 30)
    rng = random.Random(4)
    rows = table(rng, 320, d=4, clusters=3)
    same = rows[5][1]
    rows += [(1000 + i, same, i % 2) for i in range(120)]                       # one vector for a quarter of the rows
    rows += [(2000, same, 1)] * 3 + [(2100, same, 2)] * 2                       # copies, of anchors too
    rows += [(None, same, 1), (None, rows[7][1], 3), (-300, rows[9][1], 2)]
    rows += [(3000, None, 1), (3001, rows[1][1], None), (3100, [1.0, None, 2.0, 3.0], 1), (3200, [1.0, float("nan"), 0.0, 0.0], 1), (3300, [float("inf")] * 4, 2)]
    rows += [(4000, [], 1), (4001, [0.5, 0.25], 2), (4100, [0.0] * 4, 1), (4200, [-x for x in same], 0)]
    assert run(spark, rows, tmp_path) == brute(rows)


def test_empty_tables(spark, tmp_path):
    assert run(spark, [], tmp_path) == []
    assert run(spark, [(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 2)], tmp_path) == []
    assert run(spark, [(100, [1.0, 2.0], 1)], tmp_path) == []


def test_other_columns_and_windows(spark):
    df = spark.createDataFrame([(i, [float(i % 5), 1.0], "ab"[i % 2]) for i in range(40)], "window long, copies array<double>, score string")
    got = H.mine(df, F.col("window") < 3, ident="window", label="score", vector="copies", scale=4, n_positive=2, n_negative=1, low=0, high=100)
    assert got.where("negative_score > positive_score OR rank > 1").count() == 0 and got.groupBy("anchor_id").count().where("count <= 2").count() == 3


def test_cover_tree_holds_its_bounds():
    rng = np.random.default_rng(1)
    V = np.concatenate([rng.integers(-50, 50, (500, 5)), np.tile(rng.integers(-5, 5, 5), (90, 1)), 3 + rng.integers(0, 3, (300, 5))])
    longest2 = float((V * V).sum(1).max())
    A = H.augmented(V, longest2)
    order, nodes = H.cover_tree(A)
    assert sorted(order) == list(range(len(V)))
    assert np.allclose((A * A).sum(1), longest2)
    leaves = np.zeros(len(V), int)
    for c, r, parent, lo, hi, leaf, level in nodes:
        inside = order[int(lo):int(hi)]
        assert H.distances(A[int(c):int(c) + 1], A[inside]).max() <= r + 1e-6
        if parent >= 0:
            up = nodes[int(parent)]
            assert up[3] <= lo and hi <= up[4] and level == up[6] + 1
        leaves[inside] += int(leaf)
    assert (leaves == 1).all()


def test_narrow_windows_skip_leaves():
    """On clustered data a descent reaches few leaves."""
    rng = np.random.default_rng(3)
    mid = rng.integers(-300, 300, (40, 8))
    V = np.repeat(mid, 50, 0) + rng.integers(-3, 4, (2000, 8))
    order, nodes = H.cover_tree(H.augmented(V, float((V * V).sum(1).max())))
    zero = np.zeros(len(V), np.int64)
    tree = H.Tree(V[order], order, ["a"] * len(V), zero + 1, zero, order, nodes)
    Q = V[::100]
    exact = Q @ V.T
    lo, hi = np.sort(exact, 1)[:, -20:-19].astype(float), np.full((len(Q), 1), np.inf)
    who, leaf, _ = H.descend(tree, Q, np.sqrt((Q * Q).sum(1)), lo, hi)
    seen = sum(int(nodes[x, 4] - nodes[x, 3]) for x in leaf)
    assert seen < 0.25 * len(Q) * len(V)
    for a in range(len(Q)):
        held = {int(p) for x in leaf[who == a] for p in order[int(nodes[x, 3]):int(nodes[x, 4])]}
        assert set(np.flatnonzero(exact[a] >= lo[a, 0])) <= held


def test_slices_and_shelves(spark, tmp_path, monkeypatch):
    """Many slices of anchors and shelves of trees; some vectors too long for two bytes a component."""
    for name, x in (("BLOCK", 40), ("CHUNK", 2), ("LEAF", 4), ("SAMPLE", 64), ("SLICE", 3), ("SHELF", 2 * 40 * 6 * 8)):
        monkeypatch.setattr(H, name, x)
    rows = [(i * 4, [200 * e for e in x] if i % 9 == 0 else x, label) for i, x, label in table(random.Random(8), 700)]
    assert run(spark, rows, tmp_path) == brute(rows)


def plan_sums(df):
    """Bytes sent to Python and rows broadcast by an executed plan."""
    sums = {"pythonDataSent": 0, "numOutputRows": 0}

    def walk(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(node.plan())
        metrics = node.metrics()
        for name in sums:
            if metrics.contains(name) and (name != "numOutputRows" or kind == "BroadcastExchangeExec"):
                sums[name] += metrics.apply(name).value()
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return sums


def test_trees_are_sent_by_slice_and_anchors_not_broadcast(spark, monkeypatch):
    """Chunks that want the same tree share it; anchors times blocks are not broadcast, however small their file is."""
    for name, x in (("BLOCK", 20), ("CHUNK", 4), ("LEAF", 4), ("SHELF", 8 * 20 * 8 * 8)):
        monkeypatch.setattr(H, name, x, raising=False)
    rng = random.Random(6)
    some = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(120)]
    df = spark.createDataFrame([(i, some[i % 120], i % 3) for i in range(1200)], "id long, x array<double>, label int")
    forest = H.index(H.points(df, F.col("id"), F.col("label"), F.col("x"), 256.0), "shared")
    anchors = H.checkpoint_table(forest.points.where("id % 12 = 0").withColumns({"lo": F.array(F.lit(float("-inf"))), "hi": F.array(F.lit(float("inf")))}), spark, "shared-anchors")
    found = H.look(forest, H.chunks(anchors, 1), True, 5, 1, "all")
    assert len(found.collect()) >= 100 * 5
    sums = plan_sums(found)
    assert len(forest.centers) >= 50
    assert sums["numOutputRows"] <= 200 and sums["pythonDataSent"] < 1_000_000, sums    # the centres' counts; trees once, anchors once a shelf
