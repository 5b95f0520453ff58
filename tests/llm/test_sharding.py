import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from kernelspark.llm import sharding


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def spark_hash(*values):
    """XXH64 of longs and ints as Spark chains them."""
    h = 42
    for kind, v in values:
        h = xxhash.xxh64_intdigest(struct.pack(kind, v), h)
    return signed(h)


def place(row, n, seed=42):
    import math

    height = max(1, math.isqrt(max(n - 1, 0)) + 1)
    width = max(1, -(-n // height))
    while True:
        up, low = divmod(row, width)
        for r in range(sharding.ROUNDS):
            if r % 2 == 0:
                up = (up + spark_hash(("<q", low), ("<i", r), ("<i", seed)) % height) % height
            else:
                low = (low + spark_hash(("<q", up), ("<i", r), ("<i", seed)) % width) % width
        row = up * width + low
        if row < n:
            return row


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 4999])
def test_permutation_is_the_feistel_network_and_a_bijection(spark, n):
    got = {r.id: r.p for r in spark.range(n).select("id", sharding.permute(F.col("id"), n).alias("p")).collect()}
    assert sorted(got.values()) == list(range(n))
    for row in list(range(min(n, 50))) + [n - 1]:
        assert got[row] == place(row, n)


def test_shards_are_even_and_slots_gapless(docs):
    rows = sharding.shard(docs.select("doc_id", "text"), 7).collect()
    assert len(rows) == docs.count()
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    sizes = [len(v) for v in by.values()]
    assert max(sizes) - min(sizes) <= 1 and set(by) == set(range(7))
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_result_does_not_depend_on_the_layout(docs):
    a = sharding.shard(docs.select("doc_id", "text"), 5).collect()
    b = sharding.shard(docs.select("doc_id", "text").repartition(2, "text"), 5).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))


def test_many_equal_rows_are_numbered_apart(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK", 8)
    df = spark.createDataFrame([(None, "a")] * 50 + [(1, "b")] * 3, "k long, t string")
    numbered, n = sharding.number_rows(df, "row")
    assert n == 53 and sorted(r["row"] for r in numbered.collect()) == list(range(53))


def test_empty_table_and_clashing_names(spark, no_docs):
    assert sharding.shard(no_docs, 4).collect() == []
    with pytest.raises(ValueError):
        sharding.shard(spark.createDataFrame([(1, 2)], "Shard int, x int"), 4)
    odd = sharding.shard(spark.createDataFrame([(1, 2)], "__many int, __bucket int"), 1).collect()
    assert [tuple(r) for r in odd] == [(1, 2, 0, 0)]
