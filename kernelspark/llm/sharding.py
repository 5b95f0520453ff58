"""Sharding by a Feistel permutation of global row numbers, DataFrame functions only.

Law ``rows``: row number r of n goes to place p = permute(r); shard = p mod shards and
slot = p div shards, so shard sizes differ by at most one and slots have no gaps. Both
can be computed from a row number alone, and rows of neighbouring numbers land apart.

Global row numbers order the rows by (bucket, all columns), where the bucket is a hash
of the columns: no sampling decides them, so equal input gives equal numbers however the
files are split. Equal rows are counted before the shuffle (a row repeated over a third
of the table is one counted row) and numbered apart afterwards.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint_table, fresh, read

ROUNDS = 6
#: Numbering buckets: about this many rows in each, and at most MAX_BUCKETS of them (their
#: totals, 16 bytes each, are the one small table that is broadcast).
BUCKET_ROWS, MAX_BUCKETS = 4_000, 65_536
#: Equal rows are numbered apart in blocks, so that no array grows with their count.
BLOCK = 65_536


def _round_trip(place: Column, height: int, width: int, seed: int) -> Column:
    """One alternating Feistel network over [0, height * width): each round adds a hash of one half to the other."""
    state = F.struct(F.call_function("div", place, F.lit(width).cast("long")).alias("up"), (place % F.lit(width).cast("long")).alias("low"))

    def step(s, r):
        def stir(half, size):
            return F.pmod(F.xxhash64(half, r, F.lit(seed)), F.lit(size)).cast("long")

        return F.when(r % 2 == 0, F.struct(((s["up"] + stir(s["low"], height)) % height).alias("up"), s["low"].alias("low"))) \
            .otherwise(F.struct(s["up"].alias("up"), ((s["low"] + stir(s["up"], width)) % width).alias("low")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), state, step, lambda s: s["up"] * width + s["low"])


def permute(row: Column, n: int, seed: int = 42) -> Column:
    """Bijection of [0, n): the network permutes height * width >= n places and is walked
    along its cycle until it lands below n.

    At most ``spare = height * width - n`` places lie outside, so spare + 1 steps always
    end. Where that is many, so many steps are taken that the chance of a walk not ending
    is below 2**-100; such a row would raise an error, never get a wrong place.
    """
    n = max(n, 1)
    height = math.isqrt(n - 1) + 1
    width = -(-n // height)
    spare = height * width - n
    steps = spare + 1
    if spare:
        steps = min(steps, math.ceil(100 / math.log2(height * width / spare)) + 1)
    place = _round_trip(row.cast("long"), height, width, seed)
    if steps > 1:
        place = F.aggregate(F.sequence(F.lit(2), F.lit(steps)), place,
                            lambda p, _: F.when(p < n, p).otherwise(_round_trip(p, height, width, seed)))
        place = F.when(place < n, place).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("long"))
    return place


def number_rows(df: DataFrame, out: str, seed: int = 42) -> tuple[DataFrame, int]:
    """df with a gapless global row number ``out`` (0-based) and the row count.

    Columns must be orderable. Equal rows get different numbers; nulls are values like
    any other. An empty table gives an empty table.
    """
    spark, cols = df.sparkSession, df.columns
    many, bucket, start, base, block, within = (fresh([*cols, out], f"__{x}") for x in ("many", "bucket", "start", "base", "block", "within"))
    counted = checkpoint_table(df.groupBy(*cols).agg(F.count(F.lit(1)).alias(many)), spark, "shard-rows")
    n = counted.agg(F.sum(many)).first()[0] or 0
    size = max(1, min(MAX_BUCKETS, n // BUCKET_ROWS))
    counted = counted.withColumn(bucket, F.pmod(F.xxhash64(*cols, F.lit(seed)), F.lit(size)).cast("int"))
    totals = counted.groupBy(bucket).agg(F.sum(many).alias(base))
    totals = totals.select(bucket, (F.sum(base).over(Window.orderBy(bucket)) - F.col(base)).alias(base))
    order = Window.partitionBy(bucket).orderBy(*cols).rowsBetween(Window.unboundedPreceding, 0)
    numbered = counted.withColumn(start, F.sum(many).over(order) - F.col(many)).join(F.broadcast(totals), bucket)
    numbered = numbered.withColumn(block, F.explode(F.sequence(F.lit(0).cast("long"), (F.col(many) - 1).cast("long"), F.lit(BLOCK).cast("long"))))
    numbered = numbered.withColumn(within, F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(BLOCK), F.col(many) - F.col(block)).cast("long") - 1)))
    return numbered.select(*cols, (F.col(base) + F.col(start) + F.col(block) + F.col(within)).alias(out)), n


def shard(df: DataFrame, shards: int, seed: int = 42, shard_col: str = "shard", slot_col: str = "slot") -> DataFrame:
    """df with ``shard`` (int, 0 to shards - 1) and ``slot`` (long, gapless from 0 in each shard).

    Existing columns of those names raise ValueError. Nulls, repeated rows and empty
    tables are allowed (see number_rows).
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    if clash := {shard_col.lower(), slot_col.lower()} & {c.lower() for c in df.columns}:
        raise ValueError(f"columns exist already: {sorted(clash)}")
    row = fresh([*df.columns, shard_col, slot_col], "__row")
    numbered, n = number_rows(df, row, seed)
    placed = numbered.withColumn(row, permute(F.col(row), n, seed))
    return placed.select(*df.columns, (F.col(row) % shards).cast("int").alias(shard_col), F.call_function("div", F.col(row), F.lit(shards).cast("long")).alias(slot_col))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into shards 0 to 39 by law ``rows``; a null text has no bytes and crc32 0."""
    rows = read(spark, sf_dir, "documents").select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.coalesce(F.crc32(F.encode("text", "utf-8")), F.lit(0)).cast("long").alias("text_crc32"))
    return shard(rows, 40).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
