"""Products of two tables of any size on a grid of (left block, right block) cells.

Both sides are dealt into blocks by a hash of the key. The rows of a left block are repeated
for every right block and the other way round, and one shuffle brings the two of a cell
together as a group: the plan has one size at any row count, no side passes through the
driver or is broadcast, and a task holds one cell's two blocks at a time. A shuffle
partition gets about one cell and cells grow to a fixed size, so more rows give more tasks
and no longer ones. What a cell gives back is either its long form or partial sums, which are
added by id.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..session import checkpoint_table

#: Feature values of a block.
GRID_CELLS = 1 << 18
#: The same where a cell gives back one number a row.
SUM_CELLS = 1 << 20
#: Cells that a product is cut into while they have at least LEAST_PAIRS row pairs, pairs of a cell
#: and shuffle partitions at most.
BUSY, LEAST_PAIRS, MOST_PAIRS, MOST_PARTS = 64, 1 << 22, 1 << 28, 20_000
#: Row pairs of a long form's cell; rows of either side whose kernel values are held at once for sums.
LONG_PAIRS, TILE = 1 << 20, 512


def stored_side(df: DataFrame, key: str, features: str, *more) -> DataFrame:
    x = df.select(F.col(key).alias("key"), F.col(features).cast("array<double>").alias("x"), *more)
    return checkpoint_table(x, df.sparkSession, "grid-side")


def _shape(side: DataFrame) -> tuple[int, int]:
    """Rows and features."""
    n, width = side.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    return n, max(1, width or 1)


def _cells(left: DataFrame, right: DataFrame, make, schema: T.StructType, pairs: tuple[int, int], cells: int) -> DataFrame:
    """``make(left block, right block)``, two tables, of every cell; blocks have at most ``cells`` feature values, cells
    between the two of ``pairs`` row pairs."""
    (n, width), (m, _) = _shape(left), _shape(right)
    rows = min(math.isqrt(min(max(n * m // BUSY, pairs[0]), pairs[1])), cells // width)
    na, nb = (max(1, -(-count // max(1, rows))) for count in (n, m))

    def dealt(side: DataFrame, own: str, count: int, other: str, others: int) -> DataFrame:
        block = F.pmod(F.xxhash64("key"), F.lit(count)).cast("int").alias(own)
        out = side.select(block, F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other), *side.columns)
        return out.repartition(min(na * nb, MOST_PARTS), "i", "j").groupBy("i", "j")

    def cell(a: pa.Table, b: pa.Table) -> pa.Table:
        if not (a.num_rows and b.num_rows):
            return empty
        return pa.Table.from_arrays(make(a, b), names)

    names = schema.names
    empty = pa.table({f.name: pa.array([], to_arrow_type(f.dataType)) for f in schema})
    return dealt(left, "i", na, "j", nb).cogroup(dealt(right, "j", nb, "i", na)).applyInArrow(cell, schema)


def self_cells(side: DataFrame, least_rows: int = 256) -> tuple[int, DataFrame]:
    """(rows, cells) of a stored side with itself: (same, left, right), each pair of blocks once.

    Blocks are small enough to keep some sixty of them busy, and no larger than ``GRID_CELLS``.
    """
    n, width = side.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    per = max(1, min(max(least_rows, n // 64), GRID_CELLS // max(1, width or 1)))
    count = max(1, -(-n // per))
    dealt = side.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(count)).cast("int"))
    blocks = dealt.groupBy("block").agg(F.collect_list(F.struct("x")).alias("rows"))
    over = lambda lo, hi: F.explode(F.sequence(lo, hi))
    a = blocks.select(F.col("block").alias("i"), over(F.col("block"), F.lit(count - 1)).alias("j"), F.col("rows").alias("left"))
    b = blocks.select(over(F.lit(0), F.col("block")).alias("i"), F.col("block").alias("j"), F.col("rows").alias("right"))
    return n, a.join(b, ["i", "j"]).select((F.col("i") == F.col("j")).alias("same"), "left", "right")


def block_pairs(batches):
    """(same, X, Y) of the cells in Arrow batches of ``self_cells``."""
    for got in batches:
        for i in range(got.num_rows):
            yield got.column(0)[i].as_py(), _rows(got.column(1)[i].values)["x"], _rows(got.column(2)[i].values)["x"]


def _rows(block: pa.StructArray | pa.Table) -> dict:
    if isinstance(block, pa.Table):
        block = block.combine_chunks()
        cols = {name: col.chunk(0) for name, col in zip(block.column_names, block.columns, strict=True)}
    else:
        cols = dict(zip([f.name for f in block.type], block.flatten(), strict=True))
    flat = np.asarray(cols["x"].flatten(), dtype=np.float64)
    cols["x"] = flat.reshape(len(block), len(flat) // len(block))
    return cols


def _tiles(block: pa.Table):
    """``_rows`` of at most TILE rows at a time, read where they lie: a block is not put together first."""
    for batch in block.to_batches():
        for lo in range(0, batch.num_rows, TILE):
            yield _rows(pa.Table.from_batches([batch.slice(lo, TILE)]))


def long_form(left: DataFrame, right: DataFrame, block, key: str, features: str, names=("i", "j", "k"), cells: int | None = None) -> DataFrame:
    """(i, j, value) of all pairs; ``block(X, Y)`` gives the values of a cell."""
    schema = T.StructType([T.StructField(names[0], left.schema[key].dataType), T.StructField(names[1], right.schema[key].dataType), T.StructField(names[2], T.DoubleType())])

    def make(a, b):
        a, b = _rows(a), _rows(b)
        n, m = len(a["x"]), len(b["x"])
        return [a["key"].take(pa.array(np.repeat(np.arange(n), m))), b["key"].take(pa.array(np.tile(np.arange(m), n))), pa.array(np.ascontiguousarray(block(a["x"], b["x"])).ravel())]

    return _cells(stored_side(left, key, features), stored_side(right, key, features), make, schema, (LONG_PAIRS, LONG_PAIRS), cells or GRID_CELLS)


def weighted_sums(train: DataFrame, test: DataFrame, block, weight: str, key: str, features: str, out: str, cells: int | None = None) -> DataFrame:
    """(id, out): Σ over train of block(test row, train row) · weight; 0 when train is empty."""
    # the key only deals train rows to blocks
    own = train.withColumn("_key", F.xxhash64(features, weight) if key not in train.columns else F.col(key))
    left = stored_side(test, key, features)
    right = stored_side(own, "_key", features, F.col(weight).cast("double").alias("w"))

    def make(a, b):
        sums, done, right = np.zeros(a.num_rows), 0, [(y["x"], np.asarray(y["w"], dtype=np.float64)) for y in _tiles(b)]
        for x in _tiles(a):
            own = sums[done:done + len(x["x"])]
            for y, w in right:
                own += block(x["x"], y) @ w
            done += len(own)
        return [a["key"].cast(pa.int64()), pa.array(sums)]

    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("s", T.DoubleType())])
    parts = _cells(left, right, make, schema, (LEAST_PAIRS, MOST_PAIRS), cells or SUM_CELLS)
    zero = left.select(F.col("key").cast("long").alias("id"), F.lit(0.0).alias("s"))
    return parts.unionByName(zero).groupBy("id").agg(F.sum("s").alias(out))
