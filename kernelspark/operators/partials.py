"""Tree sum of per-partition partial vectors (the DataFrame form of treeAggregate).

Operators that reduce N rows to a k-sized (or k²-sized) statistic emit ONE
row per input partition: ``v array<double>``. ``tree_sum`` folds those rows in
≈ √P tasks (a shuffle of P array rows, never P × V scalar rows), then the
driver adds the ≈ √P vectors. Memory is bounded by the statistic's size V,
not by N.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "v array<double>"
#: Vectors that one task adds up in a round.
FAN = 32


def emit(vec: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"v": [np.asarray(vec, dtype=np.float64)]})


def emit_arrow(vec: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([np.asarray(vec, dtype=np.float64)])], ["v"])


def tree_sum(partials: DataFrame, size: int, direct_cells: int = 4_000_000, parts: int | None = None) -> np.ndarray:
    """Sum the ``v`` arrays of ``partials`` (one row per partition) into one vector.

    ``parts``: the number of partitions where it is known; asking Spark plans the job once more.

    Rows are folded in rounds of FAN to one, until what is left fits ``direct_cells``
    numbers (or is one row); only that reaches the driver.
    """
    def fold(batches):
        acc = np.zeros(size)
        seen = False
        for pdf in batches:
            for v in pdf["v"]:
                acc += np.asarray(v, dtype=np.float64)
                seen = True
        if seen:
            yield emit(acc)

    n_parts = partials.rdd.getNumPartitions() if parts is None else parts
    while n_parts > 1 and n_parts * size > direct_cells:
        n_parts = max(1, math.ceil(n_parts / FAN))
        partials = partials.repartition(n_parts).mapInPandas(fold, SCHEMA)
    out = np.zeros(size)
    for r in partials.collect():
        out += np.asarray(r["v"], dtype=np.float64)
    return out


def _triangle(rows: np.ndarray) -> np.ndarray:
    """The R of a QR, filled up with zero rows to a square."""
    R = np.linalg.qr(rows, mode="r")
    return np.vstack([R, np.zeros((rows.shape[1] - len(R), rows.shape[1]))])


def tree_qr(src: DataFrame, width: int, matrix_of) -> np.ndarray:
    """R of the QR of all rows, without the Gram matrix and its squared condition number.

    Each partition folds its batches (``matrix_of(pdf)`` has ``width`` columns) into one
    triangle; triangles are stacked and factored again, FAN to one, until one task's worth is
    left for the driver. Small singular values keep their relative size.
    """
    def part(batches):
        R = None
        for pdf in batches:
            if len(pdf):
                M = np.asarray(matrix_of(pdf), dtype=np.float64)
                R = _triangle(M if R is None else np.vstack([R, M]))
        if R is not None:
            yield emit(R.ravel())

    def fold(batches):
        R = None
        for pdf in batches:
            for v in pdf["v"]:
                M = np.asarray(v, dtype=np.float64).reshape(width, width)
                R = M if R is None else _triangle(np.vstack([R, M]))
        if R is not None:
            yield emit(R.ravel())

    tri = src.mapInPandas(part, SCHEMA)
    n_parts = tri.rdd.getNumPartitions()
    while n_parts > FAN:
        n_parts = math.ceil(n_parts / FAN)
        tri = tri.repartition(n_parts).mapInPandas(fold, SCHEMA)
    R = np.zeros((width, width))
    for r in tri.collect():                      # at most FAN triangles
        R = _triangle(np.vstack([R, np.asarray(r["v"], dtype=np.float64).reshape(width, width)]))
    return R


# Every NumPy array shipped to executors goes through this check: pivots, Cholesky
# factors, draw batches, samples and landmarks are sized by run parameters
# (k, b, S, m), never by the data, and the bound below makes that explicit.
MAX_BROADCAST_CELLS = 8_000_000      # 64 MB of doubles per broadcast


def bounded_broadcast(spark_or_sc, arr, what: str, max_cells: int = MAX_BROADCAST_CELLS):
    a = np.asarray(arr, dtype=np.float64)
    if a.size > max_cells:
        raise ValueError(f"{what}: {a.shape} ({a.size} cells) exceeds the broadcast bound of {max_cells} cells")
    sc = getattr(spark_or_sc, "sparkContext", spark_or_sc)
    return sc.broadcast(a)
