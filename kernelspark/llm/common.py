"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import checkpoint_table, ship_package


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fresh(columns: Iterable[str], base: str) -> str:
    """A column name that does not clash with ``columns`` (case-insensitively)."""
    used = {c.lower() for c in columns}
    name = base
    while name.lower() in used:
        name += "_"
    return name


def parts_of(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string or binary Arrow column; null is empty."""
    if pa.types.is_string(column.type):
        column = column.cast(pa.binary())
    return [b"" if t is None else t for t in column.to_pylist()]


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def components(n: int, a: np.ndarray, b: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
    """Smallest reachable index per node of a small graph (min labels, pointer jumping)."""
    lab = np.arange(n) if labels is None else labels.copy()
    while len(a):
        low = np.minimum(lab[a], lab[b])
        before = lab.copy()
        np.minimum.at(lab, lab[a], low)
        np.minimum.at(lab, lab[b], low)
        np.minimum.at(lab, a, low)
        np.minimum.at(lab, b, low)
        while True:
            jump = lab[lab]
            if np.array_equal(jump, lab):
                break
            lab = jump
        keep = lab[a] != lab[b]
        a, b = a[keep], b[keep]
        if np.array_equal(before, lab) and not len(a):
            break
    return lab


__all__ = ["batch", "checkpoint_table", "components", "fresh", "parts_of", "read", "ship_package", "texts"]
