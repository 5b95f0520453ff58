"""Registry of named queries: a Spark builder and, where SQL can say it, DuckDB text.

Output convention on both sides: every floating column is rounded to 6
decimals and has ``+ 0.0`` added (no −0.0), so the driver's value hash does not
see last-digit summation-order noise.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGITS = 6


@dataclass
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None
    doubles: tuple[str, ...] = field(default_factory=tuple)
    op_ids: tuple[str, ...] = field(default_factory=tuple)

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        if not self.doubles:
            return self.sql
        rep = ", ".join(f"round({c}, {DIGITS}) + 0.0 AS {c}" for c in self.doubles)
        return f"SELECT * REPLACE ({rep}) FROM ({self.sql}) AS _q"


REGISTRY: dict[str, Query] = {}


def finish(df: DataFrame) -> DataFrame:
    """Round floating columns to DIGITS decimals (+0.0)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append((F.round(F.col(f.name).cast("double"), DIGITS) + F.lit(0.0)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def register(name: str, sql: str | None = None, doubles=(), ops=()):
    def deco(fn):
        def build(spark, sf_dir):
            return finish(fn(spark, sf_dir))
        build.__name__ = fn.__name__
        build.__doc__ = fn.__doc__
        REGISTRY[name] = Query(name, build, sql, tuple(doubles), tuple(ops))
        return fn
    return deco


def load_all() -> dict[str, Query]:
    # importing the plan modules fills REGISTRY
    from . import q_chains, q_closed, q_lowrank, q_metrics, q_posterior, q_prep, q_quality, q_sources  # noqa: F401

    return REGISTRY
