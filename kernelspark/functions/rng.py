"""Keyed random numbers that Spark and DuckDB compute bit-identically.

``u01(id, draw, seed)`` takes the first 13 hex digits (52 bits) of
``md5('<id>:<draw>:<seed>')`` and divides by 2**52, so it is in [0, 1). It
depends only on the key, never on partitioning or task order, so retries and
re-plans reproduce the same sample. ``rand()`` is never used.

``fast_u01`` is the same idea on ``xxhash64`` (cheaper, JVM-native) for
rows-only operators that have no SQL oracle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO52 = 4503599627370496.0  # 2**52


def _key(id_col: Column, draw, seed) -> Column:
    d = draw if isinstance(draw, Column) else F.lit(str(draw))
    s = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.concat_ws(":", id_col.cast("string"), d.cast("string"), s.cast("string"))


def u01(id_col, draw=0, seed=42) -> Column:
    """Uniform in [0,1) from md5 of the key."""
    id_col = F.col(id_col) if isinstance(id_col, str) else id_col
    h = F.conv(F.substring(F.md5(_key(id_col, draw, seed)), 1, 13), 16, 10).cast("bigint")
    return h / F.lit(TWO52)


def u01_open(id_col, draw=0, seed=42) -> Column:
    """Uniform strictly inside (0,1): (h + 1/2) / 2**52."""
    return u01(id_col, draw, seed) + F.lit(0.5 / TWO52)


def gumbel(id_col, draw=0, seed=42) -> Column:
    return -F.log(-F.log(u01_open(id_col, draw, seed)))


def std_normal(id_col, draw=0, seed=42) -> Column:
    """Box-Muller on two keyed uniforms (draw keys 2*draw and 2*draw+1)."""
    id_col = F.col(id_col) if isinstance(id_col, str) else id_col
    if isinstance(draw, Column):
        d1, d2 = draw * 2, draw * 2 + 1
    else:
        d1, d2 = 2 * int(draw), 2 * int(draw) + 1
    r = F.sqrt(F.lit(-2.0) * F.log(u01_open(id_col, d1, seed)))
    return r * F.cos(F.lit(2 * math.pi) * u01(id_col, d2, seed))


def fast_u01(*cols) -> Column:
    """Uniform in (0,1) from xxhash64 of the given columns/literals."""
    h = F.xxhash64(*[c if isinstance(c, Column) else F.lit(c) for c in cols])
    # keep 52 bits: shiftright of the unsigned value
    bits = F.shiftrightunsigned(h, 12)
    return (bits.cast("double") + F.lit(0.5)) / F.lit(TWO52)


def fast_gumbel(*cols) -> Column:
    return -F.log(-F.log(fast_u01(*cols)))


# --- DuckDB text of the same numbers (for oracle SQL) -----------------------

def u01_sql(id_expr: str, draw="0", seed="42") -> str:
    return (f"(('0x' || substr(md5(concat_ws(':', CAST({id_expr} AS VARCHAR), "
            f"CAST({draw} AS VARCHAR), CAST({seed} AS VARCHAR))), 1, 13))::BIGINT "
            f"/ 4503599627370496.0::DOUBLE)")


def u01_open_sql(id_expr: str, draw="0", seed="42") -> str:
    return f"({u01_sql(id_expr, draw, seed)} + {0.5 / TWO52!r})"


def gumbel_sql(id_expr: str, draw="0", seed="42") -> str:
    return f"(-ln(-ln({u01_open_sql(id_expr, draw, seed)})))"


def u01_py(key_id, draw=0, seed=42) -> float:
    """Pure-Python twin (tests, driver-side draws of small k-vectors)."""
    import hashlib

    h = hashlib.md5(f"{key_id}:{draw}:{seed}".encode()).hexdigest()[:13]
    return int(h, 16) / TWO52


def std_normal_py(key_id, draw=0, seed=42) -> float:
    u1 = u01_py(key_id, 2 * draw, seed) + 0.5 / TWO52
    u2 = u01_py(key_id, 2 * draw + 1, seed)
    return math.sqrt(-2.0 * math.log(u1)) * math.cos(2 * math.pi * u2)


# --- vectorised keyed numbers for Arrow batches (rows-only operators) ----------------

def _mix64_np(z):
    import numpy as np

    z = z.astype(np.uint64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def keyed_uniform_np(ids, n_draws: int, seed: int, stream: int = 0):
    """(len(ids) × n_draws) uniforms in (0, 1), a pure function of (seed, stream, id, draw)."""
    import numpy as np

    ids = np.asarray(ids, dtype=np.int64).astype(np.uint64)
    draws = np.arange(n_draws, dtype=np.uint64)
    with np.errstate(over="ignore"):
        base = _mix64_np(np.array([(seed * 1_000_003 + stream) & 0xFFFFFFFFFFFF], dtype=np.uint64))[0]
        h = _mix64_np(_mix64_np(ids[:, None] * np.uint64(0x9E3779B97F4A7C15) + base)
                      + draws[None, :] * np.uint64(0xD1B54A32D192ED03))
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) / 9007199254740992.0


def keyed_normal_np(ids, n_draws: int, seed: int):
    """Standard normals by Box–Muller on two keyed uniform streams."""
    import numpy as np

    u1 = keyed_uniform_np(ids, n_draws, seed, 1)
    u2 = keyed_uniform_np(ids, n_draws, seed, 2)
    return np.sqrt(-2.0 * np.log(u1)) * np.cos(2.0 * np.pi * u2)
