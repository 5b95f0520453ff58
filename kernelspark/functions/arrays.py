"""Array maths as Catalyst higher-order functions (JVM-side, codegen-friendly).

Vectors live in ``array<double>`` columns. Every function takes Columns (or
column names) and returns a Column; nothing leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_double(a) -> Column:
    return col(a).cast("array<double>")


def lit_vector(values: Sequence[float]) -> Column:
    """A small driver-side vector as an array<double> literal."""
    return F.array(*[F.lit(float(v)) for v in values])


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, v: acc + v)


def dot(a, b) -> Column:
    return _sum(F.zip_with(col(a), col(b), lambda x, y: x * y))


def sqdist(a, b) -> Column:
    """Explicit-difference squared distance (the stable form)."""
    return _sum(F.zip_with(col(a), col(b), lambda x, y: (x - y) * (x - y)))


def l1dist(a, b) -> Column:
    return _sum(F.zip_with(col(a), col(b), lambda x, y: F.abs(x - y)))


def norm2(a) -> Column:
    return _sum(F.transform(col(a), lambda x: x * x))


def sqdist_expanded(a, b, na=None, nb=None) -> Column:
    """Norm-expansion form ‖a‖²+‖b‖²−2a·b, clamped at 0."""
    na = norm2(a) if na is None else col(na)
    nb = norm2(b) if nb is None else col(nb)
    return F.greatest(na + nb - F.lit(2.0) * dot(a, b), F.lit(0.0))


def scale(a, s) -> Column:
    s = s if isinstance(s, Column) else F.lit(float(s))
    return F.transform(col(a), lambda x: x * s)


def axpy(alpha, x, y) -> Column:
    """alpha*x + y elementwise."""
    alpha = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    return F.zip_with(col(x), col(y), lambda u, v: alpha * u + v)


def sub(a, b) -> Column:
    return F.zip_with(col(a), col(b), lambda x, y: x - y)


def add(a, b) -> Column:
    return F.zip_with(col(a), col(b), lambda x, y: x + y)


def mul(a, b) -> Column:
    return F.zip_with(col(a), col(b), lambda x, y: x * y)


def array_sum(a) -> Column:
    return _sum(col(a))


# --- DuckDB text twins (oracle SQL) -------------------------------------------

def dot_sql(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2]))"


def sqdist_sql(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def l1dist_sql(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: abs(z[1] - z[2])))"


def norm2_sql(a: str) -> str:
    return f"list_sum(list_transform({a}, lambda x: x * x))"
