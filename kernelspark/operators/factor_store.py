"""The state of a pivoted Cholesky run: rows (id, x, g, d) on the executors.

``g`` holds the factor columns found so far and ``d`` the residual diagonal. Columns are only
ever appended: for a block of b new pivots every row adds

    c = (k(x, P_new) − g · F_newᵀ) L_new⁻ᵀ,     d ← max(d − ‖c‖², 0)

which costs O(d + k) a pivot and row: no earlier column is rebuilt and no k × k system is
solved. Pivots collect in a pending block first, whose columns a pass works out on the fly;
when it has ``BLOCK`` pivots, its columns are appended and the rows are written to the shared
checkpoint folder in place of the table before. So a pass costs the same whatever the rank,
plans stay small, and a lost executor costs one pass. Python sees batches of (x, g) and gives
back numbers; vectors are held as bytes, which neither side takes apart. What is broadcast is
b × (d + k + b).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import rng
from ..session import checkpoint_table, discard_tables, last_table
from .partials import bounded_broadcast

#: Winners of partitions are merged in rounds of FAN partitions to one until this many rows are left.
DIRECT_ROWS, FAN = 100_000, 32
#: Pivots of a pending block.
BLOCK = 64
_PICK = "slot int, k1 double, k2 long, id long, d double, g double"


def fast_gumbel_np(ids: np.ndarray, rnd: int, draw: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = rng._mix64_np(ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                          + rng._mix64_np(np.full(len(ids), (seed * 1_000_003 + rnd) * 65_537 + draw,
                                                  dtype=np.uint64)))
    u = ((h >> np.uint64(12)).astype(np.float64) + 0.5) / 4503599627370496.0
    return -np.log(-np.log(u))


def matrix(column: pa.Array, kind) -> np.ndarray:
    """A binary Arrow column of equally long rows as a matrix of doubles."""
    n = len(column)
    if not n:
        return np.zeros((0, 0))
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + n + 1]
    width = int(at[1] - at[0])
    if (np.diff(at) != width).any():
        raise ValueError("vectors of different lengths")
    if not width:
        return np.zeros((n, 0))
    flat = np.frombuffer(column.buffers()[2], np.uint8)[at[0]:at[n]]
    return flat.view(kind).reshape(n, -1).astype(np.float64)


def packed(M: np.ndarray) -> pa.Array:
    """The rows of a matrix as a binary Arrow column."""
    M = np.ascontiguousarray(M)
    width = M.shape[1] * M.itemsize
    at = np.arange(len(M) + 1, dtype=np.int32) * np.int32(width)
    return pa.Array.from_buffers(pa.binary(), len(M), [None, pa.py_buffer(at), pa.py_buffer(M)])


def _listed(column: pa.Array, kind) -> np.ndarray:
    """An Arrow list column of equally long rows as a matrix."""
    n = len(column)
    flat = np.asarray(column.flatten(), dtype=kind)
    if n and (np.diff(column.offsets) != len(flat) // n).any():
        raise ValueError("vectors of different lengths")
    return flat.reshape(n, len(flat) // n if n else 0)


def _keep(slot: np.ndarray, k1: np.ndarray, k2: np.ndarray, keep: int) -> np.ndarray:
    """Positions of the first ``keep`` rows of each slot, larger keys first."""
    order = np.lexsort((-k2, -k1, slot))
    s = slot[order]
    return order[np.arange(len(s)) - np.searchsorted(s, s) < keep]


def new_columns(kernel, X: np.ndarray, G: np.ndarray, P: np.ndarray, old: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Columns of a block of pivots for rows X with earlier columns G."""
    C = kernel.block(X, P)
    if old.shape[1]:
        C = C - G @ old.T
    for j in range(len(low)):
        if j:
            C[:, j] -= C[:, :j] @ low[j, :j]
        C[:, j] /= low[j, j]
    return C


class FactorStore:
    def __init__(self, points: DataFrame, kernel, key: str = "id", features: str = "features"):
        dt = points.schema[features].dataType
        elem = getattr(dt, "elementType", None)
        x = F.col(features) if isinstance(elem, (T.FloatType, T.DoubleType)) else F.col(features).cast("array<double>")
        self.kernel = kernel
        self.spark = points.sparkSession
        self.points = points.select(F.col(key).cast("long").alias("id"), x.alias("x"))   # float32 stays float32 at rest

        self.kind = kind = np.dtype("<f4" if isinstance(elem, T.FloatType) else "<f8")

        @F.arrow_udf("struct<x: binary, d: double>")
        def begin(x: pa.Array) -> pa.Array:
            X = _listed(x, kind)
            d = np.asarray(kernel.diag_np(X.astype(np.float64)), dtype=np.float64)
            return pa.StructArray.from_arrays([packed(X), pa.array(d)], ["x", "d"])

        start = self.points.select("id", begin("x").alias("r"))
        self.state = start.select("id", "r.x", F.lit(b"").alias("g"), "r.d").persist(StorageLevel.MEMORY_AND_DISK)
        self.written, self.path = 0, ""              # columns of g, and where the rows are stored
        self.pending: list[tuple] = []               # (x, factor row, residual) of pivots without a column
        self._sent: list = []

    @property
    def k(self) -> int:
        return self.written + len(self.pending)

    # ---- columns ----------------------------------------------------------------
    def extend(self, X, fvecs: list, resid: list) -> None:
        """Accepted pivots in order: their rows, factor rows over all earlier pivots, residuals."""
        for new in zip(X, fvecs, resid, strict=True):
            self.pending.append(new)
            if len(self.pending) == BLOCK:
                self._write()

    def _block(self):
        """The pending block (P_new, F_new, L_new) as broadcasts."""
        k, b = self.written, len(self.pending)
        X = np.array([p[0] for p in self.pending], dtype=np.float64)
        old = np.array([p[1][:k] for p in self.pending], dtype=np.float64).reshape(b, k)
        low = np.zeros((b, b))
        for j, (_, f, resid) in enumerate(self.pending):
            low[j, :j] = f[k:k + j]
            low[j, j] = math.sqrt(resid)
        for value in self._sent:
            value.destroy()
        self._sent = [bounded_broadcast(self.spark, a, what) for a, what in ((X, "new pivots"), (old, "their factor rows"), (low, "their Cholesky block"))]
        return self._sent

    def _write(self) -> None:
        sent, kernel, kind = self._block(), self.kernel, self.kind

        @F.arrow_udf("struct<c: binary, s: double>")
        def columns(x: pa.Array, g: pa.Array) -> pa.Array:
            C = new_columns(kernel, matrix(x, kind), matrix(g, "<f8"), *[v.value for v in sent])
            return pa.StructArray.from_arrays([packed(C), pa.array(np.einsum("ij,ij->i", C, C))], ["c", "s"])

        added = self.state.withColumn("r", columns("x", "g"))
        rows = added.select("id", "x", F.concat("g", "r.c").alias("g"), F.greatest(F.col("d") - F.col("r.s"), F.lit(0.0)).alias("d"))
        stored = checkpoint_table(rows, self.spark, "factor-state")
        self.close()
        self.state, self.path = stored, last_table(self.spark)
        self.written += len(self.pending)
        self.pending = []

    def rows(self, *extra):
        """(DataFrame, reader): the reader turns a batch into (ids, factor columns, residuals, batch)."""
        kernel, kind, sent = self.kernel, self.kind, self._block() if self.pending else None

        def read(got):
            G, d = matrix(got.column(2), "<f8"), np.asarray(got.column(3))
            if sent:
                C = new_columns(kernel, matrix(got.column(1), kind), G, *[v.value for v in sent])
                G, d = np.column_stack([G, C]), np.maximum(d - np.einsum("ij,ij->i", C, C), 0.0)
            return np.asarray(got.column(0)), G, d

        return self.state.select("id", "x", "g", "d", *extra), read

    def columns_df(self) -> DataFrame:
        """(id, f, residual) with the columns as arrays."""
        source, read = self.rows()
        self._sent = []                              # a lazy result keeps its broadcasts

        def run(batches):
            for got in batches:
                ids, G, d = read(got)
                at = pa.array(np.arange(len(G) + 1, dtype=np.int32) * np.int32(G.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(at, pa.array(G.ravel())), pa.array(d)], ["id", "f", "residual"])

        return source.mapInArrow(run, "id long, f array<double>, residual double")

    def close(self) -> None:
        """Release the stored rows."""
        self.state.unpersist()
        discard_tables(self.spark, [self.path])

    # ---- pivots ------------------------------------------------------------------
    def pick(self, rule: str, keep: int, slots: int = 1, first: int = 0, seed: int = 42):
        """The ``keep`` best rows of each slot and (Σd, max d, n).

        greedy: key d (one slot). rp: key ln d + md5 Gumbel noise of round ``first + slot``.
        iid: the same with fast noise of (round ``first``, draw ``slot``). Ties go to the lowest
        id. Returns ({slot: [(key, id, d, noise)]}, Σd, max d, n).
        """
        noise = [rng.gumbel(F.col("id"), first + s, seed).alias(f"_g{s}") for s in range(slots)] if rule == "rp" else []
        plain = not self.pending
        source, read = (self.state.select("id", "d", *noise), None) if plain else self.rows(*noise)

        def best(batches):
            held = [np.empty(0, t) for t in (np.int32, np.float64, np.int64, np.int64, np.float64, np.float64)]
            tr, dmax, n = 0.0, 0.0, 0
            for got in batches:
                if got.num_rows == 0:
                    continue
                ids, d = (np.asarray(got.column(0)), np.asarray(got.column(1))) if plain else read(got)[::2]
                tr, dmax, n = tr + float(d.sum()), max(dmax, float(d.max())), n + len(d)
                with np.errstate(divide="ignore"):
                    ld = np.log(d) if rule != "greedy" else d
                fresh = [held]
                for s in range(slots):
                    if rule == "greedy":
                        g, key = np.zeros(len(d)), d
                    else:
                        g = np.asarray(got.column((2 if plain else 4) + s)) if rule == "rp" else fast_gumbel_np(ids, first, s, seed)
                        key = ld + g
                    some = np.flatnonzero(np.isfinite(key))
                    if len(some) > keep:                         # the key of rank ``keep``, ties included
                        some = some[key[some] >= np.partition(key[some], len(some) - keep)[len(some) - keep]]
                    top = some[_keep(np.zeros(len(some), np.int32), key[some], -ids[some], keep)]
                    fresh.append([np.full(len(top), s, np.int32), key[top], -ids[top], ids[top], d[top], g[top]])
                held = [np.concatenate(c) for c in zip(*fresh, strict=True)]
                kept = _keep(held[0], held[1], held[2], keep)
                held = [c[kept] for c in held]
            sums = [[-1], [tr], [n], [0], [dmax], [0.0]]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([c, np.array(s, c.dtype)])) for c, s in zip(held, sums, strict=True)], ["slot", "k1", "k2", "id", "d", "g"])

        def merge(batches):
            cols = [np.concatenate([np.asarray(b.column(i)) for b in batches_list]) for i in range(6)] if (batches_list := list(batches)) else None
            if cols is None:
                return
            s = cols[0] == -1
            rows = [c[~s] for c in cols]
            kept = _keep(rows[0], rows[1], rows[2], keep)
            sums = [[-1], [cols[1][s].sum()], [cols[2][s].sum()], [0], [cols[4][s].max(initial=0.0)], [0.0]]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([c[kept], np.array(x, c.dtype)])) for c, x in zip(rows, sums, strict=True)], ["slot", "k1", "k2", "id", "d", "g"])

        part, parts = source.mapInArrow(best, _PICK), self.state.rdd.getNumPartitions()
        while parts > 1 and parts * (slots * keep + 1) > DIRECT_ROWS:
            parts = math.ceil(parts / FAN)
            part = part.repartition(parts).mapInArrow(merge, _PICK)
        out = part.collect()                                     # at most DIRECT_ROWS rows, or one partition's winners
        tr, dmax, n, found = 0.0, 0.0, 0, {}
        for r in sorted(out, key=lambda r: (r["k1"], r["k2"]), reverse=True):
            if r["slot"] < 0:
                tr, dmax, n = tr + r["k1"], max(dmax, r["d"]), n + r["k2"]
            else:
                found.setdefault(r["slot"], []).append((r["k1"], r["id"], r["d"], r["g"]))
        return {s: rows[:keep] for s, rows in sorted(found.items())}, tr, dmax, n

    def fetch(self, ids) -> dict:
        """x, g and d of the chosen rows: {id: (x, g, d)}; as many rows as ids."""
        wanted = sorted({int(i) for i in ids})
        if not wanted:
            return {}
        got = self.state.where(f"id IN ({', '.join(map(str, wanted))})").toArrow().combine_chunks()
        if not got.num_rows:
            return {}
        X, G = (matrix(got.column(c).combine_chunks(), kind) for c, kind in (("x", self.kind), ("g", "<f8")))
        d = np.asarray(got.column("d"))
        if self.pending:
            C = new_columns(self.kernel, X, G, *[v.value for v in self._block()])
            G, d = np.column_stack([G, C]), np.maximum(d - np.einsum("ij,ij->i", C, C), 0.0)
        return {i: (x, g, float(r)) for i, x, g, r in zip(got.column("id").to_pylist(), X, G, d, strict=True)}


class Candidates:
    """Fetched rows on the driver: their residuals follow as pivots among them are accepted."""

    def __init__(self, kernel, rows: dict):
        self.kernel = kernel
        self.ids = list(rows)
        self.at = {i: n for n, i in enumerate(self.ids)}
        self.X = np.array([rows[i][0] for i in self.ids])
        self.G = np.array([rows[i][1] for i in self.ids]).reshape(len(rows), -1)
        self.d = np.array([rows[i][2] for i in self.ids])
        self.used: set[int] = set()

    def accept(self, ident: int) -> tuple[np.ndarray, list, float]:
        """Take a row as the next pivot: its x, its factor row so far and its residual."""
        i = self.at[ident]
        resid = float(self.d[i])
        taken = (self.X[i], self.G[i].tolist(), resid)
        column = (self.kernel.block(self.X, self.X[i:i + 1])[:, 0] - self.G @ self.G[i]) / math.sqrt(resid)
        self.G = np.column_stack([self.G, column])
        self.d = np.maximum(self.d - column * column, 0.0)
        self.used.add(ident)
        return taken
