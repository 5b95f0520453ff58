"""DuckDB text for kernel and pivoted-Cholesky oracles (SQL-k: k rounds unrolled).

Each round is two CTEs: the pivot (ORDER BY rule LIMIT 1) and the new factor
column for every row. Factor columns are scalars f1..fk; dot products are
written left to right from 0.0 like the Spark expressions.
"""

from __future__ import annotations

from ..functions import arrays as A
from ..functions import rng


def sample_sql(src: str, m: int = 1000, seed: int = 42) -> str:
    u = rng.u01_sql("id", "'sample'", str(seed))
    return f"SELECT id, features FROM ({src}) ORDER BY {u}, id LIMIT {m}"


def median_bw_sql(src: str, metric: str = "l2", m: int = 1000, seed: int = 42) -> str:
    dist = A.l1dist_sql("a.features", "b.features") if metric == "l1" else \
        f"sqrt({A.sqdist_sql('a.features', 'b.features')})"
    return (f"SELECT quantile_cont({dist}, 0.5) AS bw, count(*) AS n_pairs "
            f"FROM ({sample_sql(src, m, seed)}) a, ({sample_sql(src, m, seed)}) b")


def gaussian_sql(a: str, b: str, bw: str) -> str:
    return f"exp(-0.5 * {A.sqdist_sql(a, b)} / ({bw} * {bw}))"


def pivots_sql(src: str, k: int, rule: str = "greedy", seed: int = 42, bw_sql: str | None = None,
               bandwidth: float | None = None, among: str = "TRUE") -> tuple[str, list[str]]:
    """CTEs for k rounds; returns (ctes_text, names of pivot CTEs). Greedy pivots are
    rows for which ``among`` (a condition on id) holds; all rows get factor columns."""
    bw = "bwq.bw" if bandwidth is None else repr(float(bandwidth))
    ctes = []
    if bandwidth is None:
        ctes.append(f"bwq AS ({bw_sql})")
    ctes.append(f"s0 AS (SELECT id, features AS x, 1.0 AS d FROM ({src}))")
    if rule == "uniform":
        u = rng.u01_sql("id", "'uniform'", str(seed))
        ctes.append(f"uo AS (SELECT id, row_number() OVER (ORDER BY {u}, id) AS pos FROM s0)")
    names = []
    for j in range(1, k + 1):
        prev = f"s{j - 1}"
        if rule == "greedy":
            pick = f"SELECT * FROM {prev} WHERE {among} ORDER BY d DESC, id ASC LIMIT 1"
        elif rule == "rp":
            g = rng.gumbel_sql("id", str(j - 1), str(seed))
            pick = f"SELECT * FROM {prev} WHERE d > 0 ORDER BY ln(d) + {g} DESC LIMIT 1"
        elif rule == "uniform":
            pick = f"SELECT * FROM {prev} WHERE id = (SELECT id FROM uo WHERE pos = {j})"
        else:
            raise ValueError(rule)
        ctes.append(f"p{j} AS ({pick})")
        names.append(f"p{j}")
        prev_f = [f"f{l}" for l in range(1, j)]
        dot = "0.0" + "".join(f" + s.{c} * p.{c}" for c in prev_f)
        kern = gaussian_sql("s.x", "p.x", bw)
        keep = "".join(f"s.{c}, " for c in prev_f)
        from_bw = ", bwq" if bandwidth is None else ""
        ctes.append(f"g{j} AS (SELECT s.id, s.x, {keep}(({kern}) - ({dot})) / sqrt(p.d) AS f{j}, s.d AS d_prev "
                    f"FROM {prev} s, p{j} p{from_bw})")
        ctes.append(f"s{j} AS (SELECT * EXCLUDE (d_prev), greatest(d_prev - f{j} * f{j}, 0.0) AS d FROM g{j})")
    return ", ".join(ctes), names


def error_by_rank_sql(src: str, k: int, rule: str = "greedy", seed: int = 42, bandwidth: float | None = None,
                      with_queries: bool = False) -> str:
    ctes, names = pivots_sql(src, k, rule, seed, median_bw_sql(src), bandwidth)
    parts = []
    for j in range(1, k + 1):
        extra = f", CAST((SELECT count(*) FROM s0) * {j + 1} AS BIGINT) AS kernel_queries" if with_queries else ""
        parts.append(f"SELECT CAST({j} AS INTEGER) AS rank, (SELECT id FROM p{j}) AS pivot_id, "
                     f"(SELECT sum(d) FROM s{j}) / (SELECT sum(d) FROM s0) AS rel_trace_error{extra}")
    return f"WITH {ctes} " + " UNION ALL ".join(parts)


def kpp_sql(src: str, k: int, rule: str = "greedy", seed: int = 42) -> str:
    ctes, names = pivots_sql(src, k, rule, seed, median_bw_sql(src))
    piv = " UNION ALL ".join(f"SELECT {j} AS r, x FROM p{j}" for j in range(1, k + 1))
    return (f"WITH {ctes}, piv AS ({piv}) SELECT CAST(a.r AS INTEGER) AS i, CAST(b.r AS INTEGER) AS j, "
            f"({gaussian_sql('a.x', 'b.x', 'bwq.bw')} + {gaussian_sql('b.x', 'a.x', 'bwq.bw')}) / 2.0 AS v "
            f"FROM piv a, piv b, bwq")
