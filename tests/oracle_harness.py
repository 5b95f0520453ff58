"""Local twin of the driver's correctness gate.

Runs each registered Spark query and its DuckDB oracle on the same Parquet
tables and compares column names, types (by family), row counts and the
order-insensitive multiset of values.

    python tests/oracle_harness.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from kernelspark.plans.views import TABLES  # noqa: E402

FAMILIES = {
    "int": "int", "integer": "int", "bigint": "int", "smallint": "int", "tinyint": "int", "long": "int",
    "hugeint": "int", "double": "float", "float": "float", "decimal": "float", "string": "str",
    "varchar": "str", "boolean": "bool", "bool": "bool", "timestamp": "ts", "timestamp_ntz": "ts", "date": "date",
}


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        if math.isnan(v):
            return (0, "")
        return (1, f"{v:.6f}")
    if isinstance(v, bool):
        return (1, str(v))
    if isinstance(v, int):
        return (1, str(v))
    return (1, str(v))


def rows_of(records, cols):
    return sorted(tuple(_norm(r[c]) for c in cols) for r in records)


def compare(spark_df, con, sql):
    import pyspark.sql.types as T

    t0 = time.time()
    srows = [r.asDict() for r in spark_df.collect()]
    t_spark = time.time() - t0
    scols = spark_df.columns
    stypes = {f.name: f.dataType.simpleString().split("(")[0] for f in spark_df.schema.fields}
    if sql is None:
        return dict(status="rows-only", rows=len(srows), t_spark=t_spark)
    rel = con.execute(sql)
    ocols = [d[0] for d in rel.description]
    otypes = {d[0]: str(d[1]).lower().split("(")[0] for d in rel.description}
    orows = [dict(zip(ocols, r)) for r in rel.fetchall()]
    problems = []
    if sorted(scols) != sorted(ocols):
        problems.append(f"columns differ: spark={sorted(scols)} oracle={sorted(ocols)}")
    else:
        for c in scols:
            fs, fo = FAMILIES.get(stypes[c], stypes[c]), FAMILIES.get(otypes[c], otypes[c])
            if fs != fo:
                problems.append(f"type {c}: spark={stypes[c]} oracle={otypes[c]}")
    if len(srows) != len(orows):
        problems.append(f"rows spark={len(srows)} oracle={len(orows)}")
    if not problems:
        cols = sorted(scols)
        a, b = rows_of(srows, cols), rows_of(orows, cols)
        if a != b:
            diffs = [(x, y) for x, y in zip(a, b) if x != y][:3]
            problems.append(f"values differ, e.g. {diffs}")
    return dict(status="ok" if not problems else "FAIL", rows=len(srows), problems=problems, t_spark=t_spark)


def main(argv):
    from kernelspark.plans.catalog import load_all
    from kernelspark.session import build_session

    sf_dir = argv[0] if argv and argv[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv if not a.startswith("/")]
    spark = build_session(shuffle_partitions=8)
    reg = load_all()
    con = duck(sf_dir)
    bad = 0
    for name, q in reg.items():
        if names and name not in names:
            continue
        try:
            res = compare(q.build(spark, sf_dir), con, q.oracle())
        except Exception as e:  # report and continue
            res = dict(status="ERROR", problems=[repr(e)[:600]])
        bad += res["status"] in ("FAIL", "ERROR")
        extra = "" if res["status"] in ("ok", "rows-only") else " " + " | ".join(res.get("problems", []))
        print(f"{res['status']:9s} {name:32s} rows={res.get('rows')} t={res.get('t_spark', 0):.2f}s{extra}",
              flush=True)
    print(f"{bad} failing of {len([n for n in reg if not names or n in names])}")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
