"""The driver contract: entry(), queries() and oracle_sql() agree."""

import importlib.util
import os


def load_entry():
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "__spark_entry__.py")
    spec = importlib.util.spec_from_file_location("spark_entry", path)
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    return mod


def test_entry_runs(spark):
    m = load_entry()
    df = m.entry(spark)
    rows = df.collect()
    assert df.columns == ["rank", "pivot_id", "rel_trace_error"]
    assert len(rows) == 8
    errs = [r.rel_trace_error for r in rows]
    assert all(a >= b for a, b in zip(errs, errs[1:]))


def test_oracle_keys_subset_of_queries():
    m = load_entry()
    q, o = m.queries(), m.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 120 and len(o) >= 90
    assert all(isinstance(s, str) and s.strip() for s in o.values())
