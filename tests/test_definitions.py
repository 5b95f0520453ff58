"""No module or class defines a name twice: the second definition would silently win."""

import ast
import pathlib

import pytest

import kernelspark

ROOT = pathlib.Path(kernelspark.__file__).parent
MODULES = [p for p in sorted(ROOT.rglob("*.py")) if "llm" not in p.relative_to(ROOT).parts]


def defined(body):
    return [n.name for n in body if isinstance(n, (ast.FunctionDef, ast.ClassDef))]


@pytest.mark.parametrize("path", MODULES, ids=lambda p: str(p.relative_to(ROOT)))
def test_names_are_defined_once(path):
    tree = ast.parse(path.read_text())
    for scope in [tree, *(n for n in ast.walk(tree) if isinstance(n, ast.ClassDef))]:
        names = defined(scope.body)
        assert len(names) == len(set(names)), sorted(n for n in names if names.count(n) > 1)


def test_pell_columns(spark):
    from kernelspark.operators import metrics as M

    draws = spark.createDataFrame([(0, 0.5, 0.0, 1), (0, 0.25, 1.0, 0), (1, 0.5, 0.0, 1), (1, 0.5, -1.0, 0)], "draw int, p double, latent double, y int")
    four = ["pell", "pell_mean", "posterior_log_loss_mean", "posterior_total_log_loss"]
    row = M.pell(draws).collect()[0]
    assert row.asDict().keys() == set(four) and row.posterior_total_log_loss == -row.pell
    assert row.pell_mean == pytest.approx(row.pell / 2) and row.posterior_log_loss_mean == -row.pell_mean
    assert M.pell_latent(draws).columns == four[:2]
    report = M.binary_report(draws.where("draw = 0"), draws=draws)
    assert set(four) <= set(report.columns)
