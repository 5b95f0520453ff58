"""binary_report against an independent brute-force NumPy implementation (random, tie-heavy data)."""

import numpy as np
import pytest

from kernelspark.operators import metrics as M


def brute(y, p, t=0.5, n_bins=15):
    p = np.clip(p.astype(float), 1e-12, 1 - 1e-12)
    yh = (p >= t).astype(int)
    out = dict(tp=int(((yh == 1) & (y == 1)).sum()), fp=int(((yh == 1) & (y == 0)).sum()),
               tn=int(((yh == 0) & (y == 0)).sum()), fn=int(((yh == 0) & (y == 1)).sum()))
    lt = y * np.log(p) + (1 - y) * np.log(1 - p)
    out.update(brier=float(np.mean((p - y) ** 2)), elpd=float(lt.sum()), nll=float(-lt.mean()))
    edges = np.linspace(0, 1, n_bins + 1)
    ece = 0.0
    for b in range(n_bins):
        m = (p >= edges[b]) & ((p <= edges[b + 1]) if b == n_bins - 1 else (p < edges[b + 1]))
        if m.any():
            ece += m.mean() * abs(y[m].mean() - p[m].mean())
    out["ece"] = ece
    pos, neg = p[y == 1], p[y == 0]
    out["auroc"] = float(np.mean([(1.0 if a > b else 0.5 if a == b else 0.0) for a in pos for b in neg]))
    ap, prev_r = 0.0, 0.0
    for thr in np.unique(p)[::-1]:
        sel = p >= thr
        r = (sel & (y == 1)).sum() / (y == 1).sum()
        prec = (sel & (y == 1)).sum() / sel.sum()
        ap += (r - prev_r) * prec
        prev_r = r
    out["auprc"] = ap
    return out


@pytest.mark.parametrize("seed,decimals", [(11, 2), (12, 1), (13, 4)])
def test_report_matches_bruteforce(spark, seed, decimals):
    rng = np.random.default_rng(seed)
    n = 300
    y = rng.integers(0, 2, n)
    p = np.round(np.clip(0.25 * y + 0.75 * rng.random(n), 0.001, 0.999), decimals)
    # keep clear of the bin edges so the float edge convention cannot matter
    p = np.where(np.isclose((p * 15) % 1, 0, atol=1e-9), p + 0.0004, p)
    g = rng.integers(0, 3, n)
    df = spark.createDataFrame([(int(a), float(b), int(c)) for a, b, c in zip(y, p, g)], "y int, p double, g int")
    rows = {r.g: r for r in M.binary_report(df, group_by=["g"], n_buckets=5).collect()}
    for grp in range(3):
        m = g == grp
        want = brute(y[m], p[m])
        got = rows[grp]
        for key, v in want.items():
            assert getattr(got, key) == pytest.approx(v, abs=1e-9), (grp, key)
