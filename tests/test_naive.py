"""Operators against plain loops on random panels with gaps."""

import math

import numpy as np
import pytest

from panelwright import operators as op

N, K = 24, 5


def gappy(seed, rows=N, cols=K, part=0.25):
    g = np.random.default_rng(seed)
    x = g.normal(size=(rows, cols)).round(3)
    x[g.random(x.shape) < part] = np.nan
    x[3] = np.nan
    return x


def lists(x):
    return [[None if math.isnan(v) else float(v) for v in r] for r in x]


def same(got, want, tol=1e-9):
    a = np.array([[np.nan if v is None else float(v) for v in r] for r in got])
    np.testing.assert_allclose(a, want, rtol=tol, atol=tol, equal_nan=True)


def rolled(x, n, f):
    out = np.full(x.shape, np.nan)
    for i in range(len(x)):
        for j in range(x.shape[1]):
            w = x[max(0, i - n + 1) : i + 1, j]
            out[i, j] = f(w, i)
    return out


def present(w):
    return w[~np.isnan(w)]


ROLLING = [
    (lambda p: op.partial_rolling_mean(p, 6, 2), 6, lambda w, i: present(w).mean() if len(present(w)) >= 2 else np.nan),
    (lambda p: op.partial_rolling_std(p, 6, 3), 6, lambda w, i: present(w).std(ddof=1) if len(present(w)) >= 3 else np.nan),
    (lambda p: op.partial_rolling_std(p, 6, 1, ddof=2), 6, lambda w, i: present(w).std(ddof=2) if len(present(w)) >= 3 else np.nan),
    (lambda p: op.trailing_std(p, 6), 6, lambda w, i: present(w).std(ddof=1) if i >= 5 and len(present(w)) >= 2 else np.nan),
    (lambda p: op.rolling_extreme(p, 6, 2, lowest=True), 6, lambda w, i: present(w).min() if len(present(w)) >= 2 else np.nan),
    (lambda p: op.bars_since_extreme(p, 6, 2, lowest=False), 6, lambda w, i: len(w) - 1 - np.nanargmax(w) if len(present(w)) >= 2 else np.nan),
    (lambda p: op.rolling_slope(p, 6, 2), 6, lambda w, i: np.polyfit(np.flatnonzero(~np.isnan(w)), present(w), 1)[0] if len(present(w)) >= 2 else np.nan),
    (lambda p: op.downside_deviation(p, 6), 6, lambda w, i: math.sqrt((present(w)[present(w) < 0] ** 2).mean()) if i >= 5 and (present(w) < 0).any() else np.nan),
    (lambda p: op.rolling_sums(p, 3), 3, lambda w, i: w.sum() if len(w) == 3 else np.nan),
]


@pytest.mark.parametrize("case", range(len(ROLLING)))
def test_rolling(panel, rows, case):
    run, n, f = ROLLING[case]
    x = gappy(case)
    same(rows(run(panel(lists(x)))), rolled(x, n, f))


def test_rolling_correlation(panel, rows):
    x, y = gappy(21), gappy(22)
    ok = ~np.isnan(x) & ~np.isnan(y)
    want = np.full(x.shape, np.nan)
    for i in range(N):
        for j in range(K):
            m = ok[max(0, i - 7) : i + 1, j]
            if m.sum() >= 3:
                want[i, j] = np.corrcoef(x[max(0, i - 7) : i + 1, j][m], y[max(0, i - 7) : i + 1, j][m])[0, 1]
    same(rows(op.rolling_correlation(panel(lists(x)), panel(lists(y)), 8, 3)), want, 1e-8)


def test_large_levels_keep_their_digits(panel, rows):
    noise = np.random.default_rng(5).normal(size=60)
    x = (1e8 + noise * 1e-3)[:, None]
    exact = rolled((x - 1e8), 30, lambda w, i: w.std(ddof=1) if i >= 29 else np.nan)
    same(rows(op.trailing_std(panel(lists(x)), 30)), exact, 1e-9)


def test_ewm(panel, rows):
    x = gappy(31)
    for span in (1, 3, 6):
        d = 1 - 2 / (span + 1)
        want = np.full(x.shape, np.nan)
        for j in range(K):
            for i in range(N):
                seen = ~np.isnan(x[: i + 1, j])
                weights = d ** (i - np.arange(i + 1)) * seen
                if seen.sum() >= span and weights.sum() > 0:
                    want[i, j] = (np.nan_to_num(x[: i + 1, j]) * weights).sum() / weights.sum()
        same(rows(op.ewm_mean(panel(lists(x)), span)), want)


def test_band(panel, rows):
    x = gappy(41)
    held, want = np.full(K, np.nan), []
    for r in x:
        scale = np.nanmean(np.abs(r)) if (~np.isnan(r)).any() else np.nan
        for j in range(K):
            if not scale > 0 or math.isnan(r[j]) or math.isnan(held[j]) or abs(r[j] - held[j]) > 0.6 * scale:
                held[j] = r[j]
        want.append(held.copy())
    same(rows(op.no_trade_band(panel(lists(x)), 0.6)), np.array(want))


def test_regression(spark, panel, rows):
    y, a, b = gappy(51, cols=9, part=0.1), gappy(52, cols=9, part=0.1), gappy(53, cols=9, part=0.1)
    c = 2 * a + 1  # adds no direction
    p = panel(lists(y))
    for name, m in (("a", a), ("b", b), ("c", c)):
        p = p.join(panel(lists(m)).withColumnRenamed("value", name), ["date", "asset"])
    for controls, ms in ((["a", "b"], (a, b)), (["a", "c", "b"], (a, c, b)), ([], ())):
        want = np.full(y.shape, np.nan)
        for i in range(N):
            ok = ~np.isnan(y[i])
            for m in ms:
                ok &= ~np.isnan(m[i])
            if ok.any():
                d = np.column_stack([np.ones(ok.sum()), *[m[i, ok] for m in ms]])
                want[i, ok] = y[i, ok] - d @ np.linalg.lstsq(d, y[i, ok], rcond=None)[0]
        same(rows(op.project_out_rows(p, controls)), want, 1e-9)
    thin = rows(op.residualize_rows(p, ["a"], required_assets=8, standardize=False))
    for r in thin:
        assert sum(v is not None for v in r) == 0 or sum(v is not None for v in r) >= 8


def test_covariance(panel):
    x = gappy(61, rows=12)
    got = {(r.asset_i, r.asset_j): r["cov"] for r in op.observed_covariance(panel(lists(x))).collect()}
    for i in range(K):
        for j in range(K):
            ok = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            want = np.cov(x[ok, i], x[ok, j])[0, 1] if ok.sum() > 1 else 0.0
            assert got[chr(97 + i), chr(97 + j)] == pytest.approx(want, abs=1e-12)


def test_equal_risk(panel, rows):
    """Risk contributions under the shrunk covariance are equal, and the frame matches the row solver."""
    x = np.random.default_rng(71).normal(size=(60, 4)) * [1, 2, 3, 4]
    w = op.equal_risk_row(x, np.ones(4), iterations=400)
    c = np.cov(x, rowvar=False)
    c = 0.5 * c + 0.5 * np.diag(np.diag(c))
    parts = w * (c @ w)
    assert w.sum() == pytest.approx(1)
    np.testing.assert_allclose(parts, parts.mean(), rtol=1e-6)
    assert list(op.equal_risk_row(x[:2], np.array([1, 0, 1, 0]))) == [1, 0, 1, 0]
    y = gappy(72, rows=14)
    held = ~np.isnan(gappy(73, rows=14))
    p = panel(lists(y))
    h = panel([[1.0 if v else 0.0 for v in r] for r in held])
    got = rows(op.equal_risk_weights(p, op.held(h), op.EqualRiskConfig(period=6, rebalance=4)))
    kept, want = None, np.zeros(y.shape)
    for i in range(14):
        if i % 4 == 0:
            kept = op.equal_risk_row(y[max(0, i - 5) : i + 1], held[i])
        now = np.where(held[i], kept, 0)
        want[i] = now / now.sum() * held[i].sum() if now.sum() else 0
    same(got, want, 1e-9)


def test_penalised(spark, panel):
    cov = op.observed_covariance(panel([[1.0, 2.0], [2.0, 5.0], [4.0, 3.0]]))
    full = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "asset string, value double")
    half = spark.createDataFrame([("a", 0.5), ("b", 1.0)], "asset string, value double")
    get = lambda df: {(r.asset_i, r.asset_j): r["cov"] for r in df.collect()}
    c = get(cov)
    assert get(op.penalised_for_coverage(cov, full)) == pytest.approx(c)
    p = get(op.penalised_for_coverage(cov, half))
    worst = max(c["a", "a"], c["b", "b"])
    assert p["a", "a"] == pytest.approx(0.5 * c["a", "a"] + 0.5 * worst)
    before = c["a", "b"] / math.sqrt(c["a", "a"] * c["b", "b"])
    assert p["a", "b"] / math.sqrt(p["a", "a"] * p["b", "b"]) == pytest.approx(before)
