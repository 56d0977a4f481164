"""Panels that do not match, and windows longer than are gone through row by row."""

from datetime import datetime

import numpy as np
import pytest

from panelwright import operators as op
from panelwright.functions import columns
from tests.test_naive import ROLLING, gappy, lists, rolled, same

W = [[0.1, 0.2], [0.2, 0.1], [0.3, 0.0]]


@pytest.mark.parametrize(
    "run",
    [
        lambda a, b: op.apply_costs(a, b, cost=0.1),
        lambda a, b: op.book_returns(a, b),
        lambda a, b: op.drifted_weights(a, b, a),
        lambda a, b: op.drifted_weights(a, a, b),
        lambda a, b: op.fill_missing(a, b),
        lambda a, b: op.normalised_share(a, op.held(b), power=1.0),
        lambda a, b: op.inverse_volatility_share(a, b),
        lambda a, b: op.rolling_correlation(a, b, 3, 2),
        lambda a, b: op.equal_risk_weights(a, op.held(b), op.EqualRiskConfig(period=2)),
    ],
)
def test_panels_that_do_not_match_are_refused(panel, run):
    a = panel(W)
    assert run(a, panel(W)).collect()
    for b in (panel(W[:2]), panel([r[:1] for r in W]), panel(W, assets=["a", "c"]), panel(W, start=datetime(2024, 1, 2)), panel([*W, W[0]]), a.unionByName(a)):
        with pytest.raises(Exception, match="do not match"):
            run(a, b).collect()


def test_a_series_of_other_dates_is_refused(panel, series):
    a = panel(W)
    assert op.rolling_correlation(a, series([0.1, 0.2, 0.1]), 3, 2).count() == 6
    for s in (series([0.1, 0.2]), series([0.1] * 4)):
        with pytest.raises(Exception, match="do not match"):
            op.rolling_correlation(a, s, 3, 2).collect()


@pytest.mark.parametrize("case", [0, 1, 2, 3, 4, 8])
def test_windows_from_parts_of_blocks(panel, rows, monkeypatch, case):
    monkeypatch.setattr(columns, "SLIDING", 2)
    run, n, f = ROLLING[case]
    x = gappy(90 + case, rows=40, part=0.4)
    x[20:24, 1] = 3.0  # equal values
    x[25:38, 2] = np.nan  # more gaps than a window has rows
    x[:, 3] += 1e6  # a high level keeps its digits

    def exact(w, i):
        p = w[~np.isnan(w)]
        return np.nan if case in (1, 2) and len(p) and p.max() == p.min() else f(w, i)

    same(rows(run(panel(lists(x)))), rolled(x, n, exact), 1e-8)


def test_covariance_by_blocks(panel, monkeypatch):
    from panelwright.operators import risk

    monkeypatch.setattr(risk, "BLOCK", 2)
    monkeypatch.setattr(risk, "STRETCH", 5)
    x = gappy(62, rows=23) + [0, 0, 1e5, 0, -3]
    x[:, 4] = np.nan
    x[7, 4] = 2.0
    got = {(r.asset_i, r.asset_j): r["cov"] for r in op.observed_covariance(panel(lists(x))).collect()}
    assert len(got) == 25
    for i in range(5):
        for j in range(5):
            ok = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            want = np.cov(x[ok, i], x[ok, j])[0, 1] if ok.sum() > 1 else 0.0
            assert got[chr(97 + i), chr(97 + j)] == pytest.approx(want, abs=1e-9)


def test_equal_risk_against_its_definition(panel, spark):
    """Contributions of the held names are equal, others get nothing, and too little to weigh gives 1 each."""
    x = np.random.default_rng(77).normal(size=(50, 5)) @ np.diag([1, 3, 0.5, 2, 1]) + np.random.default_rng(78).normal(size=(50, 1))
    p = panel(lists(x))
    flags = spark.createDataFrame([("a", True), ("b", True), ("c", False), ("d", True), ("e", None)], "asset string, flag boolean")
    got = {r.asset: r.value for r in op.equal_risk_sizes(p, flags, iterations=500, shrinkage=0.25).collect()}
    assert got["c"] == got["e"] == 0
    c = np.cov(x[:, [0, 1, 3]], rowvar=False)
    c = 0.75 * c + 0.25 * np.diag(np.diag(c))
    w = np.array([got["a"], got["b"], got["d"]])
    assert w.sum() == pytest.approx(1)
    parts = w * (c @ w)
    np.testing.assert_allclose(parts, parts.mean(), rtol=1e-6)
    few = {r.asset: r.value for r in op.equal_risk_sizes(panel(lists(x[:2])), flags).collect()}
    assert few == {"a": 1, "b": 1, "c": 0, "d": 1, "e": 0}
    assert list(op.equal_risk_row(np.zeros((9, 3)), np.array([1, 1, 0]))) == [0.5, 0.5, 0]
