"""What holds for any panel."""

import numpy as np
import pytest

from panelwright import operators as op
from tests.test_naive import gappy, lists, same


@pytest.fixture(scope="module")
def x():
    return gappy(7, rows=8)


def test_scale(panel, rows, x):
    for run in (lambda p: op.to_gross(p, 1.0), op.row_rank_pct, op.row_rank_minmax, op.standardize_rows, op.weights_from_bins):
        same(rows(run(panel(lists(x * 8)))), np.array(rows(run(panel(lists(x)))), dtype=float))


def test_translation(panel, rows, x):
    for run in (op.center, op.standardize_rows, op.row_rank_pct, lambda p: op.rolling_slope(p, 4, 2), lambda p: op.partial_rolling_std(p, 4, 2)):
        same(rows(run(panel(lists(x + 16)))), np.array(rows(run(panel(lists(x)))), dtype=float))


def test_idempotence(panel, rows, x):
    for run in (op.center, lambda p: op.to_gross(p, 2.0), lambda p: op.clip_allocation(p, 0.5), lambda p: op.quantize(p, 0.25), lambda p: op.capped(p, max_gross=1.0)):
        once = run(panel(lists(x)))
        same(rows(run(once)), np.array(rows(once), dtype=float))


def test_gaps_stay(panel, rows, x):
    for run in (op.center, lambda p: op.to_gross(p, 1.0), lambda p: op.capped(p, max_gross=1.0, max_net=0.1), lambda p: op.tilt(p, 1.0), op.standardize_rows, op.weights_from_bins):
        got = np.array(rows(run(panel(lists(x)))), dtype=float)
        assert (np.isnan(got) == np.isnan(x)).all()


def test_bounds(panel, rows, x):
    p = panel(lists(x))
    capped = op.capped(p, max_gross=0.7, max_net=0.2)
    assert max(rows(op.gross(capped))) <= 0.7 + 1e-12
    assert max(map(abs, rows(op.net(capped)))) <= 0.2 + 1e-12
    assert all(0 < v <= 1 for r in rows(op.row_rank_pct(p)) for v in r if v is not None)
    assert all(sum(r) <= 2 for r in rows(op.top_n_mask(p, 2)))


@pytest.mark.parametrize("given", [[[None, None], [None, None]], [[0.0, 0.0]], [[0.25, 0.25]], [[1e-300, 1e-300]], [[1e300, -1e300]], [[float("inf"), float("nan")]], [[5.0]]])
def test_degenerate(panel, rows, given):
    p = panel(given)
    for run in (op.center, lambda p: op.to_gross(p, 1.0), lambda p: op.capped(p, max_gross=1.0), op.standardize_rows, op.row_rank_pct, op.row_rank_minmax, op.weights_from_bins, op.rescaled_to_held_count, lambda p: op.tilt(p, 0.1), lambda p: op.partial_rolling_std(p, 3, 1), lambda p: op.rolling_slope(p, 3, 1), lambda p: op.rolling_correlation(p, p, 3, 1), lambda p: op.ewm_mean(p, 2), lambda p: op.no_trade_band(p, 0.1), lambda p: op.drifted_weights(p, p, p), op.turnover):
        assert len(rows(run(p))) == len(given)


def test_carried_looks_back_only(panel, rows):
    p = panel(lists(gappy(9, rows=6)))
    grid = p.select("date").distinct()
    full = rows(op.carried(p, grid))
    early = p.where("date <= timestamp_ntz'2024-01-03 00:00:00'")
    assert rows(op.carried(early, grid))[:3] == full[:3]
