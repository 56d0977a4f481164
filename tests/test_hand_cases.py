"""Small cases worked out by hand."""

from datetime import datetime, timedelta

import numpy as np
import pytest

from panelwright import operators as op
from panelwright.sources import panels

INF = float("inf")
_ = None


def close(got, want):
    flat = lambda x: [z for y in x for z in (y if isinstance(y, list) else [y])]
    g, w = flat(got), flat(want)
    assert len(g) == len(w), (got, want)
    for x, y in zip(g, w, strict=True):
        assert (x is None) == (y is None), (got, want)
        assert x is None or x == pytest.approx(y, rel=1e-9, abs=1e-12), (got, want)


@pytest.mark.parametrize(
    ("run", "given", "want"),
    [
        (lambda p: op.to_gross(p, 1.0), [[INF, 0.3, 0.2]], [[_, 0.6, 0.4]]),
        (lambda p: op.to_gross(p, 1.0), [[0.0, 0.0, _]], [[0.0, 0.0, _]]),
        (lambda p: op.capped(p, max_gross=0.5), [[0.5, -0.5, INF]], [[0.25, -0.25, _]]),
        (lambda p: op.capped(p), [[5.0, -5.0]], [[5.0, -5.0]]),
        (lambda p: op.capped(p, max_net=1.0), [[3.0, -1.0]], [[1.5, -0.5]]),
        (lambda p: op.quantize(p, 0.2), [[0.71, -1.09]], [[0.8, -1.0]]),
        (lambda p: op.quantize(p, 1.0), [[0.5, 1.5, 2.5]], [[0.0, 2.0, 2.0]]),
        (op.weights_from_bins, [[0, 1, 2]], [[-0.5, 0, 0.5]]),
        (op.weights_from_bins, [[4, 4, 4]], [[0, 0, 0]]),
        (op.weights_from_bins, [[4, _, 4]], [[0, _, 0]]),
        (lambda p: op.clip_allocation(p, 0.2), [[0.5, -0.5, _]], [[0.2, -0.2, _]]),
        (lambda p: op.tilt(p, 0.3), [[0.1, 0.0, 0.2, _]], [[0.25, 0.0, 0.35, _]]),
        (op.center, [[1, 3, _]], [[-1, 1, _]]),
        (op.rescaled_to_held_count, [[1, 3, _]], [[0.5, 1.5, _]]),
        (op.row_rank_pct, [[3, 1, 2]], [[1, 1 / 3, 2 / 3]]),
        (op.row_rank_pct, [[2, 2, _]], [[0.5, 1, _]]),
        (op.row_rank_minmax, [[1, 2, 2, 3]], [[0, 0.5, 0.5, 1]]),
        (op.row_rank_minmax, [[7, _]], [[_, _]]),
        (lambda p: op.standardize_rows(p, 0), [[7, _, _]], [[0, _, _]]),
        (lambda p: op.standardize_rows(p, 1), [[7, _, _]], [[_, _, _]]),
        (lambda p: op.standardize_rows(p, 0), [[3, 3, 3]], [[0, 0, 0]]),
        (op.turnover, [[_], [1], [_], [2]], [[0], [1], [1], [2]]),
        (lambda p: op.rolling_sums(p, 2), [[1], [2], [_], [4], [5], [6]], [[_], [3], [_], [_], [9], [11]]),
        (lambda p: op.rolling_mean(p, 3), [[_], [_], [1], [2], [3]], [[_], [_], [_], [_], [2]]),
        (lambda p: op.ewm_mean(p, 3), [[_], [8], [4], [_], [2]], [[_], [_], [_], [_], [(2 + 4 / 4 + 8 / 8) / (1 + 1 / 4 + 1 / 8)]]),
        (lambda p: op.ewm_mean(p, 1), [[1], [_], [3]], [[1], [_], [3]]),
        (lambda p: op.bars_since_extreme(p, 3, 1, lowest=True), [[3], [1], [2]], [[0], [0], [1]]),
        (lambda p: op.bars_since_extreme(p, 3, 1, lowest=False), [[2], [2], [1]], [[0], [1], [2]]),
        (lambda p: op.partial_rolling_std(p, 3, 2), [[5], [5], [5]], [[_], [_], [_]]),
        (lambda p: op.trailing_std(p, 3), [[5], [5], [5]], [[_], [_], [0]]),
        (lambda p: op.downside_deviation(p, 2), [[-3], [-4], [1], [1]], [[_], [12.5**0.5], [4], [_]]),
        (lambda p: op.no_trade_band(p, 0.4), [[0.8, -0.3], [0.7, -0.2], [0.7, 0.1]], [[0.8, -0.3], [0.8, -0.3], [0.8, 0.1]]),
        (lambda p: op.no_trade_band(p, 0.25), [[0.5, 0.5], [_, 0.7], [0.4, 0.7]], [[0.5, 0.5], [_, 0.7], [0.4, 0.7]]),
        (lambda p: op.no_trade_band(p, 0.25), [[0.5, 0.5], [0.0, 0.0], [0.01, 0.0]], [[0.5, 0.5], [0.0, 0.0], [0.01, 0.0]]),
        (lambda p: op.lag_rows(p, 1), [[1], [2]], [[_], [1]]),
        (lambda p: op.lag_rows(p, 0), [[1], [2]], [[1], [2]]),
        (lambda p: op.lagged(p, 0), [[1], [2]], [[_], [1]]),
        (lambda p: op.rolling_slope(p, 4, 2), [[1], [_], [5], [7]], [[_], [_], [2], [2]]),
        (lambda p: op.rolling_extreme(p, 2, 1, lowest=False), [[_], [_], [1], [0]], [[_], [_], [1], [1]]),
    ],
)
def test_panel(panel, rows, run, given, want):
    close(rows(run(panel(given))), want)


def test_reducers(panel, rows):
    p = panel([[1.0, -3.0, None], [None, None, None]])
    close(rows(op.row_sums(p)), [-2, 0])
    close(rows(op.gross(p)), [4, 0])
    close(rows(op.net(p)), [-2, 0])
    close(rows(op.row_counts(p)), [2, 0])
    close(rows(op.row_means(p)), [-1, None])
    close(rows(op.exposure_scale(p, max_gross=2.0, max_net=4.0)), [0.5, 1])
    assert rows(op.held(panel([[0.0, 1.0, None]]))) == [[False, True, False]]
    assert rows(op.top_n_mask(panel([[1.0, 1.0, None]]), 1)) == [[True, False, False]]


def test_two_panels(panel, rows):
    a, b = panel([[1.0, None]]), panel([[9.0, 2.0]])
    close(rows(op.fill_missing(a, b)), [[1, 2]])
    close(rows(op.normalised_share(panel([[1.0, 3.0, None]]), op.held(panel([[1.0, 1.0, 0.0]])), power=1.0)), [[0.5, 1.5, 0]])
    close(rows(op.normalised_share(panel([[0.0, 2.0]]), op.held(panel([[1.0, 1.0]])), power=-1.0)), [[0, 2]])
    close(rows(op.inverse_volatility_share(panel([[1.0, 2.0, 0.0, 5.0]]), panel([[1.0, 1.0, 1.0, None]]))), [[2.0, 1.0, 0.0, None]])
    w, r = panel([[0.5, 0.5], [0.5, 0.5]]), panel([[0.0, 0.0], [0.1, 0.2]])
    close(rows(op.book_returns(w, r)), [0, 0.15])
    close(rows(op.apply_costs(panel([[1.0], [2.0]]), panel([[0.0], [None]]), cost=0.1)), [[0], [-0.1]])


def test_drift(panel, rows):
    close(rows(op.drifted_weights(panel([[0.5, 0.0]]), panel([[100.0, None]]), panel([[110.0, None]]))), [[0.55 / 1.05, 0]])
    close(rows(op.drifted_weights(panel([[0.5, 0.5]]), panel([[100.0, None]]), panel([[110.0, 1.0]]))), [[None, None]])
    close(rows(op.drifted_weights(panel([[0.5, None]]), panel([[100.0, 1.0]]), panel([[110.0, 1.0]]))), [[None, None]])
    close(rows(op.drifted_weights(panel([[2.0]]), panel([[100.0]]), panel([[10.0]]))), [[None]])


def test_stacks(spark, panel, rows):
    s = op.align({"x": panel([[1.0]]), "y": panel([[None]])})
    close(rows(op.nanmean_stack(s)), [[1]])
    close(rows(op.mean_stack(s)), [[0.5]])
    shares = {"x": 0.25, "y": 0.75}
    close(rows(op.weighted_nanmean_stack(s, shares)), [[1]])
    close(rows(op.weighted_mean_stack(s, shares)), [[0.25]])
    m = op.align({"x": panel([[-70.0, 3.0]]), "y": panel([[0.4, 5.0]]), "z": panel([[0.3, None]])})
    close(rows(op.nanmedian_stack(m)), [[0.3, 4.0]])
    t = op.align({"x": panel([[0.4, 0.2]]), "y": panel([[0.6, None]])})
    daily = t.select("frame", "date").distinct().selectExpr("frame", "date", "1.0D as share")
    close(rows(op.mean_stack_over_time(t, daily)), [[0.5, 0.1]])
    silent = op.align({"x": panel([[0.4, 0.2]]), "y": panel([[None, None]])})
    close(rows(op.mean_stack_over_time(silent, daily)), [[0.4, 0.2]])
    with pytest.raises(ValueError):
        op.weighted_mean_stack(s, {"x": 1.0})
    with pytest.raises(ValueError):
        op.weighted_mean_stack(s, {"x": -1.0, "y": 1.0})


def test_shares(spark):
    f = lambda *v: {r.frame: r.share for r in op.normalised_shares(panels.sanitize(spark.createDataFrame([(str(i), x) for i, x in enumerate(v)], "frame string, value double"))).collect()}
    assert f(INF, 1.0) == {"0": 0, "1": 1}
    assert f(0.0, 0.0) == {"0": 0.5, "1": 0.5}
    assert f(1.0, 3.0, -1.0) == {"0": 0.25, "1": 0.75, "2": 0}


def test_align_unions_labels(spark, panel, rows):
    a = panel([[1.0, 2.0]], assets=["a", "b"])
    b = panel([[3.0]], assets=["c"], start=datetime(2024, 1, 2))
    s = op.align({"x": a, "y": b, "z": a.where("false")})
    assert s.count() == 3 * 2 * 3
    close(rows(s.where("frame = 'x'")), [[1, 2, None], [None, None, None]])
    close(rows(s.where("frame = 'z'")), [[None] * 3] * 2)


def test_carried(spark, panel, rows):
    one = panel([[1.0, None]])
    grid = panel([[0.0]] * 4, step=timedelta(hours=1)).select("date")
    close(rows(op.carried(one, grid, max_age=timedelta(hours=2))), [[1, None]] * 3 + [[None, None]])
    early = panel([[0.0]], start=datetime(2023, 1, 1)).select("date")
    close(rows(op.carried(one, early)), [[None, None]])


def test_series(series, rows):
    close(rows(op.to_prices(series([0.1, None, 0.1, INF, 0.1]))), [1.1, None, 1.21, None, 1.331])
    close(rows(op.drawdown(series([0.5, -0.5, 0.0]))), [0, -0.5, -0.5])
    one = lambda df: df.first()["value"]
    assert one(op.max_drawdown(series([None]))) == 0
    assert one(op.max_drawdown(series([0.5, -0.5, 0.0]))) == pytest.approx(-0.5)
    assert one(op.sharpe(series([0.0] * 10))) == op.DEGENERATE_SHARPE
    assert one(op.sharpe(series([0.01] * 10))) == op.DEGENERATE_SHARPE
    assert one(op.sharpe(series([0.01, 0.03]), 1)) == pytest.approx(0.02 / np.std([0.01, 0.03], ddof=1))
    assert one(op.compounded(series([]))) == 0
    assert one(op.compounded(series([0.1, None, 0.1]))) == pytest.approx(0.21)
    assert one(op.cagr(series([0.21]), 730)) == pytest.approx(0.1)
    assert one(op.beta(series([0.2, 0.4, None]), series([0.1, 0.2, 0.3]))) == pytest.approx(2)
    assert one(op.beta(series([0.2, 0.4]), series([0.1, 0.1]))) is None
    close(rows(op.volatility_target(series([0.0, 0.0, 0.0]), op.VolatilityTargetConfig(period=2, target=0.1))), [1, 1, 1])
    close(rows(op.volatility_target(series([0.01, -0.01]), op.VolatilityTargetConfig(period=2, target=1.0, periods_per_year=1))), [1, 3])


def test_ewm_over_a_long_gap(panel, rows):
    got = rows(op.ewm_mean(panel([[1.0], [2.0]] + [[None]] * 2998), 2))
    close(got, [[None]] + [[1.75]] * 2999)


def test_wide_and_back(spark, panel):
    p = panel([[1.0, None], [float("nan"), 2.0]])
    assert panels.equal_panels(panels.from_wide(panels.to_wide(p)), p)
    assert panels.shape(p) == (2, 2)
    assert [tuple(r) for r in panels.last_row(p).orderBy("asset").collect()] == [("a", None), ("b", 2.0)]
    assert not panels.is_empty(p)
    assert panels.has_dates(p)
    assert panels.from_wide(spark.createDataFrame([("2024-01-01",)], "date string")).isEmpty()


def test_equal_panels_sees_differences(panel):
    p = panel([[1.0, None]])
    assert not panels.equal_panels(p, panel([[1.0, 0.0]]))
    assert not panels.equal_panels(p, panel([[1.0]]))
