"""Arguments and data that are refused."""

import pytest

from panelwright import operators as op
from panelwright.sources import panels


@pytest.mark.parametrize(
    "run",
    [
        lambda p: op.to_gross(p, 0.0),
        lambda p: op.capped(p, max_gross=0.0),
        lambda p: op.exposure_scale(p, max_net=-1.0),
        lambda p: op.clip_allocation(p, 0.0),
        lambda p: op.quantize(p, -1.0),
        lambda p: op.standardize_rows(p, -1),
        lambda p: op.top_n_mask(p, 0),
        lambda p: op.partial_rolling_mean(p, 0, 1),
        lambda p: op.partial_rolling_mean(p, 2, 3),
        lambda p: op.partial_rolling_std(p, 1, 1),
        lambda p: op.rolling_extreme(p, 2, 0, lowest=True),
        lambda p: op.windowed(p, 0),
        lambda p: op.ewm_mean(p, 0),
        lambda p: op.lag_rows(p, -1),
        lambda p: op.lagged(p, -1),
        lambda p: op.apply_costs(p, p, cost=-0.1),
        lambda p: op.rolling_sums(p, 0),
        lambda p: op.trailing_std(p, 1),
        lambda p: op.no_trade_band(p, 0.0),
        lambda p: op.cagr(p, 0),
        lambda p: op.align({}),
        lambda p: op.stack_volatility(p, ddof=-1),
        lambda p: op.equal_risk_weights(p, op.held(p), op.EqualRiskConfig(period=2, rebalance=0)),
        lambda p: panels.from_wide(p.drop("date")),
        lambda p: panels.validate(p.unionByName(p)),
        lambda p: panels.last_row(p.where("false")),
    ],
)
def test_refused(panel, run):
    with pytest.raises(ValueError):
        run(panel([[1.0, 2.0]]))


def test_from_rows_refuses(spark):
    for dates, assets, values in ((["2024-01-01"], ["a", "a"], [[1, 2]]), (["2024-01-01"] * 2, ["a"], [[1], [2]]), (["2024-01-01"], ["a"], [[1, 2]])):
        with pytest.raises(ValueError):
            panels.from_rows(spark, dates, assets, values)
