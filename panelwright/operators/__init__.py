"""Operators on panels, stacks and series."""

from .align import align, carried, stack_count
from .band import no_trade_band
from .costs import apply_costs, book_returns, lagged, turnover
from .cross_section import project_out_rows, residualize_rows, row_counts, row_means, row_rank_minmax, row_rank_pct, standardize_rows, top_n_mask
from .drift import drifted_weights
from .ensemble import mean_stack, mean_stack_over_time, nanmean_stack, nanmedian_stack, normalised_shares, stack_volatility, weighted_mean_stack, weighted_nanmean_stack, weighted_nanmean_stack_over_time
from .metrics import DEGENERATE_SHARPE, beta, cagr, compounded, drawdown, max_drawdown, sharpe, to_prices
from .risk import EqualRiskConfig, VolatilityTargetConfig, downside_deviation, equal_risk_row, equal_risk_sizes, equal_risk_weights, inverse_volatility_share, observed_covariance, penalised_for_coverage, rolling_sums, trailing_std, volatility_target
from .rolling import bars_since_extreme, partial_rolling_mean, partial_rolling_std, rolling_correlation, rolling_extreme, rolling_slope, windowed
from .sizing import capped, center, clip_allocation, exposure_scale, fill_missing, gross, held, net, normalised_share, quantize, rescaled_to_held_count, row_sums, tilt, to_gross, weights_from_bins
from .smoothing import ewm_mean, lag_rows, rolling_mean

__all__ = [_n for _n, _x in list(globals().items()) if not _n.startswith("_") and (callable(_x) or _n.isupper())]
