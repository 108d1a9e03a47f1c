from .axis import DAILY, POS, TICKS, Axis
from .blocks import Rolling, with_rolling
from .layout import attach, discard_materialised, lay_out, materialise, number_rows, with_positions
from .rankcorr import rank_correlations
from .ranking import average_rank, quantiles, value_counts_upto
from .rolling import (
    after, before, change, full_frames, over_rows, rolling, rolling_cov, rolling_max, rolling_mean, rolling_min,
    rolling_rank, rolling_std, rolling_sum, rolling_var, trailing, with_rolling_ranks, with_rolling_sums,
)
from .running import running

__all__ = [
    "Axis", "DAILY", "POS", "Rolling", "TICKS", "after", "attach", "average_rank", "before", "change",
    "discard_materialised", "full_frames", "lay_out",
    "materialise", "number_rows", "over_rows", "quantiles", "rank_correlations", "rolling", "rolling_cov", "rolling_max",
    "rolling_mean", "rolling_min", "rolling_rank", "rolling_std", "rolling_sum", "rolling_var", "running",
    "trailing", "value_counts_upto", "with_positions", "with_rolling",
    "with_rolling_ranks", "with_rolling_sums",
]
