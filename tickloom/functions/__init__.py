from .closed_forms import (
    chi2_two_df_tail, kurt_corrected, normal_density, normality_k2, skew_corrected, student_p, unit_root_p,
)
from .guards import (
    bin_start, col, from_micros, interval_micros, micros, nan_to_null, ratio, round_to, zero_to_null,
)
from .quotes import (
    LEVEL_WEIGHTS, effective_spread, mid_price, queue_imbalance, queue_imbalance_levels, quoted_spread,
    trade_side, weighted_mid,
)

__all__ = [
    "LEVEL_WEIGHTS", "bin_start", "chi2_two_df_tail", "col", "effective_spread", "from_micros",
    "interval_micros", "kurt_corrected", "micros", "mid_price", "nan_to_null", "normal_density",
    "normality_k2", "queue_imbalance", "queue_imbalance_levels", "quoted_spread", "ratio", "round_to",
    "skew_corrected", "student_p", "trade_side", "unit_root_p", "weighted_mid", "zero_to_null",
]
