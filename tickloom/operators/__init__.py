from . import bars, clean, features, models, normalize, ofi, orderbook, rows, stats, trades, validate

__all__ = [
    "bars", "clean", "features", "models", "normalize", "ofi", "orderbook", "rows", "stats", "trades", "validate",
]
