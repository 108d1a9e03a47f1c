from .files import (
    downcast_floats, flatten_header, footer_counts, footers, read_bars, read_csv, read_minute_bars, read_parquet, verify,
    verify_stored, with_session_date, write_csv, write_parquet,
)
from .market import MARKET_SQL, market_table
from .schemas import (
    DAILY_BARS, DEEP_QUOTES, ORDER_EVENTS, QUOTES, STRATEGY_RETURNS, TICKS_TABLE, TRADES, conform,
)

__all__ = [
    "DAILY_BARS", "DEEP_QUOTES", "MARKET_SQL", "ORDER_EVENTS", "QUOTES", "STRATEGY_RETURNS", "TICKS_TABLE", "TRADES",
    "conform", "downcast_floats", "flatten_header", "footer_counts", "footers", "market_table", "read_bars", "read_csv", "read_minute_bars",
    "read_parquet", "verify", "verify_stored", "with_session_date", "write_csv", "write_parquet",
]
