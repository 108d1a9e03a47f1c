from . import books_and_flow, cleaning_and_bars, selection, sources_and_streams, statistics, tables_and_targets, windows
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
