from .live import (
    bar_stream, book_stream, clean_stream, ofi_bar_stream, ofi_stream, use_rocksdb, volume_bar_stream, zoned,
)

__all__ = [
    "bar_stream", "book_stream", "clean_stream", "ofi_bar_stream", "ofi_stream", "use_rocksdb", "volume_bar_stream", "zoned",
]
