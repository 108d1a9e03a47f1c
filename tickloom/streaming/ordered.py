"""Keyed state for operators that need a symbol's ticks in order.

A micro-batch holds a symbol's rows in any order, and later batches may hold earlier rows.
Rows therefore wait in state until the watermark has passed them; an event-time timer then
hands them over, sorted by (ts, seq), exactly once. They wait in parts, sorted stretches of at most ``PART_ROWS`` rows cut
at buckets of event time, so a timer reads the parts that are due and no row that is not yet, save those of the parts
in which the watermark stands. Rows come in and are handed over piece by piece: nothing holds all that a symbol has waiting.
They are Arrow columns all the way, and ``follow`` works on whole columns: one symbol is one task, so its rows must be cheap.
PySpark makes a Python tuple of each row that goes into keyed state, so ``blocks`` puts many rows of a symbol into one first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Least event time that a bucket of waiting rows covers; what arrives at once is cut into about ``BUCKETS`` of them or more.
BUCKET_US = 10_000_000
BUCKETS = 64
#: Most rows of a part, rows that are sorted and stored at once, parts that a timer reads at once, and rows of an output frame.
PART_ROWS = 10_000
ADDED_ROWS = 500_000
#: Most rows of a block, and rows that a task looks through at once to make blocks.
BLOCK_ROWS = 2_000
LOOK_ROWS = 100_000
READ_PARTS = 50
FRAME_ROWS = 20_000

_TYPES = {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}


def _schema(fields: str) -> pa.Schema:
    """Arrow schema of a DDL text."""
    return pa.schema([(name, _TYPES[kind]) for name, kind in map(str.split, fields.split(","))])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def _tuples(batch: pa.RecordBatch) -> list[tuple]:
    return list(zip(*batch.to_pydict().values()))


def _in_order(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    """The rows of all ``batches`` by (time, seq), a missing seq first."""
    whole = pa.Table.from_batches(batches).combine_chunks().to_batches()
    if not whole:
        return batches[0].slice(0, 0)
    time, seq = batches[0].schema.names[:2]
    return whole[0].take(pc.sort_indices(whole[0], sort_keys=[(time, "ascending"), (seq, "ascending")], null_placement="at_start"))


def blocks(df: DataFrame, fields: str) -> DataFrame:
    """(symbol, ts, rows): the rows of a stream of symbol, ts, seq, ... in blocks of one symbol, with the block's last time.

    ``fields`` is what waits of a row: microseconds of ``ts``, and the columns after it.
    """
    schema = _schema(fields)

    def packed(table: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = table.combine_chunks().to_batches()[0]
        rows = rows.take(pc.sort_indices(rows, sort_keys=[("symbol", "ascending"), ("ts", "ascending")]))
        symbol, ts = rows.column(0), rows.column(1)
        if ts.null_count:
            raise ValueError("a live row without a time has no place among the others")
        waiting = pa.RecordBatch.from_arrays([ts.cast(pa.timestamp("us", ts.type.tz)).cast(pa.int64()), *rows.columns[2:]], schema=schema)
        codes = symbol.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)]
        parts = [(i, min(i + BLOCK_ROWS, end)) for first, end in zip(cuts, cuts[1:]) for i in range(first, end, BLOCK_ROWS)]
        at, last = pa.array([a for a, _ in parts]), pa.array([b - 1 for _, b in parts])
        held = pa.array([waiting.slice(a, b - a).serialize().to_pybytes() for a, b in parts], type=pa.binary())
        yield pa.RecordBatch.from_arrays([symbol.take(at), ts.take(last), held], names=["symbol", "ts", "rows"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = [], 0
        for batch in batches:
            if batch.num_rows:
                seen.append(batch)
                n += batch.num_rows
            if n >= LOOK_ROWS:
                yield from packed(pa.Table.from_batches(seen))
                seen, n = [], 0
        if seen:
            yield from packed(pa.Table.from_batches(seen))

    return df.mapInArrow(pack, "symbol string, ts timestamp, rows binary")


class WaitingRows:
    """Rows in sorted parts by the time of their first row. A batch adds parts and rewrites none."""

    def __init__(self, handle: StatefulProcessorHandle, fields: str):
        self.schema = _schema(fields)
        self.parts = handle.getMapState("parts", "start bigint", "n bigint")
        # rows are stored as bytes, which pass to the store and back as they are
        self.rows = handle.getMapState("rows", "start bigint, part bigint", "rows binary")

    def add(self, rows: list[tuple] | list[pa.RecordBatch]) -> None:
        if not rows:
            return
        rows = _in_order([_batch(rows, self.schema)] if isinstance(rows[0], tuple) else rows)
        if not rows.num_rows:
            return
        us = rows.column(0).to_numpy()
        width = max(BUCKET_US, int(us[-1] - us[0]) // BUCKETS // BUCKET_US * BUCKET_US)
        cuts = [0, *(np.flatnonzero(np.diff(us // width)) + 1).tolist(), len(us)]
        for first, end in zip(cuts, cuts[1:]):
            for i in range(first, end, PART_ROWS):
                self._put(int(us[i]), rows.slice(i, min(PART_ROWS, end - i)))

    def _put(self, start: int, held: pa.RecordBatch) -> None:
        n = self.parts.getValue((start,))[0] if self.parts.containsKey((start,)) else 0
        self.rows.updateValue((start, n), (held.serialize().to_pybytes(),))
        self.parts.updateValue((start,), (n + 1,))

    def _get(self, start: int, part: int) -> pa.RecordBatch:
        return pa.ipc.read_record_batch(pa.py_buffer(bytes(self.rows.getValue((start, part))[0])), self.schema)

    def due(self, until: int) -> Iterator[pa.RecordBatch]:
        """Remove the rows before ``until`` and hand them over in order, in batches.

        Parts are read in order of their first rows; what lies before the first row of the next part is complete.
        """
        starts = sorted(s for (s,) in self.parts.keys() if s < until)
        held = _batch([], self.schema)
        for i in range(0, len(starts), READ_PARTS):
            read = [held]
            for start in starts[i : i + READ_PARTS]:
                for part in range(self.parts.getValue((start,))[0]):
                    read.append(self._get(start, part))
                    self.rows.removeKey((start, part))
                self.parts.removeKey((start,))
            held = _in_order(read)
            end = int(np.searchsorted(held.column(0).to_numpy(), min([until, *starts[i + READ_PARTS : i + READ_PARTS + 1]])))
            if end:
                yield held.slice(0, end)
                held = held.slice(end)
        self.add([held])

    def take(self, until: int) -> list[tuple]:
        """What ``due`` hands over, in one list of tuples."""
        return [row for rows in self.due(until) for row in _tuples(rows)]


class OrderedProcessor(StatefulProcessor):
    """Holds rows back until they are complete, then passes them to ``follow`` in order."""

    #: DDL of the waiting rows: microseconds, seq and the values ``follow`` reads.
    waiting: str
    #: Output column names.
    names: list[str]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = WaitingRows(handle, self.waiting)
        #: Watermark, in milliseconds, when the key was last looked at: that of the batch before, for a key in every batch.
        self.seen = handle.getValueState("seen", "watermark bigint")
        self.open_state(handle)

    def open_state(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def follow(self, key: str, rows: pa.RecordBatch) -> pa.RecordBatch:
        """Output rows (columns ``names``) of the next rows, one at least, of a key."""
        raise NotImplementedError

    def advance(self, key: str, rows: list[tuple]) -> list[tuple]:
        """``follow`` on tuples."""
        return _tuples(self.follow(key, _batch(rows, _schema(self.waiting))))

    def _out(self, key: str, columns: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key] * len(columns[0]), type=pa.string()), *columns], names=self.names)

    def _frame(self, rows: pa.RecordBatch | None = None) -> pd.DataFrame:
        out = pd.DataFrame([], columns=self.names) if rows is None else rows.to_pandas()
        return out.assign(ts=pd.to_datetime(out["ts"], unit="us"))

    def _rows(self, frames: Iterator[pd.DataFrame]) -> Iterator[pa.RecordBatch]:
        """The rows of frames that hold rows, or ``blocks`` of them."""
        schema = self.pending.schema
        for frame in frames:
            if "rows" in frame.columns:
                found = [pa.ipc.read_record_batch(pa.py_buffer(held), schema) for held in frame["rows"]]
                # Spark drops a block that is late as a whole; of another, the rows that are late are dropped here
                late = self.seen.get()[0] * 1000 if self.seen.exists() else None
                yield from found if late is None else (b.filter(pc.greater(b.column(0), late)) for b in found)
                continue
            if frame["ts"].isna().any():
                raise ValueError("a live row without a time has no place among the others")
            # whole microseconds, which no time zone setting of a worker can shift
            us = (frame["ts"] - pd.Timestamp(0)) // pd.Timedelta(microseconds=1)
            values = frame.drop(columns="symbol").assign(ts=us)
            # a missing whole number has made floats of its column in pandas
            columns = [pa.array(values[c], type=f.type, from_pandas=True) for c, f in zip(values.columns, schema)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        latest, new, n = None, [], 0
        for batch in self._rows(rows):
            if not batch.num_rows:
                continue
            new.append(batch)
            n += batch.num_rows
            if n >= ADDED_ROWS:
                self.pending.add(new)
                new, n = [], 0
            last = pc.max(batch.column(0)).as_py()
            latest = last if latest is None else max(latest, last)
        self.pending.add(new)
        self._look(timerValues)
        if latest is not None:
            # one millisecond up, so that every row of the millisecond is behind the watermark
            self.handle.registerTimer(latest // 1000 + 1)
        yield self._frame()

    def _look(self, timerValues) -> None:
        if timerValues is not None:
            self.seen.update((timerValues.getCurrentWatermarkInMs(),))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._look(timerValues)
        for ready in self.pending.due(expiredTimerInfo.getExpiryTimeInMs() * 1000):
            for i in range(0, ready.num_rows, FRAME_ROWS):
                yield self._frame(self.follow(key[0], ready.slice(i, FRAME_ROWS)))
        yield self._frame()

    def close(self) -> None:
        pass


class _Known:
    """A column as numbers and a mask of those that are known; numbers that are not known are 0."""

    def __init__(self, values: np.ndarray, known: np.ndarray):
        self.values, self.known = values, known

    @classmethod
    def of(cls, column: pa.Array) -> "_Known":
        known = column.is_valid().to_numpy(zero_copy_only=False)
        return cls(column.fill_null(0).to_numpy(zero_copy_only=False), known)

    def after(self, first) -> "_Known":
        """Each row's value before it; ``first`` is that of the first row."""
        head = np.array([0 if first is None else first], dtype=self.values.dtype)
        return _Known(np.append(head, self.values[:-1]), np.append(first is not None, self.known[:-1]))

    def last(self):
        return self.values[-1].item() if self.known[-1] else None

    def array(self) -> pa.Array:
        return pa.array(self.values, mask=~self.known)


def _sum(a: _Known, b: _Known, sign: int = -1) -> _Known:
    known = a.known & b.known
    return _Known(np.where(known, a.values + sign * b.values, 0), known)


def _either(test: np.ndarray, a: _Known, b: _Known) -> _Known:
    return _Known(np.where(test, a.values, b.values), np.where(test, a.known, b.known))


class OfiProcessor(OrderedProcessor):
    """State: the last quote of the symbol."""

    waiting = (
        "us bigint, seq bigint, bid_price double, ask_price double, bid_size bigint, ask_size bigint, "
        "trade_price double, volume bigint"
    )
    names = ["symbol", "ts", "seq", "bid_price", "ask_price", "bid_size", "ask_size", "trade_price", "volume", "ofi"]

    def open_state(self, handle):
        self.quote = handle.getValueState("quote", "bid_price double, ask_price double, bid_size bigint, ask_size bigint")

    @staticmethod
    def _flow(now: _Known, size: _Known, was: _Known, was_size: _Known, better: np.ndarray) -> _Known:
        both = now.known & was.known
        kept = _either(both & (now.values == was.values), _sum(size, was_size), _Known(-was_size.values, was_size.known))
        return _either(both & better, size, kept)

    def follow(self, key, rows):
        quote = [_Known.of(rows.column(i)) for i in range(2, 6)]
        first = not self.quote.exists()
        bid, ask, bid_size, ask_size = quote
        before = [c.after(v) for c, v in zip(quote, (None,) * 4 if first else self.quote.get())]
        up = self._flow(bid, bid_size, before[0], before[2], bid.values > before[0].values)
        down = self._flow(ask, ask_size, before[1], before[3], ask.values < before[1].values)
        flow = _sum(up, down).values
        if first:
            flow[0] = 0
        self.quote.update(tuple(c.last() for c in quote))
        return self._out(key, [*rows.columns, pa.array(flow)])


class BookProcessor(OrderedProcessor):
    """State: the touch as last read.

    A price that becomes the best was never seen before, so its size starts with the event that made it the best and no
    other level is needed. A missing price changes nothing and a missing quantity adds nothing.
    """

    waiting = "us bigint, seq bigint, side string, price double, quantity bigint, is_seed boolean"
    names = ["symbol", "ts", "seq", "bid_price", "ask_price", "bid_size", "ask_size", "ofi"]

    def open_state(self, handle):
        self.touch = handle.getValueState("touch", "bid_price double, ask_price double, bid_size bigint, ask_size bigint")

    def follow(self, key, rows):
        side, price, quantity = rows.column(2), _Known.of(rows.column(3)), _Known.of(rows.column(4))
        buys, sells = (pc.fill_null(pc.equal(side, s), False).to_numpy(zero_copy_only=False) for s in ("buy", "sell"))
        wrong = np.flatnonzero(~(buys | sells))
        if len(wrong):
            raise ValueError(f"an order is on the buy or the sell side, not {side[int(wrong[0])].as_py()!r}")
        was = self.touch.get() if self.touch.exists() else (None,) * 4
        bid, bid_size = self._best(price, quantity, buys, was[0], was[2], 1)
        ask, ask_size = self._best(price, quantity, sells, was[1], was[3], -1)
        touch = bid, ask, bid_size, ask_size
        before = [c.after(v) for c, v in zip(touch, was)]
        up = self._change(bid, bid_size, before[0], before[2])
        down = self._change(ask, ask_size, before[1], before[3])
        self.touch.update(tuple(c.last() for c in touch))
        out = self._out(key, [rows.column(0), rows.column(1), *[c.array() for c in (*touch, _sum(up, down))]])
        return out.filter(pc.invert(pc.fill_null(rows.column(5), False)))

    @staticmethod
    def _best(price: _Known, quantity: _Known, here: np.ndarray, was, was_size, sign: int) -> tuple[_Known, _Known]:
        """Best price of one side (``sign`` 1: the highest) after each row, and the size of its queue."""
        here = here & price.known
        level = np.maximum.accumulate(np.append(-np.inf if was is None else sign * was, np.where(here, sign * price.values, -np.inf)))
        earlier = np.append(was is not None, here[:-1]).cumsum() > 0
        moved = here & (~earlier | (sign * price.values > level[:-1]))
        adds = here & quantity.known & (moved | (sign * price.values == level[:-1]))
        number = np.append(0, np.cumsum(moved))  # of the level; 0 is the one of the frame before
        within = lambda x: (x - np.append(0, x[:-1][moved])[number])[1:]
        total = np.cumsum(np.append(0 if was_size is None else was_size, np.where(adds, quantity.values, 0)))
        seen = np.cumsum(np.append(was_size is not None, adds).astype(np.int64))
        known = earlier | here
        size_known = within(seen) > 0
        best = _Known(np.where(known, sign * level[1:], 0.0), known)
        return best, _Known(np.where(size_known, within(total), 0), size_known)

    @staticmethod
    def _change(price: _Known, size: _Known, was: _Known, was_size: _Known) -> _Known:
        """The whole queue where the best price moved, else the change of its size."""
        return _either(price.known & was.known & (price.values == was.values), _sum(size, was_size), size)


class VolumeBarProcessor(OrderedProcessor):
    """State: volume traded so far and the bar that is still open."""

    waiting = "us bigint, seq bigint, price double, volume bigint"
    names = ["symbol", "bar_id", "ts", "open", "high", "low", "close", "total_volume", "vwap"]

    out = _schema("symbol string, bar_id bigint, ts bigint, open double, high double, low double, close double, total_volume bigint, vwap double")

    def __init__(self, threshold: int):
        self.threshold = threshold

    def open_state(self, handle):
        self.bar = handle.getValueState(
            "bar",
            "traded bigint, bar_id bigint, us bigint, open double, high double, low double, close double, "
            "total bigint, value double",
        )

    def follow(self, key, rows):
        traded, held = 0, None
        if self.bar.exists():
            traded, *held = self.bar.get()
        us, price, volume = rows.column(0).to_numpy(), _Known.of(rows.column(2)), _Known.of(rows.column(3))
        upto = pc.cumulative_sum_checked(pa.array(volume.values), start=traded).to_numpy()
        bar_id = upto // self.threshold
        starts = np.append(0, np.flatnonzero(np.diff(bar_id)) + 1)
        n, m = len(us), len(starts)
        at, bar = np.arange(n), np.repeat(np.arange(m), np.diff(np.append(starts, n)))
        first = np.minimum.reduceat(np.where(price.known, at, n), starts)
        last = np.maximum.reduceat(np.where(price.known, at, -1), starts)
        priced, both = last >= 0, price.known & volume.known
        bars = {
            "bar_id": bar_id[starts], "ts": us[np.append(starts[1:], n) - 1], "open": price.values[np.minimum(first, n - 1)],
            "high": np.maximum.reduceat(np.where(price.known, price.values, -np.inf), starts),
            "low": np.minimum.reduceat(np.where(price.known, price.values, np.inf), starts), "close": price.values[last],
            "total": np.add.reduceat(volume.values, starts),
        }
        valued = np.bincount(bar, weights=both, minlength=m) > 0
        # added up row by row, from what the bar has from the frame before
        goes_on = held is not None and held[0] == bar_id[0]
        before = held[7] if goes_on and held[7] is not None else 0.0
        value = np.bincount(np.append(0, bar), weights=np.append(before, np.where(both, price.values * volume.values, 0.0)), minlength=m)
        columns = [(bars["bar_id"], None), (bars["ts"], None), *[(bars[c], priced) for c in ("open", "high", "low", "close")], (bars["total"], None), (value, valued)]
        one = lambda i: [v[i].item() if known is None or known[i] else None for v, known in columns]
        b, closed = one(0), []
        if goes_on:
            _, _, was_open, was_high, was_low, was_close, was_total, was_value = held
            if was_open is not None:
                b[2] = was_open
                b[3] = was_high if b[3] is None else max(was_high, b[3])
                b[4] = was_low if b[4] is None else min(was_low, b[4])
                b[5] = was_close if b[5] is None else b[5]
            b[6] += was_total
            b[7] = was_value if b[7] is None else b[7]
        elif held is not None:
            closed.append(held)
        if m > 1:
            closed.append(b)
            b = one(m - 1)
        self.bar.update((int(upto[-1]), *b))
        few = _batch([self._closed(key, c) for c in closed], self.out)
        return few if m < 3 else pa.Table.from_batches([few, self._between(key, columns)]).combine_chunks().to_batches()[0]

    def _between(self, key, columns: list[tuple]) -> pa.RecordBatch:
        """Rows of the bars that opened and closed in one frame: all but its first and last, as whole columns."""
        cut = [(v[1:-1], None if known is None else known[1:-1]) for v, known in columns]
        (total, _), (value, valued) = cut[-2:]
        divided = valued & (total != 0)
        vwap = np.divide(value, total, out=np.zeros(len(total)), where=divided)
        known = [(v, k) for v, k in cut[:-1]] + [(vwap, divided)]
        return pa.RecordBatch.from_arrays(
            [pa.array([key] * len(total), type=pa.string()), *[pa.array(v, mask=None if k is None else ~k) for v, k in known]], schema=self.out
        )

    @staticmethod
    def _closed(key, bar):
        bar_id, ts, first, high, low, last, total, value = bar
        vwap = value / total if total and value is not None else None
        return (key, bar_id, ts, first, high, low, last, total, vwap)
