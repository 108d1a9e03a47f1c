"""Waiting rows of a live symbol: handed over piece by piece, with few calls to the store."""

import datetime as dt
import random

import pandas as pd
import pyarrow as pa

from tickloom.streaming import ordered
from tickloom.streaming.ordered import BookProcessor, VolumeBarProcessor, WaitingRows


class _Store:
    """A map state that counts its calls."""

    def __init__(self):
        self.held, self.calls = {}, 0

    def containsKey(self, key):
        self.calls += 1
        return key in self.held

    def getValue(self, key):
        self.calls += 1
        return self.held[key]

    def updateValue(self, key, value):
        self.calls += 1
        self.held[key] = value

    def removeKey(self, key):
        self.calls += 1
        del self.held[key]

    def keys(self):
        return iter(list(self.held))


class _Value:
    kept = None

    def exists(self):
        return self.kept is not None

    def get(self):
        return self.kept

    def update(self, value):
        self.kept = value


class _Handle:
    def getMapState(self, name, key, value):
        return _Store()

    def getValueState(self, name, schema):
        return _Value()

    def registerTimer(self, ms):
        self.timer = ms


class _Expired:
    def __init__(self, ms):
        self.ms = ms

    def getExpiryTimeInMs(self):
        return self.ms


def frames(rows, columns, size):
    for i in range(0, len(rows), size):
        d = pd.DataFrame(rows[i : i + size], columns=columns)
        yield d.assign(ts=pd.to_datetime(d["ts"], unit="us"), symbol="A")


def run(processor, rows, columns, size=10_000):
    handle = _Handle()
    processor.init(handle)
    list(processor.handleInputRows(("A",), frames(rows, columns, size), None))
    return list(processor.handleExpiredTimer(("A",), None, _Expired(handle.timer)))


def test_a_timer_hands_over_rows_in_bounded_frames(monkeypatch):
    monkeypatch.setattr(ordered, "ADDED_ROWS", 20_000)
    monkeypatch.setattr(ordered, "FRAME_ROWS", 3_000)
    monkeypatch.setattr(ordered, "READ_PARTS", 5)
    columns = ["ts", "seq", "side", "price", "quantity", "is_seed"]
    rows = [(i * 1_000_000, i, "buy" if i % 2 else "sell", 100.0 - i % 7 if i % 2 else 200.0 + i % 5, i % 9 + 1 if i % 11 else None, False) for i in range(60_000)]
    mixed = random.Random(3).sample(rows, len(rows))
    out = run(BookProcessor(), mixed, columns)
    assert len(out) > 20 and max(map(len, out)) <= 3_000
    plain = BookProcessor()
    plain.touch = _Value()
    whole = pd.concat([f for f in out if len(f)], ignore_index=True)
    want = pd.DataFrame(plain.advance("A", rows), columns=plain.names)
    assert whole["seq"].tolist() == want["seq"].tolist()
    for c in ("bid_price", "ask_price", "bid_size", "ask_size", "ofi"):
        assert whole[c].fillna(-1).tolist() == want[c].fillna(-1).tolist()


def test_sparse_rows_take_few_calls_to_the_store():
    """One row in each ten seconds or fewer: calls follow the parts, not the rows."""
    waiting = WaitingRows(_Handle(), "us bigint, seq bigint")
    rows = [(i * 130_000_000, i) for i in range(50_000)]
    waiting.add(rows[::-1])
    assert waiting.take(rows[-1][0] + 1) == rows
    assert waiting.parts.calls + waiting.rows.calls < 2_000 and not waiting.parts.held and not waiting.rows.held


def test_ofi_of_sizes_that_are_partly_missing():
    """A missing size makes floats of its column in pandas; the others stay whole numbers."""
    columns = ["ts", "seq", "bid_price", "ask_price", "bid_size", "ask_size", "trade_price", "volume"]
    rows = [(i, i, 10.0, 11.0, 2**53 + 1 if i == 0 else 5 if i < 3 else None, 4, 10.5, 7) for i in range(4)]
    handle, ofi = _Handle(), ordered.OfiProcessor()
    ofi.init(handle)
    list(ofi.handleInputRows(("A",), frames(rows, columns, 10), None))
    held = ofi.pending.take(10)
    assert [type(r[4]) for r in held] == [int, int, int, type(None)]


def test_a_volume_bar_goes_on_in_the_next_frame(monkeypatch):
    columns = ["ts", "seq", "price", "volume"]
    rows = [(i * 700_000, i, 100.0 + i % 13, i % 17) for i in range(9_000)]
    whole = ordered.VolumeBarProcessor(500)
    whole.bar = _Value()
    want = whole.advance("A", rows)
    monkeypatch.setattr(ordered, "FRAME_ROWS", 37)
    out = run(ordered.VolumeBarProcessor(500), rows[::-1], columns, 1_000)
    assert len(out) > 100 and pd.concat([f for f in out if len(f)])["bar_id"].tolist() == [b[1] for b in want]
    assert sum(f["total_volume"].sum() for f in out) == sum(b[7] for b in want)


def test_live_rows_go_into_keyed_state_in_blocks(spark):
    """Each row that goes into keyed state becomes a Python tuple; blocks of a symbol do not."""
    rows = spark.range(50_000).selectExpr("IF(id % 5 = 4, NULL, CONCAT('s', id % 5)) AS symbol", "TIMESTAMP_MICROS(id * 7919 % 50000) AS ts", "id AS seq", "CAST(id AS DOUBLE) AS price", "IF(id % 3 = 0, NULL, id) AS volume")
    out = ordered.blocks(rows.repartition(2), VolumeBarProcessor.waiting).collect()
    assert 5 * 2 <= len(out) <= 2 * (50_000 // ordered.BLOCK_ROWS + 5)
    schema = ordered._schema(VolumeBarProcessor.waiting)
    found = []
    for block in out:
        held = ordered._tuples(pa.ipc.read_record_batch(pa.py_buffer(bytes(block["rows"])), schema))
        assert max(r[0] for r in held) == (block["ts"] - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)
        found += [(block["symbol"], *r) for r in held]
    want = [(None if i % 5 == 4 else f"s{i % 5}", i * 7919 % 50_000, i, float(i), i if i % 3 else None) for i in range(50_000)]
    assert sorted(found, key=lambda r: r[2]) == want


class _Now:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_a_late_row_of_a_block_in_time_is_dropped():
    handle, bars = _Handle(), VolumeBarProcessor(500)
    bars.init(handle)
    block = lambda *us: iter([pd.DataFrame({"symbol": ["A"], "ts": [pd.Timestamp(max(us), unit="us")], "rows": [ordered._batch([(u, u, 1.0, 2) for u in us], bars.pending.schema).serialize().to_pybytes()]})])
    list(bars.handleInputRows(("A",), block(5_000, 9_000), _Now(7)))
    list(bars.handleInputRows(("A",), block(6_999, 7_000, 7_001), _Now(8)))
    assert [r[0] for r in bars.pending.take(10_000)] == [5_000, 7_001, 9_000]


def test_columns_follow_as_single_rows_do():
    """One frame, or frames of any size: the same rows, and what is missing stays missing."""
    draw = random.Random(4)
    some = lambda value: None if draw.random() < 0.3 else value()
    price, size = lambda: draw.randint(0, 4) / 4, lambda: draw.randint(-2, 9)
    quotes = [(i, i, some(price), some(price), some(size), some(size), some(price), some(size)) for i in range(300)]
    orders = [(i, i, draw.choice(["buy", "sell"]), some(price), some(size), some(lambda: draw.random() < 0.2)) for i in range(300)]
    ticks = [(i, i, some(price), some(size)) for i in range(300)]
    for make, state, rows in ((ordered.OfiProcessor, "quote", quotes), (BookProcessor, "touch", orders), (lambda: VolumeBarProcessor(20), "bar", ticks)):
        single, whole, cut = make(), make(), make()
        for p in (single, whole, cut):
            setattr(p, state, _Value())
        want = [r for row in rows for r in single.advance("A", [row])]
        assert whole.advance("A", rows) == want and len(want) > 30
        assert [r for i in range(0, 300, 7) for r in cut.advance("A", rows[i : i + 7])] == want


def test_bars_within_a_frame_are_closed_as_columns(monkeypatch):
    """Only the first bar of a frame, and one that was open before, are looked at on their own."""
    calls, closed = [], VolumeBarProcessor._closed
    monkeypatch.setattr(VolumeBarProcessor, "_closed", staticmethod(lambda key, bar: calls.append(bar) or closed(key, bar)))
    rows = [(i, i, None if i % 5 == 0 else 1.0 + i % 3, None if i % 7 == 0 else 600 - i % 4 * 600 if i % 11 else 0) for i in range(2_000)]
    single, whole = VolumeBarProcessor(500), VolumeBarProcessor(500)
    single.bar, whole.bar = _Value(), _Value()
    want = [r for row in rows for r in single.advance("A", [row])]
    assert len(want) > 500 and any(r[3] is None for r in want) and any(r[7] == 0 for r in want)
    calls.clear()
    assert [r for i in range(0, 2_000, 500) for r in whole.advance("A", rows[i : i + 500])] == want
    assert whole.bar.get() == single.bar.get() and len(calls) <= 2 * 4
