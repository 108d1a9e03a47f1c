"""The touch of keys cut into runs numbers its rows once."""

from tickloom.operators import orderbook
from tickloom.plans import Axis, layout


def test_touch_of_a_large_key_numbers_rows_once(spark):
    orders = [("a", i, i, "buy" if i % 2 else "sell", 100.0 + i // 9 if i % 2 else 200.0 - i // 7, i % 5 + 1) for i in range(60)]
    df = spark.createDataFrame(orders, "symbol string, ts long, seq long, side string, price double, quantity long").repartition(3)
    before = len(layout._written)
    split = orderbook.touch(df, Axis(rows_per_task=4))
    assert len(layout._written) - before <= 2
    assert sorted(split.collect()) == sorted(orderbook.touch(df, Axis()).select(*split.columns).collect(), key=tuple)
