import random

import pytest
from pyspark.sql import functions as F

from barloom.bars import EPOCH, from_matrix
from barloom.timeframe import fan_out, interval_ms, roll_up, roll_up_exact, timeframe_minutes


def test_parse():
    assert [timeframe_minutes(x) for x in ("1m", "4H", "1D", "1W", "1M")] == [1, 240, 1440, 10080, 1]
    assert interval_ms("5m") == 300_000
    for bad in ("7H", "bad", "", "0m", "5x"):
        with pytest.raises(ValueError):
            timeframe_minutes(bad)


def plain(ticks, minutes):
    """Count-closed bars by a loop."""
    out, bar = [], None
    for t, o, h, l, c, v in ticks:
        if bar is None:
            if t % 60 == 0 and (t // 60) % 1440 % minutes == 0:
                bar = [t, o, h, l, c, v, 1]
            continue
        bar[2], bar[3], bar[4], bar[5], bar[6] = max(bar[2], h), min(bar[3], l), c, bar[5] + v, bar[6] + 1
        if bar[6] == minutes:
            out.append(tuple(bar[:6]))
            bar = None
    return out


def test_exact_roll_up_with_gaps_equals_the_loop(spark):
    rng, ticks = random.Random(4), []
    for k in range(3000):
        if k % 7 != 3:
            p = 100 + rng.random()
            ticks.append((EPOCH + 60 * k, p, p + 1, p - 1, p + rng.random() - 0.5, rng.random()))
    df = from_matrix(spark, [[o, h, l, c, v, t] for t, o, h, l, c, v in ticks], "X")
    for minutes in (5, 7, 60):
        got = [(r.time, r.open, r.high, r.low, r.close, pytest.approx(r.volume)) for r in roll_up_exact(df, f"{minutes}m" if minutes < 60 else "1h").orderBy("time").collect()]
        assert got == plain(ticks, minutes)


def test_dense_and_exact_agree_on_dense_bars(spark):
    df = from_matrix(spark, [[100 + k, 101 + k, 99 + k, 100.5 + k, 1] for k in range(3000)], "X")
    for tf in ("5m", "4h", "1D"):
        a, b = (f(df, tf).orderBy("time").collect() for f in (roll_up, roll_up_exact))
        assert a == b and len(a) == 3000 // timeframe_minutes(tf)


def test_time_zone_moves_the_day(spark):
    df = from_matrix(spark, [[1, 2, 0.5, 1, 1]] * 4000, "X")
    utc, tehran = (roll_up(df, "1D", timezone=z).orderBy("time").collect() for z in ("UTC", "Asia/Tehran"))
    assert utc[0].time == EPOCH and tehran[0].time == EPOCH + 86400 - int(3.5 * 3600)
    assert roll_up_exact(df, "1D", timezone="Asia/Tehran").first().time == tehran[0].time


def test_fan_out(spark):
    df = from_matrix(spark, [[1, 2, 0.5, 1, 1]] * 30, "X")
    assert {r.tf: r["count"] for r in fan_out(df, ["1m", "5m", "15m"]).groupBy("tf").count().collect()} == {"1m": 30, "5m": 6, "15m": 2}


def test_fan_out_is_one_exchange_and_equals_each_roll_up(spark):
    rng, ticks = random.Random(6), []
    for k in range(2000):
        if k % 11 != 5:
            p = 100 + rng.random()
            ticks.append([p, p + 1, p - 1, p + rng.random() - 0.5, rng.random(), EPOCH + 60 * k])
    df = from_matrix(spark, ticks, "X").cache()
    tfs = ["5m", "7m", "15m", "1h", "4h"]
    got = fan_out(df, tfs)
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    want = [r for tf in tfs for r in roll_up_exact(df, tf).collect()]
    assert sorted(got.collect()) == sorted(want) and len({r.tf for r in want}) == 5
    df.unpersist()


def test_a_price_of_zero_is_the_low(spark):
    """Zero is a price in a count-closed bar; a missing high or low is none."""
    rows = [[5, 6, 4, 5, 1], [5, 6, 0, 0, 1], [5, 9, 3, 5, 1], [-2, -2, -3, -2, 1], [-2, 0, -3, -1, 1], [-2, -1, -3, -1, 1]]
    bars = from_matrix(spark, rows, "X")
    for got in (roll_up_exact(bars, "3m"), fan_out(bars, ["3m"])):
        assert [(r.high, r.low) for r in got.orderBy("time").collect()] == [(9.0, 0.0), (0.0, -3.0)]
    missing = bars.withColumns({c: F.when(F.unix_timestamp(F.timestamp_seconds("time")) % 180 != 0, F.col(c)) for c in ("high", "low")})
    assert [(r.high, r.low) for r in roll_up_exact(missing, "3m").orderBy("time").collect()] == [(9.0, 0.0), (0.0, -3.0)]
