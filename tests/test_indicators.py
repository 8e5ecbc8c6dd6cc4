"""Known values, properties and edge cases of the indicators, and plain-loop versions of the state machines."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import barloom.operators  # noqa: F401
from barloom.bars import EPOCH, from_columns, from_matrix, latest, skip_first
from barloom.functions.extract import extract, valid_bar
from barloom.registry import OPERATORS, Registrations, get, register_operator


def floats(spark, values, symbol="BTC"):
    return from_matrix(spark, [[v, v + 1, v - 1, v, 1] for v in values], symbol)


def run(df, name, *outputs, **params):
    out = get(name)(df, **params).orderBy("symbol", "time").collect()
    outputs = outputs or (OPERATORS[name].name,)
    return [tuple(r[o] for o in outputs) if len(outputs) > 1 else r[outputs[0]] for r in out]


def test_side_and_extractors(spark):
    df = from_matrix(spark, [[110, 115, 100, 105], [100, 110, 90, 108]], "BTC")
    assert [r.side for r in df.orderBy("time").collect()] == [0, 1]
    df = from_matrix(spark, [[100, 110, 90, 42], [100, 120, 80, 100]], "BTC").orderBy("time")
    assert df.select(extract("close").alias("x")).first().x == 42.0
    assert df.select(extract("hlc3").alias("x")).collect()[1].x == 100.0


def test_layouts_and_validity(spark):
    assert from_matrix(spark, [[100, 110, 90, 105, 2]], "X").first().high == 110
    got = from_columns(spark, {"open": [1.0, 2.0], "high": [3.0, 3.0], "low": [0.5, 0.5], "close": [2.0], "volume": [1.0]}, "X")
    assert got.count() == 2 and got.filter(valid_bar()).count() == 1
    assert from_matrix(spark, [[100, 99, 90, 105]], "X").filter(valid_bar()).count() == 0


def test_known_values(spark):
    assert run(floats(spark, [1, 2, 3]), "sma", period=3) == [2.0]
    assert run(floats(spark, [1, 2, 3, 4, 5]), "sma", period=3)[-1] == 4.0
    assert run(floats(spark, [7, 13]), "sma", period=1) == [7.0, 13.0]
    assert run(floats(spark, [100] * 30), "ema", period=5)[-1] == pytest.approx(100)
    assert run(floats(spark, [1, 2, 3]), "wma", period=3) == [pytest.approx(14 / 6)]
    assert run(floats(spark, [1, 2, 3, 4, 5]), "momentum", period=3) == [3.0, 3.0]
    assert run(floats(spark, [100, 200]), "roc", period=1) == [100.0]
    assert run(floats(spark, [10] * 20), "stddev", period=5)[-1] == 0
    assert run(floats(spark, range(1, 7)), "stddev", period=5)[-1] > 0


def test_ranges(spark):
    assert all(0 <= x <= 100 for x in run(floats(spark, [100 + 0.5 * i for i in range(50)]), "rsi"))
    assert run(floats(spark, [100 + 5 * i for i in range(50)]), "rsi")[-1] > 90
    assert run(floats(spark, [1000 - 5 * i for i in range(50)]), "rsi")[-1] < 10
    assert all(-100 <= x <= 100 for x in run(floats(spark, [100 + 2 * i for i in range(20)]), "cmo", period=5))
    bars = from_matrix(spark, [[100 + i, 110 + i, 90 + i, 105 + i] for i in range(10)], "BTC")
    assert all(-100 <= x <= 0 for x in run(bars, "williams_r", period=5))
    assert run(bars, "ichimoku", "tenkan", "senkou_b", tenkan=3, kijun=5, senkou=7)
    assert all(isinstance(up, bool) for _, up in run(bars, "psar", "sar", "is_uptrend"))
    macd = from_matrix(spark, [[100 + i, 102 + i, 98 + i, 101 + i] for i in range(20)], "BTC")
    assert run(macd, "macd", "macd", "signal", "histogram", fast=3, slow=5, signal=3)


def test_true_range_bands_and_flow(spark):
    tr = run(from_matrix(spark, [[100, 110, 90, 100], [100, 120, 95, 115]], "BTC"), "tr")
    assert tr == [20.0, 25.0]
    assert run(from_matrix(spark, [[100, 110, 90, 100], [100, 120, 95, 115]], "BTC"), "tr", parity=True) == [25.0]
    for upper, middle, lower in run(floats(spark, [100, 102, 98, 105, 99, 103, 101]), "bbands", "upper", "middle", "lower", period=5):
        assert upper >= middle >= lower
    don = from_matrix(spark, [[100, 110, 90, 100], [100, 120, 85, 100], [100, 115, 95, 100]], "BTC")
    assert run(don, "donchian", "upper", "lower", period=3) == [(120.0, 85.0)]
    up = from_matrix(spark, [[100, 101, 99, 100, 100], [100, 108, 99, 107, 150]], "BTC")
    down = from_matrix(spark, [[100, 101, 99, 100, 100], [100, 101, 95, 96, 200]], "BTC")
    assert run(up, "obv")[-1] > 0 > run(down, "obv")[-1]


AVERAGES = sorted(n for n, o in OPERATORS.items() if o.family == "average")


@pytest.mark.parametrize("name", AVERAGES)
def test_average_of_a_constant_is_the_constant(name, spark):
    assert run(floats(spark, [50] * 60), name)[-1] == pytest.approx(50)


def test_too_few_bars_give_no_rows_and_empty_input_too(spark):
    few, none = floats(spark, [5.0]), floats(spark, [1.0]).filter("false")
    for name in ("sma", "ema", "macd", "psar", "zigzag_base", "kst", "doji"):
        assert get(name)(none).count() == 0
    assert get("ema")(few).count() == get("kst")(few).count() == 0


def test_flat_and_zero_volume(spark):
    flat = from_matrix(spark, [[10, 10, 10, 10, 0]] * 60, "X")
    assert run(flat, "vwma") == run(flat, "cmf") == run(flat, "rsi") == []
    assert set(run(flat, "stochrsi")) == {50.0} and set(run(flat, "zscore")) == {0.0} and set(run(flat, "correl")) == {0.0}
    assert run(flat, "doji", "signal") == [0] * 60


def test_symbols_do_not_mix_and_row_order_does_not_matter(spark):
    rng = random.Random(1)
    values = [100 + rng.random() * 10 for _ in range(60)]
    alone = floats(spark, values, "A")
    both = alone.unionByName(floats(spark, [v * 7 for v in values], "B")).repartition(7)
    for name in ("sma", "ema", "rsi", "kama"):
        want = run(alone, name)
        got = [r[name] for r in get(name)(both).filter("symbol = 'A'").orderBy("time").collect()]
        assert got == pytest.approx(want)


def test_fold_over_small_arrow_batches_equals_one_batch(spark):
    rng = random.Random(2)
    df = floats(spark, [100 + rng.random() * 10 for _ in range(200)])
    names = ("ema", "dema", "t3", "zlema", "jma", "rsi", "stochrsi", "kama", "tsi", "macd", "adx", "nvi", "supertrend", "psar", "zigzag_base", "ssma", "vidya")
    outputs = {n: [c for c in get(n)(df).columns if c not in ("symbol", "tf", "time")] for n in names}
    want = {n: get(n)(df).orderBy("time").collect() for n in names}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for n in names:
            got = get(n)(df).orderBy("time").collect()
            assert len(got) == len(want[n])
            for a, b in zip(got, want[n], strict=True):
                for o in outputs[n]:
                    assert a[o] == (pytest.approx(b[o]) if isinstance(b[o], float) else b[o]), n
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("cut", [1, 3, 8, 9, 100])
def test_missing_values_in_a_filter_do_not_depend_on_batches(cut):
    from barloom.plans.recursive import Ema, Linear

    x = np.arange(1.0, 150.0)
    x[[8, 70, 71]] = np.nan, np.inf, -np.inf
    for make in (lambda: Ema(3), lambda: Linear(0.5), lambda: Ema(20, seed="first")):
        whole, cuts = make().feed(x), make()
        parts = np.concatenate([cuts.feed(x[i : i + cut]) for i in range(0, len(x), cut)])
        assert np.allclose(whole, parts, equal_nan=True)
        plain = make().feed(x[np.isfinite(x)])
        assert np.allclose(whole[np.isfinite(x)], plain, equal_nan=True) and np.isnan(whole[[8, 70, 71]]).all()


def test_a_fold_takes_one_bar_of_a_time(spark):
    df = floats(spark, [100.0 + i for i in range(40)])
    want = run(df, "ema")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert run(df.unionByName(df), "ema") == pytest.approx(want)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_columns_are_part_of_a_key(spark):
    uses = Registrations()
    a, b = uses.add("sma", "btc", "1m", value=F.col("close") * 2), uses.add("sma", "btc", "1m", value=F.col("close") * 3)
    assert a != b and uses.add("sma", "btc", "1m", value=F.col("close") * 2) == a and len(uses.keys()) == 2


def plain_psar(bars, step=0.02, most=0.2):
    """A second version of the rule, bar by bar, with the lows and highs kept per trend."""
    out, s = [], None
    for i, (h, l, c) in enumerate(bars):
        if i < 2:
            continue
        if i == 2:
            up = c > bars[0][2]
            s = {"up": up, "sar": bars[0][1] if up else bars[0][0], "ep": h if up else l, "af": step, "lo": [bars[1][1], bars[0][1]] if up else [0, 0], "hi": [0, 0] if up else [bars[1][0], bars[0][0]]}
        else:
            s["sar"] += s["af"] * (s["ep"] - s["sar"])
            if s["up"]:
                s["sar"] = min([s["sar"], *s["lo"]])
                if h > s["ep"]:
                    s["ep"], s["af"] = h, min(s["af"] + step, most)
                s["lo"] = [l, s["lo"][0]]
                if l < s["sar"]:
                    s.update(sar=s["ep"], ep=l, af=step, up=False)
            else:
                s["sar"] = max([s["sar"], *s["hi"]])
                if l < s["ep"]:
                    s["ep"], s["af"] = l, min(s["af"] + step, most)
                s["hi"] = [h, s["hi"][0]]
                if h > s["sar"]:
                    s.update(sar=s["ep"], ep=h, af=step, up=True)
        out.append((s["sar"], s["up"]))
    return out


def test_psar_equals_the_plain_loop(spark):
    rng, price, bars = random.Random(3), 100.0, []
    for _ in range(150):
        price += rng.gauss(0, 2)
        bars.append((price + rng.random(), price - rng.random(), price))
    df = from_matrix(spark, [[c, h, l, c] for h, l, c in bars], "X")
    for (a, up), (b, was) in zip(run(df, "psar", "sar", "is_uptrend"), plain_psar(bars), strict=True):
        assert a == pytest.approx(b) and up == was


def test_zigzag_marks_turns(spark):
    path = [100 + 5 * i for i in range(10)] + [145 - 6 * i for i in range(12)] + [79 + 5 * i for i in range(12)] + [134 - 6 * i for i in range(12)]
    df = from_matrix(spark, [[a, max(a, b) + 1, min(a, b) - 1, b] for a, b in zip(path, path[1:])], "X")
    got = run(df, "zigzag_base", "label", "price")
    assert [x[0] for x in got][0] in ("L", "H") and len(got) >= 3
    assert {x[0] for x in got[1:]} <= {"LL", "LH", "HH", "HL"}


def test_latest_and_skip(spark):
    df = spark.createDataFrame([("a", "1m", 1, 1, 5.0), ("a", "1m", 1, 2, 6.0), ("a", "1m", 2, 1, 7.0)], "symbol string, tf string, time long, version int, x double")
    assert sorted(r.x for r in latest(df).collect()) == [6.0, 7.0]
    assert [r.x for r in skip_first(latest(df), 1).collect()] == [7.0]


def test_registry(spark):
    uses = Registrations()
    a, b = uses.add("sma", "btc", "1m", period=20), uses.add("sma", "btc", "1m")
    c = uses.add("sma", "btc", "1m", period=50)
    assert a == b != c and len(uses.keys()) == 2 and a == "SMA_BTC_1m_20_close"
    uses.remove(a), uses.remove(a)
    assert uses.keys() == [c]
    register_operator("last_close", lambda bars: bars.select("symbol", "tf", "time", "close"), replace=True)
    assert get("last_close")(floats(spark, [1, 2])).count() == 2
    OPERATORS.pop("last_close")
    with pytest.raises(KeyError):
        get("nothing")
    with pytest.raises(TypeError):
        get("sma")(floats(spark, [1]), wrong=1)
    assert len(OPERATORS) == 115


def test_epoch_is_a_monday():
    assert EPOCH % 86400 == 0 and (EPOCH // 86400 + 3) % 7 == 0 and math.isfinite(EPOCH)


def test_zigzag_worked_by_hand(spark):
    """Up over two bars, alarmed at 3, turned at 4; down, alarmed at 6, turned at 7; up, turned at 10."""
    closes = [10, 12, 14, 16, 13, 11, 9, 12, 14, 15, 11, 10]
    rows = [("S", "1m", i, float(o), float(max(o, c) + 1), float(min(o, c) - 1), float(c), 1.0) for i, (o, c) in enumerate(zip(closes, closes[1:], strict=False))]
    df = spark.createDataFrame(rows, "symbol string, tf string, time long, open double, high double, low double, close double, volume double")
    got = [(r.time, r.label, r.price, r.pivot_time, r.pivot_close, r.break_close) for r in get("zigzag_base")(df).orderBy("time").collect()]
    assert got == [(4, "L", 11.0, 4, 11.0, 11.0), (7, "LH", 14.0, -1, 0.0, 14.0), (10, "HL", 16.0, 8, 15.0, 10.0)]


def test_zigzag_transitions():
    from barloom.operators.zigzag import ZigZagFold

    fold = ZigZagFold(0.0)
    bars = [(10.0, 12.0), (12.0, 14.0), (14.0, 16.0), (16.0, 15.0), (15.0, 13.0), (13.0, 15.0), (15.0, 17.0)]
    states = []
    for t, (o, c) in enumerate(bars):
        fold.step((o, max(o, c), min(o, c), c, float(t)))
        states.append((fold.way, fold.lead and fold.lead[4], fold.alarmed, fold.nest_follows))
    assert states == [(0, None, False, False), (1, 1.0, False, False), (1, 2.0, False, False), (1, 2.0, False, True), (1, 2.0, True, True), (1, 2.0, False, True), (1, 6.0, False, True)]


@pytest.mark.parametrize("n", [1, 2, 20, 333])
def test_sliding_statistics_equal_a_loop_over_batches(n):
    from barloom.plans.sliding import Deviation, Drop, NotAbove, maxima

    rng = np.random.default_rng(n)
    x = np.round(1000 + rng.normal(0, 3, 1000).cumsum(), 1)  # ties
    x[400] = np.nan  # missing: no output, and the windows close over it
    parts = [x[:7], x[7:8], x[8:350], x[350:900], x[900:]]
    kept = x[~np.isnan(x)]
    windows = [kept[max(0, i - n + 1) : i + 1] for i in range(len(kept))]
    full = [len(w) == n for w in windows]

    def run(fold, k=0):
        out = np.concatenate([np.asarray(fold.feed(p)[k]) for p in parts])
        assert np.isnan(out[400])
        return out[~np.isnan(x)]

    want = [100 * (w <= w[-1]).mean() if f else np.nan for w, f in zip(windows, full)]
    assert np.allclose(run(NotAbove(n)), want, equal_nan=True)
    want = [np.abs(w - w.mean()).mean() if f else np.nan for w, f in zip(windows, full)]
    assert np.allclose(run(Deviation(n), 2), want, equal_nan=True, atol=1e-9)
    want = [np.sqrt((((w - w.max()) / w.max() * 100) ** 2).mean()) if f else np.nan for w, f in zip(windows, full)]
    assert np.allclose(run(Drop(n)), want, equal_nan=True, atol=1e-6)
    assert np.array_equal(maxima(kept, n), [w.max() for w, f in zip(windows, full) if f])


def test_a_long_window_takes_about_the_time_of_a_short_one():
    import time

    from barloom.plans.sliding import Deviation, NotAbove

    x = np.random.default_rng(1).random(40_000)
    for make in (NotAbove, Deviation):
        took = {}
        for n in (20, 10_000):
            began = time.process_time()
            make(n).feed(x)
            took[n] = time.process_time() - began
        assert took[10_000] < 4 * took[20] + 0.5


def test_coppock_divides_by_a_price_of_zero(spark):
    prices = [5.0 + i % 3 for i in range(60)]
    prices[20], prices[30], prices[44] = 0.0, 3.0, 0.0
    got = dict(zip(range(24, 61), run(floats(spark, prices), "coppock"), strict=True))
    # the rates 11 and 14 bars after a zero are infinite, and ten bars hold each
    assert all(math.isinf(got[n]) for n in [*range(32, 45), *range(56, 61)])
    assert all(math.isfinite(got[n]) for n in [*range(24, 32), *range(45, 56)])


def test_hv_of_a_window_with_a_price_of_zero(spark):
    prices = [5.0 + i % 3 for i in range(80)]
    prices[40] = 0.0
    got = dict(zip(range(21, 81), run(floats(spark, prices), "hv"), strict=True))
    assert [n for n, x in got.items() if math.isnan(x)] == list(range(41, 62))


@pytest.mark.parametrize(("name", "way"), [("nvi", -1), ("pvi", 1)])
def test_an_index_that_comes_to_zero(spark, tmp_path, name, way):
    """Its logarithm is minus infinity from a price of zero on, and underflow is that of the SQL's product."""
    from barloom import queries
    from barloom.operators.volume import IndexFold

    prices = [5.0, 4.0, 0.0, 3.0, 2.0]
    events = [(i, EPOCH + 60 * i, 500 + way * i, "view", x, '{"k": 1}') for i, x in enumerate(prices)]
    df = spark.createDataFrame(events, "event_id long, ts long, user_id long, event_type string, value double, props string")
    df.withColumn("ts", F.timestamp_seconds("ts")).write.parquet(str(tmp_path / "events.parquet"))
    got = [r[name] for r in queries.queries()[name](spark, str(tmp_path)).orderBy("time").collect()]
    assert got == pytest.approx([math.log(1000), math.log(800), -math.inf, -math.inf, -math.inf], abs=1e-6)
    rng = np.random.default_rng(0)
    c, v, level, want = 10 ** rng.uniform(-2, 3, 9000), way * np.arange(9000.0), 1000.0, [1000.0]
    c[1::2] = c[:-1:2] * 0.5
    v[2::2] = v[1:-1:2]
    for k in range(1, 9000):
        level = level * c[k] / c[k - 1] if way * (v[k] - v[k - 1]) > 0 else level
        want.append(level)
    fold_ = IndexFold(way)
    assert np.concatenate([fold_.feed(c[i : i + 1000], v[i : i + 1000])[0] for i in range(0, 9000, 1000)]).tolist() == want and level == 0
