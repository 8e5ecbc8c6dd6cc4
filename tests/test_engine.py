"""The front door: registration, listeners, pushing, replay, restart, reset; views, as-of join, patterns, frames."""

import json
import random

import pytest
from pyspark.sql import functions as F

import barloom.engine as engine
from barloom.bars import EPOCH, from_matrix
from barloom.engine import Config, as_views, init
from barloom.functions.asof import as_of
from barloom.functions.series_defs import output_defs
from barloom.registry import OPERATORS, get, register_pattern
from barloom.sources.readers import CandleSource, ranges
from barloom.streaming.payloads import bar_frames, chart_snapshot, drawing_delete, history_frame, points, zigzag_drawing
from barloom.timeframe import interval_ms, roll_up


def bars(spark, n, start=0, symbol="BTC"):
    return from_matrix(spark, [[100 + i, 102 + i + i % 3, 99 + i, 101 + i, 1, EPOCH + 60 * i] for i in range(start, start + n)], symbol)


@pytest.fixture()
def front(spark, tmp_path):
    e = init(spark, str(tmp_path / "engine"), timezone="UTC", exchange="x")
    yield e
    e.stop()


def test_settings(spark, tmp_path, front):
    with pytest.raises(RuntimeError):
        init(spark, str(tmp_path))
    assert Config("p").timezone == "Asia/Tehran" and Config("p").max_bars == 10_000
    for bad in ({"source_timeframe": "7x"}, {"exchange": "Bad"}, {"max_bars": 0}):
        with pytest.raises(ValueError):
            Config("p", **bad)
    front.stop()
    assert engine._engine is None


def test_push_computes_over_batches_and_restarts(spark, tmp_path, front):
    heard, rolled = [], []
    ema = front.use("ema", "btc", "1m", listener=lambda b, e: heard.extend(r.ema for r in b.collect()), period=5)
    sma = front.use("sma", "BTC", "5m", period=3)
    front.attach("BTC", "5m", lambda b, e: rolled.extend(r.time for r in b.collect()))
    everything = bars(spark, 40)
    front.push(bars(spark, 17).unionByName(bars(spark, 5, symbol="ETH")))
    again = engine.Engine(spark, front.config)
    again.use("ema", "btc", "1m", listener=lambda b, e: heard.extend(r.ema for r in b.collect()), period=5)
    again.use("sma", "BTC", "5m", period=3)
    again.attach("BTC", "5m", lambda b, e: rolled.extend(r.time for r in b.collect()))
    again.push(bars(spark, 23, start=17))
    want = [r.ema for r in get("ema")(everything, period=5).orderBy("time").collect()]
    assert heard == pytest.approx(want)
    assert again.to_lists(ema, 100)["value"] == pytest.approx(want) and again.to_lists(ema, 3)["time"] == [EPOCH + 60 * i for i in (37, 38, 39)]
    assert len(rolled) == len(set(rolled)) == 8
    higher = roll_up(everything, "5m")
    assert again.to_lists(sma)["value"] == pytest.approx([r.sma for r in get("sma")(higher, period=3).orderBy("time").collect()])
    assert [r.time for r in again.recent("btc", "1m", 2).collect()] == [EPOCH + 60 * i for i in (38, 39)] and again.recent("BTC", "1m").count() == 40
    assert again.store.count("x", "ETH", "1m") == 5 and len(json.loads(again.snapshot("BTC", "1m").first().payload)["bars"]) == 40


def test_replay_hooks_and_reset(spark, front):
    heard, calls = [], []
    key = front.use("ema", "BTC", "1m", listener=lambda b, e: heard.append(b.count()), period=2)
    front.seed(bars(spark, 12), count_first=8, on_first=lambda: calls.append(("first", sum(heard))), on_provide=lambda df: calls.append(("provide", df.count())), on_finish=lambda: calls.append("finish"))
    assert calls == [("first", 0), ("provide", 4), "finish"] and sum(heard) == 4
    assert front.results(key).count() == 11
    front.reset()
    front.advance()
    assert sum(heard) == 4 + 11 and front.results(key).count() == 11


def test_one_bar_and_the_start_of_history(spark, tmp_path):
    e = engine.Engine(spark, Config(str(tmp_path / "e"), exchange="x", start_provide_from="2024-01-01 00:05:00"))
    e.push(bars(spark, 10))
    e.push_one("btc", EPOCH + 600, 1.0, 3.0, 0.5, 2.0)
    e.push_one("btc", EPOCH + 660, 1.0, 0.5, 3.0, 2.0)  # malformed
    assert [r.time for r in e.store.rows("x", "BTC").orderBy("time").collect()] == [EPOCH + 60 * i for i in range(5, 11)]


def test_references_and_listeners(spark, front):
    f, g = (lambda b, e: None), (lambda b, e: None)
    a, b = front.use("rsi", "BTC", "1m", f), front.use("rsi", "btc", "1m", g)
    assert a == b and front.info()[0]["uses"] == front.info()[0]["listeners"] == 2
    front.release(a, f)
    assert front.info()[0]["listeners"] == 1
    front.release(a, g)
    assert front.info() == [] and front.listeners == {}
    front.attach("BTC", "5m", f)
    front.detach("BTC", "5m", f)
    assert front.bar_listeners == {}
    with pytest.raises(ValueError):
        front.use("rsi", "BTC", "7H")


def test_views(spark):
    assert as_views(bars(spark, 10), ["sma", "ema"], "v_") == ["v_bars", "v_sma", "v_ema"]
    assert spark.sql("SELECT count(*) AS n FROM v_bars b LEFT JOIN v_sma s USING (symbol, tf, time)").first().n == 10


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("span", [1, 3, 32 * 86400])
def test_as_of_equals_a_loop(spark, strict, span):
    rng = random.Random(span)
    left = [("a", t, float(t)) for t in (1, 5, 5, 9)] + [("b", 4, 0.0), ("a", None, 1.0)] + [("d", rng.randrange(-20, 20), float(i)) for i in range(30)]
    right = [("a", 0, "x", 1), ("a", 5, "y", None), ("a", 5, "x", 9), ("a", 7, "z", 2), ("c", 1, "q", 1), ("a", None, "n", 1)] + [("d", rng.randrange(-20, 20), "k", i) for i in range(15)]
    got = as_of(spark.createDataFrame(left, "symbol string, time long, v double"), spark.createDataFrame(right, "symbol string, time long, k string, n int"), strict=strict, span=span).collect()
    want = []
    for s, t, v in left:
        at = [(rt, k, -1 if n is None else n) for rs, rt, k, n in right if rs == s and None not in (t, rt) and (rt < t if strict else rt <= t)]
        best = max(at, default=(None, None, None))
        want.append((s, t, v, best[1], None if best[2] == -1 else best[2]))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    with pytest.raises(ValueError):
        as_of(bars(spark, 1), bars(spark, 1))


@pytest.mark.parametrize("kind", ["timestamp", "date"])
def test_as_of_by_days(spark, kind):
    at = lambda days: F.lit("2024-01-01").cast(kind) if days == 0 else F.date_add(F.lit("2024-01-01"), days).cast(kind)
    left = spark.range(1).select(F.lit("a").alias("symbol"), at(100).alias("time"))
    right = spark.range(1).select(F.lit("a").alias("symbol"), at(0).alias("time"), F.lit(7).alias("n"))
    got = as_of(left, right)
    assert got.first().n == 7
    assert as_of(left, left.select("symbol").withColumns({"time": at(101), "n": F.lit(1)})).first().n is None


def test_custom_pattern(spark):
    register_pattern("two_up", lambda at: F.when((at("close") > at("close", 1)) & (at("close", 1) > at("close", 2)), 1).otherwise(0), lookback=3, replace=True)
    try:
        assert [r.signal for r in get("two_up")(bars(spark, 5)).orderBy("time").collect()] == [1, 1, 1]
    finally:
        OPERATORS.pop("two_up")


def test_intervals_and_split_reads(spark):
    assert [interval_ms(x) for x in ("30s", "5h", "1m", "2D", "1w")] == [30_000, 18_000_000, 60_000, 172_800_000, 604_800_000]
    for bad in ("", "m", "1x", "1.5h"):
        with pytest.raises(ValueError):
            interval_ms(bad)
    assert ranges("open_time", 0, 10, 4) == {"partitionColumn": "open_time", "lowerBound": "0", "upperBound": "10", "numPartitions": "4"}

    class Pieces(CandleSource):
        @classmethod
        def name(cls):
            return "pieces"

        def pieces(self, symbol):
            return [0, 1, 2]

        def candles(self, symbol, piece=None):
            from datetime import datetime

            yield (symbol, "1m", datetime(2024, 1, 1, 0, piece), 1.0, 2.0, 0.5, 1.5, 1.0, 1, 1)

    spark.dataSource.register(Pieces)
    df = spark.read.format("pieces").option("symbol", "BTC, ETH").load()
    assert df.count() == 6 and df.rdd.getNumPartitions() == 6


def test_frames(spark):
    df = bars(spark, 6)
    assert json.loads(bar_frames(df, "c1").orderBy("time").first().payload) | {"bar": 0} == {"type": "chart_bar", "chartId": "c1", "bar": 0}
    page = json.loads(history_frame(df.filter(F.col("time") < EPOCH + 120), 5).first().payload)
    assert page["type"] == "history" and page["noMoreHistory"] and [b["time"] for b in page["data"]] == [EPOCH, EPOCH + 60]
    assert json.loads(history_frame(df.filter("false"), 5, "c").first().payload)["noMoreHistory"]
    defs = output_defs(spark, "ichimoku", ["tenkan", "chikou"])
    snap = json.loads(chart_snapshot(df, "c1", 3, long_points=points(df, "X", ["close"]), defs=defs).first().payload)
    assert snap["type"] == "chart_snapshot" and len(snap["data"]) == len(snap["points"]["X"]) == 3 and [d["color"] for d in snap["definitions"]] == ["#9C27B0", "#F44336"]
    macd = {r.key: r for r in output_defs(spark, "macd", ["macd", "signal", "histogram"]).collect()}
    assert macd["macd.histogram"].kind == "histogram" and macd["macd.histogram"].color_neg == "#F23645" and macd["macd.macd"].label == "MACD (12,26,9) macd"
    pivots = spark.createDataFrame([("A", "1m", 9, "HH", 5.0, 3, 4.5, 4.0), ("A", "1m", 4, "L", 2.0, 1, 2.0, 3.0), ("A", "1m", 4, "LH", 2.0, -1, 2.0, 3.0)], "symbol string, tf string, time long, label string, price double, pivot_time long, pivot_close double, break_close double")
    drawing = json.loads(zigzag_drawing(pivots).first().payload)["drawing"]
    assert [p["time"] for p in drawing["points"]] == [1, 3] and [p["text"] for p in drawing["pointLabels"]] == ["L", "HH"]
    assert json.loads(drawing_delete(spark.createDataFrame([("b",), ("a",)], "id string")).first().payload)["drawingIds"] == ["a", "b"]


def test_shared_parts_and_their_tree(spark, front):
    macd, ema, bands = front.use("macd", "BTC", "1m"), front.use("ema", "BTC", "1m", period=12), front.use("bbands", "BTC", "5m")
    graph = front.uses.graph()
    assert graph[macd] == [ema, ema.replace("_12_", "_26_")] and graph[ema] == [] and len(graph[bands]) == 2
    assert front.uses.tree().split("\n") == [
        f"- {bands} [1m -> 5m]", "  - SMA_BTC_5m_20_close [1m -> 5m]", "  - STDDEV_BTC_5m_20_close [1m -> 5m]",
        f"- {macd} [1m]", f"  - {ema} [1m]", "  - EMA_BTC_1m_26_close [1m]",
    ]
    front.push(bars(spark, 2), advance=False)
    started = []
    front._run = lambda rows, name, handlers: started.append(name)
    front._catch_up = lambda use: None
    front.advance()
    assert started == ["bars", "tf-5m"]  # a query for each timeframe, whatever the number of uses


def test_a_table_is_followed_without_reading_a_row_twice(spark, tmp_path):
    import sqlite3

    from barloom.sources.cursor import CandleTable
    from barloom.streaming.live import each_batch

    spark.dataSource.register(CandleTable)
    path, start = str(tmp_path / "db"), 1_704_067_200_000

    def insert(symbol, times):
        with sqlite3.connect(path) as db:
            db.execute(f"CREATE TABLE IF NOT EXISTS k_{symbol} (open_time integer, open real, high real, low real, close real, volume real)")
            db.executemany(f"INSERT INTO k_{symbol} VALUES (?, ?, ?, ?, ?, ?)", [(start + 60_000 * t, t, t + 1, t - 1, t, None if t % 2 else 1) for t in times])

    insert("BTC", range(25))
    insert("ETH", [])
    options = {"connect": json.dumps([path]), "table": "k_{symbol}", "symbol": "btc, ETH", "rows_per_task": "10"}
    once = spark.read.format("candle_table").options(**options).load()
    assert once.count() == 25 and once.rdd.getNumPartitions() == 3
    seen = []

    def run(**more):
        stream = spark.readStream.format("candle_table").options(**options, **more).load()
        each_batch(stream, [lambda b, e: seen.extend((r.symbol, int(r.time.timestamp() - start // 1000) // 60) for r in b.collect())], str(tmp_path / "c")).awaitTermination()

    run()
    assert sorted(seen) == [("BTC", t) for t in range(25)]
    run()
    insert("BTC", range(25, 30))
    insert("ETH", range(3))
    run()
    assert sorted(seen) == [("BTC", t) for t in range(30)] + [("ETH", t) for t in range(3)]
    with pytest.raises(Exception, match="no table name"):
        spark.read.format("candle_table").options(**options | {"table": "x; drop {symbol}"}).load().count()

    e = engine.Engine(spark, Config(str(tmp_path / "e"), timezone="UTC", exchange="x"))
    e.follow(lambda: spark.readStream.format("candle_table").options(**options).load())
    key = e.use("sma", "BTC", "1m", period=3)
    e.advance()
    insert("BTC", range(30, 32))
    e.advance()
    assert e.to_lists(key)["value"] == [float(t) for t in range(1, 31)] and not (tmp_path / "e" / "inbox").exists()


def test_a_trigger_takes_a_page(tmp_path):
    import sqlite3

    from barloom.sources.cursor import _Stream

    path = str(tmp_path / "db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE BTC (open_time integer, open real, high real, low real, close real, volume real)")
        db.executemany("INSERT INTO BTC VALUES (?, 1, 1, 1, 1, 1)", [(t,) for t in range(10, 110, 10)])
    stream, at, pages = _Stream({"connect": json.dumps([path]), "symbol": "BTC", "rows_per_trigger": "4", "rows_per_task": "3"}), None, []
    at = stream.initialOffset()
    while (end := stream.latestOffset()) != at:
        pages.append([p.value[1:] for p in stream.partitions(at, end)])
        at = end
        stream.commit(end)
    assert [[b for _, b in p] for p in pages] == [[30, 40], [70, 80], [100]]
