import json

import pytest
from pyspark.sql import functions as F

from barloom.bars import EPOCH, from_matrix
from barloom.functions.series_defs import series_defs
from barloom.sources.readers import CandleSource, jdbc_options, legacy_bars
from barloom.sources.store import BarStore, NotFoundError, ValidationError, as_document, check_component, check_schema_name, split_row, table_name
from barloom.streaming.payloads import definitions_frame, frames, indicators_frame, points, snapshot, symbols_frame, zigzag_points


@pytest.fixture()
def store(spark, tmp_path):
    return BarStore(spark, str(tmp_path / "store"))


def bars(spark, n, symbol="BTC", start=0, scale=1.0):
    return from_matrix(spark, [[scale * (i + 1), scale * (i + 2), scale * (i + 0.5), scale * (i + 1.5), 1, EPOCH + 60 * (start + i)] for i in range(n)], symbol)


def test_upsert_merge_and_read(spark, store):
    store.upsert(bars(spark, 10), "binance")
    store.upsert(bars(spark, 4, "ETH"), "binance")
    store.upsert(bars(spark, 5, start=5, scale=10), "binance", as_document({"A": F.col("close"), "B": {"x": F.col("open"), "y": F.lit(float("nan"))}}))
    assert store.count("binance", "BTC", "1m") == 10 and store.count("binance", "ETH", "1m") == 4
    assert store.latest_bar("binance", "BTC", "1m").first().close == 55.0
    store.merge_points(spark.createDataFrame([("BTC", "1m", EPOCH, "A", 1.0), ("BTC", "1m", EPOCH + 60 * 99, "C", 2.0), ("BTC", "1m", EPOCH + 60, "A", float("nan"))], "symbol string, tf string, time long, key string, value double"), "binance")
    assert store.count("binance", "BTC", "1m") == 11
    assert store.fetch_bars("binance", "BTC", "1m").count() == 10
    assert [r.key for r in store.indicator_keys("binance", "BTC", "1m").collect()] == ["A", "B", "C"]
    assert [r.fields for r in store.indicator("binance", "BTC", "1m", "B").collect()][0] == {"x": 10.0}
    stats = store.stats("binance", "BTC", "1m", "A").first()
    assert (stats.n, stats.least, stats.last_time) == (6, 1.0, EPOCH + 60 * 9)
    assert store.complete("binance", "BTC", "1m", "A", 3) == (False, 3)
    assert [r.time for r in store.candles_with("binance", "BTC", "1m", ["A"], limit=2).collect()] == [EPOCH + 60 * 9, EPOCH + 60 * 99]
    assert [tuple(r) for r in store.catalog().collect()] == [("binance", "BTC", "1m"), ("binance", "ETH", "1m")]
    assert store.exists("binance", "ETH", "1m") and not store.exists("binance", "XRP", "1m")
    store.delete_older(EPOCH + 86_400 + 180, 1, "binance", "ETH")
    assert store.count("binance", "ETH", "1m") == 1 and store.count("binance", "BTC", "1m") == 11
    store.delete_older(EPOCH + 10 * 86_400, 1)
    assert store.rows().count() == 0


def test_same_write_twice_changes_nothing(spark, store):
    for _ in range(2):
        store.upsert(bars(spark, 3), "x", as_document({"A": F.col("close")}))
    assert store.count("x", "BTC", "1m") == 3


@pytest.mark.parametrize("tf", ["1d", "1D", "1.0", "30s"])
@pytest.mark.parametrize("symbol", ["BTC", "007", "1e5"])
def test_names_stay_text_in_the_store(spark, store, tf, symbol):
    named = bars(spark, 3, symbol).withColumn("tf", F.lit(tf))
    if not tf.isalnum():
        with pytest.raises(ValidationError):
            store.upsert(named, "x")
        return
    for _ in range(2):
        store.upsert(named, "x")
    assert store.count("x", symbol, tf) == store.rows().count() == 3
    assert [tuple(r) for r in store.catalog().collect()] == [("x", symbol.upper(), tf)]


def test_only_touched_spans_are_rewritten(spark, store):
    from barloom.sources.store import SPAN_SECONDS

    store.upsert(bars(spark, 3), "x")
    stamp = {r.time: r.updated_at for r in store.rows().collect()}
    later = bars(spark, 2, start=2 * SPAN_SECONDS // 60)
    store.upsert(later, "x")
    assert {r.time: r.updated_at for r in store.rows(end=EPOCH + 600).collect()} == stamp
    assert store.count("x", "BTC", "1m") == 5 and store.rows("x", "btc", "1m", start=EPOCH + SPAN_SECONDS).count() == 2
    store.delete_older(EPOCH + 2 * SPAN_SECONDS + 86_400 + 60, 1, "x")
    assert [r.time for r in store.rows().orderBy("time").collect()] == [EPOCH + 2 * SPAN_SECONDS + 60]


def test_the_largest_version_wins(spark, store):
    df = bars(spark, 1).unionByName(bars(spark, 1, scale=9.0)).withColumn("version", F.when(F.col("open") == 1, 2).otherwise(1))
    store.upsert(df, "x", version="version")
    assert store.latest_bar("x", "BTC", "1m").first().open == 1.0
    store.upsert(df, "x")
    assert store.latest_bar("x", "BTC", "1m").first().open == 9.0
    points = [("BTC", "1m", EPOCH, "A", 1.0), ("BTC", "1m", EPOCH, "A", 3.0)]
    store.take_over(bars(spark, 1), "x", spark.createDataFrame(points, "symbol string, tf string, time long, key string, value double"))
    assert [r.fields["value"] for r in store.indicator("x", "BTC", "1m", "A").collect()] == [3.0]


@pytest.mark.parametrize("with_bars", [True, False])
def test_merged_rows_are_dealt_once(spark, with_bars):
    """One shuffle, by span, for old and new rows; the merge equals a plain one."""
    from barloom.sources.store import BAR, DOCUMENT, merge_rows

    schema = f"exchange string, symbol string, tf string, time long, span int, {', '.join(f'{c} double' for c in BAR)}, indicators {DOCUMENT}, updated_at timestamp"
    row = lambda t, x, doc: ("e", "S", "1m", t, t // 100, x, x, x, x, x, doc, None)
    old = [row(t, float(t), {"A": {"value": 1.0}, "B": {"value": 2.0}} if t % 3 else None) for t in range(0, 300, 2)]
    new = [row(t, -1.0, {"A": {}, "C": {"value": 3.0}} if t % 2 else None) for t in range(0, 300, 3)]
    new += [row(t, 5.0, {"A": {"value": 4.0}}) for t in range(0, 300, 6)]
    got = merge_rows(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema).drop("updated_at"), with_bars)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Repartition") == 1
    assert got._jdf.queryExecution().sparkPlan().toString().count("Join") == 0
    rows = got.collect()
    assert got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning") == 1
    want = {r[3]: (r[5], r[10] or {}, False) for r in old}
    best = {}
    for r in new:
        best[r[3]] = max(best.get(r[3], r), r, key=lambda r: r[5])
    for t, r in best.items():
        x, doc, _ = want.get(t, (None, {}, False))
        put = r[10] or {}
        want[t] = (r[5] if with_bars else x, {k: v for k, v in doc.items() if k not in put} | {k: v for k, v in put.items() if v}, True)
    assert {r.time: (r.close, r.indicators, r.updated_at is not None) for r in rows} == want and len(rows) == len(want)


def test_incremental_fills_late_points(spark, store):
    from barloom.streaming.live import incremental

    results = bars(spark, 5).select("symbol", "tf", "time", F.col("close").alias("a"))
    store.upsert(bars(spark, 5), "x")
    incremental(store, "x", results.filter(F.col("time") != EPOCH + 60), "A", "a")
    incremental(store, "x", results, "A", "a")
    assert store.indicator("x", "BTC", "1m", "A").count() == 5


def test_state(spark, store):
    with pytest.raises(NotFoundError):
        store.load_state(["a"])
    for t in (1, 2):
        store.save_state(spark.createDataFrame([("a", t, "{}")], "indicator_key string, last_bar_time long, state string"))
    assert [r.last_bar_time for r in store.load_state(["a", "b"]).collect()] == [2]
    store.save_state(spark.createDataFrame([("b", 1, "{}")], "indicator_key string, last_bar_time long, state string"))
    assert store.load_state(["a", "b"]).count() == 2 and len(store._states()) <= 2


def test_names(spark):
    assert check_schema_name("binance_1") == "binance_1" and check_component("btc") == "BTC" and table_name("btc", "1m") == "BTC1M"
    for bad in ("Binance", "1x", "a" * 64):
        with pytest.raises(ValidationError):
            check_schema_name(bad)
    with pytest.raises(ValidationError):
        check_component("a-b")
    with pytest.raises(ValidationError):
        split_row(spark.range(1))
    assert split_row(spark.createDataFrame([(1, 2.0, 3.0)], "time long, close double, sma double")) == (["close"], ["sma"])


def test_readers(spark):
    opts = jdbc_options("postgresql://u:p%40w@db:6000/x", 7)
    assert opts["url"] == "jdbc:postgresql://db:6000/x" and opts["password"] == "p@w" and opts["fetchsize"] == "7"
    got = legacy_bars(spark.createDataFrame([(60_000, 1.0, 2.0, 0.5, 1.5)], "open_time long, open double, high double, low double, close double"), "BTC").first()
    assert (got.time, got.volume, got.side) == (60, 0.0, 1)

    class Two(CandleSource):
        def candles(self, symbol):
            from datetime import datetime

            for i in range(2):
                yield (symbol, "1m", datetime(2024, 1, 1, 0, i), 1.0, 2.0, 0.5, 1.5, 1.0, 1, 1)

    spark.dataSource.register(Two)
    assert spark.read.format("candles").option("symbol", "BTC").load().count() == 2


def test_payloads(spark):
    df = bars(spark, 5)
    assert json.loads(frames(df).orderBy("time").first().payload)["type"] == "bar"
    assert [b["close"] for b in json.loads(snapshot(df, 2).first().payload)["bars"]] == [4.5, 5.5]
    long = points(df, "X", ["close", "open"])
    assert long.count() == 10 and {r.series_key for r in long.collect()} == {"X.close", "X.open"}
    assert json.loads(indicators_frame(long).orderBy("time").first().payload)["values"] == {"X.close": 1.5, "X.open": 1.0}
    assert series_defs(spark).count() == 115
    assert len(json.loads(definitions_frame(series_defs(spark)).first().payload)["series"]) == 115
    assert json.loads(symbols_frame(df).first().payload)["symbols"] == [{"symbol": "BTC", "tfs": ["1m"]}]
    pivots = spark.createDataFrame([("A", "1m", 9, "HH", 5.0, 3, 4.5, 4.0)], "symbol string, tf string, time long, label string, price double, pivot_time long, pivot_close double, break_close double")
    assert (p := zigzag_points(pivots).first()).time == 3 and json.loads(p.color) == {"label": "HH", "break": 4.0}


def test_summaries_answer_as_a_scan_does(spark, store):
    """Several spans, rows without a bar, gaps in a key, merges and deletions; the answers read summaries only."""
    from barloom.sources.store import SPAN_SECONDS, completeness, indicator_keys, indicator_stats

    day = 86_400
    df = from_matrix(spark, [[i + 1, i + 2, i, i + 1, 1, EPOCH + day * i] for i in range(100)], "BTC")
    store.upsert(df, "x", as_document({"A": F.col("close"), "B": {"u": F.col("open")}}))
    store.merge_indicators(df.filter(F.col("time") % (3 * day) == 0).select("symbol", "tf", "time", F.expr("map('C', map('value', close))").alias("indicators")), "x")
    store.merge_indicators(df.filter(F.col("time") == EPOCH + 90 * day).select("symbol", "tf", "time", F.expr("map('A', cast(map() as map<string,double>))").alias("indicators")), "x")
    store.merge_points(spark.createDataFrame([("BTC", "1m", EPOCH + day * 120, "A", 7.0)], "symbol string, tf string, time long, key string, value double"), "x")

    def check():
        rows = store.rows("x", "BTC", "1m")
        for key in ("A", "B", "C", "none"):
            got, want = store.stats("x", "BTC", "1m", key).first(), indicator_stats(rows, key).first()
            assert tuple(got) == pytest.approx(tuple(want), nan_ok=True), key
            for n in (1, 9, 10, 11, 40, 1000):
                want = completeness(rows, key, n).first()
                assert store.complete("x", "BTC", "1m", key, n) == (want.complete, want.n_rows), (key, n)
        assert store.indicator_keys("x", "BTC", "1m").collect() == indicator_keys(rows).collect()
        assert store.latest_bar("x", "BTC", "1m").collect() == rows.select("time", "open", "high", "low", "close", "volume").orderBy(F.desc("time")).limit(1).collect()

    check()
    store.delete_older(EPOCH + 41 * day, 1)
    check()
    assert {r.span for r in store.summaries().collect()} == {(EPOCH + d * day) // SPAN_SECONDS for d in (40, 60, 90, 120)}
    for df in (store.stats("x", "BTC", "1m", "A"), store.indicator_keys("x", "BTC", "1m"), store.latest_bar("x", "BTC", "1m")):
        assert df.inputFiles() and all("/summaries/" in f for f in df.inputFiles())


def test_frames_of_drawings_and_definitions(spark):
    from barloom.functions.series_defs import output_defs
    from barloom.streaming.payloads import drawings_clear, drawings_frame, indicators_list, zigzag_drawing

    pivots = spark.createDataFrame([(s, "1m", 9, "HH", 5.0, 3, 4.5, 4.0) for s in ("A", "B")], "symbol string, tf string, time long, label string, price double, pivot_time long, pivot_close double, break_close double")
    both = zigzag_drawing(pivots).unionByName(zigzag_drawing(pivots, "second", "#FFFFFF"))
    frames_ = {r.symbol: json.loads(r.payload) for r in drawings_frame(both).collect()}
    assert set(frames_) == {"A", "B"} and frames_["A"]["type"] == "drawings"
    assert [d["id"] for d in frames_["A"]["drawings"]] == ["second", "zigzag"] and frames_["A"]["drawings"][1]["points"] == [{"time": 3, "price": 5.0}]
    assert [(r.symbol, json.loads(r.payload)) for r in drawings_clear(pivots.union(pivots)).orderBy("symbol").collect()] == [("A", {"type": "drawings_clear"}), ("B", {"type": "drawings_clear"})]
    listed = json.loads(indicators_list(output_defs(spark, "rsi", ["rsi"])).first().payload)
    assert listed["type"] == "indicators_list" and listed["indicators"][0]["label"].startswith("RSI (14")
    assert [(v["value"], v["color"], v["label"]) for v in listed["indicators"][0]["levels"]] == [(70.0, "#EF5350", "OB"), (50.0, "#454560", ""), (30.0, "#26A69A", "OS")]
    assert len(json.loads(indicators_list(series_defs(spark)).first().payload)["indicators"]) == 115


def test_a_missing_price_is_no_bar_for_windows_and_folds(spark):
    import barloom.operators  # noqa: F401
    from barloom.bars import from_columns
    from barloom.registry import get

    whole = {"open": [1.0, 2.0, 3.0, 4.0, 5.0], "high": [2.0, 3.0, 4.0, 5.0, 6.0], "low": [0.5, 1.5, 2.5, 3.5, 4.5], "close": [1.5, 2.5, 3.5, 4.5, 5.5], "time": [EPOCH + 60 * i for i in (0, 1, 3, 4, 5)]}
    gap = {k: [*v[:2], None if k != "time" else EPOCH + 120, *v[2:]] for k, v in whole.items()}
    for name in ("sma", "ema", "rma", "obv", "tr", "bullish_engulfing"):
        params = {"period": 2} if name in ("sma", "ema", "rma") else {}
        got, want = (sorted(get(name)(from_columns(spark, x, "A"), **params).collect()) for x in (gap, whole))
        assert got == want and want
