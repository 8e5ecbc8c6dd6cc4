"""Late and repeated bars, states by field, marks, and the engine's own queries."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import barloom.engine as engine
import barloom.operators  # noqa: F401
from barloom.bars import EPOCH, from_matrix
from barloom.engine import init
from barloom.functions.series import reach
from barloom.operators.averages import EmaFold, KamaFold
from barloom.operators.zigzag import ZigZagFold
from barloom.plans.fold import resuming
from barloom.plans.replay import replay
from barloom.plans.state import STATE_FIELDS, flat, get_state, nested, set_state
from barloom.registry import OPERATORS, get
from barloom.sources.readers import stream_bars
from barloom.sources.store import SPAN_SECONDS, BarStore
from barloom.streaming.live import each_batch

DAY = 86_400


def walk(spark, n, step=60, symbol="BTC", seed=3):
    rng, price, rows = random.Random(seed), 100.0, []
    for i in range(n):
        close = price + rng.gauss(0, 1)
        rows.append([price, max(price, close) + rng.random(), min(price, close) - rng.random(), close, 1 + rng.random(), EPOCH + step * i])
        price = close
    return from_matrix(spark, rows, symbol)


def points(df, name):
    outputs = [c for c in df.columns if c not in ("symbol", "tf", "time")]
    return {r["time"]: [r[o] for o in outputs] for r in df.collect()}


@pytest.mark.parametrize("make", [lambda: EmaFold(5, (3.0, -3.0, 1.0)), lambda: KamaFold(10, 2, 30, False)])
def test_a_state_by_field_goes_on_alike(make):
    x = np.random.default_rng(1).random(300)
    one, other = make(), make()
    one.feed(x[:7])
    set_state(other, nested(flat(get_state(one))))
    one.feed(x[7:150])
    assert get_state(other) != get_state(one)
    set_state(other, nested(flat(get_state(one))))
    assert np.array_equal(one.feed(x[150:])[0], other.feed(x[150:])[0], equal_nan=True)


def test_a_zigzag_state_by_field():
    x = np.random.default_rng(2).random(400) * 10
    feeds = [x, np.maximum(x, np.roll(x, -1)), np.minimum(x, np.roll(x, -1)), np.roll(x, -1), np.arange(400.0)]
    one, other = ZigZagFold(0.0), ZigZagFold(0.0)
    one.feed(*[f[:300] for f in feeds])
    set_state(other, nested(flat(get_state(one))))
    assert get_state(one) == get_state(other)
    assert str(one.feed(*[f[300:] for f in feeds])) == str(other.feed(*[f[300:] for f in feeds]))


def test_a_renamed_class_and_a_newer_version():
    class Renamed(EmaFold):
        state_version = 2

        def upgrade(self, fields, version):
            return {**fields, "weights": {"tuple": [2.0]}}

    old = EmaFold(3, (1.0,))
    old.feed(np.array([1.0, 2.0, 3.0]))
    new = Renamed(3, (1.0,))
    set_state(new, get_state(old))
    assert new.weights == (2.0,) and new.feed(np.array([5.0]))[0] == 2 * old.feed(np.array([5.0]))[0]
    with pytest.raises(ValueError):
        set_state(EmaFold(3, (1.0,)), get_state(new))


@pytest.mark.parametrize("name", ["ema", "adx", "zigzag_base", "chandelier", "stochrsi", "psar"])
def test_folds_resume_from_states(spark, name):
    bars, op, cut = walk(spark, 500).unionByName(walk(spark, 300, symbol="ETH", seed=4)).cache(), get(name), EPOCH + 60 * 200
    with resuming(None, 3600) as first:
        before = op(bars.filter(F.col("time") <= cut)).collect()
        states = spark.createDataFrame(first.left.filter(F.col("time") == cut).collect(), first.left.schema)
        assert first.left.count() == 2 * 4
    with resuming(states, 3600) as second:
        after = op(bars.filter(F.col("time") > cut - 60 * int(reach(op, bars)))).filter(F.col("time") > cut).collect()
    want = {tuple(r)[:3]: tuple(r)[3:] for r in op(bars).collect()}
    got = {tuple(r)[:3]: tuple(r)[3:] for r in [*before, *after]}
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k] == pytest.approx(v) if name != "zigzag_base" else got[k] == v
    for r in (first.raw, second.raw, bars):
        r.unpersist()


def test_reach():
    from barloom.bars import BAR_SCHEMA
    from pyspark.sql import SparkSession

    empty = SparkSession.active().createDataFrame([], BAR_SCHEMA)
    assert {n: reach(get(n), empty) for n in ("sma", "hma", "ema", "obv", "dpo", "morning_star")} == {"sma": 19, "hma": 9 + 2, "ema": 0, "obv": float("inf"), "dpo": 30, "morning_star": 2}


@pytest.mark.parametrize("name", ["sma", "ema", "obv", "zigzag_base", "bbands"])
def test_late_bars_in_the_store_give_the_batch(spark, tmp_path, name):
    """Spans of 32 days: daily bars, late ones before and after kept states, one bar with another value."""
    store, bars, op = BarStore(spark, str(tmp_path)), walk(spark, 150, DAY), get(name)
    late = F.col("time").isin([EPOCH + DAY * k for k in (40, 41, 99, 149)])
    wrong = bars.filter(F.col("time") == EPOCH + DAY * 70).withColumn("close", F.col("close") - 0.1)
    store.upsert(bars.filter(~late & (F.col("time") != EPOCH + DAY * 70)).unionByName(wrong), "x")
    replay(store, "x", "btc", "1m", "K", op, None)
    for part, since in ((bars.filter(F.col("time") == EPOCH + DAY * 149), 149), (bars.filter(F.col("time") == EPOCH + DAY * 99), 99), (bars.filter(F.col("time").isin([EPOCH + DAY * k for k in (40, 41, 70)])), 40)):
        store.upsert(part, "x")
        back = replay(store, "x", "btc", "1m", "K", op, EPOCH + DAY * since)
        assert back is None or back.filter(F.unix_timestamp("time") < EPOCH + DAY * since).isEmpty()
    want = points(op(bars).drop("label"), name)
    got = {r.time: r.fields for r in store.indicator("x", "BTC", "1m", "K").collect()}
    assert set(got) == set(want)
    numbers = [c for c in op(bars).drop("label").columns if c not in ("symbol", "tf", "time")]
    for t, values in want.items():
        mine = [got[t].get("value" if len(op(bars).columns) == 4 else c) for c in numbers]
        assert mine == pytest.approx([None if v is None else float(v) for v in values])
    if name == "ema":
        spans = [r.time // SPAN_SECONDS for r in store.fold_states("K").collect()]
        assert len(spans) == len(set(spans)) == 6 and store.seen_until("K") == EPOCH + DAY * 149


def test_duplicates_have_one_answer(spark):
    bars = walk(spark, 30)
    doubled = bars.unionByName(bars.filter("time % 180 = 0").withColumn("open", F.col("open") - 1)).unionByName(bars.limit(3))
    for name in ("sma", "ema", "obv", "bullish_engulfing"):
        assert sorted(get(name)(doubled).collect()) == sorted(get(name)(bars).collect())
    newest = bars.withColumn("version", F.lit(1)).unionByName(bars.withColumns({"version": F.lit(2), "close": F.col("low")}))
    assert sorted(get("sma")(newest).collect()) == sorted(get("sma")(bars.withColumn("close", F.col("low"))).collect())


def test_late_bars_in_a_stream(spark, tmp_path):
    """Late and changed bars are replayed from kept states; what comes out, by time, is the batch's."""
    bars = walk(spark, 700).withColumn("time", F.timestamp_seconds("time"))
    at = lambda k: F.timestamp_seconds(F.lit(EPOCH + 60 * k))
    late, seen = F.col("time").isin([at(650), at(400)]), {}

    def take(batch, epoch):
        seen.update({r["time"]: r["ema"] for r in batch.collect()})

    for part in (bars.filter(~late & (F.col("time") < at(690))), bars.filter(late), bars.filter(F.col("time") >= at(690))):
        part.select("symbol", "tf", "time", "open", "high", "low", "close", "volume", "side", "timeframe").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        each_batch(get("ema")(stream_bars(spark, str(tmp_path / "in")), period=9), [take], str(tmp_path / "c")).awaitTermination()
    want = {r["time"]: r["ema"] for r in get("ema")(bars, period=9).collect()}
    assert {t: v for t, v in seen.items() if v is not None} == pytest.approx(want)
    held = spark.read.format("statestore").option("stateVarName", "states").option("flattenCollectionTypes", True).load(str(tmp_path / "c"))
    assert held.count() > 1 and "list_element" in held.columns


def test_engine_takes_late_and_repeated_bars(spark, tmp_path):
    e = init(spark, str(tmp_path / "engine"), timezone="UTC", exchange="x")
    foreign = spark.readStream.format("rate").load().writeStream.format("noop").option("checkpointLocation", str(tmp_path / "rate")).start()
    try:
        bars, heard = walk(spark, 12), []
        sma = e.use("sma", "BTC", "1m", listener=lambda b, k: heard.append(sorted(r["time"].timestamp() for r in b.collect())), period=3)
        ema = e.use("ema", "BTC", "1m", period=3)
        first = F.col("time").isin([EPOCH + 60 * 5, EPOCH + 60 * 8])
        e.push(bars.filter(~first).withColumn("close", F.when(F.col("time") == EPOCH + 60, 0.5 + F.col("low")).otherwise(F.col("close"))))
        e.push(bars.filter(first))
        e.push(bars.filter(F.col("time") == EPOCH + 60))
        late = e.use("rsi", "BTC", "1m", period=3)  # catches up from its own mark
        e.advance()
        for key, name in ((sma, "sma"), (ema, "ema"), (late, "rsi")):
            want = [tuple(r)[3] for r in get(name)(bars, period=3).orderBy("time").collect()]
            assert e.to_lists(key)["value"] == pytest.approx(want)
        assert heard[1] == [EPOCH + 60 * k for k in range(5, 12)] and heard[2] == [EPOCH + 60 * k for k in range(2, 12)]
        state = e.get_state(ema)
        assert state["time"] == EPOCH + 60 * 11 and e.get_state(sma) is None
        e.set_state(ema, state)
        assert e.get_state(ema) == state
        e.reset()
        again = engine.Engine(spark, e.config)
        assert again._generation == 1 and again.get_state(ema) is None
    finally:
        e.stop()
        assert foreign.isActive
        foreign.stop()


def test_every_state_can_be_kept(spark):
    """The state of every fold among the operators goes through the typed row."""
    bars = walk(spark, 120).cache()
    for name, op in OPERATORS.items():
        with resuming(None, 1 << 40) as resume:
            op(bars).count()
            if resume.left is not None:
                (row,) = resume.left.collect()
                assert nested(tuple(row[f] for f in STATE_FIELDS))["version"] == 1, name
                resume.raw.unpersist()
    bars.unpersist()


@pytest.mark.parametrize("name", ["sma", "ema", "obv"])
def test_late_bars_of_many_series_give_the_batch(spark, tmp_path, name):
    """One replay of all series, with starts of their own, gives what each series gives by itself."""
    from barloom.plans.replay import replay_all

    store, op = BarStore(spark, str(tmp_path)), get(name)
    bars = walk(spark, 100, DAY, "AA").unionByName(walk(spark, 120, DAY, "BB", 4)).unionByName(walk(spark, 70, DAY, "CC", 5))
    late = ((F.col("symbol") == "AA") & F.col("time").isin([EPOCH + DAY * k for k in (40, 41)])) | ((F.col("symbol") == "BB") & (F.col("time") == EPOCH + DAY * 99))
    for part in (bars.filter(~late), bars.filter(late)):
        store.upsert(part, "x")
        replay_all(store, "x", "1m", {"K": op, "E": get("ema")}, part.groupBy("symbol").agg(F.min("time").alias("since")))
    for key, operator in (("K", op), ("E", get("ema"))):
        for symbol in ("AA", "BB", "CC"):
            want = points(operator(bars.filter(F.col("symbol") == symbol)), key)
            got = {r.time: r.fields["value"] for r in store.indicator("x", symbol, "1m", key).collect()}
            assert set(got) == set(want) and [got[t] for t in sorted(got)] == pytest.approx([want[t][0] for t in sorted(got)])
    kept = store.series_states("E").collect()
    assert len({(r.symbol, r.time // SPAN_SECONDS) for r in kept}) == len(kept) == 4 + 5 + 3


def test_jobs_of_a_replay_do_not_grow_with_the_series(spark, tmp_path):
    from barloom.plans.replay import replay_all

    def jobs(k):
        store, bars = BarStore(spark, str(tmp_path / str(k))), walk(spark, 40, DAY, "S0")
        bars = bars.withColumn("symbol", F.explode(F.array(*[F.lit(f"S{i}") for i in range(k)])))
        store.upsert(bars, "x")
        spark.sparkContext.setJobGroup(f"series{k}", "")
        try:
            replay_all(store, "x", "1m", {"E": get("ema")}, bars.groupBy("symbol").agg(F.min("time").alias("since")))
        finally:
            spark.sparkContext._jsc.clearJobGroup()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"series{k}"))

    one, many = jobs(1), jobs(12)
    assert one and many <= one + 2
