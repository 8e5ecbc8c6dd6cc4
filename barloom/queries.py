"""The indicator operators as queries over the driver's tables, and their SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom import oracles
from barloom.bars import minute_bars

#: Decimals in results where values are large; 6 for all others.
DIGITS = {"natr": 4, "hv": 3, "trix": 4, "stochrsi": 2, "kst": 2, "coppock": 2, "roc": 3, "force_index": 3, "ad": 3, "adosc": 3, "eom": 1, "pvt": 2, "variance": 4}


def shown(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(F.col(c) + float(oracles.SHIFT), digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def _indicator(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    import barloom.operators  # noqa: F401
    from barloom.registry import get

    # RSI and CHOP unrounded; McGinley's mean on prices that do not pass near zero
    params = {"rsi": {"digits": None}, "chop": {"digits": None}, "mcginley": {"value": F.col("close") + 1000.0}}.get(name, {})
    out = get(name)(minute_bars(spark, sf_dir), **params)
    if name in ("nvi", "pvi"):  # a product over all bars: compared by its logarithm
        out = out.withColumn(name, F.when(F.col(name) == 0, float("-inf")).otherwise(F.log(name)))
    return shown(out, DIGITS.get(name, 6))


def overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.operators.bundle import overview

    return shown(overview(minute_bars(spark, sf_dir)))


# ---- roll-ups, bars and the relational surface


def bars_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.functions.extract import valid_bar

    return shown(minute_bars(spark, sf_dir).filter(valid_bar()).select("symbol", "time", "open", "high", "low", "close", "volume", "side"))


def bars_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.bars import hourly_bars

    return hourly_bars(spark, sf_dir).select("symbol", "time", "open", "high", "low", "close", "volume", "side")


def bars_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.bars import daily_bars

    return daily_bars(spark, sf_dir).select("symbol", "time", "open", "high", "low", "close", "volume", "side")


def extractors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.functions.extract import extract

    names = ("open", "high", "low", "close", "volume", "hl2", "hlc3", "hlcc4")
    return shown(minute_bars(spark, sf_dir).select("symbol", "time", *[extract(x).alias(f"x_{x}") for x in names]))


def _rolled(df: DataFrame) -> DataFrame:
    return shown(df.select("symbol", "tf", "time", "open", "high", "low", "close", "volume", "side"))


def rollup_5m(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.timeframe import roll_up

    return _rolled(roll_up(minute_bars(spark, sf_dir), "5m"))


def rollup_4h(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.timeframe import roll_up

    return _rolled(roll_up(minute_bars(spark, sf_dir), "4h"))


def rollup_exact_7m(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven minutes do not divide a day, so bars re-align at midnight."""
    from barloom.timeframe import roll_up_exact

    return _rolled(roll_up_exact(minute_bars(spark, sf_dir), "7m"))


def rollup_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.timeframe import fan_out

    return _rolled(fan_out(minute_bars(spark, sf_dir), ["1m", "15m", "1h"]))


def multi_timeframe_sma(spark: SparkSession, sf_dir: str) -> DataFrame:
    import barloom.operators  # noqa: F401
    from barloom.registry import get
    from barloom.timeframe import fan_out

    return shown(get("sma")(fan_out(minute_bars(spark, sf_dir), ["5m", "15m"]), period=5))


def skip_and_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars from a time on, less the first 10 of each series, and of those the last 20."""
    from barloom.bars import EPOCH, skip_before, skip_first
    from barloom.sources.store import recent

    return recent(skip_first(skip_before(minute_bars(spark, sf_dir), EPOCH + 3600), 10), 20).select("symbol", "time", "close")


def duplicates_last_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours with several events: the last event of an hour wins."""
    from barloom.bars import latest

    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = e.select(F.col("event_type").alias("symbol"), F.lit("1h").alias("tf"), F.unix_timestamp(F.date_trunc("hour", F.col("ts").cast("timestamp"))).alias("time"), F.struct("ts", "event_id").alias("version"), "value")
    return latest(rows).select("symbol", "time", "value")


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a store: minute bars with the documents of SMA(20), and of momentum(10) on even minutes."""
    import barloom.operators  # noqa: F401
    from barloom.registry import get
    from barloom.sources.store import as_document, merged

    bars = minute_bars(spark, sf_dir)
    sma = get("sma")(bars).select("symbol", "time", as_document({"SMA_20": F.col("sma")}).alias("d1"))
    mom = get("momentum")(bars).filter("time % 120 = 0").select("symbol", "time", as_document({"MOM_10": {"value": F.col("momentum"), "sign": F.signum("momentum")}}).alias("d2"))
    rows = bars.join(sma, ["symbol", "time"], "left").join(mom, ["symbol", "time"], "left")
    return rows.select(F.lit("ex").alias("exchange"), "symbol", "tf", "time", "open", "high", "low", "close", "volume", merged(F.col("d1"), F.col("d2")).alias("indicators"), F.lit(None).cast("timestamp").alias("updated_at"))


def store_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars upserted and documents merged: new closes and a new document for every third minute."""
    from barloom.sources.store import BAR, as_document, merge_rows

    old = _stored(spark, sf_dir)
    new = old.filter("time % 180 = 0").select("exchange", "symbol", "tf", (F.col("time") + 60 * 60 * 24 * 3650 * (F.col("time") % 540 == 0).cast("int")).alias("time"), *[(F.col(c) * 2).alias(c) for c in BAR], as_document({"SMA_20": F.col("close"), "NEW": F.lit(1.0)}).alias("indicators"))
    out = merge_rows(old, new)
    ind = F.col("indicators")
    return shown(out.select("symbol", "time", "close", ind["SMA_20"]["value"].alias("sma"), ind["MOM_10"]["sign"].alias("mom_sign"), ind["NEW"]["value"].alias("added"), F.size(F.map_keys(ind)).alias("n_keys")))


def store_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.sources.store import indicator_stats

    return shown(indicator_stats(_stored(spark, sf_dir).filter("symbol = 'click'"), "MOM_10"))


def store_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics from the summaries of a store, written twice: half of the documents come with a second write."""
    from barloom.session import shared_folder
    from barloom.sources.store import BarStore
    from barloom.sources.summaries import stats

    store, rows = BarStore(spark, shared_folder(spark, "summaries")), _stored(spark, sf_dir).persist()
    store.upsert(rows, "ex", F.when(F.col("time") % 240 == 0, F.col("indicators")))
    store.merge_indicators(rows.filter("time % 240 != 0").select("symbol", "tf", "time", F.coalesce("indicators", F.create_map().cast("map<string,map<string,double>>")).alias("indicators")), "ex")
    rows.unpersist()
    return shown(stats(store.summaries("ex"), "MOM_10", ("symbol",)).withColumn("symbol", F.lower("symbol")))


def store_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.sources.store import completeness

    rows = _stored(spark, sf_dir).filter("symbol = 'view'")
    return completeness(rows, "SMA_20", 50).withColumn("key", F.lit("SMA_20")).unionByName(completeness(rows, "MOM_10", 50).withColumn("key", F.lit("MOM_10")))


def store_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.sources.store import indicator_keys

    return indicator_keys(_stored(spark, sf_dir))


def store_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.sources.store import indicator_series

    return shown(indicator_series(_stored(spark, sf_dir).filter("symbol = 'error'"), "MOM_10").select("time", F.col("fields")["value"].alias("value"), F.col("fields")["sign"].alias("sign")))


def store_candles_with(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.sources.store import candles_with

    got = candles_with(_stored(spark, sf_dir).filter("symbol = 'signup'"), ["SMA_20", "MOM_10"], 100)
    sma = F.when(F.size("SMA_20") == 1, F.col("SMA_20")["value"])
    return shown(got.select("time", "close", sma.alias("sma"), F.col("MOM_10")["value"].alias("mom")))


def store_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.sources.store import recent

    return shown(recent(_stored(spark, sf_dir), 1).select("symbol", "time", "open", "high", "low", "close", "volume"))


def store_history_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.bars import EPOCH
    from barloom.sources.store import history_page

    return history_page(_stored(spark, sf_dir).filter("symbol = 'purchase'"), EPOCH + 60 * 150, 40).select("time", "close")


def store_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.bars import EPOCH
    from barloom.sources.store import retained

    return retained(_stored(spark, sf_dir), EPOCH + 86_400 + 6_000, 1).groupBy("symbol").agg(F.count(F.lit(1)).alias("n_rows"), F.min("time").alias("first_time"))


def store_bulk_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long points to documents and back: count and sum by key."""
    from barloom.sources.store import to_documents

    bars = minute_bars(spark, sf_dir)
    points = bars.select("symbol", "tf", "time", F.explode(F.array(F.struct(F.lit("O").alias("key"), F.col("open").alias("value")), F.struct(F.lit("C").alias("key"), F.col("close").alias("value")))).alias("p")).select("symbol", "tf", "time", "p.*")
    back = to_documents(points).select("symbol", F.explode("indicators").alias("key", "fields"))
    return back.groupBy("symbol", "key").agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.sum(F.col("fields")["value"]), 2).alias("total"))


def payload_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    import barloom.operators  # noqa: F401
    from barloom.registry import get
    from barloom.streaming.payloads import points

    return shown(points(get("bbands")(minute_bars(spark, sf_dir)), "BBANDS_20", ["upper", "middle", "lower"]).drop("color"))


def payload_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bar frames to JSON, decoded again."""
    from barloom.bars import decode_wire
    from barloom.streaming.payloads import frames

    return shown(decode_wire(frames(minute_bars(spark, sf_dir)), "payload").select("symbol", "time", "open", "high", "low", "close", "volume"))


def as_of_higher_timeframe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each minute bar with the last complete 15-minute close before its end."""
    from barloom.functions.asof import as_of
    from barloom.timeframe import roll_up

    bars = minute_bars(spark, sf_dir)
    high = roll_up(bars, "15m").select("symbol", (F.col("time") + 14 * 60).alias("time"), F.col("close").alias("close_15m"))
    return as_of(bars.select("symbol", "time", "close"), high)


def _by_name(frames: dict[str, DataFrame]) -> DataFrame:
    """symbol, time, name, value of several results with one output each, one below the other."""
    out = None
    for name, df in frames.items():
        one = df.select("symbol", F.col("time").cast("long").alias("time"), F.lit(name).alias("name"), F.col(name).alias("value"))
        out = one if out is None else out.unionByName(one)
    return shown(out)


def duplicates_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of the same time, above and below the first: windows and folds both take the largest."""
    import barloom.operators  # noqa: F401
    from barloom.registry import get

    bars = minute_bars(spark, sf_dir)
    n = (F.col("time") - 1704067200) / 60 + 1
    above = bars.filter(n % 5 == 0).withColumns({"open": F.col("open") + 1, "high": F.col("high") + 1, "close": F.col("close") + 2})
    below = bars.filter(n % 7 == 0).withColumns({"open": F.col("open") - 1, "low": F.col("low") - 1, "close": F.col("close") - 2})
    doubled = bars.unionByName(above).unionByName(below)
    return _by_name({name: get(name)(doubled) for name in ("sma", "ema")})


#: One in so many hours of each series comes late.
LATE_HOURS = 5


def late_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth hour of each series arrives late, into a store: the points are those of bars in order."""
    import barloom.operators  # noqa: F401
    from barloom.plans.replay import replay_all
    from barloom.registry import get
    from barloom.session import shared_folder
    from barloom.sources.store import BarStore

    store = BarStore(spark, shared_folder(spark, "late"))
    bars = minute_bars(spark, sf_dir).persist()
    late = F.floor(F.col("time") / 3600) % LATE_HOURS == 1
    for part in (bars.filter(~late), bars.filter(late)):
        store.upsert(part, "x")
        since = part.groupBy("symbol").agg(F.min("time").alias("since"))
        replay_all(store, "x", "1m", {name: get(name) for name in ("sma", "ema")}, since)
    bars.unpersist()
    rows = store.rows("x").withColumn("symbol", F.lower("symbol"))
    value = lambda name: F.col("indicators")[name]["value"]
    return _by_name({name: rows.select("symbol", "time", value(name).alias(name)).filter(F.col(name).isNotNull()) for name in ("sma", "ema")})


def parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operators whose documented formula and the served behaviour differ, in the served behaviour."""
    import barloom.operators  # noqa: F401
    from barloom.registry import get

    bars = minute_bars(spark, sf_dir)
    return _by_name({name: get(name)(bars, parity=True) for name in ("tr", "atr", "roc", "zlema", "cci", "kama")})


def _over_spans(spark: SparkSession, sf_dir: str, names: tuple[str, ...]) -> DataFrame:
    import barloom.operators  # noqa: F401
    from barloom.plans.spans import numbered, over_spans
    from barloom.registry import get

    bars = numbered(minute_bars(spark, sf_dir), 7200).persist()
    out = _by_name({name: over_spans(get(name), bars, span_bars=512, slot_seconds=7200) for name in names})
    bars.unpersist()
    return out


def long_series_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows and running sums over spans of a series, with a halo or the totals before."""
    return _over_spans(spark, sf_dir, ("sma", "hma", "zscore", "obv"))


def long_series_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recursive averages over spans of a series by an associative scan."""
    return _over_spans(spark, sf_dir, ("ema", "tema", "t3", "tsi"))


RELATIONAL = (
    overview, bars_valid, bars_hourly, bars_daily, extractors, rollup_5m, rollup_4h, rollup_exact_7m, rollup_fan_out, multi_timeframe_sma, skip_and_recent, duplicates_last_write,
    store_merge, store_stats, store_summaries, store_complete, store_keys, store_series, store_candles_with, store_latest, store_history_page, store_retention, store_bulk_points, payload_points, payload_bars, as_of_higher_timeframe, duplicates_series, late_bars, parity, long_series_windows, long_series_scan,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import barloom.operators  # noqa: F401
    from barloom.registry import OPERATORS

    return {name: functools.partial(_indicator, name) for name in OPERATORS} | {f.__name__: f for f in RELATIONAL}


def oracle_sql() -> dict[str, str]:
    return oracles.indicator_sql() | oracles.relational_sql()
