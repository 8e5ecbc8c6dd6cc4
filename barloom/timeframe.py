"""Timeframes: parsing, and roll-up of one-minute bars to higher timeframes.

Two roll-ups: ``roll_up`` is a plain aggregation by aligned bucket that keeps the complete buckets, right for
dense bars and planned with partial aggregation; ``roll_up_exact`` is count-closed like a live feed: a bar
opens at the first aligned minute, swallows ticks until it has its count, and waits for the next opening.
"""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.extract import side
from barloom.functions.series import one_per_time
from barloom.plans.fold import fold

_TF = re.compile(r"(\d+)([mhdw])", re.I)
MINUTES = {"m": 1, "h": 60, "d": 1440, "w": 10080}
HOURS = (1, 2, 3, 4, 6, 8, 12)


def timeframe_minutes(tf: str) -> int:
    """1m .. 59m, hours of HOURS, days, weeks; any case. ValueError for all else."""
    m = _TF.fullmatch(tf.strip())
    if not m or not int(m[1]):
        raise ValueError(f"no timeframe: {tf!r}")
    n, unit = int(m[1]), m[2].lower()
    if unit == "h" and n not in HOURS:
        raise ValueError(f"hours must be one of {HOURS}: {tf!r}")
    return n * MINUTES[unit]


_UNIT_MS = {"s": 1_000, "m": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 604_800_000}


def interval_ms(interval: str) -> int:
    """Milliseconds of any number of seconds, minutes, hours, days or weeks; other than timeframes, 30s and 5h are intervals."""
    m = re.fullmatch(r"(\d+)([smhdw])", interval.strip(), re.I)
    if not m:
        raise ValueError(f"no interval: {interval!r}")
    return int(m[1]) * _UNIT_MS[m[2].lower()]


def local(time: Column, timezone: str) -> Column:
    return F.from_utc_timestamp(time, timezone)


def as_timestamp(df: DataFrame, name: str = "time") -> Column:
    kind = dict(df.dtypes)[name]
    return F.timestamp_seconds(F.col(name)) if kind in ("bigint", "int") else F.col(name).cast("timestamp")


def is_open(at: Column, minutes: int, week_start: int = 0) -> Column:
    """Whether a local time begins a bar: aligned in the day, midnight, or midnight of the week's first day."""
    clean = F.second(at) == 0
    of_day = F.hour(at) * 60 + F.minute(at)
    if minutes < 1440:
        return clean & (of_day % minutes == 0)
    midnight = clean & (of_day == 0)
    return midnight if minutes == 1440 else midnight & (F.weekday(at) == week_start)


def roll_up(bars: DataFrame, tf: str, timezone: str = "UTC", week_start: int = 0) -> DataFrame:
    """Complete bars of tf from one-minute bars without gaps or duplicates."""
    minutes = timeframe_minutes(tf)
    at = local(as_timestamp(bars), timezone)
    of_day = F.hour(at) * 60 + F.minute(at)
    if minutes < 1440:
        start = F.date_trunc("day", at) + F.make_dt_interval(mins=of_day - of_day % minutes)
    else:
        # 1970-01-05 was a Monday
        days = F.datediff(F.to_date(at), F.lit("1970-01-05").cast("date")) - week_start
        step = 1 if minutes == 1440 else 7
        start = F.date_add(F.lit("1970-01-05").cast("date"), (F.floor(days / step) * step + week_start).cast("int")).cast("timestamp")
    ticks = bars.withColumn("__start", start).withColumn("__offset", (F.unix_timestamp(at) - F.unix_timestamp(F.col("__start"))) / 60).filter(F.col("__offset") < minutes)
    grouped = ticks.groupBy("symbol", "__start").agg(
        F.min("time").alias("time"),
        F.min_by("open", "time").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "time").alias("close"),
        F.sum("volume").alias("volume"),
        F.count(F.lit(1)).alias("n"),
        F.min("__offset").alias("first"),
    )
    out = grouped.filter((F.col("n") == minutes) & (F.col("first") == 0))
    return out.select("symbol", F.lit(tf).alias("tf"), "time", "open", "high", "low", "close", "volume", side().alias("side"), F.lit(minutes).alias("timeframe"))


class RollUpFold:
    def __init__(self, minutes: int):
        self.minutes, self.bar, self.count = minutes, None, 0

    def feed(self, opens, o, h, l, c, v, t):
        out = np.full((6, len(o)), np.nan)
        for i, (begins, *tick) in enumerate(zip(*(x.tolist() for x in (opens, o, h, l, c, v, t)), strict=True)):
            open_, high, low, close, volume, time = tick  # a missing high or low is NaN, 0 is a price
            if self.bar is None:
                if begins:
                    self.bar, self.count = [open_, high, low, close, volume, time], 1
                else:
                    continue
            else:
                b = self.bar
                b[1] = high if math.isnan(b[1]) else max(b[1], high)
                b[2] = low if math.isnan(b[2]) else min(b[2], low)
                b[4] += volume
                self.count += 1
            if self.count == self.minutes and self.count > 1:
                self.bar[1:4] = [0.0 if math.isnan(x) else x for x in self.bar[1:3]] + [close]
                out[:, i], self.bar = self.bar, None
        return tuple(out)


class FanOutFold:
    """Count-closed bars of several timeframes in one pass; a timeframe without a bar at a tick that closes another's has infinities."""

    def __init__(self, minutes: tuple[int, ...]):
        self.folds = [RollUpFold(m) for m in minutes]

    def feed(self, *inputs):
        k = len(self.folds)
        out = np.array([f.feed(inputs[i], *inputs[k:]) for i, f in enumerate(self.folds)])
        closes = ~np.isnan(out[:, 0]).all(axis=0)
        out[:, :, closes] = np.where(np.isnan(out[:, :, closes]), np.inf, out[:, :, closes])
        return tuple(out.reshape(6 * k, -1))


def roll_up_exact(bars: DataFrame, tf: str, timezone: str = "UTC", week_start: int = 0) -> DataFrame:
    """Count-closed bars of tf, gaps and duplicates included. Works on streams."""
    return bars if timeframe_minutes(tf) == 1 else _closed(bars, [tf], timezone, week_start)


def _closed(bars: DataFrame, tfs: list[str], timezone: str, week_start: int) -> DataFrame:
    minutes = [timeframe_minutes(tf) for tf in tfs]
    bars = bars if bars.isStreaming else one_per_time(bars)
    at = local(as_timestamp(bars), timezone)
    seconds = F.unix_timestamp(as_timestamp(bars)).cast("double")
    inputs = {f"opens{i}": is_open(at, m, week_start).cast("double") for i, m in enumerate(minutes)}
    value = {x: F.col(x).cast("double") for x in ("open", "high", "low", "close", "volume")}
    inputs |= {x: F.coalesce(v, F.lit(math.nan if x in ("high", "low") else 0.0)) for x, v in value.items()} | {"t": seconds}
    fields = ("open", "high", "low", "close", "volume", "start")
    got = fold(bars, inputs, tuple(f"{x}{i}" for i in range(len(tfs)) for x in fields), FanOutFold, tuple(minutes))
    of = F.array(*[F.struct(F.lit(tf).alias("tf"), F.lit(m).alias("timeframe"), *[F.col(f"{x}{i}").alias(x) for x in fields]) for i, (tf, m) in enumerate(zip(tfs, minutes, strict=True))])
    one = got.select("symbol", F.explode(of).alias("b")).select("symbol", "b.*").filter(F.col("start").isNull() | (F.col("start") != float("inf")))
    time = F.col("start").cast("long") if dict(bars.dtypes)["time"] in ("bigint", "int") else F.timestamp_seconds(F.col("start").cast("long"))
    return one.select("symbol", "tf", time.alias("time"), "open", "high", "low", "close", "volume", side().alias("side"), "timeframe")


def fan_out(bars: DataFrame, tfs: list[str], timezone: str = "UTC", week_start: int = 0) -> DataFrame:
    """One-minute bars and their roll-ups, one below the other; one pass over the bars feeds all roll-ups. Works on streams."""
    higher = [tf for tf in tfs if timeframe_minutes(tf) > 1]
    out = _closed(bars, higher, timezone, week_start) if higher else None
    for tf in (tf for tf in tfs if timeframe_minutes(tf) == 1):
        one = bars.select("symbol", F.lit(tf).alias("tf"), "time", "open", "high", "low", "close", "volume", side().alias("side"), F.lit(1).alias("timeframe"))
        out = one if out is None else out.unionByName(one)
    return out
