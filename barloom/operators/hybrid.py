"""Compound indicators."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.extract import extract
from barloom.functions.series import Series, highest, lag, looks_back, lowest, ratio
from barloom.operators.volatility import with_true_range
from barloom.plans.fold import fold
from barloom.plans.recursive import Ema, then
from barloom.registry import operator

hybrid = operator("hybrid")


def as_timestamp(time):
    """Bar times are timestamps, or unix seconds."""
    return F.timestamp_seconds(time)


@hybrid
def vwap(bars: DataFrame, timezone: str = "UTC") -> DataFrame:
    """Volume-weighted typical price since the start of the local day; none while there is no volume."""
    s = Series(bars).let(tp=extract("hlc3"), v=extract("volume"))
    at = F.col("time") if dict(bars.dtypes)["time"].startswith("timestamp") else as_timestamp(F.col("time"))
    s.let(day=F.to_date(F.from_utc_timestamp(at, timezone)), tpv=F.col("tp") * F.col("v"))
    looks_back(math.inf)
    w = Window.partitionBy("symbol", "tf", "day").orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    return s.out(1, vwap=ratio(F.sum("tpv").over(w), F.sum("v").over(w)))


class SupertrendFold:
    def __init__(self, period: int, multiplier: float):
        self.atr, self.m, self.up, self.upper, self.lower = Ema(period, 1 / period), multiplier, None, 0.0, 0.0

    def feed(self, h, l, c, tr):
        value, side = np.full(len(h), np.nan), np.full(len(h), np.nan)
        rows = zip(((h + l) * 0.5).tolist(), c.tolist(), then(self.atr, tr).tolist(), strict=True)
        for i, (middle, close, atr) in enumerate(rows):
            if math.isnan(atr):
                continue
            high, low = middle + self.m * atr, middle - self.m * atr
            if self.up is None:
                self.upper, self.lower, self.up = high, low, close > middle
            elif self.up:
                self.lower = max(low, self.lower)
                if close < self.lower:
                    self.upper, self.up = high, False
            else:
                self.upper = min(high, self.upper)
                if close > self.upper:
                    self.lower, self.up = low, True
            value[i], side[i] = (self.lower if self.up else self.upper), self.up
        return value, side


@hybrid
def supertrend(bars: DataFrame, period: int = 10, multiplier: float = 3.0, parity: bool = False) -> DataFrame:
    """Trailing band of multiplier ATRs that flips when close crosses it."""
    s = with_true_range(bars, parity)
    return fold(s.df, {x: F.col(x) for x in ("h", "l", "c", "tr")}, ("value", "is_uptrend"), SupertrendFold, period, multiplier, kinds={"is_uptrend": "boolean"})


@hybrid
def ichimoku(bars: DataFrame, tenkan: int = 9, kijun: int = 26, senkou: int = 52) -> DataFrame:
    """Mid-ranges of three periods, without displacement; chikou is close kijun bars ago."""
    s = Series(bars).let(h=extract("high"), l=extract("low"), c=extract("close"))
    s.let(**{name: (highest("h", n) + lowest("l", n)) / 2.0 for name, n in (("tenkan", tenkan), ("kijun", kijun), ("senkou_b", senkou))})
    return s.out(senkou, tenkan=F.col("tenkan"), kijun=F.col("kijun"), senkou_a=(F.col("tenkan") + F.col("kijun")) / 2.0, senkou_b=F.col("senkou_b"), chikou=F.coalesce(lag("c", kijun), F.lit(0.0)))


class PsarFold:
    """Stop-and-reverse. strict: the lows before are only followed in an up-trend and the highs in a down-trend."""

    def __init__(self, step: float, max_af: float, strict: bool):
        self.step, self.most, self.strict, self.first = step, max_af, strict, []
        self.up, self.sar, self.ep, self.af = True, 0.0, 0.0, step
        self.lows, self.highs = (0.0, 0.0), (0.0, 0.0)

    def _start(self, bar):
        self.first.append(bar)
        if len(self.first) < 3:
            return False
        (h1, l1, c1), (h2, l2, _), (h3, l3, c3) = self.first
        self.up = c3 > c1
        self.ep, self.sar = (h3, l1) if self.up else (l3, h1)
        if self.up or not self.strict:
            self.lows = (l2, l1)
        if not self.up or not self.strict:
            self.highs = (h2, h1)
        return True

    def _next(self, h, l):
        was_up = self.up
        self.sar += self.af * (self.ep - self.sar)
        self.sar = min(self.sar, *self.lows) if was_up else max(self.sar, *self.highs)
        if (h > self.ep) if was_up else (l < self.ep):
            self.ep, self.af = (h if was_up else l), min(self.af + self.step, self.most)
        if was_up or not self.strict:
            self.lows = (l, self.lows[0])
        if not was_up or not self.strict:
            self.highs = (h, self.highs[0])
        if (l < self.sar) if was_up else (h > self.sar):
            self.sar, self.ep, self.af, self.up = self.ep, (l if was_up else h), self.step, not was_up

    def feed(self, h, l, c):
        out = np.full((4, len(h)), np.nan)
        for i, (high, low, close) in enumerate(zip(h.tolist(), l.tolist(), c.tolist(), strict=True)):
            if len(self.first) < 3:
                if not self._start((high, low, close)):
                    continue
            else:
                self._next(high, low)
            out[:, i] = self.sar, self.up, self.af, self.ep
        return tuple(out)


@hybrid
def psar(bars: DataFrame, step: float = 0.02, max_af: float = 0.20, strict: bool = True) -> DataFrame:
    """Parabolic stop and reverse, from bar 3."""
    return fold(bars, {"h": extract("high"), "l": extract("low"), "c": extract("close")}, ("sar", "is_uptrend", "af", "ep"), PsarFold, step, max_af, strict, kinds={"is_uptrend": "boolean"})
