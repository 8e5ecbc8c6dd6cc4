"""Momentum."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.extract import extract
from barloom.functions.series import Series, highest, lag, last, lowest, mean, quotient, ratio, total, weighted
from barloom.operators.volatility import with_true_range
from barloom.plans.fold import fold
from barloom.plans.recursive import Ema, Lagged, then
from barloom.registry import operator

momentum_family = operator("momentum")


class Rsi:
    """Relative strength of changes; ``seeds`` changes, divided by n - 1, begin both means."""

    def __init__(self, period: int, seeds: int):
        self.before = Lagged(1)
        self.up, self.down = (Ema(seeds, 1 / period, divisor=period - 1) for _ in range(2))

    def feed(self, v):
        change = v - self.before.feed(v)
        up, down = then(self.up, np.maximum(change, 0)), then(self.down, np.maximum(-change, 0))
        with np.errstate(divide="ignore", invalid="ignore"):
            return up, down, np.where(np.isnan(up), np.nan, np.where(down == 0, 100.0, 100 - 100 / (1 + up / down)))


class RsiFold:
    def __init__(self, period: int, digits: int | None):
        self.rsi, self.digits = Rsi(period, period - 1), digits

    def layers(self):
        return [[self.rsi.up, self.rsi.down]]

    def feed(self, v):
        up, down, out = self.rsi.feed(v)
        out = np.where((up == 0) & (down == 0), np.nan, out)
        return (out if self.digits is None else np.round(out, self.digits),)


@momentum_family
def rsi(bars: DataFrame, period: int = 14, digits: int | None = 2, value="close") -> DataFrame:
    """Wilder's RSI, rounded to digits; none while there was no change at all."""
    return fold(bars, {"v": extract(value)}, ("rsi",), RsiFold, period, digits)


class MacdFold:
    def __init__(self, fast: int, slow: int, signal: int):
        self.fast, self.slow, self.signal = Ema(fast), Ema(slow), Ema(signal)

    def layers(self):
        return [[self.fast, self.slow, self.signal]]

    def feed(self, v):
        macd = self.fast.feed(v) - self.slow.feed(v)
        signal = then(self.signal, macd)
        return macd, signal, macd - signal


@momentum_family
def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, value="close") -> DataFrame:
    """Difference of two EMAs, its EMA, and their difference."""
    return fold(bars, {"v": extract(value)}, ("macd", "signal", "histogram"), MacdFold, fast, slow, signal)


class TrixFold:
    def __init__(self, period: int):
        self.chain, self.before = [Ema(period) for _ in range(3)], Lagged(1)

    def layers(self):
        return [self.chain]

    def started(self):
        self.before.values = np.array([self.chain[-1].filter.y])

    def feed(self, v):
        x = v
        for ema in self.chain:
            x = then(ema, x)
        before = then(self.before, x)
        return (np.divide(x - before, before, out=np.full(len(x), np.nan), where=before != 0) * 100,)


@momentum_family
def trix(bars: DataFrame, period: int = 14, value="close") -> DataFrame:
    """Per cent change of the triple EMA."""
    return fold(bars, {"v": extract(value)}, ("trix",), TrixFold, period)


EPSILON = 1e-10


class Smoothed:
    """Sum of the first n, then s (1 - 1 / n) + x / n on the sum."""

    def __init__(self, period: int):
        self.ema, self.n = Ema(period, 1.0, divisor=1.0), period
        self.ema.k = 1 / period

    def feed(self, x):
        return then(self.ema, x)


class AdxFold:
    def __init__(self, period: int):
        self.tr, self.up, self.down = (Smoothed(period) for _ in range(3))
        self.adx = Ema(period, 1 / period)

    def layers(self):
        return [[x.ema for x in (self.tr, self.up, self.down)], [self.adx]]

    def feed(self, tr, up, down):
        tr, up, down = self.tr.feed(tr), self.up.feed(up), self.down.feed(down)
        plus, minus = 100 * up / (tr + EPSILON), 100 * down / (tr + EPSILON)
        return then(self.adx, 100 * np.abs(plus - minus) / (plus + minus + EPSILON)), plus, minus


@momentum_family
def adx(bars: DataFrame, period: int = 14, parity: bool = False) -> DataFrame:
    """Directional movement: ADX and both directional indicators."""
    s = with_true_range(bars, parity).let(up=F.col("h") - lag("h"), down=lag("l") - F.col("l"))
    up = F.when(F.col("up") > F.col("down"), F.greatest("up", F.lit(0.0))).otherwise(0.0)
    down = F.when(F.col("down") > F.col("up"), F.greatest("down", F.lit(0.0))).otherwise(0.0)
    return fold(s.df.filter("n > 1"), {"tr": F.col("tr"), "up": up, "down": down}, ("adx", "plus_di", "minus_di"), AdxFold, period)


@momentum_family
def aroon(bars: DataFrame, period: int = 25) -> DataFrame:
    """Place of the highest high and lowest low in the last n + 1 bars, in per cent; ties go to the oldest."""
    s = Series(bars).let(h=extract("high"), l=extract("low"))
    w = last(period + 1)
    s.let(top=F.max(F.struct("h", (-F.col("n")).alias("at"))).over(w), low=F.min(F.struct("l", F.col("n").alias("at"))).over(w))
    oldest = F.col("n") - period
    s.let(up=(-F.col("top.at") - oldest) * 100.0 / period, down=(F.col("low.at") - oldest) * 100.0 / period)
    return s.out(period + 1, up=F.col("up"), down=F.col("down"), oscillator=F.col("up") - F.col("down"))


def _awesome(bars: DataFrame) -> Series:
    s = Series(bars).let(v=extract("hl2"))
    return s.let(ao=F.when(F.col("n") >= 34, mean("v", 5) - mean("v", 34)))


@momentum_family
def ao(bars: DataFrame) -> DataFrame:
    """Mean of 5 less mean of 34 middles."""
    return _awesome(bars).out(34, ao=F.col("ao"))


@momentum_family
def ac(bars: DataFrame) -> DataFrame:
    """AO less its mean of 5."""
    return _awesome(bars).out(38, ac=F.col("ao") - mean("ao", 5))


class TsiFold:
    def __init__(self, r: int, s: int):
        self.before, self.seen, self.first = Lagged(1), 0, r + s
        self.chains = [[Ema(r, None, "first"), Ema(s, None, "first")] for _ in range(2)]

    def layers(self):
        return [[*self.chains[0], *self.chains[1]]]

    def feed(self, v):
        change = v - self.before.feed(v)
        out = []
        for chain, x in zip(self.chains, (change, np.abs(change)), strict=True):
            for ema in chain:
                x = then(ema, x)
            out.append(x)
        count = self.seen + np.arange(1, len(v) + 1)
        self.seen += len(v)
        tsi = np.divide(100 * out[0], out[1], out=np.zeros(len(v)), where=out[1] != 0)
        return (np.where(count >= self.first, tsi, np.nan),)


@momentum_family
def tsi(bars: DataFrame, r_period: int = 25, s_period: int = 13, value="close") -> DataFrame:
    """True strength: doubly smoothed change over doubly smoothed size of change."""
    return fold(bars, {"v": extract(value)}, ("tsi",), TsiFold, r_period, s_period)


@momentum_family
def dpo(bars: DataFrame, period: int = 20, value="close") -> DataFrame:
    """Detrended price: the value s - 1 bars ago less the mean of the n values that end s bars ago, s = n // 2 + 1."""
    shift = period // 2 + 1
    s = Series(bars).let(v=extract(value))
    past = F.avg("v").over(last(period, skip=shift))
    return s.out(period + shift, dpo=(lag("v", shift - 1) if shift > 1 else F.col("v")) - past)


@momentum_family
def kst(bars: DataFrame, r1: int = 10, r2: int = 13, r3: int = 14, r4: int = 15, s1: int = 10, s2: int = 13, s3: int = 14, s4: int = 15, value="close") -> DataFrame:
    """Know sure thing: sum of i times the mean of the i-th rate of change."""
    rs, ss = (r1, r2, r3, r4), (s1, s2, s3, s4)
    s = Series(bars).let(v=extract(value))
    s.let(**{f"r{i}": F.when(F.col("n") > r, F.when(lag("v", r) != 0, (F.col("v") - lag("v", r)) / lag("v", r) * 100.0).otherwise(0.0)) for i, r in enumerate(rs)})
    out = F.lit(0.0)
    for i, n in enumerate(ss):
        out = out + mean(f"r{i}", n) * float(i + 1)
    return s.out(max(r + n for r, n in zip(rs, ss, strict=True)), kst=out)


@momentum_family
def coppock(bars: DataFrame, r1: int = 14, r2: int = 11, wma_period: int = 10, value="close") -> DataFrame:
    """WMA of the sum of two rates of change; infinite after a value of 0."""
    s = Series(bars).let(v=extract(value))
    roc = [quotient((F.col("v") - lag("v", r)) * 100.0, lag("v", r)) for r in (r1, r2)]
    w = np.arange(1, wma_period + 1, dtype=float)
    return s.let(x=roc[0] + roc[1]).out(max(r1, r2) + wma_period, keep_nan=True, coppock=weighted("x", w / w.sum()))


@momentum_family
def rvi(bars: DataFrame, period: int = 10) -> DataFrame:
    """Mean of the ratio of symmetrically weighted bodies and ranges."""
    s = Series(bars).let(body=extract("close") - extract("open"), span=extract("high") - extract("low"))
    w = (1 / 6, 2 / 6, 2 / 6, 1 / 6)
    s.let(num=weighted("body", w), den=weighted("span", w)).let(x=F.when(F.col("n") >= 4, F.when(F.col("den") != 0, F.col("num") / F.col("den")).otherwise(0.0)))
    return s.out(period + 3, rvi=mean("x", period))


@momentum_family
def fisher(bars: DataFrame, period: int = 9) -> DataFrame:
    """Fisher transform of the place of the bar's middle in the range of n bars, clamped to 0.999."""
    s = Series(bars).let(v=extract("hl2"), h=extract("high"), l=extract("low")).let(hi=highest("h", period), lo=lowest("l", period))
    x = F.greatest(F.lit(-0.999), F.least(F.lit(0.999), 2.0 * (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) - 1.0))
    s.let(x=F.when(F.col("hi") > F.col("lo"), x).otherwise(0.0))
    return s.out(period, fisher=0.5 * F.log((1.0 + F.col("x")) / (1.0 - F.col("x"))))


@momentum_family
def vortex(bars: DataFrame, period: int = 14) -> DataFrame:
    """Upward vortex, and the downward one under a name of its own."""
    s = with_true_range(bars).let(up=F.abs(F.col("h") - lag("l")), down=F.abs(F.col("l") - lag("h")))
    width = total("tr", period)
    return s.out(period + 1, vortex=ratio(total("up", period), width), vortex_minus=ratio(total("down", period), width))
