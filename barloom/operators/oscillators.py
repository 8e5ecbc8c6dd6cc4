"""Oscillators."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.extract import extract
from barloom.functions.series import Series, highest, lag, lowest, mean, ratio, running, total
from barloom.operators.momentum import Rsi
from barloom.operators.volatility import with_true_range
from barloom.plans.fold import fold
from barloom.plans.recursive import Ema, Tail, then
from barloom.plans.sliding import Deviation
from barloom.registry import operator

oscillator = operator("oscillator")
EPSILON = 1e-10


def _range(bars: DataFrame, period: int) -> Series:
    s = Series(bars).let(h=extract("high"), l=extract("low"), c=extract("close"))
    return s.let(hh=highest("h", period), ll=lowest("l", period))


@oscillator
def stochastic(bars: DataFrame, k_period: int = 14, d_period: int = 3) -> DataFrame:
    """Place of close in the range of k bars, and its mean over d."""
    s = _range(bars, k_period)
    s.let(k=F.when(F.col("n") >= k_period, (F.col("c") - F.col("ll")) / (F.col("hh") - F.col("ll") + EPSILON) * 100.0))
    return s.out(k_period + d_period - 1, k=F.col("k"), d=mean("k", d_period))


class CciFold:
    def __init__(self, period: int, parity: bool):
        self.deviation, self.parity = Deviation(period), parity

    def feed(self, tp):
        value, mean, deviation = self.deviation.feed(tp)
        scale = 1.0 / 0.015
        return ((value - mean) / (deviation * scale + EPSILON) * scale if self.parity else (value - mean) / (deviation * 0.015 + EPSILON),)


@oscillator
def cci(bars: DataFrame, period: int = 20, parity: bool = False) -> DataFrame:
    """Typical price less its mean, over 0.015 mean deviations. parity: over the mean deviation itself."""
    return fold(bars, {"tp": extract("hlc3")}, ("cci",), CciFold, period, parity)


@oscillator
def williams_r(bars: DataFrame, period: int = 14) -> DataFrame:
    """Distance of close from the top of the range, 0 to -100."""
    return _range(bars, period).out(period, williams_r=(F.col("hh") - F.col("c")) / (F.col("hh") - F.col("ll") + EPSILON) * -100.0)


@oscillator
def roc(bars: DataFrame, period: int = 12, value="close", parity: bool = False) -> DataFrame:
    """Per cent change over n bars. parity: over n + 1 bars from the second output on."""
    s = Series(bars).let(v=extract(value))
    s.let(p=F.when(F.col("n") == period + 1, lag("v", period)).otherwise(lag("v", period + 1)) if parity else lag("v", period))
    return s.out(period + 1, roc=ratio((F.col("v") - F.col("p")) * 100.0, F.col("p")))


@oscillator
def momentum(bars: DataFrame, period: int = 10, value="close") -> DataFrame:
    """Change over n bars."""
    return Series(bars).let(v=extract(value)).out(period + 1, momentum=F.col("v") - lag("v", period))


@oscillator
def mfi(bars: DataFrame, period: int = 14) -> DataFrame:
    """Money flow: share of flow on rising typical prices; an equal price counts as rising."""
    s = Series(bars).let(tp=extract("hlc3"), v=extract("volume")).let(ptp=lag("tp"), flow=F.col("tp") * F.col("v"))
    s.let(up=F.when(F.col("n") > 1, F.when(F.col("tp") >= F.col("ptp"), F.col("flow")).otherwise(0.0)), down=F.when(F.col("n") > 1, F.when(F.col("tp") < F.col("ptp"), F.col("flow")).otherwise(0.0)))
    s.let(pos=total("up", period), neg=total("down", period))
    return s.out(period + 1, mfi=F.when(F.col("neg") == 0, 100.0).otherwise(100.0 - 100.0 / (1.0 + F.col("pos") / F.col("neg"))))


@oscillator
def obv(bars: DataFrame) -> DataFrame:
    """Running volume by the sign of the change of close."""
    s = Series(bars).let(c=extract("close"), v=extract("volume"))
    return s.let(x=F.signum(F.col("c") - lag("c")) * F.col("v")).out(2, obv=running("x"))


@oscillator
def cmo(bars: DataFrame, period: int = 14, value="close") -> DataFrame:
    """Sum of gains less losses over their sum."""
    s = Series(bars).let(v=extract(value)).let(d=F.col("v") - lag("v"))
    s.let(g=F.greatest("d", F.lit(0.0)), l=F.greatest(-F.col("d"), F.lit(0.0)), ).let(g=total(F.when(F.col("n") > 1, F.col("g")), period), l=total(F.when(F.col("n") > 1, F.col("l")), period))
    return s.out(period + 1, cmo=100.0 * (F.col("g") - F.col("l")) / (F.col("g") + F.col("l") + EPSILON))


class PairFold:
    """Two EMAs that start at the first value: their difference, or in per cent of the slow one."""

    def __init__(self, fast: int, slow: int, first: int, relative: bool):
        self.fast, self.slow = (Ema(n, None, "first") for n in (fast, slow))
        self.first, self.relative, self.seen = first, relative, 0

    def layers(self):
        return [[self.fast, self.slow]]

    def feed(self, v):
        fast, slow = self.fast.feed(v), self.slow.feed(v)
        out = fast - slow
        if self.relative:
            out = np.divide(100 * out, slow, out=np.full(len(v), np.nan), where=slow != 0)
        count = self.seen + np.arange(1, len(v) + 1)
        self.seen += len(v)
        return (np.where(count >= self.first, out, np.nan),)


@oscillator
def ppo(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, value="close") -> DataFrame:
    """Difference of two EMAs in per cent of the slow one."""
    return fold(bars, {"v": extract(value)}, ("ppo",), PairFold, fast, slow, slow + signal, True)


@oscillator
def apo(bars: DataFrame, fast: int = 12, slow: int = 26, value="close") -> DataFrame:
    """Difference of two EMAs."""
    return fold(bars, {"v": extract(value)}, ("apo",), PairFold, fast, slow, slow, False)


class StochRsiFold:
    def __init__(self, rsi: int, stoch: int, k: int, d: int):
        self.rsi, self.window, self.k, self.skip = Rsi(rsi, rsi), Tail(stoch), Tail(k), d - 1

    def feed(self, v):
        rsi = self.rsi.feed(v)[2]
        out, ok = np.full(len(v), np.nan), np.flatnonzero(~np.isnan(rsi))

        def place(w):
            low, span = w.min(axis=1), np.ptp(w, axis=1)
            return np.divide(100 * (w[:, -1] - low), span, out=np.full(len(w), 50.0), where=span != 0)

        stoch = self.window.apply(rsi[ok], place)
        ready = ~np.isnan(stoch)
        mean = np.full(len(ok), np.nan)
        mean[ready] = self.k.apply(stoch[ready], lambda w: w.mean(axis=1))
        out[ok] = mean
        shown = np.flatnonzero(~np.isnan(out))
        out[shown[: self.skip]] = np.nan
        self.skip = max(0, self.skip - len(shown))
        return (out,)


@oscillator
def stochrsi(bars: DataFrame, rsi: int = 14, stoch: int = 14, k: int = 3, d: int = 3, value="close") -> DataFrame:
    """Mean over k of the place of RSI in its range; 50 where that is flat."""
    return fold(bars, {"v": extract(value)}, ("stochrsi",), StochRsiFold, rsi, stoch, k, d)


@oscillator
def uo(bars: DataFrame, period1: int = 7, period2: int = 14, period3: int = 28) -> DataFrame:
    """Ultimate oscillator over three periods, weighted 4, 2, 1."""
    s = Series(bars).let(h=extract("high"), l=extract("low"), c=extract("close")).let(pc=lag("c"))
    low = F.least("l", "pc")
    s.let(bp=F.when(F.col("n") > 1, F.col("c") - low), w=F.when(F.col("n") > 1, F.greatest("h", "pc") - low))
    share = [F.when(total("w", p) != 0, total("bp", p) / total("w", p)).otherwise(0.0) for p in (period1, period2, period3)]
    return s.out(period3 + 1, uo=100.0 * (4.0 * share[0] + 2.0 * share[1] + share[2]) / 7.0)


@oscillator
def chop(bars: DataFrame, period: int = 14, digits: int | None = 2) -> DataFrame:
    """Choppiness: log ratio of the summed true range and the range, rounded to digits."""
    s = with_true_range(bars).let(sum=total("tr", period), span=highest("h", period) - lowest("l", period))
    out = F.when((F.col("sum") > 0) & (F.col("span") > 0), 100.0 * F.log10(F.col("sum") / F.col("span")) / math.log10(period))
    return s.out(period + 1, chop=out if digits is None else F.round(out, digits))


class ForceFold:
    def __init__(self, period: int):
        self.ema, self.first, self.seen = Ema(period, None, "first"), period, 0

    def layers(self):
        return [[self.ema]]

    def feed(self, x):
        out = then(self.ema, x)
        count = self.seen + np.cumsum(~np.isnan(x))
        self.seen = int(count[-1])
        return (np.where(count >= self.first, out, np.nan),)


@oscillator
def force_index(bars: DataFrame, period: int = 13) -> DataFrame:
    """EMA of change of close times volume, from the first."""
    s = Series(bars).let(c=extract("close"), v=extract("volume")).let(x=(F.col("c") - lag("c")) * F.col("v"))
    return fold(s.df, {"x": F.col("x")}, ("force_index",), ForceFold, period)
