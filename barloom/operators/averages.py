"""Moving averages."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.extract import extract
from barloom.functions.series import Series, lag, mean, ratio, total, weighted
from barloom.plans.fold import fold
from barloom.plans.recursive import Ema, Lagged, Linear, then
from barloom.registry import operator

average = operator("average")


@average
def sma(bars: DataFrame, period: int = 20, value="close") -> DataFrame:
    """Mean of the last period values."""
    return Series(bars).let(v=extract(value)).out(period, sma=mean("v", period))


def fir(bars: DataFrame, name: str, weights, value) -> DataFrame:
    w = np.asarray(weights, dtype=float)
    return Series(bars).let(v=extract(value)).out(len(w), **{name: weighted("v", w / w.sum())})


def linear_weights(n: int) -> np.ndarray:
    return np.arange(1, n + 1, dtype=float)


@average
def wma(bars: DataFrame, period: int = 20, value="close") -> DataFrame:
    """Weights 1..n, the newest n."""
    return fir(bars, "wma", linear_weights(period), value)


@average
def hma(bars: DataFrame, period: int = 10, value="close") -> DataFrame:
    """WMA over isqrt(n) of 2 WMA(n // 2) - WMA(n)."""
    half, root = linear_weights(period // 2), math.isqrt(period)
    full, short = linear_weights(period), linear_weights(root)
    s = Series(bars).let(v=extract(value))
    s.let(raw=2.0 * weighted("v", half / half.sum()) - weighted("v", full / full.sum()))
    return s.out(period + root - 1, hma=weighted("raw", short / short.sum()))


@average
def vwma(bars: DataFrame, period: int = 20) -> DataFrame:
    """Volume-weighted mean of close; null where there is no volume."""
    s = Series(bars).let(c=extract("close"), v=extract("volume")).let(cv=F.col("c") * F.col("v"))
    return s.out(period, vwma=ratio(total("cv", period), total("v", period)))


@average
def trima(bars: DataFrame, period: int = 20, value="close") -> DataFrame:
    """Mean of means: ceil((n + 1) / 2), then what is left to n bars in all."""
    p1 = math.ceil((period + 1) / 2)
    p2 = period - p1 + 1
    return Series(bars).let(v=extract(value)).let(m=F.when(F.col("n") >= p1, mean("v", p1))).out(period, trima=mean("m", p2))


@average
def alma(bars: DataFrame, period: int = 20, sigma: float = 6.0, offset_pct: float = 0.85, value="close") -> DataFrame:
    """Gaussian weights around offset_pct of the window."""
    m, s = offset_pct * (period - 1), period / sigma
    return fir(bars, "alma", np.exp(-((np.arange(period) - m) ** 2) / (2 * s * s)), value)


@average
def lsma(bars: DataFrame, period: int = 25, value="close") -> DataFrame:
    """End of the least-squares line through the last n values."""
    x = np.arange(period) - (period - 1) / 2
    return fir(bars, "lsma", 1 / period + x * x[-1] / (x**2).sum(), value)


@average
def fwma(bars: DataFrame, period: int = 10, value="close") -> DataFrame:
    """Fibonacci weights, the newest largest."""
    w = [1.0, 1.0]
    while len(w) < period:
        w.append(w[-1] + w[-2])
    return fir(bars, "fwma", w[:period], value)


@average
def pwma(bars: DataFrame, period: int = 10, value="close") -> DataFrame:
    """Binomial weights."""
    return fir(bars, "pwma", [math.comb(period - 1, i) for i in range(period)], value)


@average
def swma(bars: DataFrame, period: int = 4, value="close") -> DataFrame:
    """Symmetric triangular weights."""
    return fir(bars, "swma", [min(i + 1, period - i) for i in range(period)], value)


@average
def sinwma(bars: DataFrame, period: int = 14, value="close") -> DataFrame:
    """Half a sine wave as weights."""
    return fir(bars, "sinwma", [math.sin((i + 1) * math.pi / (period + 1)) for i in range(period)], value)


class EmaFold:
    """depth EMAs in a chain; the output is a weighted sum of them."""

    def __init__(self, period: int, weights: tuple[float, ...], k: float | None = None, seed: str = "sma"):
        self.chain = [Ema(period, k, seed) for _ in weights]
        self.weights = weights

    def layers(self):
        return [self.chain]

    def feed(self, v):
        out, x = 0.0, v
        for ema, w in zip(self.chain, self.weights, strict=True):
            x = then(ema, x)
            out = out + w * x
        return (out,)


@average
def ema(bars: DataFrame, period: int = 14, value="close") -> DataFrame:
    """Exponential mean, seeded by the mean of the first n."""
    return fold(bars, {"v": extract(value)}, ("ema",), EmaFold, period, (1.0,))


@average
def rma(bars: DataFrame, period: int = 14, value="close") -> DataFrame:
    """Wilder's mean: (y (n - 1) + v) / n, seeded by the mean of the first n."""
    return fold(bars, {"v": extract(value)}, ("rma",), EmaFold, period, (1.0,), 1 / period)


@average
def dema(bars: DataFrame, period: int = 14, value="close") -> DataFrame:
    """2 EMA - EMA of EMA."""
    return fold(bars, {"v": extract(value)}, ("dema",), EmaFold, period, (2.0, -1.0))


@average
def tema(bars: DataFrame, period: int = 14, value="close") -> DataFrame:
    """3 EMA - 3 EMA of EMA + EMA of EMA of EMA."""
    return fold(bars, {"v": extract(value)}, ("tema",), EmaFold, period, (3.0, -3.0, 1.0))


class ZlemaFold:
    def __init__(self, period: int, lag: int):
        self.lagged, self.ema, self.first = Lagged(lag), Ema(period), None

    def layers(self):
        return [[self.ema]]

    def feed(self, v):
        self.first = v[0] if self.first is None else self.first
        before = self.lagged.feed(v)
        return (self.ema.feed(2 * v - np.where(np.isnan(before), self.first, before)),)


@average
def zlema(bars: DataFrame, period: int = 14, value="close", parity: bool = False) -> DataFrame:
    """EMA of 2 v - v[t - lag], lag (n - 1) // 2; the first value standing in before there is one.

    parity: one bar more of lag.
    """
    return fold(bars, {"v": extract(value)}, ("zlema",), ZlemaFold, period, (period - 1) // 2 + int(parity))


class T3Fold:
    def __init__(self, period: int, factor: float):
        self.chain = [Ema(period, None, "first") for _ in range(6)]
        self.first, self.seen = 6 * period, 0
        f = factor
        self.weights = (1 + 3 * f + 3 * f**2 + f**3, -3 * f - 6 * f**2 - 3 * f**3, 3 * f**2 + 3 * f**3, -(f**3))

    def layers(self):
        return [self.chain]

    def feed(self, v):
        stages, x = [], v
        for ema in self.chain:
            x = ema.feed(x)
            stages.append(x)
        out = sum(w * e for w, e in zip(self.weights, stages[2:], strict=True))
        count = self.seen + np.arange(1, len(v) + 1)
        self.seen += len(v)
        return (np.where(count >= self.first, out, np.nan),)


@average
def t3(bars: DataFrame, period: int = 5, volume_factor: float = 0.7, value="close") -> DataFrame:
    """Tillson's T3: six EMAs that start at the first value."""
    return fold(bars, {"v": extract(value)}, ("t3",), T3Fold, period, volume_factor)


class Adaptive:
    """Base of averages whose gain changes with every value: a plain loop over the batch."""

    def feed(self, v):
        return (np.array([self.step(x) for x in v.tolist()], dtype=float),)


class KamaFold(Adaptive):
    def __init__(self, er_period: int, fast: int, slow: int, parity: bool):
        self.n, self.parity, self.window, self.y = er_period, parity, [], None
        self.low = 2 / (slow + 1)
        self.range = 2 / (fast + 1) - self.low

    def step(self, x):
        w = self.window
        w.append(x)
        if len(w) < self.n + 2:
            if len(w) == self.n + 1:
                self.y = w[0]
            return math.nan
        path = sum(abs(b - a) for a, b in zip(w[1:], w[2:], strict=False))
        move = abs(x - w[0 if self.parity else 1])
        gain = (move / (path or 1e-10) * self.range + self.low) ** 2
        self.y += gain * (x - self.y)
        del w[0]
        return self.y


@average
def kama(bars: DataFrame, er_period: int = 10, fast: int = 2, slow: int = 30, value="close", parity: bool = False) -> DataFrame:
    """Kaufman's adaptive mean, seeded by the first value. parity: direction over one bar more."""
    return fold(bars, {"v": extract(value)}, ("kama",), KamaFold, er_period, fast, slow, parity)


class VidyaFold(Adaptive):
    def __init__(self, cmo_period: int, smooth: int):
        self.n, self.alpha, self.window, self.y = cmo_period, 2 / (smooth + 1), [], None

    def step(self, x):
        w = self.window
        w.append(x)
        if len(w) <= self.n:
            return math.nan
        if self.y is None:
            self.y = x
        else:
            del w[0]
            moves = [b - a for a, b in zip(w, w[1:], strict=False)]
            size = sum(map(abs, moves))
            self.y += self.alpha * (abs(sum(moves) / size) if size else 0.0) * (x - self.y)
        return self.y


@average
def vidya(bars: DataFrame, cmo_period: int = 9, smooth: int = 12, value="close") -> DataFrame:
    """EMA whose gain is scaled by the size of the momentum oscillator."""
    return fold(bars, {"v": extract(value)}, ("vidya",), VidyaFold, cmo_period, smooth)


class McGinleyFold(Adaptive):
    def __init__(self, period: int):
        self.n, self.seed, self.y = period, [], None

    def step(self, x):
        if self.y is None:
            self.seed.append(x)
            if len(self.seed) < self.n:
                return math.nan
            self.y, self.seed = sum(self.seed) / self.n, []
        else:
            pull = self.n * (x / self.y) ** 4 if self.y else 0.0
            self.y = self.y + (x - self.y) / pull if pull else x
        return self.y


@average
def mcginley(bars: DataFrame, period: int = 14, value="close") -> DataFrame:
    """McGinley's dynamic mean; a zero price or mean takes the value itself."""
    return fold(bars, {"v": extract(value)}, ("mcginley",), McGinleyFold, period)


class SsmaFold(Adaptive):
    def __init__(self, period: int):
        a = math.exp(-1.414 * math.pi / period)
        self.c2, self.c3 = 2 * a * math.cos(1.414 * math.pi / period), -a * a
        self.c1, self.count, self.before, self.y1, self.y2 = 1 - self.c2 - self.c3, 0, 0.0, 0.0, 0.0

    def step(self, x):
        self.count += 1
        if self.count == 1:
            self.y1 = self.y2 = x
        else:
            self.y2, self.y1 = self.y1, self.c1 * (x + self.before) / 2 + self.c2 * self.y1 + self.c3 * self.y2
        self.before = x
        return self.y1 if self.count >= 3 else math.nan


@average
def ssma(bars: DataFrame, period: int = 20, value="close") -> DataFrame:
    """Two-pole super smoother."""
    return fold(bars, {"v": extract(value)}, ("ssma",), SsmaFold, period)


class HwmaFold(Adaptive):
    def __init__(self, alpha: float, beta: float):
        self.alpha, self.beta, self.count, self.level, self.trend = alpha, beta, 0, 0.0, 0.0

    def step(self, x):
        self.count += 1
        if self.count == 1:
            self.level = x
            return math.nan
        was = self.level
        self.level = self.alpha * x + (1 - self.alpha) * (was + self.trend)
        self.trend = self.beta * (self.level - was) + (1 - self.beta) * self.trend
        return self.level + self.trend if self.count >= 3 else math.nan


@average
def hwma(bars: DataFrame, alpha: float = 0.2, beta: float = 0.1, value="close") -> DataFrame:
    """Holt's level and trend."""
    return fold(bars, {"v": extract(value)}, ("hwma",), HwmaFold, alpha, beta)


class JmaFold:
    def __init__(self, period: int, phase: float, power: float):
        self.first, self.seen = max(period, 2), 0
        self.b = 0.45 * (period - 1) / (0.45 * (period - 1) + 2)
        self.a, self.ratio = self.b**power, max(0.5, min(2.5, phase / 100 + 1.5))
        self.e0, self.e1 = Linear(self.a), Linear(self.b)

    def feed(self, v):
        if not self.seen:
            self.e0.y = self.e1.y = v[0]
        start = int(not self.seen)
        x = v[start:]
        e0 = self.e0.feed((1 - self.a) * x)
        e1 = self.e1.feed((1 - self.b) * (x - e0))
        out = np.concatenate([np.full(start, np.nan), e0 + self.ratio * e1])
        count = self.seen + np.arange(1, len(v) + 1)
        self.seen += len(v)
        return (np.where(count >= self.first, out, np.nan),)


@average
def jma(bars: DataFrame, period: int = 7, phase: float = 0, power: float = 2, value="close") -> DataFrame:
    """Jurik-style two-stage smoothing; both stages start at the first value."""
    return fold(bars, {"v": extract(value)}, ("jma",), JmaFold, period, phase, power)
