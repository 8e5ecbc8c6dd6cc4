"""Candle patterns: +1, -1 or 0 for every bar once there are enough bars before it.

A bar k back is named by its fields: ``o``, ``h``, ``l``, ``c`` and the parts body, rng, up, lo; bull means
close at or above open. Bars without range give 0 in the shapes that divide by it.
"""

from __future__ import annotations

import functools
import inspect
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.extract import extract
from barloom.functions.series import Series, lag
from barloom.registry import operator


@dataclass(frozen=True)
class Bar:
    o: Column
    h: Column
    l: Column
    c: Column

    @property
    def body(self) -> Column:
        return F.abs(self.c - self.o)

    @property
    def rng(self) -> Column:
        return self.h - self.l

    @property
    def up(self) -> Column:
        return self.h - F.greatest(self.o, self.c)

    @property
    def lo(self) -> Column:
        return F.least(self.o, self.c) - self.l

    @property
    def mid(self) -> Column:
        return (self.o + self.c) / 2.0

    @property
    def bull(self) -> Column:
        return self.c >= self.o

    @property
    def bear(self) -> Column:
        return self.c < self.o

    @property
    def share(self) -> Column:
        """Body over range; null without range, which no rule matches."""
        return F.when(self.rng > 0, self.body / self.rng)

    @property
    def colour(self) -> Column:
        return F.when(self.bull, 1).otherwise(-1)


def pattern(bars_needed: int):
    """Register rule(*bars, **params) -> Column of the signal, or null or 0 for none; bars oldest first."""

    def register(rule: Callable[..., Column]) -> Callable[..., DataFrame]:
        params = list(inspect.signature(rule).parameters.values())[bars_needed:]

        @functools.wraps(rule)
        def run(bars: DataFrame, **given) -> DataFrame:
            s = Series(bars).let(o=extract("open"), h=extract("high"), l=extract("low"), c=extract("close"))
            s.let(**{f"{x}{k}": lag(x, k) for k in range(1, bars_needed) for x in "ohlc"})
            shown = [Bar(*(F.col(f"{x}{k}" if k else x) for x in "ohlc")) for k in range(bars_needed - 1, -1, -1)]
            return s.out(bars_needed, signal=F.coalesce(rule(*shown, **given), F.lit(0)).cast("int"))

        run.__signature__ = inspect.Signature([inspect.Parameter("bars", inspect.Parameter.POSITIONAL_OR_KEYWORD), *params])
        return operator("pattern", rule.__name__)(run)

    return register


def plus(rule: Column) -> Column:
    return F.when(rule, 1)


def minus(rule: Column) -> Column:
    return F.when(rule, -1)


@pattern(1)
def doji(b: Bar, threshold: float = 0.1) -> Column:
    return plus(b.share <= threshold)


@pattern(1)
def dragonfly_doji(b: Bar) -> Column:
    return plus((b.share <= 0.1) & (b.lo >= 0.6 * b.rng) & (b.up <= 0.1 * b.rng))


@pattern(1)
def gravestone_doji(b: Bar) -> Column:
    return minus((b.share <= 0.1) & (b.up >= 0.6 * b.rng) & (b.lo <= 0.1 * b.rng))


def hammer_shape(b: Bar) -> Column:
    return (b.lo >= 2.0 * b.body) & (b.up <= 0.5 * b.body) & (b.share >= 0.1)


def inverted_shape(b: Bar) -> Column:
    return (b.up >= 2.0 * b.body) & (b.lo <= 0.5 * b.body) & (b.share >= 0.1)


@pattern(1)
def hammer(b: Bar) -> Column:
    return plus(hammer_shape(b))


@pattern(1)
def inverted_hammer(b: Bar) -> Column:
    return plus(inverted_shape(b))


@pattern(1)
def hanging_man(b: Bar) -> Column:
    return minus(hammer_shape(b))


@pattern(1)
def shooting_star(b: Bar) -> Column:
    return minus(inverted_shape(b))


@pattern(1)
def marubozu(b: Bar) -> Column:
    return F.when(b.share >= 0.95, b.colour)


@pattern(1)
def spinning_top(b: Bar) -> Column:
    return F.when((b.share <= 0.3) & (b.up >= 0.2 * b.rng) & (b.lo >= 0.2 * b.rng), b.colour)


def long_legs(b: Bar) -> Column:
    return (b.share <= 0.05) & (b.up >= 0.35 * b.rng) & (b.lo >= 0.35 * b.rng)


@pattern(1)
def long_legged_doji(b: Bar) -> Column:
    return plus(long_legs(b))


@pattern(1)
def bullish_belt(b: Bar) -> Column:
    return plus(b.bull & (b.lo <= 0.05 * b.body) & (b.share >= 0.7))


@pattern(1)
def bearish_belt(b: Bar) -> Column:
    return minus(b.bear & (b.up <= 0.05 * b.body) & (b.share >= 0.7))


@pattern(1)
def high_wave(b: Bar) -> Column:
    return F.when((b.share <= 0.15) & (b.up >= 0.4 * b.rng) & (b.lo >= 0.4 * b.rng), b.colour)


@pattern(1)
def rickshaw_man(b: Bar) -> Column:
    return plus(long_legs(b) & (F.abs(b.mid - (b.h + b.l) / 2.0) <= 0.1 * b.rng))


@pattern(1)
def umbrella_line(b: Bar) -> Column:
    return F.when((b.rng > 0) & (b.body != 0) & (b.lo >= 2.0 * b.body) & (b.up <= b.body), b.colour)


@pattern(2)
def bullish_engulfing(p: Bar, c: Bar) -> Column:
    return plus(p.bear & c.bull & (c.o <= p.c) & (c.c >= p.o))


@pattern(2)
def bearish_engulfing(p: Bar, c: Bar) -> Column:
    return minus(p.bull & c.bear & (c.o >= p.c) & (c.c <= p.o))


@pattern(2)
def bullish_harami(p: Bar, c: Bar) -> Column:
    return plus(p.bear & c.bull & (c.o > p.c) & (c.c < p.o))


@pattern(2)
def bearish_harami(p: Bar, c: Bar) -> Column:
    return minus(p.bull & c.bear & (c.o < p.c) & (c.c > p.o))


@pattern(2)
def piercing(p: Bar, c: Bar) -> Column:
    return plus(p.bear & c.bull & (c.o < p.c) & (p.mid < c.c) & (c.c < p.o))


@pattern(2)
def dark_cloud_cover(p: Bar, c: Bar) -> Column:
    return minus(p.bull & c.bear & (c.o > p.c) & (p.o < c.c) & (c.c < p.mid))


@pattern(2)
def tweezer(p: Bar, c: Bar, tolerance: float = 0.001) -> Column:
    tol = tolerance * p.rng
    return F.when((F.abs(p.h - c.h) <= tol) & p.bull & c.bear, -1).when((F.abs(p.l - c.l) <= tol) & p.bear & c.bull, 1)


@pattern(2)
def kicking(p: Bar, c: Bar) -> Column:
    full = (p.share >= 0.9) & (c.share >= 0.9)
    return F.when(full & p.bear & c.bull & (c.o > p.o), 1).when(full & p.bull & c.bear & (c.o < p.o), -1)


@pattern(2)
def on_neck(p: Bar, c: Bar, tolerance: float = 0.002) -> Column:
    return minus(p.bear & c.bull & (F.abs(c.c - p.l) <= tolerance * p.rng))


@pattern(2)
def matching_low(p: Bar, c: Bar, tolerance: float = 0.001) -> Column:
    return plus(p.bear & c.bear & (F.abs(p.c - c.c) <= tolerance * p.rng))


@pattern(3)
def morning_star(a: Bar, b: Bar, c: Bar) -> Column:
    return plus(a.bear & (b.body < 0.5 * a.body) & c.bull & (b.c < a.c) & (c.c > a.mid))


@pattern(3)
def evening_star(a: Bar, b: Bar, c: Bar) -> Column:
    return minus(a.bull & (b.body < 0.5 * a.body) & c.bear & (b.c > a.c) & (c.c < a.mid))


@pattern(3)
def morning_doji_star(a: Bar, b: Bar, c: Bar) -> Column:
    return plus(a.bear & (b.share <= 0.1) & c.bull & (c.c > a.mid))


@pattern(3)
def evening_doji_star(a: Bar, b: Bar, c: Bar) -> Column:
    return minus(a.bull & (b.share <= 0.1) & c.bear & (c.c < a.mid))


@pattern(3)
def three_white_soldiers(a: Bar, b: Bar, c: Bar) -> Column:
    return plus(a.bull & b.bull & c.bull & (b.c > a.c) & (c.c > b.c) & (b.o > a.o) & (c.o > b.o))


@pattern(3)
def three_black_crows(a: Bar, b: Bar, c: Bar) -> Column:
    return minus(a.bear & b.bear & c.bear & (b.c < a.c) & (c.c < b.c) & (b.o < a.o) & (c.o < b.o))


@pattern(3)
def three_inside_up(a: Bar, b: Bar, c: Bar) -> Column:
    return plus(a.bear & b.bull & (b.o > a.c) & (b.c < a.o) & c.bull & (c.c > b.c))


@pattern(3)
def three_inside_down(a: Bar, b: Bar, c: Bar) -> Column:
    return minus(a.bull & b.bear & (b.o < a.c) & (b.c > a.o) & c.bear & (c.c < b.c))


@pattern(3)
def deliberation(a: Bar, b: Bar, c: Bar) -> Column:
    return minus(a.bull & b.bull & c.bull & (b.c > a.c) & (c.c > b.c) & (c.body < 0.5 * b.body))


@pattern(3)
def identical_three_crows(a: Bar, b: Bar, c: Bar, tolerance: float = 0.002) -> Column:
    tol = tolerance * F.when(a.rng > 0, a.rng).otherwise(1.0)
    return minus(a.bear & b.bear & c.bear & (b.c < a.c) & (c.c < b.c) & (F.abs(b.o - a.c) <= tol) & (F.abs(c.o - b.c) <= tol))
