"""Volume."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.extract import extract
from barloom.functions.series import Series, lag, mean, ratio, running, total
from barloom.operators.oscillators import PairFold
from barloom.plans.fold import fold
from barloom.registry import operator

volume = operator("volume")


def _flow(bars: DataFrame) -> Series:
    """mfv: volume by the place of close in the bar's range; 0 for a bar without range."""
    s = Series(bars).let(h=extract("high"), l=extract("low"), c=extract("close"), v=extract("volume"))
    return s.let(mfv=F.when(F.col("h") != F.col("l"), ((F.col("c") - F.col("l")) - (F.col("h") - F.col("c"))) / (F.col("h") - F.col("l")) * F.col("v")).otherwise(0.0))


@volume
def ad(bars: DataFrame) -> DataFrame:
    """Accumulation and distribution."""
    return _flow(bars).out(1, ad=running("mfv"))


@volume
def adosc(bars: DataFrame, fast: int = 3, slow: int = 10) -> DataFrame:
    """Difference of two EMAs of AD."""
    s = _flow(bars).let(ad=running("mfv"))
    return fold(s.df, {"v": F.col("ad")}, ("adosc",), PairFold, fast, slow, slow, False)


@volume
def cmf(bars: DataFrame, period: int = 20) -> DataFrame:
    """Money flow volume over volume."""
    return _flow(bars).out(period, cmf=ratio(total("mfv", period), total("v", period)))


@volume
def eom(bars: DataFrame, period: int = 14, divisor: float = 10000.0) -> DataFrame:
    """Mean of the move of the middle by the volume it took; 0 for a bar without range or volume."""
    s = Series(bars).let(h=extract("high"), l=extract("low"), v=extract("volume")).let(m=(F.col("h") + F.col("l")) / 2.0)
    s.let(move=F.col("m") - lag("m"), box=F.when(F.col("h") != F.col("l"), F.col("v") / divisor / (F.col("h") - F.col("l"))).otherwise(0.0))
    s.let(x=F.when(F.col("n") > 1, F.when(F.col("box") != 0, F.col("move") / F.col("box")).otherwise(0.0)))
    return s.out(period + 1, eom=mean("x", period))


class IndexFold:
    """A product of price ratios from 1000, over the bars whose volume moves the given way."""

    def __init__(self, way: int):
        self.way, self.level, self.c, self.v = way, 1000.0, None, None

    def feed(self, c, v):
        pc, pv = np.concatenate([[c[0] if self.c is None else self.c], c[:-1]]), np.concatenate([[v[0] if self.v is None else self.v], v[:-1]])
        moved = (np.sign(v - pv) == self.way) & (pc != 0)
        # one step after the other, so that a long product rounds and underflows where the SQL's does
        levels = [self.level]
        for a, b in zip(c[moved].tolist(), pc[moved].tolist(), strict=True):
            levels.append(levels[-1] * a / b)
        self.level, self.c, self.v = levels[-1], c[-1], v[-1]
        return (np.array(levels)[np.cumsum(moved)],)


@volume
def nvi(bars: DataFrame) -> DataFrame:
    """Negative volume index: follows close when volume falls."""
    return fold(bars, {"c": extract("close"), "v": extract("volume")}, ("nvi",), IndexFold, -1)


@volume
def pvi(bars: DataFrame) -> DataFrame:
    """Positive volume index: follows close when volume rises."""
    return fold(bars, {"c": extract("close"), "v": extract("volume")}, ("pvi",), IndexFold, 1)


@volume
def pvt(bars: DataFrame) -> DataFrame:
    """Running volume times relative change of close."""
    s = Series(bars).let(c=extract("close"), v=extract("volume")).let(pc=lag("c"))
    return s.let(x=F.when(F.col("pc") != 0, F.col("v") * (F.col("c") - F.col("pc")) / F.col("pc")).otherwise(0.0)).out(2, pvt=running("x"))


@volume
def vo(bars: DataFrame, fast: int = 5, slow: int = 10) -> DataFrame:
    """Difference of two EMAs of volume in per cent of the slow one."""
    return fold(bars, {"v": extract("volume")}, ("vo",), PairFold, fast, slow, slow, True)


@volume
def vroc(bars: DataFrame, period: int = 14) -> DataFrame:
    """Per cent change of volume over n bars; none where it was 0."""
    s = Series(bars).let(v=extract("volume")).let(p=lag("v", period))
    return s.out(period + 1, vroc=ratio((F.col("v") - F.col("p")) * 100.0, F.col("p")))
