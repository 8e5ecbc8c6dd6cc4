"""Several indicators of one series in one pass: a single shuffle, and one Python hop for all folds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.extract import extract
from barloom.functions.series import Series, mean
from barloom.operators.averages import EmaFold
from barloom.operators.momentum import MacdFold, RsiFold
from barloom.plans.fold import fold


class Together:
    """Feeds the same value to several folds; an output is NaN until its fold is ready."""

    def __init__(self, makers):
        self.folds = [make(*params) for make, *params in makers]

    def feed(self, v, *passed):
        return (*passed, *(np.asarray(o, dtype=float) for f in self.folds for o in f.feed(v)))


def overview(bars: DataFrame, sma: int = 20, ema: int = 20, rsi: int = 14, macd: tuple[int, int, int] = (12, 26, 9), value="close") -> DataFrame:
    """SMA, EMA, RSI and MACD of every bar that has all of them."""
    s = Series(bars).let(v=extract(value)).let(sma=F.when(F.col("n") >= sma, mean("v", sma)))
    makers = ((EmaFold, ema, (1.0,)), (RsiFold, rsi, None), (MacdFold, *macd))
    return fold(s.df, {"v": F.col("v"), "sma": F.col("sma")}, ("sma", "ema", "rsi", "macd", "signal", "histogram"), Together, makers)
