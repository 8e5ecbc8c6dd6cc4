"""Statistics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.extract import extract
from barloom.functions.series import Series, deviation, last, mean, weighted
from barloom.plans.fold import fold
from barloom.plans.sliding import NotAbove
from barloom.registry import operator

statistics = operator("statistics")


@statistics
def zscore(bars: DataFrame, period: int = 20, value="close") -> DataFrame:
    """Distance from the mean in standard deviations; 0 where there is none."""
    s = Series(bars).let(v=extract(value)).let(m=mean("v", period), d=deviation("v", period))
    return s.out(period, zscore=F.when(F.col("d") > 0, (F.col("v") - F.col("m")) / F.col("d")).otherwise(0.0))


@statistics
def variance(bars: DataFrame, period: int = 20, value="close") -> DataFrame:
    """Population variance."""
    return Series(bars).let(v=extract(value)).out(period, variance=F.var_pop("v").over(last(period)))


@statistics
def linreg_slope(bars: DataFrame, period: int = 14, value="close") -> DataFrame:
    """Slope of the least-squares line through the last n values."""
    x = np.arange(period) - (period - 1) / 2
    return Series(bars).let(v=extract(value)).out(period, linreg_slope=weighted("v", x / (x**2).sum()))


@statistics
def correl(bars: DataFrame, period: int = 20, value="close") -> DataFrame:
    """Correlation of value and time over n bars; 0 for a flat window."""
    x = np.arange(period) - (period - 1) / 2
    s = Series(bars).let(v=extract(value)).let(d=deviation("v", period), cov=weighted("v", x / period))
    return s.out(period, correl=F.when(F.col("d") > 0, F.col("cov") / (F.col("d") * float(x.std()))).otherwise(0.0))


@statistics
def percentrank(bars: DataFrame, period: int = 20, value="close") -> DataFrame:
    """Per cent of the window, the value itself included, that is not above the value."""
    return fold(bars, {"v": extract(value)}, ("percentrank",), NotAbove, period)
