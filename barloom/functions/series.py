"""Columns over one series: lags, rolling and cumulative aggregates over (symbol, tf) in time order.

All columns share one window specification, so Catalyst plans one shuffle and one sort per operator, and
none where the bars are partitioned and sorted by series already.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

KEYS = ("symbol", "tf")


class Reach:
    """How many earlier bars an output depends on: the widest window of each step, summed over the steps.

    Infinite where a step looks at all bars before: by a sum over them (sums), or in another way (beyond).
    """

    def __init__(self):
        self._bars, self._step = 0, 0
        self.sums = self.beyond = False

    @property
    def bars(self) -> float:
        return self._bars

    @property
    def total(self) -> float:
        return math.inf if self.sums or self.beyond else self._bars

    def note(self, bars: float) -> None:
        if bars == math.inf:
            self.beyond = True
        else:
            self._step = max(self._step, bars)

    def next_step(self) -> None:
        self._bars, self._step = self._bars + self._step, 0


_probe: Reach | None = None


@contextmanager
def probing() -> Iterator[Reach]:
    """Within it, windows over series tell how far back they look."""
    global _probe
    before, _probe = _probe, Reach()
    try:
        yield _probe
        _probe.next_step()
    finally:
        _probe = before


def looks_back(bars: float) -> None:
    if _probe is not None:
        _probe.note(bars)


def reach(operator: Callable[[DataFrame], DataFrame], bars: DataFrame) -> float:
    """The reach of an operator's window steps over bars of this schema; nothing runs."""
    with probing() as found:
        operator(bars.limit(0))
    return found.total


def _series() -> WindowSpec:
    return Window.partitionBy(*KEYS).orderBy("time")


def series() -> WindowSpec:
    looks_back(math.inf)
    return _series()


def last(n: int, skip: int = 0) -> WindowSpec:
    """The last n bars, the newest ``skip`` left out."""
    looks_back(n + skip - 1)
    return _series().rowsBetween(-(n + skip - 1), -skip)


def lag(x: str, n: int = 1) -> Column:
    looks_back(n)
    return F.lag(x, n).over(_series())


def one_per_time(bars: DataFrame) -> DataFrame:
    """Of bars of one series and time the one that the store keeps: of the largest version, else the largest bar.

    A bar whose price is missing (NaN, as padded columns have) is no bar: windows and folds both go on over it.
    The window is sorted by series and time first, so that windows after it need no further shuffle or sort.
    """
    kinds = dict(bars.dtypes)
    missing = [F.isnan(c) for c in ("open", "high", "low", "close") if kinds.get(c) in ("double", "float")]
    if missing:
        bars = bars.filter(~F.coalesce(functools.reduce(lambda x, y: x | y, missing), F.lit(False)))
    order = [F.desc_nulls_last(c) for c in ("version", "open", "high", "low", "close", "volume") if c in bars.columns]
    w = Window.partitionBy(*KEYS).orderBy("time", *order)
    return bars.withColumn("__before", F.lag("time").over(w)).filter(~F.col("time").eqNullSafe(F.col("__before")) | F.col("__before").isNull()).drop("__before")


def mean(x: str, n: int) -> Column:
    return F.avg(x).over(last(n))


def total(x: str | Column, n: int) -> Column:
    return F.sum(x).over(last(n))


def highest(x: str, n: int) -> Column:
    return F.max(x).over(last(n))


def lowest(x: str, n: int) -> Column:
    return F.min(x).over(last(n))


def deviation(x: str, n: int) -> Column:
    return F.stddev_pop(x).over(last(n))


def running(x: str | Column) -> Column:
    if _probe is not None:
        _probe.sums = True
    return F.sum(x).over(_series().rowsBetween(Window.unboundedPreceding, 0))


def weighted(x: str, weights: Sequence[float]) -> Column:
    """Sum of weights times the last values, oldest first; null before there are enough."""
    n = len(weights)
    out = F.col(x) * float(weights[-1])
    for k in range(1, n):
        out = out + lag(x, k) * float(weights[n - 1 - k])
    return out


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.when(b != 0, a / b)


def quotient(a: Column, b: Column) -> Column:
    """a / b as doubles divide: infinite or NaN where b is 0."""
    return F.when(b != 0, a / b).otherwise(a * F.pow(b, F.lit(-1.0)))


class Series:
    """Steps over a DataFrame of bars; each step may use the columns of those before."""

    def __init__(self, bars: DataFrame):
        self.df = bars.withColumn("n", F.row_number().over(_series()))

    def let(self, **columns: Column) -> "Series":
        self.df = self.df.withColumns(columns)
        if _probe is not None:
            _probe.next_step()
        return self

    def out(self, first: int, keep_nan: bool = False, **columns: Column) -> DataFrame:
        """symbol, tf, time and the outputs, from bar ``first`` on, where no output is null, nor NaN unless those are kept."""
        kept = self.df.select(*KEYS, "time", "n", *[c.alias(k) for k, c in columns.items()]).filter(F.col("n") >= first).drop("n")
        return kept.filter(" and ".join(f"{c} is not null" for c in columns)) if keep_nan else kept.na.drop(subset=list(columns))
