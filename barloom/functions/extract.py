"""Price extractors: a name, a column name or a Column becomes the input of an operator. Null is 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELDS = ("open", "high", "low", "close", "volume")


def field(name: str) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0))


def extract(value: str | Column = "close") -> Column:
    """open, high, low, close, volume, hl2, hlc3, hlcc4 (close twice), another column, or any Column."""
    if isinstance(value, Column):
        return F.coalesce(value.cast("double"), F.lit(0.0))
    h, l, c = (field(x) for x in ("high", "low", "close"))
    mixed = {"hl2": (h + l) * 0.5, "hlc3": (h + l + c) / 3.0, "hlcc4": (h + l + c + c) * 0.25}
    return mixed.get(value) if value in mixed else field(value)


def side() -> Column:
    """0 for a bearish bar (open above close), else 1."""
    return F.when(F.col("open") > F.col("close"), 0).otherwise(1)


def valid_bar() -> Column:
    """Finite prices, no negative volume, high and low around the body."""
    finite = [F.col(x).isNotNull() & ~F.isnan(x) & (F.abs(F.col(x)) != float("inf")) for x in ("open", "high", "low", "close")]
    ok = finite[0]
    for x in finite[1:]:
        ok = ok & x
    body = (F.col("high") >= F.greatest("open", "close")) & (F.col("low") <= F.least("open", "close"))
    return ok & body & (F.coalesce(F.col("volume"), F.lit(0.0)) >= 0)
