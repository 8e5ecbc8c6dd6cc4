"""As-of join: each row with the last row of another table at or before its time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Seconds of a span, or units of a time that is a number: 32 days.
SPAN = 32 * 86400


def as_of(left: DataFrame, right: DataFrame, by: tuple[str, ...] = ("symbol",), time: str = "time", columns: tuple[str, ...] | None = None, strict: bool = False, span: float = SPAN) -> DataFrame:
    """left with the columns of right's last row of the same ``by`` with time <= left's (strict: <).

    Both tables go through one window instead of a range join: one shuffle by ``by`` and span of time, one sort,
    no pairs, so that one long series is the work of many tasks. What a span begins with comes from the last
    rows of the spans before it: one row for each, aggregated before they are shuffled. Rows of left without such a
    row, and those without a time, get nulls; right's rows without a time count for none, and of those at one time
    the largest by its columns counts.
    """
    wanted = list(columns or [c for c in right.columns if c not in (*by, time)])
    if clash := set(wanted) & set(left.columns):
        raise ValueError(f"columns of both tables: {', '.join(sorted(clash))}")
    found = F.struct(*[F.col(c) for c in wanted])
    kind = left.select(time).schema[0].dataType
    seconds = F.col(time).cast("timestamp") if isinstance(kind, T.DateType) else F.col(time)
    own = [F.lit(None).cast(left.schema[c].dataType).alias(f"__l_{c}") for c in left.columns]
    right_rows = right.select(*by, F.col(time).cast(kind).alias(time), F.lit(1 if strict else 0).alias("__side"), found.alias("__found"), *own).filter(F.col(time).isNotNull())
    left_rows = left.select(*by, time, F.lit(0 if strict else 1).alias("__side"), F.lit(None).cast(right_rows.schema["__found"].dataType).alias("__found"), *[F.col(c).alias(f"__l_{c}") for c in left.columns])
    both = left_rows.withColumn("__left", F.lit(True)).unionByName(right_rows.withColumn("__left", F.lit(False)))
    both = both.withColumn("__span", F.floor(seconds.cast("double") / span))
    last = both.groupBy(*by, "__span").agg(F.max(F.when(~F.col("__left"), F.struct(time, "__found"))).alias("__last"))
    before = Window.partitionBy(*by).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    begin = last.select(*by, F.lit(None).cast(kind).alias(time), F.lit(-1).alias("__side"), F.last("__last", ignorenulls=True).over(before)["__found"].alias("__found"), *own, F.lit(False).alias("__left"), "__span")
    w = Window.partitionBy(*by, "__span").orderBy(F.asc_nulls_first(time), "__side", F.asc_nulls_first("__found")).rowsBetween(Window.unboundedPreceding, 0)
    at = both.unionByName(begin.filter("__found is not null")).withColumn("__at", F.last("__found", ignorenulls=True).over(w)).filter("__left")
    return at.select(*[F.col(f"__l_{c}").alias(c) for c in left.columns], *[F.col("__at")[c].alias(c) for c in wanted])
