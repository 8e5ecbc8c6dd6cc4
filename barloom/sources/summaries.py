"""Mergeable summaries of the rows of a store, one row for each key and span of a series.

A row with a null key tells of all rows of the span and holds the last one's bar; a row with a key tells of the
rows with that key. ``run`` is how many of the span's last rows have the key one after the other, so that the question
whether the last n rows all have it needs no row. Stores keep them beside the bars, and write those of a span when
they write the span.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BAR = ("open", "high", "low", "close", "volume")
SPAN_KEY = ("exchange", "symbol", "tf", "span")
SCHEMA = (
    "key string, n_rows long, run long, n long, least double, largest double, total double, last_value double, last_value_time long, last_time long, "
    "open double, high double, low double, close double, volume double, exchange string, symbol string, tf string, span int"
)


def summarise(rows: DataFrame) -> DataFrame:
    """The summaries of rows (SPAN_KEY, time, bar, indicators); windows are within spans."""
    of_span = Window.partitionBy(*SPAN_KEY).orderBy(F.desc("time"))
    placed = rows.withColumn("place", F.row_number().over(of_span))
    bar = F.struct(*BAR)
    whole = placed.groupBy(*SPAN_KEY).agg(F.count(F.lit(1)).alias("n_rows"), F.max("time").alias("last_time"), F.max_by(bar, "time").alias("bar"))
    whole = whole.select(F.lit(None).cast("string").alias("key"), "n_rows", F.col("n_rows").alias("run"), "last_time", "bar.*", *SPAN_KEY)
    keyed = placed.select(*SPAN_KEY, "time", "place", F.explode("indicators").alias("key", "fields"))
    value = F.col("fields")["value"]
    there = F.when(value.isNotNull(), F.col("time"))
    in_key = keyed.withColumn("rank", F.row_number().over(Window.partitionBy(*SPAN_KEY, "key").orderBy("place")))
    keys = in_key.groupBy("key", *SPAN_KEY).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("rank") == F.col("place")).alias("run"), F.count(value).alias("n"), F.min(value).alias("least"), F.max(value).alias("largest"),
        F.sum(value).alias("total"), F.max_by(value, there).alias("last_value"), F.max(there).alias("last_value_time"), F.max("time").alias("last_time"),
    )
    return whole.unionByName(keys, allowMissingColumns=True).select(*[c.split()[0] for c in SCHEMA.split(", ")])


def stats(summaries: DataFrame, key: str, by: tuple[str, ...] = ()) -> DataFrame:
    """As ``store.indicator_stats``, from summaries; by: one row for each of these."""
    mine = summaries.filter(F.col("key") == key)
    latest: Column = F.max_by("last_value", "last_value_time")
    return mine.groupBy(*by).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.min("least").alias("least"), F.max("largest").alias("largest"), (F.sum("total") / F.sum("n")).alias("mean"), latest.alias("last_value"), F.max("last_value_time").alias("last_time"))


def keys(summaries: DataFrame) -> DataFrame:
    return summaries.filter("key is not null").select("key").distinct().orderBy("key")


def latest(summaries: DataFrame) -> DataFrame:
    """time and bar of the last row."""
    return summaries.filter("key is null").orderBy(F.desc("last_time")).limit(1).select(F.col("last_time").alias("time"), *BAR)


def complete(summaries: DataFrame, key: str, last_n: int) -> tuple[bool, int]:
    """(whether the last n rows all have the key, how many of them there are), span by span from the newest; one series."""
    whole = F.max(F.when(F.col("key").isNull(), F.col("n_rows")))
    runs = F.coalesce(F.max(F.when(F.col("key") == key, F.col("run"))), F.lit(0))
    of = summaries.filter(F.col("key").isNull() | (F.col("key") == key)).groupBy("span").agg(whole.alias("n_rows"), runs.alias("run"))
    newer = Window.orderBy(F.desc("span")).rowsBetween(Window.unboundedPreceding, -1)  # one row a span
    asked = of.withColumn("before", F.coalesce(F.sum("n_rows").over(newer), F.lit(0))).filter(F.col("before") < last_n)
    wanted = F.least(F.col("n_rows"), last_n - F.col("before"))
    row = asked.agg(F.coalesce(F.every(F.col("run") >= wanted), F.lit(False)).alias("complete"), F.coalesce(F.sum(wanted), F.lit(0)).alias("n_rows")).first()
    return bool(row["complete"]), int(row["n_rows"])
