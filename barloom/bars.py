"""Bars: schema, ingest layouts, validity, duplicates, and bars derived from event and order tables.

A bar has symbol, tf, time (a timestamp or unix seconds), open, high, low, close, volume, side, timeframe.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.extract import side, valid_bar

BAR_SCHEMA = "symbol string, tf string, time timestamp, open double, high double, low double, close double, volume double, side int, timeframe int"
EPOCH = 1_704_067_200  # 2024-01-01 00:00 UTC, a Monday


def with_identity(df: DataFrame, symbol: str | None = None, tf: str = "1m", timeframe: int = 1) -> DataFrame:
    out = df.withColumn("symbol", F.lit(symbol)) if symbol is not None else df
    return out.withColumns({"tf": F.lit(tf), "timeframe": F.lit(timeframe), "side": side()})


def from_matrix(spark: SparkSession, rows: list[list], symbol: str, tf: str = "1m") -> DataFrame:
    """Rows [open, high, low, close, volume?, time?]; a missing time is the row's number in minutes."""
    full = [[*map(float, r[:4]), float(r[4]) if len(r) > 4 and r[4] is not None else 0.0, int(r[5]) if len(r) > 5 else EPOCH + 60 * i] for i, r in enumerate(rows)]
    return with_identity(spark.createDataFrame(full, "open double, high double, low double, close double, volume double, time long"), symbol, tf)


def from_columns(spark: SparkSession, columns: dict[str, list], symbol: str, tf: str = "1m") -> DataFrame:
    """Lists by field name; shorter lists are padded with null, volume with 0."""
    n = max(map(len, columns.values()), default=0)
    names = ("open", "high", "low", "close", "volume", "time")
    padded = {k: [*columns.get(k, []), *[None] * (n - len(columns.get(k, [])))] for k in names}
    return from_matrix(spark, [[padded[k][i] if padded[k][i] is not None else float("nan") for k in names[:4]] + [padded["volume"][i] or 0.0] + ([padded["time"][i]] if padded["time"][i] is not None else []) for i in range(n)], symbol, tf)


def decode_wire(df: DataFrame, column: str = "value", symbol: str = "symbol", tf: str = "1m") -> DataFrame:
    """Bars from JSON text {time, open, high, low, close, volume?}; malformed and invalid ones are left out."""
    wire = T.StructType([T.StructField("time", T.LongType()), *[T.StructField(x, T.DoubleType()) for x in ("open", "high", "low", "close", "volume")]])
    got = df.select(F.col(symbol).alias("symbol"), F.from_json(column, wire).alias("b")).select("symbol", "b.*")
    return with_identity(got.withColumn("volume", F.coalesce("volume", F.lit(0.0))).filter(valid_bar() & F.col("time").isNotNull()), None, tf)


def latest(df: DataFrame, keys: tuple[str, ...] = ("symbol", "tf", "time"), version: str = "version") -> DataFrame:
    """One row per key, the one with the largest version."""
    w = Window.partitionBy(*keys).orderBy(F.desc(version))
    return df.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def skip_before(bars: DataFrame, start) -> DataFrame:
    """Bars from start on; an ISO date, "YYYY-MM-DD HH:MM:SS" (UTC) or unix seconds."""
    numeric = dict(bars.dtypes)["time"] in ("bigint", "int")
    at = F.lit(start) if isinstance(start, (int, float)) else F.unix_timestamp(F.lit(start).cast("timestamp"))
    return bars.filter(F.col("time") >= at if numeric else F.col("time") >= F.timestamp_seconds(at))


def skip_first(bars: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("symbol", "tf").orderBy("time")
    return bars.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") > k).drop("__r")


def minute_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bar a minute from 2024-01-01 for each event of a type, in order of time."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    w = Window.partitionBy("event_type").orderBy("ts", "event_id")
    k = F.get_json_object("props", "$.k").cast("double") / 1000.0
    e = events.select(F.col("event_type").alias("symbol"), F.row_number().over(w).alias("n"), F.coalesce(F.lag("value").over(w), F.col("value")).alias("open"), F.col("value").alias("close"), k.alias("k"), (F.col("user_id") + 1).cast("double").alias("volume"))
    return with_identity(e.select("symbol", (F.lit(EPOCH) + 60 * (F.col("n") - 1)).cast("long").alias("time"), "open", (F.greatest("open", "close") * (1 + F.col("k"))).alias("high"), (F.least("open", "close") * (1 - F.col("k"))).alias("low"), "close", "volume"))


def _grouped(rows: DataFrame, tf: str, timeframe: int) -> DataFrame:
    """Bars of (symbol, time, at, price): at orders the prices of a bar."""
    return with_identity(
        rows.groupBy("symbol", "time").agg(F.min_by("price", "at").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "at").alias("close"), F.count(F.lit(1)).cast("double").alias("volume")),
        None, tf, timeframe,
    )


def hourly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of an hour of the events of a type, with gaps."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    seconds = F.unix_timestamp(F.date_trunc("hour", F.col("ts").cast("timestamp")))
    return _grouped(e.select(F.col("event_type").alias("symbol"), seconds.alias("time"), F.struct("ts", "event_id").alias("at"), F.col("value").alias("price")), "1h", 60)


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of a day of the orders of a priority."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    seconds = F.unix_timestamp(F.date_trunc("day", F.col("o_orderdate").cast("timestamp")))
    return _grouped(o.select(F.col("o_orderpriority").alias("symbol"), seconds.alias("time"), F.col("o_orderkey").alias("at"), F.col("o_totalprice").alias("price")), "1D", 1440)
