"""Batch and streaming readers of bars."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from barloom.bars import BAR_SCHEMA, with_identity


def jdbc_options(config: str | dict, fetch_size: int = 10_000) -> dict[str, str]:
    """Reader options of a DSN (postgresql://user:password@host:port/db) or of a mapping of its parts."""
    if isinstance(config, str):
        from urllib.parse import unquote, urlsplit

        u = urlsplit(config)
        config = {"host": u.hostname, "port": u.port or 5432, "dbname": u.path.lstrip("/"), "user": unquote(u.username or ""), "password": unquote(u.password or "")}
    return {"url": f"jdbc:postgresql://{config['host']}:{config.get('port', 5432)}/{config['dbname']}", "user": config.get("user", ""), "password": config.get("password", ""), "fetchsize": str(fetch_size)}


def ranges(column: str, low: int, high: int, parts: int) -> dict[str, str]:
    """Reader options that split a JDBC read into parts by ranges of a numeric column; rows outside low..high are read too."""
    if parts < 1 or low > high:
        raise ValueError("low <= high and at least one part")
    return {"partitionColumn": column, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(parts)}


def read_jdbc(spark: SparkSession, config: str | dict, table: str, symbol: str, start_ms: int | None = None, split: dict[str, str] | None = None) -> DataFrame:
    """Bars of a table (open_time in ms, open, high, low, close[, volume]); the driver's jar must be there.

    split: ``ranges("open_time", first, last, parts)``, so that as many tasks read.
    """
    df = spark.read.format("jdbc").options(**jdbc_options(config), **(split or {}), dbtable=table).load()
    return legacy_bars(df if start_ms is None else df.filter(F.col("open_time") > start_ms), symbol)


def legacy_bars(df: DataFrame, symbol: str, tf: str = "1m") -> DataFrame:
    """From rows with open_time in milliseconds; no volume means 0."""
    volume = F.coalesce(F.col("volume").cast("double"), F.lit(0.0)) if "volume" in df.columns else F.lit(0.0)
    got = df.select(F.lit(symbol).alias("symbol"), F.floor(F.col("open_time") / 1000).cast("long").alias("time"), *[F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close")], volume.alias("volume"))
    return with_identity(got, None, tf)


def stream_bars(spark: SparkSession, path: str, schema: str = BAR_SCHEMA, per_trigger: int = 1) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


class CandleSource(DataSource):
    """Base of Python bar sources: subclass, give ``candles(symbol)``, register with spark.dataSource.

    The option symbol names the symbols, with commas between them; each is read by a task of its own. A
    source that can read a symbol in pieces gives them in ``pieces`` and takes one in ``candles``.
    """

    @classmethod
    def name(cls) -> str:
        return "candles"

    def schema(self) -> str:
        return BAR_SCHEMA

    def candles(self, symbol: str, piece=None) -> Iterator[tuple]:
        raise NotImplementedError

    def pieces(self, symbol: str) -> list:
        return [None]

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self)


class _Reader(DataSourceReader):
    def __init__(self, source: CandleSource):
        self.source = source

    def partitions(self) -> list[InputPartition]:
        symbols = [s.strip() for s in self.source.options.get("symbol", "").split(",")]
        return [InputPartition((symbol, piece)) for symbol in symbols for piece in self.source.pieces(symbol)]

    def read(self, partition) -> Iterator[tuple]:
        symbol, piece = partition.value
        yield from self.source.candles(symbol) if piece is None else self.source.candles(symbol, piece)
