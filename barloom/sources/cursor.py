"""Live bars of database tables as a stream with offsets: the last open_time read of each symbol.

Each symbol has a table with open_time in milliseconds, open, high, low, close and volume. A batch takes the rows
after the offset up to the newest one, cut into ranges of at most ``rows_per_task`` rows, a task each; rows go from
the database to executors and none through the driver. Spark keeps the offsets in the query's
checkpoint, so that a restarted query reads no row twice and misses none. ``rows_per_trigger`` bounds the rows of a symbol in a
batch of a running query; the first batch after a restart is not bounded by it, as a Python source learns its
position only with that batch (tasks are bounded then too). Rows that come in with an open_time before the offset are not seen.
"""

from __future__ import annotations

import importlib
import json
import re
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from barloom.bars import BAR_SCHEMA


class Tables:
    """Queries on the tables, over any DB-API module.

    Options: module (sqlite3 by default), connect (JSON of the arguments of its connect, a list or a mapping), table (a name
    with {symbol} in it), symbol (names with commas between them), tf, timeframe, rows_per_task, rows_per_trigger.
    """

    def __init__(self, options: dict[str, str]):
        self.module = importlib.import_module(options.get("module", "sqlite3"))
        self.arguments = json.loads(options.get("connect", "[]"))
        self.mark = "?" if getattr(self.module, "paramstyle", "qmark") == "qmark" else "%s"
        self.pattern = options.get("table", "{symbol}")
        self.symbols = [s.strip().upper() for s in options.get("symbol", "").split(",") if s.strip()]
        self.tf, self.timeframe = options.get("tf", "1m"), int(options.get("timeframe", "1"))
        self.per_task, self.per_trigger = int(options.get("rows_per_task", "100000")), int(options.get("rows_per_trigger", "0"))
        for s in self.symbols:
            self.table(s)

    def table(self, symbol: str) -> str:
        name = self.pattern.format(symbol=symbol)
        if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_.]{0,127}", name):
            raise ValueError(f"no table name: {name!r}")
        return name

    def rows(self, sql: str, *values) -> Iterator[tuple]:
        connection = self.module.connect(**self.arguments) if isinstance(self.arguments, dict) else self.module.connect(*self.arguments)
        try:
            cursor = connection.cursor()
            cursor.execute(sql.replace("?", self.mark), values)
            while page := cursor.fetchmany(10_000):
                yield from page
        finally:
            connection.close()

    def newest(self, symbol: str, after: int | None = None) -> int | None:
        """The newest open_time; with after, that of the last row of a trigger that starts there."""
        if self.per_trigger and after is not None:
            sql = f"SELECT max(open_time) FROM (SELECT open_time FROM {self.table(symbol)} WHERE open_time > ? ORDER BY open_time LIMIT ?) AS page"
            return next(self.rows(sql, after, self.per_trigger))[0]
        return next(self.rows(f"SELECT max(open_time) FROM {self.table(symbol)}"))[0]

    def ranges(self, symbol: str, after: int, until: int) -> list[tuple[str, int, int]]:
        """(symbol, after, until] in ranges of at most per_task rows, by the bounds alone."""
        sql = f"SELECT max(open_time), count(*) FROM (SELECT open_time FROM {self.table(symbol)} WHERE open_time > ? AND open_time <= ? ORDER BY open_time LIMIT ?) AS page"
        out = []
        while after < until:
            last, n = next(self.rows(sql, after, until, self.per_task))
            if not n:
                break
            out.append((symbol, after, last))
            after = last
        return out

    def candles(self, symbol: str, after: int, until: int) -> Iterator[tuple]:
        sql = f"SELECT open_time, open, high, low, close, volume FROM {self.table(symbol)} WHERE open_time > ? AND open_time <= ? ORDER BY open_time"
        for at, o, h, l, c, v in self.rows(sql, after, until):
            yield symbol, self.tf, datetime.fromtimestamp(at // 1000, timezone.utc), float(o), float(h), float(l), float(c), float(v or 0.0), int(o <= c), self.timeframe


BEFORE_ALL = -(1 << 62)


class _Batch(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        tables = Tables(self.options)
        return [InputPartition(r) for s in tables.symbols if (newest := tables.newest(s)) is not None for r in tables.ranges(s, BEFORE_ALL, newest)]

    def read(self, partition) -> Iterator[tuple]:
        yield from Tables(self.options).candles(*partition.value)


class _Stream(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.options, self.at = options, None

    def initialOffset(self) -> dict:
        start = int(self.options.get("start_ms", BEFORE_ALL))
        self.at = {s: start for s in Tables(self.options).symbols}
        return self.at

    def latestOffset(self) -> dict:
        tables, at = Tables(self.options), self.at or {}
        found = {s: tables.newest(s, at.get(s)) for s in tables.symbols}
        return {s: at.get(s, BEFORE_ALL) if x is None else max(x, at.get(s, BEFORE_ALL)) for s, x in found.items()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        tables = Tables(self.options)
        self.at = dict(end)
        return [InputPartition(r) for s, until in end.items() for r in tables.ranges(s, start.get(s, BEFORE_ALL), until)]

    def read(self, partition) -> Iterator[tuple]:
        yield from Tables(self.options).candles(*partition.value)

    def commit(self, end: dict) -> None:
        self.at = dict(end)


class CandleTable(DataSource):
    """Register with ``spark.dataSource.register(CandleTable)``; format "candle_table", for read and readStream."""

    @classmethod
    def name(cls) -> str:
        return "candle_table"

    def schema(self) -> str:
        return BAR_SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Batch(dict(self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(dict(self.options))
