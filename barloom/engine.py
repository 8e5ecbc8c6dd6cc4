"""The front door: configure once, register operators with listeners, push bars, replay history, stop.

An engine keeps everything in one folder that driver and executors share: pushed bars in ``inbox``, the store with
the states of folds, and the checkpoints of its streaming queries. ``advance`` runs one query for the
source and one for each other timeframe over what is new, whatever the number of uses, and stops (``availableNow``). A batch
goes into the store first; then each use of a series that it touched is replayed from the earliest touched bar on
(``plans.replay``), from the nearest state before it, so that late and repeated bars end in the same points
as bars in order. A use that came later catches up from its own mark. A rolled-up bar follows late ticks as long
as the stream keeps them (``plans.fold``).
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.bars import BAR_SCHEMA
from barloom.functions.extract import side, valid_bar
from barloom.plans.replay import replay
from barloom.plans.state import STATE_FIELDS, STATE_SCHEMA, flat, nested
from barloom.registry import OPERATORS, Registrations, get
from barloom.sources.readers import stream_bars
from barloom.sources.store import BAR, BarStore, check_component, check_schema_name
from barloom.streaming.live import each_batch
from barloom.streaming.payloads import snapshot
from barloom.timeframe import as_timestamp, roll_up_exact, timeframe_minutes

Listener = Callable[[DataFrame, int], None]
COLUMNS = [x.split()[0] for x in BAR_SCHEMA.split(", ")]
#: A push is one micro-batch however many files it has, so that its bars are taken in order of time.
EVERY_FILE = (1 << 31) - 1


@dataclass(frozen=True)
class Config:
    """Settings of an engine; the defaults are those of the interface that it serves."""

    path: str
    timezone: str = "Asia/Tehran"
    source_timeframe: str = "1m"
    max_bars: int = 10_000
    snapshot_size: int = 500
    exchange: str = "default"
    start_provide_from: str | None = None
    week_start: int = 0

    def __post_init__(self):
        timeframe_minutes(self.source_timeframe)
        check_schema_name(self.exchange)
        if self.max_bars < 1 or self.snapshot_size < 1:
            raise ValueError("max_bars and snapshot_size are at least 1")


@dataclass
class Engine:
    spark: SparkSession
    config: Config
    uses: Registrations = field(default_factory=Registrations)
    listeners: dict[str, list[Listener]] = field(default_factory=dict)
    bar_listeners: dict[tuple[str, str], list[Listener]] = field(default_factory=dict)
    silent: bool = False
    source: Callable[[], DataFrame] | None = None

    @property
    def store(self) -> BarStore:
        return BarStore(self.spark, f"{self.config.path}/store")

    # ---- registration

    def use(self, name: str, symbol: str, tf: str, listener: Listener | None = None, **params) -> str:
        """Register an operator; the same one twice is one entry with two references. The listener gets new results."""
        if timeframe_minutes(tf) % timeframe_minutes(self.config.source_timeframe):
            raise ValueError(f"{tf} does not consist of {self.config.source_timeframe} bars")
        key = self.uses.add(name, check_component(symbol), tf, **params)
        if listener is not None:
            self.listeners.setdefault(key, []).append(listener)
        return key

    def release(self, key: str, listener: Listener | None = None) -> None:
        """Detach the listener and drop one reference; without references the use is gone."""
        if listener is not None:
            self.listeners[key].remove(listener)
        self.uses.remove(key)
        if key not in self.uses.keys():
            self.listeners.pop(key, None)

    def attach(self, symbol: str, tf: str, listener: Listener) -> None:
        """The listener gets the new bars of a symbol and timeframe."""
        timeframe_minutes(tf)
        self.bar_listeners.setdefault((check_component(symbol), tf), []).append(listener)

    def detach(self, symbol: str, tf: str, listener: Listener) -> None:
        there = self.bar_listeners[check_component(symbol), tf]
        there.remove(listener)
        if not there:
            del self.bar_listeners[check_component(symbol), tf]

    def info(self) -> list[dict]:
        return [u | {"listeners": len(self.listeners.get(u["key"], []))} for u in self.uses.info()]

    # ---- bars

    def push(self, bars: DataFrame, advance: bool = True) -> None:
        """Take bars of the source timeframe (symbol, time, open, high, low, close, volume); malformed ones are left out."""
        time = as_timestamp(bars)
        volume = F.coalesce(F.col("volume").cast("double"), F.lit(0.0)) if "volume" in bars.columns else F.lit(0.0)
        minutes = timeframe_minutes(self.config.source_timeframe)
        rows = bars.select(F.upper(F.trim("symbol")).alias("symbol"), F.lit(self.config.source_timeframe).alias("tf"), time.alias("time"), *[F.col(c).cast("double").alias(c) for c in BAR[:4]], volume.alias("volume"), side().alias("side"), F.lit(minutes).alias("timeframe"))
        rows = rows.filter(valid_bar() & F.col("time").isNotNull())
        if self.config.start_provide_from is not None:
            rows = rows.filter(F.col("time") >= F.lit(self.config.start_provide_from).cast("timestamp"))
        rows.write.mode("append").parquet(f"{self.config.path}/inbox")
        if advance:
            self.advance()

    def push_one(self, symbol: str, time: int, open: float, high: float, low: float, close: float, volume: float = 0.0) -> None:
        """Push one bar and advance."""
        self.push(self.spark.createDataFrame([(symbol, time, open, high, low, close, volume)], "symbol string, time long, open double, high double, low double, close double, volume double"))

    def follow(self, source: Callable[[], DataFrame]) -> None:
        """Take bars from a stream (BAR_SCHEMA) in place of pushes, for example of ``sources.cursor``; ``advance`` reads what is new."""
        self.source = source

    def _bars(self) -> DataFrame:
        return stream_bars(self.spark, f"{self.config.path}/inbox", per_trigger=EVERY_FILE) if self.source is None else self.source().filter(valid_bar() & F.col("time").isNotNull())

    def advance(self) -> None:
        """Carry all that was pushed into the store, the timeframes, the operators and the listeners."""
        source = self.config.source_timeframe
        wanted = {tf for *_, tf in self.bar_listeners} | {u["tf"] for u in self.uses.info()}
        handlers = lambda tf: [self._to_store, self._to_bar_listeners, functools.partial(self._to_uses, tf)]
        self._run(self._bars(), "bars", handlers(source))
        for tf in sorted(wanted - {source}):
            rolled = roll_up_exact(self._bars(), tf, self.config.timezone, self.config.week_start)
            self._run(rolled.filter(F.col("time").isNotNull()), f"tf-{tf}", handlers(tf))
        for use in self.uses.info():
            self._catch_up(use)

    def _to_uses(self, tf: str, batch: DataFrame, epoch: int) -> None:
        """Replay the uses of the series that the batch touched."""
        uses = [u for u in self.uses.info() if u["tf"] == tf]
        if not uses:
            return
        # one row a symbol
        touched = {r["symbol"]: r["since"] for r in batch.filter(F.col("symbol").isin(sorted({u["symbol"] for u in uses}))).groupBy("symbol").agg(F.min(F.unix_timestamp("time")).alias("since")).collect()}
        for use in uses:
            if use["symbol"] in touched:
                seen = self.store.seen_until(use["key"])
                since = touched[use["symbol"]]
                self._replay(use, None if seen is None else min(since, seen + 1), epoch)

    def _catch_up(self, use: dict) -> None:
        """A use that has not seen the bars of its series goes on from its mark."""
        seen = self.store.seen_until(use["key"])
        start = None if seen is None else seen + 1
        if self.store.rows(self.config.exchange, use["symbol"], use["tf"], start).filter(F.col("open").isNotNull()).isEmpty():
            return
        self._replay(use, start, -1)

    def _replay(self, use: dict, since: int | None, epoch: int) -> None:
        operator = functools.partial(get(use["name"]), **use["params"])
        points = replay(self.store, self.config.exchange, use["symbol"], use["tf"], use["key"], operator, since)
        if points is not None:
            for listener in () if self.silent else self.listeners.get(use["key"], ()):
                listener(points, epoch)

    def get_state(self, key: str) -> dict | None:
        """The state that the use's fold was left in: {"time", "version", "fields"}; None without one."""
        row = self.store.fold_states(key).filter("version is not null").orderBy(F.desc("time")).first()
        return None if row is None else {"time": row["time"]} | nested(row[1:])

    def set_state(self, key: str, state: dict) -> None:
        """Let the use go on from a state that ``get_state`` gave; it has seen the bars up to the state's time."""
        row = self.spark.createDataFrame([(state["time"], *flat(state))], f"time bigint, {STATE_SCHEMA}").select("time", *STATE_FIELDS)
        self.store.keep_fold_states(key, state["time"], state["time"], row)

    def __post_init__(self):
        self._queries: list = []
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        pattern = jvm.org.apache.hadoop.fs.Path(f"{self.config.path}/checkpoint-*")
        found = [int(m[1]) for f in pattern.getFileSystem(conf).globStatus(pattern) or [] if (m := re.search(r"checkpoint-(\d+)$", str(f.getPath())))]
        self._generation = max(found, default=0)

    def _folder(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.config.path}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _run(self, rows: DataFrame, name: str, handlers: list[Listener]) -> None:
        query = each_batch(rows, handlers, f"{self.config.path}/checkpoint-{self._generation}/{name}")
        self._queries.append(query)
        try:
            query.awaitTermination()
        finally:
            self._queries.remove(query)

    def _to_store(self, batch: DataFrame, epoch: int) -> None:
        self.store.upsert(batch.withColumn("time", F.unix_timestamp("time")), self.config.exchange)

    def _to_bar_listeners(self, batch: DataFrame, epoch: int) -> None:
        for (symbol, tf), listeners in () if self.silent else list(self.bar_listeners.items()):
            mine = batch.filter((F.col("symbol") == symbol) & (F.col("tf") == tf))
            for listener in listeners:
                listener(mine, epoch)

    # ---- history

    def seed(self, bars: DataFrame, count_first: int = 0, on_first: Callable[[], None] | None = None, on_provide: Callable[[DataFrame], None] | None = None, on_finish: Callable[[], None] | None = None) -> None:
        """Replay history in time order of each series.

        The first count_first bars of a series only warm the operators up: no listener hears of them; then
        on_first is called. The others go through the listeners and to on_provide. on_finish comes last.
        """
        from pyspark.sql import Window

        number = F.row_number().over(Window.partitionBy("symbol").orderBy("time"))
        numbered = bars.withColumn("__n", number)
        if count_first:
            self.silent = True
            try:
                self.push(numbered.filter(F.col("__n") <= count_first).drop("__n"))
            finally:
                self.silent = False
            if on_first is not None:
                on_first()
        rest = numbered.filter(F.col("__n") > count_first).drop("__n")
        self.push(rest)
        if on_provide is not None:
            on_provide(rest)
        if on_finish is not None:
            on_finish()

    def results(self, key: str) -> DataFrame:
        """The stored results of a use: time and fields."""
        use = {u["key"]: u for u in self.uses.info()}[key]
        return self.store.indicator(self.config.exchange, use["symbol"], use["tf"], key)

    def to_lists(self, key: str, last: int = 50) -> dict[str, list]:
        """The last results of a use, a list for each field and one of the times."""
        rows = sorted(self.results(key).orderBy(F.desc("time")).limit(last).collect(), key=lambda r: r["time"])
        fields = dict.fromkeys(f for r in rows for f in r["fields"])
        return {"time": [r["time"] for r in rows], **{f: [r["fields"].get(f) for r in rows] for f in fields}}

    def recent(self, symbol: str, tf: str, n: int | None = None) -> DataFrame:
        """The last n bars of a series, max_bars at most, in time order."""
        rows = self.store.rows(self.config.exchange, symbol, tf).filter(F.col("open").isNotNull())
        return rows.orderBy(F.desc("time")).limit(min(n or self.config.max_bars, self.config.max_bars)).select("time", *BAR).orderBy("time")

    def snapshot(self, symbol: str, tf: str) -> DataFrame:
        """The frame that a new client gets: the last bars of a series."""
        return snapshot(self.store.rows(self.config.exchange, symbol, tf).filter(F.col("open").isNotNull()), self.config.snapshot_size)

    def reset(self) -> None:
        """Forget all operator state, also for engines to come: the next advance reads the inbox from the start."""
        self._generation += 1
        path, files = self._folder(f"checkpoint-{self._generation}")
        files.mkdirs(path)
        self.store.forget_fold_states()
        old, files = self._folder(f"checkpoint-{self._generation - 1}")
        files.delete(old, True)

    def stop(self) -> None:
        """Stop the engine's own running queries and forget registrations and listeners."""
        for query in list(self._queries):
            query.stop()
        self.uses, self.listeners, self.bar_listeners = Registrations(), {}, {}
        global _engine
        if _engine is self:
            _engine = None


_engine: Engine | None = None


def init(spark: SparkSession, path: str, **settings) -> Engine:
    """The session's engine; a second one before stop is an error."""
    global _engine
    if _engine is not None:
        raise RuntimeError("the engine is configured already; stop it first")
    import barloom.operators  # noqa: F401

    _engine = Engine(spark, Config(path, **settings))
    return _engine


def as_views(bars: DataFrame, names: list[str] | None = None, prefix: str = "") -> list[str]:
    """Temporary views for SQL: ``bars`` and one of each operator over them, with its defaults."""
    import barloom.operators  # noqa: F401

    bars.createOrReplaceTempView(f"{prefix}bars")
    made = [f"{prefix}bars"]
    for name in names or sorted(OPERATORS):
        get(name)(bars).createOrReplaceTempView(f"{prefix}{name}")
        made.append(f"{prefix}{name}")
    return made
