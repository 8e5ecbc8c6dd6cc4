"""A Parquet store of bars and their indicator documents, partitioned by exchange, symbol, timeframe and span.

A row has the bar and ``indicators``: map<string, map<string, double>>, one entry per indicator with its fields,
scalars under "value". A span is SPAN_SECONDS of time, so that a write rewrites the spans it touches and not
the history of the series, and a time range prunes folders. Writes read the touched partitions, merge, and
overwrite those only; Spark stages the new files and swaps folders when the job commits, after all reading.
Names are checked on every write, symbols are upper-cased, and all partition columns but span are strings. A write
also leaves summaries of the spans that it writes, from which keys, statistics, completeness and the latest row
are read. Folders are swapped one by one: a reader at that moment may see some spans before and some after a write, and
two writers of one span at a time lose one's rows; one writer for each series is assumed.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from barloom.plans.state import STATE_SCHEMA
from barloom.sources import summaries

BAR = ("open", "high", "low", "close", "volume")
PARTITION = ("exchange", "symbol", "tf")
KEY = (*PARTITION, "time")
SPAN_SECONDS = 32 * 86_400
DOCUMENT = "map<string,map<string,double>>"
ROWS = f"time long, open double, high double, low double, close double, volume double, indicators {DOCUMENT}, updated_at timestamp, exchange string, symbol string, tf string, span int"
MOST_NAMES = 1000  # up to so many written series, their folders are named in the read of the old rows
RESERVED = frozenset(("time", *BAR, *PARTITION, "span", "indicators", "updated_at", "side", "timeframe"))


class StoreError(Exception):
    """Any error of the store."""


class ValidationError(StoreError, ValueError):
    """A name or row that the store does not take."""


class NotFoundError(StoreError, LookupError):
    """A series that is not there."""


class StorageError(StoreError):
    """Reading or writing failed."""


def check_schema_name(name: str) -> str:
    if not re.fullmatch(r"[a-z][a-z0-9_]{0,62}", name):
        raise ValidationError(f"no exchange name: {name!r}")
    return name


def check_component(name: str) -> str:
    """Upper-cased symbol or timeframe; 1m and 1M become one, as in the table names of the wire protocol."""
    if not re.fullmatch(r"[A-Z0-9]{1,63}", up := name.strip().upper()):
        raise ValidationError(f"no symbol or timeframe: {name!r}")
    return up


def table_name(symbol: str, tf: str) -> str:
    name = check_component(symbol) + check_component(tf)
    if len(name) > 63:
        raise ValidationError(f"table name is longer than 63: {name}")
    return name


def clean(value: Column) -> Column:
    """NaN and infinities become null."""
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def as_document(columns: dict[str, Column | dict[str, Column]]) -> Column:
    """An indicator document: scalars go under "value"; null and NaN fields are left out."""
    pairs = []
    for key, value in columns.items():
        fields = value if isinstance(value, dict) else {"value": value}
        entries = F.array(*[F.struct(F.lit(k).alias("key"), clean(v.cast("double")).alias("value")) for k, v in fields.items()])
        pairs += [F.lit(key), F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))]
    return F.map_filter(F.create_map(*pairs), lambda k, v: F.size(v) > 0)


def split_row(df: DataFrame) -> tuple[list[str], list[str]]:
    """(bar columns, indicator columns) of a flat DataFrame; reserved names are no indicators."""
    if "time" not in df.columns:
        raise ValidationError("a row needs time")
    return [c for c in BAR if c in df.columns], [c for c in df.columns if c not in RESERVED]


def unwrap(document: Column, key: str) -> Column:
    """The scalar under a key; null if it has other fields."""
    return F.when(F.size(document[key]) == 1, document[key]["value"])


def span_of_time() -> Column:
    return F.floor(F.col("time") / SPAN_SECONDS).cast("int")


def merged(old: Column, new: Column) -> Column:
    """Both documents, the new one winning by key; a key without fields in the new one is removed."""
    old, new = (F.coalesce(x, F.create_map().cast(DOCUMENT)) for x in (old, new))
    return F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k)), F.map_filter(new, lambda k, v: F.size(v) > 0))


@dataclass
class BarStore:
    spark: SparkSession
    path: str

    # ---- reading

    def _all(self) -> DataFrame:
        try:
            return self.spark.read.schema(ROWS).parquet(f"{self.path}/bars")
        except AnalysisException:
            return self.spark.createDataFrame([], ROWS)

    def rows(self, exchange: str | None = None, symbol: str | None = None, tf: str | None = None, start=None, end=None) -> DataFrame:
        """Rows with time in start..end, both included; partitions are pruned and time is pushed down."""
        df = self._all()
        for name, value in zip(PARTITION, (exchange, None if symbol is None else check_component(symbol), tf), strict=True):
            df = df if value is None else df.filter(F.col(name) == value)
        if start is not None:
            df = df.filter((F.col("time") >= start) & (F.col("span") >= start // SPAN_SECONDS))
        if end is not None:
            df = df.filter((F.col("time") <= end) & (F.col("span") <= end // SPAN_SECONDS))
        return df.drop("span")

    def fetch_bars(self, exchange: str, symbol: str, tf: str, start=None, end=None) -> DataFrame:
        """Valid bars in time order."""
        from barloom.functions.extract import valid_bar

        return self.rows(exchange, symbol, tf, start, end).filter(valid_bar()).select("time", *BAR).orderBy("time")

    def indicator(self, exchange: str, symbol: str, tf: str, key: str, start=None, end=None) -> DataFrame:
        """One indicator's fields in time order, rows without it skipped."""
        return indicator_series(self.rows(exchange, symbol, tf, start, end), key)

    def candles_with(self, exchange: str, symbol: str, tf: str, keys: list[str], limit: int | None = None, start=None, end=None) -> DataFrame:
        return candles_with(self.rows(exchange, symbol, tf, start, end), keys, limit)

    def latest_bar(self, exchange: str, symbol: str, tf: str) -> DataFrame:
        """The last row, by the summaries of spans: no bars are read."""
        return summaries.latest(self.summaries(exchange, symbol, tf))

    def stats(self, exchange: str, symbol: str, tf: str, key: str) -> DataFrame:
        """Count, least, largest, mean and last value of a scalar indicator, by the summaries of spans."""
        return summaries.stats(self.summaries(exchange, symbol, tf), key)

    def complete(self, exchange: str, symbol: str, tf: str, key: str, last_n: int) -> tuple[bool, int]:
        """Whether the last n rows all have the key, and how many rows there are of them, by the summaries of spans."""
        return summaries.complete(self.summaries(exchange, symbol, tf), key, last_n)

    def summaries(self, exchange: str | None = None, symbol: str | None = None, tf: str | None = None) -> DataFrame:
        """What every write leaves of the spans that it writes (``sources.summaries``)."""
        try:
            df = self.spark.read.schema(summaries.SCHEMA).parquet(f"{self.path}/summaries")
        except AnalysisException:
            df = self.spark.createDataFrame([], summaries.SCHEMA)
        for name, value in zip(PARTITION, (exchange, None if symbol is None else check_component(symbol), tf), strict=True):
            df = df if value is None else df.filter(F.col(name) == value)
        return df

    def count(self, exchange: str, symbol: str, tf: str) -> int:
        return self.rows(exchange, symbol, tf).count()

    def indicator_keys(self, exchange: str, symbol: str, tf: str, most: int = 1000) -> DataFrame:
        return summaries.keys(self.summaries(exchange, symbol, tf)).limit(most)

    def _folders(self) -> list[tuple[str, str, str, int]]:
        """(exchange, symbol, tf, span) of every folder: names only, no file is read."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        pattern = jvm.org.apache.hadoop.fs.Path(f"{self.path}/bars/exchange=*/symbol=*/tf=*/span=*")
        found = pattern.getFileSystem(conf).globStatus(pattern) or []
        named = [dict(x.split("=", 1) for x in str(f.getPath()).rstrip("/").split("/")[-4:]) for f in found]
        return sorted((x["exchange"], x["symbol"], x["tf"], int(x["span"])) for x in named)

    def catalog(self) -> DataFrame:
        """The series that there are, by the store's folders."""
        series = sorted({x[:3] for x in self._folders()})
        return self.spark.createDataFrame(series, "exchange string, symbol string, tf string").orderBy(*PARTITION)

    def exists(self, exchange: str, symbol: str, tf: str) -> bool:
        return (exchange, check_component(symbol), tf) in {x[:3] for x in self._folders()}

    def refresh(self, exchange: str | None = None) -> None:
        """Forget cached listings of the store, or of one exchange."""
        self.spark.catalog.refreshByPath(self.path if exchange is None else f"{self.path}/bars/exchange={check_schema_name(exchange)}")

    # ---- writing

    def upsert(self, bars: DataFrame, exchange: str, indicators: Column | None = None, version: str | None = None) -> None:
        """Insert or overwrite the bars; with indicators, their documents are merged into the old ones.

        Of bars with the same key the one with the largest version stays, or the largest bar without one.
        """
        check_schema_name(exchange)
        doc = F.lit(None).cast(DOCUMENT) if indicators is None else indicators
        order = F.lit(None).cast("long") if version is None else F.col(version)
        self._merge(bars.select(F.lit(exchange).alias("exchange"), "symbol", "tf", F.col("time").cast("long").alias("time"), *[F.col(c).cast("double").alias(c) for c in BAR], doc.alias("indicators"), order.alias("version")), with_bars=True, held=bars.is_cached)

    def merge_indicators(self, points: DataFrame, exchange: str) -> None:
        """points: symbol, tf, time, indicators. A row that is not there is made, without a bar."""
        check_schema_name(exchange)
        self._merge(points.select(F.lit(exchange).alias("exchange"), "symbol", "tf", F.col("time").cast("long").alias("time"), *[F.lit(None).cast("double").alias(c) for c in BAR], "indicators"), with_bars=False)

    def rewrite(self, bars: DataFrame, points: DataFrame, exchange: str, key: str, outputs: list[str]) -> None:
        """Put points (symbol, tf, time, outputs) under the key at the bars' times, and remove the key at their other times."""
        self.rewrite_all(bars, {key: (points, outputs)}, exchange)

    def rewrite_all(self, bars: DataFrame, uses: dict[str, tuple[DataFrame, list[str]]], exchange: str) -> None:
        """``rewrite`` of several keys, each with its points and outputs, by one write."""
        rows, docs = bars.select("symbol", "tf", "time"), []
        for i, (key, (points, outputs)) in enumerate(uses.items()):
            fields = F.col(outputs[0]) if len(outputs) == 1 else {o: F.col(o) for o in outputs}
            numbers = [c for c, kind in points.select(*outputs).dtypes if kind != "string"]
            fields = fields if len(outputs) == 1 else {o: f for o, f in fields.items() if o in numbers}
            rows = rows.join(points.select("symbol", "tf", "time", as_document({key: fields}).alias(f"__{i}")), ["symbol", "tf", "time"], "left")
            none = F.create_map(F.lit(key), F.create_map().cast("map<string,double>"))
            docs.append(F.when(F.size(f"__{i}") > 0, F.col(f"__{i}")).otherwise(none))
        self.merge_indicators(rows.select("symbol", "tf", "time", F.map_concat(*docs).alias("indicators")), exchange)

    def points(self, exchange: str, symbol: str, tf: str, key: str, outputs: list[str], kinds: dict[str, str], start: int) -> DataFrame:
        """The stored points of a key from start on as an operator gives them: symbol, tf, time (timestamp), outputs; texts are not stored."""
        rows = self.rows(exchange, symbol, tf, start).filter(F.map_contains_key("indicators", key))
        of = lambda o: F.col("indicators")[key]["value" if len(outputs) == 1 else o].cast(kinds[o]).alias(o)
        return rows.select("symbol", "tf", F.timestamp_seconds("time").alias("time"), *[of(o) for o in outputs if kinds[o] != "string"])

    def merge_points(self, points: DataFrame, exchange: str) -> None:
        """points in long form: symbol, tf, time, key, value."""
        self.merge_indicators(to_documents(points), exchange)

    def _merge(self, new: DataFrame, with_bars: bool, held: bool = False) -> None:
        """held: new comes from rows that are persisted already."""
        new = new.withColumn("symbol", F.upper(F.trim("symbol"))).withColumn("span", span_of_time())
        new = new if held else new.persist(StorageLevel.MEMORY_AND_DISK)
        touched = new.groupBy(*PARTITION, "span").agg(F.count(F.lit(1)).alias("n"))
        # a row without a time has no span
        right = F.col("symbol").rlike("^[A-Z0-9]{1,63}$") & F.col("tf").rlike("^[A-Za-z0-9]{1,63}$") & F.col("span").isNotNull()
        touched = touched.withColumn("wrong", F.when(right, 0).otherwise(F.col("n"))).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            self._merge_checked(new, touched, with_bars)
        finally:
            touched.unpersist()
            if not held:
                new.unpersist()

    def _merge_checked(self, new: DataFrame, touched: DataFrame, with_bars: bool) -> None:
        seen = touched.agg(F.sum("wrong").alias("wrong"), F.min("span").alias("low"), F.max("span").alias("high")).first()
        if seen["wrong"]:
            raise ValidationError(f"{seen['wrong']} rows without a proper symbol, timeframe or time")
        if seen["low"] is None:
            return
        old = self._all().filter(F.col("span").between(seen["low"], seen["high"]))
        series = touched.select(*PARTITION).distinct().limit(MOST_NAMES + 1).collect()
        for k, name in enumerate(PARTITION if len(series) <= MOST_NAMES else ()):
            old = old.filter(F.col(name).isin(sorted({r[k] for r in series})))
        old = old.join(touched.select(*PARTITION, "span"), [*PARTITION, "span"], "left_semi")
        self._replace(merge_rows(old, new, with_bars))

    def _replace(self, rows: DataFrame) -> None:
        rows = rows if "span" in rows.columns else rows.withColumn("span", span_of_time()).repartition(*PARTITION, "span")
        rows = rows.sortWithinPartitions(*PARTITION, "span", "time").persist(StorageLevel.DISK_ONLY)
        try:
            # the bars go last: a write to their folder drops what is cached of it, and rows with it
            for df, folder in ((summaries.summarise(rows), "summaries"), (rows, "bars")):
                df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITION, "span").parquet(f"{self.path}/{folder}")
        except Py4JJavaError as e:
            raise StorageError(f"writing to {self.path} failed") from e
        finally:
            rows.unpersist()

    def delete_older(self, now: int, days: int, exchange: str | None = None, symbol: str | None = None, tf: str | None = None) -> None:
        """Drop rows before now - days: the folders of whole spans go, and only spans at the edge are rewritten."""
        cut = now - days * 86_400
        edge = cut // SPAN_SECONDS
        scope = (exchange, None if symbol is None else check_component(symbol), tf)
        mine = [f for f in self._folders() if all(v is None or v == x for v, x in zip(scope, f, strict=False))]
        gone = [f for f in mine if f[3] < edge]
        at_edge = self.rows(*scope).filter(F.floor(F.col("time") / SPAN_SECONDS) == edge)
        kept = retained(at_edge, now, days)
        left = {tuple(r) for r in kept.select(*PARTITION).distinct().collect()}  # one row for each series at the edge
        gone += [f for f in mine if f[3] == edge and f[:3] not in left]
        if left:
            self._replace(kept)
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for e, s, t, k in gone:
            for folder in ("bars", "summaries"):
                at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}/exchange={e}/symbol={s}/tf={t}/span={k}")
                at.getFileSystem(conf).delete(at, True)

    def take_over(self, bars: DataFrame, exchange: str, points: DataFrame | None = None) -> None:
        """Move what is held in memory into the store: the bars, and points in long form (symbol, tf, time, key, value)."""
        self.upsert(bars, exchange)
        if points is not None:
            self.merge_points(points, exchange)

    # ---- state of folds

    def _states(self, folder: str = "state") -> list[str]:
        """The complete state folders, oldest first."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        pattern = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}/v*/_SUCCESS")
        return sorted(str(f.getPath().getParent()) for f in pattern.getFileSystem(conf).globStatus(pattern) or [])

    def _delete(self, paths: list[str]) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for path in paths:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)

    @staticmethod
    def _of_key(key: str) -> str:
        return f"fold_states/{uuid.uuid5(uuid.NAMESPACE_URL, key).hex}"

    def fold_states(self, key: str) -> DataFrame:
        """time and the typed fields (``plans.state``) of the states that a use's fold left: the last of each span.

        A row without a version only says how far the use has come.
        """
        there = self._states(self._of_key(key))
        schema = f"time bigint, {STATE_SCHEMA}"
        return self.spark.read.schema(schema).parquet(there[-1]) if there else self.spark.createDataFrame([], schema)

    def keep_fold_states(self, key: str, since: int, last: int, left: DataFrame | None) -> None:
        """Replace the states from since on by those in left; last: the time of the last bar that the use has seen."""
        before = self._states(self._of_key(key))
        schema = f"time bigint, {STATE_SCHEMA}"
        new = self.spark.createDataFrame([(last, *[None] * 6)], schema) if left is None else left
        states = self.fold_states(key).filter(F.col("time") < since).unionByName(new)
        w = Window.partitionBy(F.floor(F.col("time") / SPAN_SECONDS)).orderBy(F.desc("time"))
        number = int(re.search(r"v(\d+)$", before[-1])[1]) + 1 if before else 0
        states.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r").coalesce(1).write.parquet(f"{self.path}/{self._of_key(key)}/v{number:012d}")
        self._delete(before[:-1])

    def seen_until(self, key: str) -> int | None:
        """The time of the last bar that a use has seen."""
        return self.fold_states(key).agg(F.max("time")).first()[0]

    def series_states(self, key: str) -> DataFrame | None:
        """As ``fold_states`` for a use of many series, with symbol and tf; None before the first are kept."""
        there = self._states(f"series_{self._of_key(key)}")
        return self.spark.read.schema(f"symbol string, tf string, time bigint, {STATE_SCHEMA}").parquet(there[-1]) if there else None

    def keep_series_states(self, key: str, tf: str, since: DataFrame, left: DataFrame) -> None:
        """Replace the states of the series in since (symbol, since) from that time on by those in left; the last of each span stays."""
        folder = f"series_{self._of_key(key)}"
        before, states = self._states(folder), left
        if before:
            old = self.series_states(key).join(since, "symbol", "left").filter(F.col("since").isNull() | (F.col("tf") != tf) | (F.col("time") < F.col("since"))).drop("since")
            states = old.unionByName(left)
        w = Window.partitionBy("symbol", "tf", F.floor(F.col("time") / SPAN_SECONDS)).orderBy(F.desc("time"))
        number = int(re.search(r"v(\d+)$", before[-1])[1]) + 1 if before else 0
        states.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r").write.parquet(f"{self.path}/{folder}/v{number:012d}")
        self._delete(before[:-1])

    def forget_fold_states(self) -> None:
        self._delete([f"{self.path}/fold_states", f"{self.path}/series_fold_states"])

    def save_state(self, states: DataFrame) -> None:
        """states: indicator_key, last_bar_time, state. The latest by key stays.

        Every save is a folder of its own, read once it is complete, so a crash leaves the states before it.
        """
        now, before = states.withColumn("updated_at", F.current_timestamp()), self._states()
        if before:
            now = self.spark.read.parquet(before[-1]).unionByName(now)
        w = Window.partitionBy("indicator_key").orderBy(F.desc("last_bar_time"), F.desc("updated_at"))
        number = int(re.search(r"v(\d+)$", before[-1])[1]) + 1 if before else 0
        now.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r").write.parquet(f"{self.path}/state/v{number:012d}")
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for path in before[:-1]:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)

    def load_state(self, keys: list[str]) -> DataFrame:
        if not (there := self._states()):
            raise NotFoundError("no state is saved")
        return self.spark.read.parquet(there[-1]).filter(F.col("indicator_key").isin(keys))


# ---- the relational operators by themselves


def merge_rows(old: DataFrame, new: DataFrame, with_bars: bool = True) -> DataFrame:
    """old and new rows by key: the new row wins the bar, documents are merged, the new one winning.

    Of new rows with the same key the one with the largest version wins, if new has that column, then the
    one with the largest bar and document; the others leave nothing. Old rows have one row for each key. Where both
    have their span, rows are dealt by it once, and stay so.
    """
    spans = ["span"] if "span" in old.columns and "span" in new.columns else []
    version = F.col("version") if "version" in new.columns else F.lit(None).cast("long")
    n = new.select(*PARTITION, *spans, "time", *BAR, "indicators", F.lit(None).cast("timestamp").alias("updated_at"), version.alias("__version"), F.lit(True).alias("__new"))
    o = old.select(*PARTITION, *spans, "time", *BAR, "indicators", "updated_at", F.lit(None).cast(n.schema["__version"].dataType).alias("__version"), F.lit(False).alias("__new"))
    both = o.unionByName(n)
    both = both.repartition(*PARTITION, "span") if spans else both
    document = F.when(F.col("__new"), F.to_json("indicators"))
    w = Window.partitionBy(*PARTITION, *spans, "time").orderBy(F.desc("__new"), *[F.desc_nulls_last(c) for c in ("__version", *BAR)], F.desc_nulls_last(document))
    last = F.struct("__new", *BAR, "indicators").alias("__last")
    placed = both.withColumn("__last", F.last(last).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).withColumn("__r", F.row_number().over(w)).filter("__r = 1")
    is_new, was = F.col("__new"), F.when(~F.col("__last.__new"), F.col("__last"))
    pick = (lambda c: F.col(c)) if with_bars else (lambda c: was[c].alias(c))
    stamp = F.when(is_new, F.current_timestamp()).otherwise(F.col("updated_at")).alias("updated_at")
    mine = F.col("indicators")
    alone = F.when(is_new, F.map_filter(F.coalesce(mine, F.create_map().cast(DOCUMENT)), lambda k, v: F.size(v) > 0)).otherwise(F.coalesce(mine, F.create_map().cast(DOCUMENT)))
    documents = F.when(is_new & was.isNotNull(), merged(was["indicators"], mine)).otherwise(alone).alias("indicators")
    return placed.select("time", *[pick(c) for c in BAR], documents, stamp, *PARTITION, *spans)


def to_documents(points: DataFrame) -> DataFrame:
    """(symbol, tf, time, key, value) to (symbol, tf, time, indicators)."""
    entry = F.struct("key", F.create_map(F.lit("value"), F.col("value")).alias("value"))
    good = points.withColumn("value", clean(F.col("value").cast("double"))).filter("value is not null")
    # of values with the same key the largest stays
    one = good.groupBy("symbol", "tf", "time", "key").agg(F.max("value").alias("value"))
    return one.groupBy("symbol", "tf", "time").agg(F.map_from_entries(F.collect_list(entry)).alias("indicators"))


def indicator_series(rows: DataFrame, key: str) -> DataFrame:
    return rows.filter(F.map_contains_key("indicators", key)).select("time", F.col("indicators")[key].alias("fields")).orderBy("time")


def candles_with(rows: DataFrame, keys: list[str], limit: int | None = None) -> DataFrame:
    """Bars with the chosen indicators, of the most recent rows, in time order."""
    chosen = rows.select("time", *BAR, *[F.col("indicators")[k].alias(k) for k in keys])
    return (chosen if limit is None else chosen.orderBy(F.desc("time")).limit(limit)).orderBy("time")


def indicator_stats(rows: DataFrame, key: str) -> DataFrame:
    """Count, least, largest, mean and last value of a scalar indicator."""
    v = F.col("indicators")[key]["value"]
    return rows.withColumn("v", v).agg(F.count("v").alias("n"), F.min("v").alias("least"), F.max("v").alias("largest"), F.avg("v").alias("mean"), F.max_by("v", F.when(F.col("v").isNotNull(), F.col("time"))).alias("last_value"), F.max(F.when(F.col("v").isNotNull(), F.col("time"))).alias("last_time"))


def completeness(rows: DataFrame, key: str, last_n: int) -> DataFrame:
    last = rows.orderBy(F.desc("time")).limit(last_n)
    return last.agg(F.coalesce(F.every(F.map_contains_key("indicators", key)), F.lit(False)).alias("complete"), F.count(F.lit(1)).alias("n_rows"))


def indicator_keys(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode(F.map_keys("indicators")).alias("key")).distinct().orderBy("key")


def retained(rows: DataFrame, now: int, days: int) -> DataFrame:
    return rows.filter(F.col("time") >= now - days * 86_400)


def recent(rows: DataFrame, n: int, by: tuple[str, ...] = ("symbol", "tf")) -> DataFrame:
    """The last n rows of every series (ring buffer)."""
    w = Window.partitionBy(*by).orderBy(F.desc("time"))
    return rows.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= n).drop("__r")


def history_page(rows: DataFrame, before: int, count: int) -> DataFrame:
    """The count rows before a time, in time order."""
    return rows.filter(F.col("time") < before).orderBy(F.desc("time")).limit(count).orderBy("time")
