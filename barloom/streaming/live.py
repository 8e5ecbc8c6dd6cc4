"""Structured Streaming: bars in, roll-up and indicators with state, results merged into the store.

The same operators run on streams; folds keep their state in the state store (``plans.fold``). Late bars,
not after the last one of their series, do not change results; duplicates by time collapse.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from barloom.sources.store import BarStore


def without_late(bars: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Watermarked and free of duplicates; time must be a timestamp."""
    return bars.withWatermark("time", delay).dropDuplicatesWithinWatermark(["symbol", "tf", "time"])


def each_batch(df: DataFrame, handlers: list[Callable[[DataFrame, int], None]], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Run the handlers on every micro-batch; once: all that is there, then stop."""

    def run(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        for handler in handlers:
            handler(batch, epoch)
        batch.unpersist()

    writer = df.writeStream.foreachBatch(run).outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def into_store(store: BarStore, exchange: str, name: str, outputs: list[str]) -> Callable[[DataFrame, int], None]:
    """A handler that merges an indicator's outputs into the store; a batch run again merges the same."""
    from barloom.sources.store import as_document

    fields = F.col(outputs[0]) if len(outputs) == 1 else {o: F.col(o) for o in outputs}

    def handle(batch: DataFrame, epoch: int) -> None:
        seconds = F.col("time") if dict(batch.dtypes)["time"] == "bigint" else F.unix_timestamp("time")
        store.merge_indicators(batch.select("symbol", "tf", seconds.alias("time"), as_document({name: fields}).alias("indicators")), exchange)

    return handle


def incremental(store: BarStore, exchange: str, results: DataFrame, name: str, output: str) -> None:
    """Merge the points that the store does not have yet, late ones among them."""
    done = store.rows(exchange).filter(F.map_contains_key("indicators", name)).select("symbol", "tf", "time")
    new = results.join(done, ["symbol", "tf", "time"], "left_anti")
    from barloom.sources.store import as_document

    store.merge_indicators(new.select("symbol", "tf", "time", as_document({name: F.col(output)}).alias("indicators")), exchange)
