"""Streams give the batch results, over several micro-batches and restarts."""

import random

import pytest
from pyspark.sql import functions as F

import barloom.operators  # noqa: F401
from barloom.bars import BAR_SCHEMA, from_matrix
from barloom.registry import get
from barloom.sources.readers import stream_bars
from barloom.sources.store import BarStore
from barloom.streaming.live import each_batch, incremental, into_store, without_late
from barloom.timeframe import roll_up_exact


def all_bars(spark, n=90):
    rng = random.Random(5)
    df = from_matrix(spark, [[100 + rng.random(), 103, 98, 100 + rng.random(), 1 + rng.random()] for _ in range(n)], "BTC")
    return df.withColumn("time", F.timestamp_seconds("time")).select(*[x.split()[0] for x in BAR_SCHEMA.split(", ")])


def drop(df, folder, parts):
    rows = df.orderBy("time").collect()
    step = -(-len(rows) // parts)
    for i in range(parts):
        yield lambda i=i: df.sparkSession.createDataFrame(rows[i * step : (i + 1) * step], df.schema).coalesce(1).write.mode("append").parquet(folder)


def test_stream_equals_batch_over_restarts(spark, tmp_path):
    df = all_bars(spark)
    store = BarStore(spark, str(tmp_path / "store"))
    for write in drop(df, str(tmp_path / "in"), 3):
        write()
        for name, out in (("ema", "ema"), ("rsi", "rsi")):
            results = get(name)(stream_bars(spark, str(tmp_path / "in")))
            each_batch(results, [into_store(store, "x", name.upper(), [out])], str(tmp_path / f"checkpoint-{name}")).awaitTermination()
    for name in ("ema", "rsi"):
        want = [r[name] for r in get(name)(df).orderBy("time").collect()]
        got = [r.fields["value"] for r in store.indicator("x", "BTC", "1m", name.upper()).collect()]
        assert got == pytest.approx(want)


def test_roll_up_on_a_stream(spark, tmp_path):
    df, seen = all_bars(spark), []
    for write in drop(df, str(tmp_path / "in"), 2):
        write()
        each_batch(roll_up_exact(stream_bars(spark, str(tmp_path / "in")), "5m"), [lambda b, e: seen.extend(b.collect())], str(tmp_path / "checkpoint")).awaitTermination()
    assert sorted(seen) == sorted(roll_up_exact(df, "5m").collect())


def test_duplicates_within_the_watermark_and_late_bars(spark, tmp_path):
    df, seen = all_bars(spark, 20), []
    folder = str(tmp_path / "in")
    df.coalesce(1).write.parquet(folder)
    df.limit(5).coalesce(1).write.mode("append").parquet(folder)
    each_batch(without_late(stream_bars(spark, folder)), [lambda b, e: seen.extend(b.collect())], str(tmp_path / "c1")).awaitTermination()
    assert len(seen) == 20
    got = []
    each_batch(get("ema")(stream_bars(spark, folder), period=2), [lambda b, e: got.extend(b.collect())], str(tmp_path / "c2")).awaitTermination()
    assert len(got) == 19


def test_incremental_merges_only_new_points(spark, tmp_path):
    store = BarStore(spark, str(tmp_path / "store"))
    rows = spark.createDataFrame([("A", "1m", 60 * i, float(i)) for i in range(5)], "symbol string, tf string, time long, v double")
    incremental(store, "x", rows.filter("time < 120"), "V", "v")
    incremental(store, "x", rows.withColumn("v", F.col("v") + 100), "V", "v")
    assert [r.fields["value"] for r in store.indicator("x", "A", "1m", "V").collect()] == [0.0, 1.0, 102.0, 103.0, 104.0]
