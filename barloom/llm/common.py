"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZER_FILE = "word_bpe_49k.json"


_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Where a local session has none (tests), a temporary folder is set for the context; a cluster must name one.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="barloom-checkpoint-"))
        named = sc._jsc.sc().getCheckpointDir().get()
    return str(named).rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends here.

    The tables stay until ``forget``, as results are read from them later.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/barloom-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession) -> None:
    """Delete every table written so far; results that were not saved elsewhere are gone with them."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _written:
        at = jvm.org.apache.hadoop.fs.Path(_written.pop())
        at.getFileSystem(conf).delete(at, True)


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches, rows: int = 500):
    """Arrow batches cut to few rows each, so that a task's copies of texts stay small beside the batch."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


@contextlib.contextmanager
def small_arrow_batches(spark: SparkSession, rows: int = 1000, size: str = "8m") -> Iterator[None]:
    """Fewer rows and bytes in the batches between executors and Python workers, of what runs inside.

    Both sides hold a batch of each running task, and the sender twice that while its buffers grow.
    """
    names = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@contextlib.contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query that runs inside go when it ends, and not when the driver's garbage is next collected.

    For queries whose result is written or collected there, as nothing reads their shuffles again.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "true")
        yield
    finally:
        spark.conf.set(name, before)


def give_back() -> None:
    """Return memory that a task has freed to the system, as Python workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def first_by_hash(df: DataFrame, h: Column, n: int) -> DataFrame:
    """About n rows of df: those of the n smallest hashes, 2 n at most. Only hashes are sorted."""
    bound = df.select(h.alias("__h")).orderBy("__h").limit(n).agg(F.max("__h")).first()[0]
    return df.limit(0) if bound is None else df.filter(h <= bound).limit(2 * n)


def different_by_hash(df: DataFrame, h: Column, n: int) -> DataFrame:
    """The rows of the n smallest different hashes, one row for each hash. Only hashes are sorted.

    The same rows at every run, where rows of one hash are alike.
    """
    bound = df.select(h.alias("__h")).distinct().orderBy("__h").limit(n).agg(F.max("__h")).first()[0]
    return df.limit(0) if bound is None else df.filter(h <= bound).withColumn("__h", h).dropDuplicates(["__h"]).drop("__h")
