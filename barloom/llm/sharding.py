"""Sharding by best-fit-decreasing bin packing of indivisible groups.

A group is all documents of equal text; it goes into one shard whole. Groups sorted by size enter the bin
with the tightest remaining capacity, found through a balanced tree.

1. Groups are summed with partial aggregation (a 128-bit hash is the key: a collision would only put
   two texts together).
2. Groups are packed into bricks of a ``BRICKS``-th of a shard: hash buckets of some ``BUCKET_GROUPS`` groups,
   each best-fit decreasing in a task. A group as large as a brick is one. What any level leaves is at
   most two bricks for each full one and one for each bucket, so further levels (none below hundreds of
   millions of groups) bring it to ``MOST_BRICKS``, whatever the input.
3. The bricks, of bounded number, are packed into shards the same way: for a number of shards with the
   least capacity, found by bisection, for which best fit needs no more; for a given capacity into as few
   shards as best fit needs. A group of more than a mean shard has a shard of its own and the others share the rest. Last,
   bricks move from the fullest to the emptiest shard while that levels them.
4. Rows join their group's shard. Slots are numbered within blocks of the written rows, and each block
   starts after those before it, so that neither a shard nor a group of copies meets in one task.

Defined results: null text counts as empty (size 8, with the empty texts); null and repeated ids are
rows like others; repeated rows are copies and go together; very long texts are one group each; an
empty table gives no rows; other columns are ignored. Shards may be empty where there are fewer groups.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.balanced import Tree
from barloom.llm.common import written
from barloom.llm.exact_dedup import md5_128

BRICKS = 256
BUCKET_GROUPS = 50_000
MOST_BRICKS = 50_000
BLOCK = 65_536


def best_fit(sizes: Iterable[int], capacity: int, bins: int | None = None) -> list[int] | None:
    """The bin of each size, sizes in descending order; None where ``bins`` do not suffice.

    The tightest bin that has room is taken, of equal ones the first; a new one is opened where none has.
    A size over the capacity has a bin of its own.
    """
    room, out, opened = Tree(), [], 0
    for size in sizes:
        found = room.at_least((size, -1))
        if found is None:
            if bins is not None and opened == bins:
                return None
            found, opened = (max(capacity, size), opened), opened + 1
        else:
            room.remove(found)
        left, at = found[0] - size, found[1]
        room.add((left, at))
        out.append(at)
    return out


def level(sizes: list[int], bins: list[int], n: int) -> list[int]:
    """bins after moves of items from the fullest to the emptiest bin, each of which brings the two closer."""
    bins = list(bins)
    total, held = [0] * n, [[] for _ in range(n)]
    for i, b in enumerate(bins):
        total[b] += sizes[i]
        insort(held[b], (sizes[i], i))
    while True:
        full, empty = max(range(n), key=lambda b: (total[b], -b)), min(range(n), key=lambda b: (total[b], b))
        gap = total[full] - total[empty]
        # the largest item of no more than half the gap, else the smallest one below the gap
        at = bisect_right(held[full], (gap // 2, len(sizes)))
        at -= at > 0
        if not held[full] or not 0 < held[full][at][0] < gap:
            return bins
        size, i = held[full].pop(at)
        insort(held[empty], (size, i))
        total[full] -= size
        total[empty] += size
        bins[i] = empty


def balanced(sizes: list[int], n: int) -> list[int]:
    """The bin of each size, of n whose sums are near equal; sizes in descending order."""
    total, alone = sum(sizes), 0
    while alone < min(n - 1, len(sizes)) and sizes[alone] * (n - alone) >= total:
        total -= sizes[alone]
        alone += 1
    rest, bins = sizes[alone:], n - alone
    if not rest:
        return list(range(alone))
    low, high = max(rest[0], -(-total // bins)), rest[0] - (-total // bins)
    best = best_fit(rest, high, bins)
    while low < high:
        middle = (low + high) // 2
        got = best_fit(rest, middle, bins)
        if got is None:
            low = middle + 1
        else:
            best, high = got, middle
    return [*range(alone), *(alone + b for b in level(rest, best, bins))]


def _bricks(groups: DataFrame, capacity: int, n: int, salt: int) -> DataFrame:
    """id, size, brick of groups (id binary, size): bricks of a bucket by best fit; a large group is a brick alone."""
    buckets = max(1, -(-n // BUCKET_GROUPS))
    dealt = groups.withColumn("bucket", F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(buckets)))

    def pack(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "id"], ascending=[False, True], kind="stable", ignore_index=True)
        brick = np.array(best_fit(pdf["size"].tolist(), capacity), dtype=np.int64)
        return pd.DataFrame({"id": pdf["id"], "size": pdf["size"], "brick": (int(key[0]) << 32) + brick})

    return dealt.groupBy("bucket").applyInPandas(pack, "id binary, size long, brick long")


def assign(groups: DataFrame, shards: int | None = None, capacity: int | None = None) -> DataFrame:
    """id (binary), shard of groups (id, size): near equal shards of a given number, or as few of a capacity as best fit needs."""
    if (shards is None) == (capacity is None):
        raise ValueError("give shards or capacity")
    if (shards or capacity) < 1:
        raise ValueError("at least one shard, of at least one byte")
    spark = groups.sparkSession
    groups = written(groups.select("id", F.col("size").cast("long").alias("size")), "groups")
    seen = groups.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total")).first()
    brick_size = max(1, (seen["total"] or 0) // (shards * BRICKS) if shards else capacity // BRICKS)
    packed = written(_bricks(groups, brick_size, seen["n"], 0), "bricks")
    placed, salt = packed.select("id", F.col("brick").alias("top")), 0
    sums = packed.groupBy("brick").agg(F.sum("size").alias("size"))
    while shards and (n := sums.count()) > MOST_BRICKS:
        salt += 1
        higher = written(_bricks(sums.select(F.col("brick").cast("string").cast("binary").alias("id"), "size"), brick_size, n, salt), "bricks")
        up = higher.select(F.col("id").cast("string").cast("long").alias("top"), F.col("brick").alias("higher"))
        placed = written(placed.join(up, "top").select("id", F.col("higher").alias("top")), "placed")
        sums = higher.groupBy("brick").agg(F.sum("size").alias("size"))
    if shards:
        items = sorted(((r["size"], r["brick"]) for r in sums.collect()), key=lambda x: (-x[0], x[1]))  # MOST_BRICKS at most
        of = balanced([s for s, _ in items], shards)
        table = spark.createDataFrame([(b, int(s)) for (_, b), s in zip(items, of, strict=True)], "top long, shard int")
        return placed.join(F.broadcast(table), "top").select("id", "shard")
    # the number of shards grows with the input here: one more round in buckets, and shards are numbered by blocks
    higher = written(_bricks(sums.select(F.col("brick").cast("string").cast("binary").alias("id"), "size"), capacity, sums.count(), 1), "shards")
    bucket = F.shiftright("brick", 32)
    first = higher.groupBy(bucket.alias("bucket")).agg((F.max("brick").bitwiseAND(0xFFFFFFFF) + 1).alias("n")).withColumn("start", F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    up = higher.withColumn("bucket", bucket).join(first, "bucket").select(F.col("id").cast("string").cast("long").alias("top"), (F.coalesce("start", F.lit(0)) + F.col("brick").bitwiseAND(0xFFFFFFFF)).cast("int").alias("shard"))
    return placed.join(up, "top").select("id", "shard")


def shard_documents(docs: DataFrame, shards: int | None = 24, capacity: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, size (UTF-8 bytes and 8), text_crc32, law ("bytes"), shard, slot (gapless from 0), grown_shard (null)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    thin = docs.select(F.col(id_col).alias("id"), text.alias("text")).select("id", (F.octet_length("text") + 8).cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).alias("crc"), md5_128(F.col("text")).alias("h"))
    thin = written(thin, "sizes")
    place = assign(thin.groupBy(F.col("h").alias("id")).agg(F.sum("size").alias("size")), shards, capacity).withColumnRenamed("id", "h")
    # where a row stands in the written files: blocks of these are numbered one by one
    where = thin.select("*", F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    placed = written(where.join(place, "h").select("id", "size", "crc", "shard", "file", F.floor(F.col("row") / BLOCK).alias("block"), "row"), "sharded")
    before = Window.partitionBy("shard").orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "file", "block").agg(F.count(F.lit(1)).alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    numbered = placed.withColumn("k", F.row_number().over(Window.partitionBy("shard", "file", "block").orderBy("row")))
    out = numbered.join(starts, ["shard", "file", "block"])
    return out.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("k") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
