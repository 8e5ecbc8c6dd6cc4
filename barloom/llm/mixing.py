"""Mixing of sources to target weights by a multivariate-hypergeometric splitting tree.

* A document's size is its number of words. Sources, in code-point order with null last, take the
  weights in turn and share ``share`` times all words; a target stops at ``max_repeat`` times its
  source's words and the excess is shared again by weight until no target is above.
* A hash of id and text puts a source's documents in a random order, cut into blocks of about
  ``block_words`` words (equal ranges of the hash), and into ``shard_blocks`` for each shard at least: the
  permuted blocks. A shard so gets some tens of blocks of every source, near the source's share of the mix; a
  block of a small source may hold one document or none.
* A binary tree splits the blocks of all sources among the output shards: at each node the left half's
  share of every source is one draw of the multivariate hypergeometric distribution, so every shard gets
  exact quotas of blocks, and takes that many of each source's permuted blocks; no two shares a block.
* A shard draws from its own blocks only: as many whole rounds of them as the source's target holds, and of
  the rest of the target its part by words (integers that add up exactly). For that part it takes its
  blocks in order, of the last block the leading documents, of the last document its leading words (``cut``)
  or all or nothing of it. All copies of a document are in the shard that has its block. Which documents a source gives, and how often, so follows from the tree.
* Inside a shard a hash of document and copy gives the order; ``mixed`` brings the rows into it.

Only one row per source reaches the driver (at most ``max_sources``, else ValueError). Block sums are
pre-aggregated by task, running sums go over the blocks of one source in one shard, and documents are
numbered only in the one block of source and shard where the drawing stops. No join is told to
broadcast: the tables of sources (one row each) and of stops (one for each source and shard) are written,
and Spark goes by their size; a hot source meets them by (source, shard).

Defined results: null or empty text has size 0 and is never drawn in words; a null source is a source
of its own; null and repeated ids are told apart by their texts, and rows alike in both are drawn one by
one, any of them as well as the other; very long texts are cut or taken like others; an empty table gives
no rows; other columns pass through ``draws``.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import text_or_empty, written

WORD = r"[^\x20\x09-\x0D]+"
SPACE_BITS = 31
OUTPUTS = ("mix_size", "mix_source_size", "mix_target", "mix_taken", "mix_draws")
_DRAWS = "array<struct<copy:int,shard:int,place:bigint,words:bigint>>"


def targets(sizes: list[float], weights: tuple[float, ...], share: float, max_repeat: float) -> list[float]:
    """Weighted shares of share * sum(sizes), capped at max_repeat * size, excess reshared by weight."""
    out, free = [0.0] * len(sizes), list(range(len(sizes)))
    w = [float(weights[i % len(weights)]) for i in range(len(sizes))]
    left = share * sum(sizes)
    while free:
        unit = left / sum(w[i] for i in free)
        full = [i for i in free if unit * w[i] > max_repeat * sizes[i]]
        if not full:
            for i in free:
                out[i] = unit * w[i]
            break
        for i in full:
            out[i] = float(max_repeat * sizes[i])
            left -= out[i]
        gone = set(full)
        free = [i for i in free if i not in gone]
    return out


def splitting_tree(blocks: list[int], shards: int, seed: int) -> np.ndarray:
    """Quotas [shard, source]: rows sum to near-equal totals, columns to the sources' block counts."""
    rng = np.random.default_rng(seed)

    def split(counts: np.ndarray, n: int) -> list[np.ndarray]:
        if n == 1:
            return [counts]
        total, half = int(counts.sum()), n // 2
        take = (total * half + n // 2) // n
        left = rng.multivariate_hypergeometric(counts, take, method="marginals") if total else counts * 0
        return split(left, half) + split(counts - left, n - half)

    return np.array(split(np.asarray(blocks, dtype=np.int64), shards), dtype=np.int64).reshape(shards, len(blocks))


def draws(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    max_repeat: int = 2,
    seed: int = 11,
    shards: int = 64,
    block_words: int = 1 << 16,
    shard_blocks: int = 32,
    cut: bool = True,
    max_sources: int = 100_000,
    keep: tuple[str, ...] | None = None,
) -> DataFrame:
    """docs with mix_size, mix_source_size, mix_target, mix_taken and mix_draws, in place of columns so named.

    mix_draws is an array of (copy, shard, place, words): which shard takes this document, where in the
    shard's order, and how many of its words. keep: the columns to hand on, all by default; the rows are
    written with their sizes once, so leave the text out where only the plan is asked for.
    """
    spark = docs.sparkSession
    names_in = [c for c in (docs.columns if keep is None else keep) if c not in OUTPUTS]
    own_names = [f"__own{i}" for i in range(len(names_in))]
    text = text_or_empty(text_col)
    text_hash = F.xxhash64(text)
    rows = written(
        docs.select(
            *[F.col(c).alias(n) for c, n in zip(names_in, own_names, strict=True)],
            F.col(source_col).cast("string").alias("source"),
            F.xxhash64(F.lit(seed), F.col(id_col), text_hash).bitwiseAND(F.lit((1 << SPACE_BITS) - 1)).alias("u"),
            F.xxhash64(F.lit(seed + 1), F.col(id_col), text_hash).alias("h"),
            F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        ),
        "sizes",
    )
    sums = rows.groupBy("source").agg(F.sum("size").alias("n")).limit(max_sources + 1).collect()
    if len(sums) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    sums.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [int(r["n"]) for r in sums]
    goal = targets([float(x) for x in sizes], weights, share, max_repeat)
    block_words = max(block_words, sum(sizes) >> 28)
    n_blocks = [max(shards * shard_blocks, math.ceil(x / block_words)) for x in sizes]
    rounds = [min(max_repeat, int(g // x)) if x else 0 for g, x in zip(goal, sizes, strict=True)]
    rest = [max(0, round(g) - r * x) for g, r, x in zip(goal, rounds, sizes, strict=True)]
    quotas = splitting_tree(n_blocks, shards, seed) if sums else np.zeros((shards, 0), dtype=np.int64)
    ends = np.cumsum(quotas, axis=0)
    plan = [(i, sums[i]["source"], sizes[i], float(goal[i]), n_blocks[i], rounds[i], rest[i], ends[:, i].tolist()) for i in range(len(sums))]
    sources = written(spark.createDataFrame(plan, "s int, s_source string, s_size long, s_target double, s_blocks long, s_rounds int, s_rest long, s_ends array<long>"), "sources")

    dealt = rows.join(sources, F.col("source").eqNullSafe(F.col("s_source")))
    dealt = dealt.withColumn("block", F.shiftright(F.col("u") * F.col("s_blocks"), SPACE_BITS)).withColumn("shard", F.size(F.filter("s_ends", lambda e: e <= F.col("block"))))

    by_block = written(dealt.groupBy("s", "s_size", "s_rest", "shard", "block").agg(F.sum("size").alias("n")), "blocks")
    held = by_block.groupBy("s", "s_size", "s_rest", "shard").agg(F.sum("n").alias("held"))
    upto = F.sum("held").over(Window.partitionBy("s").orderBy("shard")).cast("decimal(38,0)")
    parts = held.withColumn("upto", upto).filter("s_size > 0").select("s", "shard", F.expr("(s_rest * upto) div s_size - (s_rest * (upto - held)) div s_size").alias("part"))
    order = Window.partitionBy("s", "shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    stops = by_block.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0))).join(parts, ["s", "shard"]).filter("before < part and part <= before + n")
    stops = stops.groupBy("s", "shard").agg(F.min(F.struct("block", (F.col("part") - F.col("before")).alias("words"))).alias("stop"))
    # a shard without a stop draws nothing of the rest
    stops = written(stops.select(F.col("s").alias("e_s"), F.col("shard").alias("e_shard"), F.col("stop.block").alias("e_block"), F.col("stop.words").alias("e_words")), "stops")

    placed = dealt.join(stops, (F.col("s") == F.col("e_s")) & (F.col("shard") == F.col("e_shard")), "left")
    at_stop = F.coalesce(F.col("block") == F.col("e_block"), F.lit(False))
    before_stop = F.coalesce(F.col("block") < F.col("e_block"), F.lit(False))
    whole = placed.filter(~at_stop).withColumn("last", F.when(before_stop, F.col("size")).otherwise(F.lit(0)))
    start = F.coalesce(F.sum("size").over(Window.partitionBy("s", "shard").orderBy("u", "h").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.greatest(F.lit(0), F.least(F.col("size"), F.col("e_words") - F.col("start")))
    left = left if cut else F.when(2 * left >= F.col("size"), F.col("size")).otherwise(F.lit(0))
    edge = placed.filter(at_stop).withColumn("start", start).withColumn("last", left).drop("start")
    taken = whole.unionByName(edge)

    def draw(copy: Column, words: Column) -> Column:
        return F.struct(copy.cast("int").alias("copy"), F.col("shard").cast("int").alias("shard"), F.xxhash64(F.lit(seed + 2), F.col("h"), copy.cast("long")).alias("place"), words.cast("long").alias("words"))

    rounds_of = F.when((F.col("s_rounds") > 0) & (F.col("size") > 0), F.transform(F.sequence(F.lit(0), F.greatest(F.col("s_rounds") - 1, F.lit(0))), lambda r: draw(r, F.col("size")))).otherwise(F.array().cast(_DRAWS))
    extra = F.when(F.col("last") > 0, F.array(draw(F.col("s_rounds"), F.col("last")))).otherwise(F.array().cast(_DRAWS))
    return taken.select(
        *[F.col(c).alias(n) for c, n in zip(own_names, names_in, strict=True)],
        F.col("size").alias("mix_size"),
        F.col("s_size").alias("mix_source_size"),
        F.col("s_target").alias("mix_target"),
        (F.col("s_rounds") * F.col("size") + F.col("last")).cast("long").alias("mix_taken"),
        F.concat(rounds_of, extra).alias("mix_draws"),
    )


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", placed: bool = False, **how) -> DataFrame:
    """The mix itself: one row per drawn copy, with the columns of docs, each shard's rows in its shuffled order.

    Whole documents only (``cut`` off unless asked for). placed adds mix_copy, mix_shard and mix_place, the
    order in the shard.
    """
    how.setdefault("cut", False)
    own = [f"c{i}" for i in range(len(docs.columns))]
    drawn = draws(docs.toDF(*own), *(own[docs.columns.index(c)] for c in (id_col, text_col, source_col)), **how).select(*own, F.explode("mix_draws").alias("d"))
    drawn = drawn.select(*own, *[F.col(f"d.{x}").alias(f"mix_{x}") for x in ("copy", "shard", "place")])
    drawn = drawn.repartition("mix_shard").sortWithinPartitions("mix_shard", "mix_place")
    extra = ("mix_copy", "mix_shard", "mix_place") if placed else ()
    return drawn.select(*[F.col(c).alias(n) for c, n in zip(own, docs.columns, strict=True)], *extra)
