"""Stupid-backoff language-model scores, by joining n-gram count tables that are partitioned by hash.

* Documents are packed into blocks of about BLOCK_BYTES of text, one table row each: the hashes of the block's
  words, frequent ones first, and the words by their places there. Texts are read once and go no further.
* Order by order, a block is exploded into its n-grams: sorted distinct hashes with counts, cut into hash
  partitions by their leading bits. Rows (partition, block) hold the packed hashes, so the n-grams of the
  whole corpus are shuffled once, at about five bytes each. A block has rows only for partitions that it has
  n-grams of, so rows never outnumber n-grams.
* Every partition's rows together make the count table of that partition; it is joined to the same
  rows and the totals go back by block. A frequent n-gram counts once per block, so no partition is hot.
  An order's shuffle is deleted as soon as its totals are written, so disk holds one order's n-grams at a time.
* A block's totals are joined to its words, and the logarithms are summed per document.

An n-gram is known by a hash of LEAST_BITS bits, or BITS_OVER more than the token count needs if that is
more (64 at most): at a billion tokens one lookup in ten million meets another n-gram's count. Rows of one
n-gram each, grouped and joined as DataFrames, would be exact but write 24 bytes for every n-gram of a block,
over twice the disk that there is (README).

The score of a word is c(abc) / c(ab), else ALPHA c(bc) / c(b), else ALPHA^2 c(c) / N, with half a count for
an unseen word; at the text's start the orders that there are. Counts come from all documents (or from
``corpus``); the others_log_score of a document leaves its own occurrences out.

Defined results: null, empty and wordless texts have no tokens, scores 0 and null mean and perplexity;
rows repeated with the same id are documents of their own, each of the other's corpus; very long texts are
one block each and scored whole; equal texts have equal scores; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import shuffles_deleted, slices, written
from barloom.llm.shingles import mix, words

ORDER, ALPHA = 3, 0.4
BLOCK_BYTES = 1 << 23
PARTITION_GRAMS = 1 << 21  # of one order
LEAST_BITS, BITS_OVER = 56, 20
_LIMITS = np.array([1 << 8 * k for k in range(1, 8)], dtype=np.uint64)
_ALL = np.zeros(1, dtype=np.int64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def grams(text: np.ndarray, words: np.ndarray, order: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the n-gram of this order that ends at each word, whether there is one), from each word's text and hash."""
    value = words
    for _ in range(order - 1):
        value = np.concatenate([np.zeros(min(1, len(words)), np.uint64), value[:-1]]) * _STEP + words
    there = np.zeros(len(words), dtype=bool)
    if len(words) >= order:
        there[order - 1 :] = text[order - 1 :] == text[: len(text) - order + 1]
    return mix(value + np.uint64(order)) >> np.uint64(64 - bits), there


def _widths(x: np.ndarray, begin: np.ndarray) -> list[int]:
    """Bytes that the largest number of each cut of x needs."""
    return (np.searchsorted(_LIMITS, np.maximum.reduceat(x, begin), side="right") + 1).tolist()


def press(x: np.ndarray, begin: np.ndarray = _ALL) -> list[bytes]:
    """For each cut of x, from its beginning to the next: first the lowest byte of each number, then the next, as many as the largest needs, compressed."""
    import zstandard

    if not len(x):
        return []
    squeeze, x = zstandard.ZstdCompressor(level=1).compress, x.astype(np.uint64)
    raw = x.view(np.uint8).reshape(-1, 8)
    return [bytes([w]) + squeeze(raw[b:e, :w].T.tobytes()) for b, e, w in zip(begin.tolist(), [*begin[1:].tolist(), len(x)], _widths(x, begin), strict=True)]


def unpress(pressed: list[bytes]) -> np.ndarray:
    """The numbers of all cuts, one after the other."""
    import zstandard

    expand = zstandard.ZstdDecompressor().decompress
    planes = [np.frombuffer(expand(b[1:]), dtype=np.uint8).reshape(b[0], -1) for b in pressed]
    out, at = np.zeros((sum(p.shape[1] for p in planes), 8), dtype=np.uint8), 0
    for p in planes:
        out[at : at + p.shape[1], : len(p)] = p.T
        at += p.shape[1]
    return out.view(np.uint64).ravel()


def pack_sorted(x: np.ndarray, begin: np.ndarray = _ALL) -> list[bytes]:
    """For each cut of ascending numbers: the first, and gaps, each of as many bytes as the largest gap needs."""
    if not len(x):
        return []
    gaps = np.zeros_like(x)
    gaps[1:] = x[1:] - x[:-1]
    gaps[begin] = 0
    raw = gaps.view(np.uint8).reshape(-1, 8)
    return [bytes([w]) + x[b : b + 1].tobytes() + raw[b + 1 : e, :w].tobytes() for b, e, w in zip(begin.tolist(), [*begin[1:].tolist(), len(x)], _widths(gaps, begin), strict=True)]


def packed_lengths(packed: list[bytes]) -> np.ndarray:
    return np.array([(len(b) - 9) // b[0] + 1 for b in packed], dtype=np.int64)


def unpack_sorted(packed: list[bytes]) -> np.ndarray:
    """The numbers of all cuts, one after the other."""
    lengths = packed_lengths(packed)
    begin = np.cumsum(lengths) - lengths
    out = np.zeros((int(lengths.sum()), 8), dtype=np.uint8)
    for b, at, k in zip(packed, begin.tolist(), lengths.tolist(), strict=True):
        out[at] = np.frombuffer(b, dtype=np.uint8, count=8, offset=1)
        out[at + 1 : at + k, : b[0]] = np.frombuffer(b, dtype=np.uint8, offset=9).reshape(-1, b[0])
    gaps = out.view(np.uint64).ravel()
    sums = np.cumsum(gaps, dtype=np.uint64)
    sums -= np.repeat(sums[begin] - gaps[begin], lengths)
    return sums


def text_blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(block, ids, lengths, known, places, n_tokens): words of each text, hashes of the block's distinct words, place of every word among them."""
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(kind)), *T._parse_datatype_string("lengths binary, known binary, places binary, n_tokens long").fields])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0

        def row() -> pa.RecordBatch:
            got = list(words([t.decode("utf-8", "replace") for t in texts]))
            lengths = np.bincount(np.concatenate([w.text for w in got]), minlength=len(texts))
            known, place, times = np.unique(np.concatenate([w.hash for w in got]), return_inverse=True, return_counts=True)
            order = np.argsort(-times, kind="stable")
            rank = np.empty_like(order)
            rank[order] = np.arange(len(order))
            values = [b"".join(press(lengths)), known[order].tobytes(), b"".join(press(rank[place]))]
            return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().int >> 65], pa.int64()), pa.array([pa.array(ids, id_type).to_pylist()], pa.list_(id_type)), *(pa.array([v], pa.binary()) for v in values), pa.array([len(place)], pa.int64())], names=schema.names)

        id_type = None
        for batch in slices(batches):
            id_type = batch.column(0).type
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                ids.append(i), texts.append(t or b"")
                size += len(texts[-1])
                if size >= BLOCK_BYTES:
                    yield row()
                    ids, texts, size = [], [], 0
        if ids:
            yield row()

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(pack, schema)


def _words(lengths: bytes, known: bytes, places: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of every word of a block."""
    lengths = unpress([lengths]).astype(np.int64)
    return np.repeat(np.arange(len(lengths)), lengths), np.frombuffer(known, dtype=np.uint64)[unpress([places] if places else []).astype(np.int64)]


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, alpha: float = ALPHA, corpus: DataFrame | None = None) -> DataFrame:
    """One row per document: id, n_tokens, log_score (sum of natural logarithms), mean_log, perplexity, others_log_score.

    corpus: what to count instead of docs themselves, with the same columns; nothing is left out then.
    """
    spark = docs.sparkSession
    blocks = text_blocks(docs, id_col, text_col).withColumn("scored", F.lit(True))
    if corpus is not None:
        blocks = blocks.unionByName(text_blocks(corpus, id_col, text_col).withColumn("scored", F.lit(False)))
    with shuffles_deleted(spark):
        blocks = written(blocks, "blocks")
        counted = blocks if corpus is None else blocks.filter("not scored")
        total, n_blocks = counted.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.count(F.lit(1))).first()
    bits = min(64, max(LEAST_BITS, total.bit_length() + BITS_OVER))
    split = (total // PARTITION_GRAMS).bit_length()
    apart = corpus is not None

    def explode(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block, scored, *packed = (c[i].as_py() for c in batch.columns)
                value, there = grams(*_words(*packed), n, bits)
                known, times = np.unique(value[there], return_counts=True)
                parts, begin = np.unique(known >> np.uint64(bits - split) if split else np.zeros(len(known), np.uint64), return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(parts.astype(np.int64)), pa.array([block] * len(parts), pa.int64()), pa.array([scored] * len(parts), pa.bool_()), pa.array(pack_sorted(known, begin), pa.binary()), pa.array(press(times, begin), pa.binary())], names=["part", "block", "scored", "grams", "times"])

    def join_counts(rows: pa.Table) -> pa.Table:
        packed = rows["grams"].to_pylist()
        known, lengths = unpack_sorted(packed), packed_lengths(packed)
        times, scored = unpress(rows["times"].to_pylist()), rows["scored"].to_numpy()
        asked = np.repeat(scored, lengths)
        if apart:
            times[asked] = 0
        table, place = np.unique(known, return_inverse=True)
        sums = np.bincount(place, times, len(table)).astype(np.uint64)[place[asked] if apart else place]
        at = pa.array(np.flatnonzero(scored))
        return pa.table({"block": rows["block"].take(at), "part": rows["part"].take(at), "totals": pa.array(press(sums, np.cumsum(lengths[scored]) - lengths[scored]), pa.binary())})

    def totals(n: int) -> DataFrame:
        asked = blocks.select("block", "scored", "lengths", "known", "places").mapInArrow(functools.partial(explode, n=n), "part long, block long, scored boolean, grams binary, times binary")
        told = asked.repartition(min(1 << split, 1 << 16), "part").groupBy("part").applyInArrow(join_counts, "block long, part long, totals binary")
        with shuffles_deleted(spark):
            return written(told, "totals").withColumn("n", F.lit(n))

    replies = functools.reduce(DataFrame.unionByName, [totals(n) for n in range(1, order + 1)])
    tasks = max(1, min(n_blocks, 1 << 16))  # a block is scored by itself, so more blocks to a task take more time and not more memory
    together = replies.repartition(tasks, "block").groupBy("block").agg(F.collect_list(F.struct("n", "part", "totals")).alias("replies"))  # a row for each order and partition that the block has n-grams of
    schema = T.StructType([docs.schema[id_col], *T._parse_datatype_string("n_tokens long, log_score double, mean_log double, perplexity double, others_log_score double").fields])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                text, hashes = _words(*(batch.column(k)[i].as_py() for k in (1, 2, 3)))
                lengths = unpress([batch.column(1)[i].as_py()]).astype(np.int64)
                answers = batch.column(4)[i].values
                told, part, totals = ([], [], None) if answers is None else (answers.field("n").to_numpy(), answers.field("part").to_numpy(), answers.field("totals"))
                every, others = [], []
                for n in range(1, order + 1):
                    value, there = grams(text, hashes, n, bits)
                    c, own = np.zeros(len(text)), np.zeros(len(text))
                    place = np.unique(value[there], return_inverse=True)[1]
                    if len(place):
                        at = np.flatnonzero(told == n)
                        c[there] = unpress(totals.take(pa.array(at[np.argsort(part[at])])).to_pylist())[place].astype(float)
                        if not apart:
                            own[there] = _times(place * len(lengths) + text[there])
                    every.append(c), others.append(c - own)
                sums = np.bincount(text, backoff(every, np.full(len(text), total), alpha), len(lengths))
                rest = np.bincount(text, backoff(others, total - (0 if apart else lengths[text]), alpha), len(lengths))
                mean = [s / k if k else None for s, k in zip(sums.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[i].values, pa.array(lengths, pa.int64()), pa.array(sums, pa.float64()), pa.array(mean, pa.float64()), pa.array([None if m is None else float(np.exp(-m)) for m in mean], pa.float64()), pa.array(rest, pa.float64())], names=schema.names)

    return blocks.filter("scored").select("block", "ids", "lengths", "known", "places").repartition(tasks, "block").join(together, "block", "left").select("ids", "lengths", "known", "places", "replies").mapInArrow(score, schema)


def _times(x: np.ndarray) -> np.ndarray:
    """How often each number occurs, at every place of it."""
    _, place, times = np.unique(x, return_inverse=True, return_counts=True)
    return times[place]


def backoff(counts: list[np.ndarray], tokens: np.ndarray, alpha: float) -> np.ndarray:
    """Logarithm of every word's score from the counts, by order, of the n-grams that end at it."""
    tokens = np.broadcast_to(tokens, counts[0].shape)
    logs = np.log(np.where(counts[0] > 0, counts[0], 0.5) / np.maximum(tokens, 1)) + (len(counts) - 1) * np.log(alpha)
    for n in range(1, len(counts)):
        context = np.concatenate([[0.0], counts[n - 1][:-1]]) if len(tokens) else counts[n - 1]
        seen = (counts[n] > 0) & (context > 0)
        logs[seen] = np.log(counts[n][seen] / context[seen]) + (len(counts) - 1 - n) * np.log(alpha)
    return logs
