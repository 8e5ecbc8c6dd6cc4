"""Word shingles of many texts at once: hashes, counts and TF-IDF weights as flat arrays.

Words are maximal runs of ASCII letters and digits and of non-ASCII bytes in the lower-cased UTF-8 text.
A shingle is WIDTH words in a row; a text of fewer words has one shingle, of all its words.

The IDF of a word is FLOOR + (1 - FLOOR) * ln(N / df) / ln(1 / RARE), with df no less than RARE * N, so
words of fewer documents weigh 1 and words of all documents FLOOR; a shingle's is the mean over its
words. Its weight in a text is its count there times its IDF. Only words in at least RARE * N documents
need a place in the table, and there are at most (mean distinct words per document) / RARE of them,
whatever N is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import slices, written

WIDTH = 5
RARE = 1e-3
FLOOR = 0.25
BLOCK_BYTES = 1 << 20
_WORD_BYTES = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 2 * BLOCK_BYTES)
        _powers[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, base, dtype=np.uint64)])) for base in (_P, _P_INVERSE)]
    return _powers[0][:n], _powers[1][:n]


@dataclass
class Words:
    """Words of a block of texts: text number and hash of each, in order."""

    first: int
    end: int
    text: np.ndarray
    hash: np.ndarray

    def bounds(self) -> np.ndarray:
        """Where each text's words begin, and the end."""
        return np.searchsorted(self.text, np.arange(self.first, self.end + 1))


def words(texts: list[str | None], block_bytes: int = BLOCK_BYTES) -> Iterator[Words]:
    def block(first: int, parts: list[bytes], starts: list[int]) -> Words:
        data = np.frombuffer(b" " + b" ".join(parts) + b" ", dtype=np.uint8)
        inside = data != 32
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        begin, stop = edge[0::2], edge[1::2]
        up, down = _power_tables(len(data))
        total = np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up)
        value = mix((total[stop - 1] - total[begin - 1]) * down[begin])
        return Words(first, first + len(parts), first + np.searchsorted(np.array(starts), begin, side="right") - 1, value)

    parts, starts, at, first = [], [], 1, 0
    for i, t in enumerate(texts):
        part = (t or "").lower().encode("utf-8", "replace").translate(_WORD_BYTES)
        if parts and at + len(part) > block_bytes:
            yield block(first, parts, starts)
            parts, starts, at, first = [], [], 1, i
        parts.append(part), starts.append(at)
        at += len(part) + 1
    if parts:
        yield block(first, parts, starts)


def distinct(group: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of one of each (group, value), ascending, and how often it occurs. 64-bit keys stand for pairs."""
    if not len(value):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    key = mix(value + group.astype(np.uint64) * _P)
    order = np.argsort(key)
    new = np.flatnonzero(np.concatenate([[True], key[order[1:]] != key[order[:-1]]]))
    count = np.zeros(len(value), dtype=np.int64)
    count[order[new]] = np.diff(np.append(new, len(value)))
    at = np.flatnonzero(count)
    return at, count[at]


@dataclass
class Idf:
    """IDF of the frequent words, by sorted hash; all others weigh 1."""

    hash: np.ndarray
    weight: np.ndarray

    def of(self, value: np.ndarray) -> np.ndarray:
        out = np.ones(len(value), dtype=np.float32)
        if len(self.hash):
            at = np.minimum(np.searchsorted(self.hash, value), len(self.hash) - 1)
            hit = self.hash[at] == value
            out[hit] = self.weight[at[hit]]
        return out


@dataclass
class Shingles:
    """Distinct shingles of a block of texts with their weights, texts in order."""

    first: int
    end: int
    text: np.ndarray
    hash: np.ndarray
    weight: np.ndarray
    times: np.ndarray  # how often each occurs in its text
    sequence: np.ndarray  # [text, 2], 128-bit hash of the whole word sequence


def shingles(texts: list[str | None], idf: Idf, block_bytes: int = BLOCK_BYTES) -> Iterator[Shingles]:
    for w in words(texts, block_bytes):
        bounds, weight = w.bounds(), idf.of(w.hash)
        lengths = np.diff(bounds)
        n = max(len(w.hash) - WIDTH + 1, 0)
        value, mean = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=np.float32)
        for k in range(WIDTH):
            value = value * _M1 + w.hash[k : n + k]
            mean += weight[k : n + k]
        mean /= WIDTH
        whole = w.text[:n] == w.text[WIDTH - 1 :] if n else np.zeros(0, dtype=bool)
        text, value, mean = w.text[:n][whole], mix(value[whole]), mean[whole]
        short = np.flatnonzero((lengths > 0) & (lengths < WIDTH))
        if len(short):
            extra_value, extra_mean = [], []
            for i in short.tolist():
                v = np.zeros(1, dtype=np.uint64)
                for h in w.hash[bounds[i] : bounds[i + 1]]:
                    v = v * _M2 + h
                extra_value.append(mix(v)[0]), extra_mean.append(weight[bounds[i] : bounds[i + 1]].mean())
            text = np.concatenate([text, w.first + short])
            order = np.argsort(text, kind="stable")
            text, value, mean = text[order], np.concatenate([value, np.array(extra_value, dtype=np.uint64)])[order], np.concatenate([mean, np.array(extra_mean, dtype=np.float32)])[order]
        at, count = distinct(text, value)
        sequence = np.zeros((w.end - w.first, 2), dtype=np.uint64)
        place = np.arange(len(w.hash)) - np.repeat(bounds[:-1], lengths)
        busy = np.flatnonzero(lengths)
        if len(busy):
            up, down = _power_tables(int(lengths.max()))
            sequence[busy, 0] = np.add.reduceat(w.hash * up[place], bounds[:-1][busy])
            sequence[busy, 1] = np.add.reduceat(mix(w.hash + _M2) * down[place], bounds[:-1][busy])
        yield Shingles(w.first, w.end, text[at], value[at], mean[at] * count.astype(np.float32), count, sequence)


def fit_idf(docs: DataFrame, text_col: str = "text") -> Idf:
    """Document frequencies over all rows; the table keeps the words in RARE of the documents or more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, held, size = 0, [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            value, times = np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held])
            known, place = np.unique(value, return_inverse=True)
            return known, np.bincount(place, times, len(known)).astype(np.int64)

        for batch in slices(batches):
            for w in words(batch.column(0).to_pylist()):
                at, _ = distinct(w.text, w.hash)
                n += int((np.diff(w.bounds()) > 0).sum())
                known, times = np.unique(w.hash[at], return_counts=True)
                held.append((known, times))
                size += len(known)
                if size > 2_000_000:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > 1_000_000:
                        yield rows(*held[0])
                        held, size = [], 0
        if held:
            yield rows(*merged())
        yield rows(np.zeros(1, dtype=np.uint64), np.array([n]))

    def rows(value: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(n.astype(np.int64))], names=["word", "n"])

    counts = docs.select(F.col(text_col).cast("string")).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = written(counts, "df")
    total = counts.filter("word = 0").collect()
    n = int(total[0]["n"]) if total else 0
    frequent = counts.filter((F.col("word") != 0) & (F.col("n") >= max(2, int(np.ceil(RARE * n))))).toPandas()
    value, df = frequent["word"].to_numpy(dtype=np.int64).view(np.uint64), frequent["n"].to_numpy(dtype=float)
    order = np.argsort(value)
    share = np.log(n / np.maximum(df, RARE * n)) / np.log(1 / RARE) if n else df
    return Idf(value[order], (FLOOR + (1 - FLOOR) * np.clip(share, 0, 1)).astype(np.float32)[order])
