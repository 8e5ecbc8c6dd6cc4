"""Spelling variant grouping: Aho-Corasick automata over halves of words, distance one.

If two words differ by exactly one inserted, deleted or replaced code point, then of a word cut in two
one segment stands unchanged in the other word: the first at its start, or the second at its end.

1. ``word_counts``: runs are counted in each task by word number and arrays; only words and counts are shuffled.
2. Every word gives its two segments, keyed by (its length, which end, segment), and asks for the keys that
   words of its length or one more or less would have. A key that more than ``MOST_HOLDERS`` words hold is
   taken apart: the part outside the segment is cut in two again, and one of its halves is unchanged too
   (its first half after the segment, or its second before the other end). This goes on until no key is
   over the bound or one code point is left, so that nothing is dropped and no key fills a task.
3. Keys are dealt to shards by hash. A shard builds one automaton of its segments, both ends marked, and scans
   its words: a hit must lie at its offset and fit in length. Distance is verified by the texts between the
   matched ends: equal after one deletion in the longer, or equal but for the same place in both; a table of these by
   key answers each word in time of its length, however many words share the key.
4. Near pairs are summed by word; forms are followed to the root by pointer doubling: counts at least double
   with each step, so that six rounds reach the end of any chain.

Defined results: null and empty texts have no words; a null id counts as an empty one in the hash; repeated
rows count each; words of any length are taken whole; ties of forms go to the smaller word; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Collection, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import slices, written

RUN = re.compile("[A-Za-zÀ-ÿ]+")
MODULUS = 97
#: Different words that a task counts before it gives them out, words that hold one key, and rows of a shard.
TASK_WORDS = 400_000
MOST_HOLDERS = 20_000
SHARD_ROWS = 100_000
#: Words with more than LONG code points between the ends are compared one by one, LONG_HOLDERS of one key at most.
LONG, LONG_HOLDERS = 64, 64


class Counting:
    """Counts of the words of many texts: a number for each word, arrays for the rest."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.crc: list[int] = []
        self.size: list[int] = []
        self.counts = np.zeros(0, dtype=np.int64)
        self.changed: Counter[str] = Counter()

    def _learn(self, words: list[str]) -> None:
        for w in set(words).difference(self.number):
            raw = w.encode()
            self.number[w] = len(self.number)
            self.crc.append(zlib.crc32(raw))
            self.size.append(len(raw))

    def add(self, pairs: list[tuple[bytes, list[str]]]) -> None:
        """pairs: what stands before each word in the hash, and the words of a text."""
        for _, words in pairs:
            self._learn(words)
        crc, size = np.array(self.crc, dtype=np.uint32), np.array(self.size, dtype=np.int64)
        kept = [np.zeros(0, dtype=np.int64)]
        for before, words in pairs:
            ids = np.fromiter(map(self.number.__getitem__, words), dtype=np.int64, count=len(words))
            # crc32(a + b) = crc32(b) ^ L(crc32(a)), where L depends on the length of b alone
            lengths, at = np.unique(size[ids], return_inverse=True)
            start = zlib.crc32(before)
            shift = np.array([zlib.crc32(bytes(n), start) ^ zlib.crc32(bytes(n)) for n in lengths.tolist()], dtype=np.uint32)
            h = crc[ids] ^ shift[at]
            hit = h % MODULUS == 0
            for k in np.flatnonzero(hit).tolist():
                w = words[k]
                i = int(h[k]) % len(w)
                self.changed[w[:i] + w[i + 1 :]] += 1
            kept.append(ids[~hit])
        total = np.bincount(np.concatenate(kept), minlength=len(crc))
        total[: len(self.counts)] += self.counts
        self.counts = total

    def out(self, least: int) -> pa.RecordBatch:
        """Words of least code points and their counts; starts again."""
        found = Counter({w: n for w, n in zip(self.number, self.counts.tolist(), strict=True) if n and len(w) >= least})
        found.update({w: n for w, n in self.changed.items() if len(w) >= least})
        self.__init__()
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])


def runs(text: bytes) -> list[str]:
    """Maximal runs of letters, A-Z lower-cased."""
    return RUN.findall(text.lower().decode("utf-8"))


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = 5, least_count: int = 3) -> DataFrame:
    """word, n: results of least_letters code points that occur least_count times, after the deletions by hash."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Counting()
        for part in slices(batches, 500):
            ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
            held.add([(f"{i or ''}:".encode(), runs(t)) for i, t in zip(ids, texts, strict=True) if t])
            if len(held.number) > TASK_WORDS:
                yield held.out(least_letters)
        yield held.out(least_letters)

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def first_half(n: int) -> int:
    return n // 2


def common_prefix(a: str, b: str) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one code point inserted, deleted or replaced makes a into b."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = common_prefix(a, b)
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


# A key is (length of the word that holds it, code points fixed at the start, and at the end, these code points).
# The halves of what lies between are the next keys: one more segment at the start, or at the end.


def _sub(length: int, start: int, end: int) -> tuple[tuple[int, int], tuple[int, int]]:
    inside = length - start - end
    half = first_half(inside)
    return (start + half, end), (start, end + inside - half)


def _key_rows(words: pd.Series, counts: pd.Series, length: pd.Series, start: pd.Series, end: pd.Series, by_end: pd.Series) -> pd.DataFrame:
    """Both sub-keys of every row, where the word can have them; by_end: bits, whether a cut took the end."""
    out: dict[str, list] = {c: [] for c in ("word", "n", "length", "start", "end", "segment", "by_end")}
    for w, n, m, s, e, bits in zip(words, counts, length.tolist(), start.tolist(), end.tolist(), by_end, strict=True):
        for take_end, (a, b) in enumerate(_sub(m, s, e)):
            if a + b <= len(w):
                for c, x in zip(out, (w, n, m, a, b, w[:a] + "\n" + w[len(w) - b :], bits + str(take_end)), strict=True):
                    out[c].append(x)
    return pd.DataFrame(out).astype({"n": "int64", "length": "int32", "start": "int32", "end": "int32"})


KEY_SCHEMA = "word string, n long, length int, start int, end int, segment string, by_end string"


def _first_keys(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        size = pdf["word"].str.len()
        for m in (-1, 0, 1):
            zero = pd.Series(0, index=pdf.index)
            yield _key_rows(pdf["word"], pdf["n"], size + m, zero, zero, pd.Series("", index=pdf.index))


def _next_keys(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        yield _key_rows(pdf["word"], pdf["n"], pdf["length"], pdf["start"], pdf["end"], pdf["by_end"])


class Shard:
    """Segments of some keys in one automaton, and what lies between the ends of the words that hold them."""

    def __init__(self, holders):
        """holders: (word, n, length, start, end) of words whose length is the key's."""
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        #: by (length, start, end, segment): texts between, then with one code point deleted, then replaced
        self.keys: dict[tuple, tuple[dict, dict, dict]] = {}
        segments: dict[str, set] = {}
        for w, n, m, a, b in holders:
            key = (m, a, b, w[:a] + "\n" + w[m - b :])
            whole, shorter, other = self.keys.setdefault(key, ({}, {}, {}))
            between = w[a : m - b]
            whole.setdefault(between, []).append((w, n))
            for i in range(len(between) if len(between) <= LONG else 0):
                less = between[:i] + between[i + 1 :]
                shorter.setdefault(less, []).append((w, n))
                other.setdefault((i, less), []).append((w, n))
            # the marks make a segment match at its own end of a word only; of long ones the part at the mark is enough to find it
            segments.setdefault("^" + w[: min(a, LONG)] if a >= b else w[m - min(b, LONG) :] + "$", set()).add(key)
        for segment, keys in segments.items():
            self.automaton.add_word(segment, (len(segment), sorted(keys)))
        if segments:
            self.automaton.make_automaton()
        self.empty = not segments

    def near(self, word: str, wanted: Collection[tuple]) -> Iterator[tuple[tuple, str, int]]:
        """(key, near word, its count) by the wanted keys: (length, start, end)."""
        if self.empty:
            return
        marked, size = "^" + word + "$", len(word)
        for stop, (length, keys) in self.automaton.iter(marked):
            if stop + 1 != length and stop + 1 != len(marked):
                continue  # a segment that stands at another offset
            for key in keys:
                m, a, b, fixed = key
                if (m, a, b) not in wanted or abs(size - m) > 1 or a + b > size or word[:a] + "\n" + word[size - b :] != fixed:
                    continue
                whole, shorter, other = self.keys[key]
                mine = word[a : size - b]
                if m - a - b > LONG:
                    found = {x: n for held in whole.values() for x, n in held}
                elif size == m:
                    found = {x: n for i in range(len(mine)) for x, n in other.get((i, mine[:i] + mine[i + 1 :]), ()) if x != word}
                elif size < m:
                    found = dict(shorter.get(mine, ()))
                else:
                    found = {x: n for i in range(len(mine)) for x, n in whole.get(mine[:i] + mine[i + 1 :], ())}
                for x, n in found.items():
                    if one_edit(word, x):
                        yield key, x, n


def found_before(word: str, other: str, m: int, by_end: str) -> bool:
    """Whether another cut finds the pair too: somewhere the end was taken though the first half is unchanged as well."""
    start = end = 0
    for bit in by_end:
        (a, _), (_, b) = _sub(m, start, end)
        if bit == "0":
            start = a
        else:
            if a + end <= min(len(word), len(other)) and word[:a] == other[:a]:
                return True
            end = b
    return False


def near_words(words: DataFrame, most_holders: int = MOST_HOLDERS) -> DataFrame:
    """word, n, near, near_n: every ordered pair of words one edit apart, once. words: word, n, all different."""
    words = written(words.select("word", "n"), "words")
    keys = words.mapInPandas(_first_keys, KEY_SCHEMA)
    ready = None
    of = ["length", "start", "end", "segment"]
    while True:
        keys = written(keys, "segments")
        holders = keys.filter(F.length("word") == F.col("length")).groupBy(*of).agg(F.count(F.lit(1)).alias("holders"))
        inside = F.col("length") - F.col("start") - F.col("end")
        hot = written(holders.filter((F.col("holders") > F.when(inside > LONG, min(LONG_HOLDERS, most_holders)).otherwise(most_holders)) & (inside > 1)), "hot")
        if hot.isEmpty():
            ready = keys if ready is None else ready.unionByName(keys)
            break
        cold = keys.join(hot.select(*of), of, "left_anti").select(*keys.columns)
        ready = cold if ready is None else ready.unionByName(cold)
        keys = keys.join(hot.select(*of), of, "left_semi").select(*keys.columns).mapInPandas(_next_keys, KEY_SCHEMA)
    shards = max(1, -(-ready.count() // SHARD_ROWS))

    def scan(key, pdf: pd.DataFrame) -> pd.DataFrame:
        columns = [pdf[c].tolist() for c in ("word", "n", "length", "start", "end", "by_end")]
        shard = Shard((w, n, m, a, b) for w, n, m, a, b, _ in zip(*columns, strict=True) if len(w) == m)
        asks: dict[tuple[str, int], dict[tuple, str]] = {}
        for w, n, m, a, b, bits in zip(*columns, strict=True):
            asks.setdefault((w, n), {})[m, a, b] = bits
        out = [(w, n, x, m) for (w, n), keys in asks.items() for k, x, m in shard.near(w, keys) if not found_before(w, x, k[0], keys[k[:3]])]
        return pd.DataFrame(out, columns=["word", "n", "near", "near_n"]).astype({"n": "int64", "near_n": "int64"})

    dealt = ready.withColumn("shard", F.pmod(F.xxhash64(*of), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(scan, "word string, n long, near string, near_n long")


def group_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = 5, least_count: int = 3, most_holders: int = MOST_HOLDERS) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word (see ``word_counts``).

    form: the near word of largest n, if that is at least twice the word's own; root: the last word by forms.
    """
    words = written(word_counts(docs, id_col, text_col, least_letters, least_count), "counts")
    pairs = near_words(words, most_holders)
    # the largest count first, then the smaller word
    best = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))
    told = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(-F.col("best.minus") >= 2 * F.col("n"), F.col("best.near")).alias("form"), F.when(-F.col("best.minus") >= 2 * F.col("n"), -F.col("best.minus")).alias("form_n"))
    told = written(told, "forms")
    links = told.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:
        links = written(links, "roots")
        on = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = links.join(on, "root", "left")
        if moved.filter("further is not null").isEmpty():
            break
        links = moved.select("word", F.coalesce("further", "root").alias("root"))
    return told.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
