"""Removal of long repeated byte strings, by the common-prefix intervals of an enhanced suffix array.

A byte is removed if a LENGTH-byte string that covers it also starts anywhere else, in the same or another
text. No task ever needs the whole corpus:

1. Every LENGTH-byte window is led by its minimiser, the GRAM-byte string of least hash inside it. Windows
   in a row with the same minimiser form a span. Equal windows have equal minimisers, at equal places.
2. Spans are counted by (hash of minimiser, hash of span): 128 bits, partial aggregation first. A span that
   occurs twice is a repeat as a whole, and one of its copies stands for all of them from here on. A minimiser
   with a single span has nothing else to compare.
3. Where a minimiser has several spans and one of them occurs once, they can agree in part: the edges of
   repeats. Such spans, one of each, are laid end to end, and an enhanced suffix array is built over their
   windows: ranks by prefix doubling, common prefixes from the ranks, a stack scan of the common-prefix
   array for its interval tree. Intervals of depth LENGTH or more whose members differ in the byte to
   the left are the maximal repeats, with all their occurrences.
4. A minimiser with more than MOST_SPANS different spans is split before that, by content, so that no group
   grows with the corpus. Its windows hold the minimiser at offsets 0 to LENGTH - GRAM. Those of the lower
   half of the offsets all hold the same stretch of text behind it, those of the upper half the same stretch
   before it; equal windows agree in half and stretch, so each half is grouped by its stretch. Groups of one
   are done, equal pieces are counted as in 2, and a group that is still large is halved again. After eight
   halvings an offset is alone and the stretches are the whole window, so this ends, with every window
   compared with all that could equal it.

``repeat_groups`` gives the maximal repeats themselves with all occurrences. A repeat longer than a span is
found as overlapping groups, one for each minimiser.

Windows are judged on the input. Defined results: null counts as empty, texts under LENGTH bytes have no
repeats, rows repeated with the same id and text are repeats of each other and all cut alike, rows of the same
id and other text are apart, null ids are ids like others, very long texts are read in overlapping segments of
BLOCK_BYTES, an empty table gives no rows, other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import slices, text_or_empty, written
from barloom.llm.shingles import mix

LENGTH = 200
GRAM = 50
MOST_SPANS = 1024
BLOCK_BYTES = 1 << 20
KEYS = ["key", "key2"]
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_tables: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    if not _tables or len(_tables[0]) < n:
        size = max(n, 2 * BLOCK_BYTES)
        _tables[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, b, dtype=np.uint64)])) for base in _BASES for b in (base, pow(base, -1, 1 << 64))]
    return _tables


class Hashes:
    """64-bit polynomial hashes of any substrings of data, by prefix sums; which: 0 or 1."""

    def __init__(self, data: np.ndarray):
        self.down, self.total = [], []
        powers = _powers(len(data) + 1)
        bytes_ = data.astype(np.uint64) + np.uint64(1)
        for k in (0, 1):
            self.total.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(bytes_ * powers[2 * k][: len(data)])]))
            self.down.append(powers[2 * k + 1])

    def of(self, begin: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
        return mix((self.total[which][end] - self.total[which][begin]) * self.down[which][begin] + (end - begin).astype(np.uint64))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each width values in a row."""
    out, have = x, 1
    while 2 * have <= width:
        out, have = np.minimum(out[:-have], out[have:]), 2 * have
    return np.minimum(out[: len(x) - width + 1], out[width - have : width - have + len(x) - width + 1])


def spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: Hashes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first window, last window, minimiser) of the spans of texts data[starts:ends]."""
    none = np.zeros(0, dtype=np.int64)
    if len(data) < LENGTH:
        return none, none, none, none
    at = np.arange(len(data) - GRAM + 1)
    grams = hashes.of(at, at + GRAM, 0)
    key = (grams & ~np.uint64(0xFFFFFFFF)) | at.astype(np.uint64)
    lead = (sliding_min(key, LENGTH - GRAM + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    counts = np.maximum(ends - starts - LENGTH + 1, 0)
    text = np.repeat(np.arange(len(starts)), counts)
    if not len(text):
        return none, none, none, none
    window = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts, counts)
    lead = lead[window]
    new = np.concatenate([[True], (text[1:] != text[:-1]) | (lead[1:] != lead[:-1])])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(text)) - 1
    return text[first], window[first], window[last], lead[first]


def blocks(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, bytes, starts, ends) of about BLOCK_BYTES bytes each, or one longer text."""
    part, first, size = [], 0, 0
    for i, t in enumerate(texts):
        if part and size + len(t) > BLOCK_BYTES:
            yield first, *_joined(part)
            part, first, size = [], i, 0
        part.append(t)
        size += len(t)
    if part:
        yield first, *_joined(part)


def _joined(part: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ends = np.cumsum([len(t) for t in part])
    return np.frombuffer(b"".join(part), dtype=np.uint8), np.concatenate([[0], ends[:-1]]).astype(np.int64), ends.astype(np.int64)


def segments(texts: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
    """(text, offset, bytes): texts of more than BLOCK_BYTES in pieces that share no window and miss none."""
    for i, t in enumerate(texts):
        for at in range(0, max(len(t) - LENGTH + 1, 1), BLOCK_BYTES):
            yield i, at, t[at : at + BLOCK_BYTES + LENGTH - 1] if len(t) > BLOCK_BYTES else t


def find_spans(rows: DataFrame) -> DataFrame:
    """(gram, span, key, key2, at, size, place) of (key, key2, bytes).

    Hashes of minimiser and span, first window's place in the text, windows, and the minimiser's place in the span.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            owner, offset, parts = zip(*segments(batch.column(2).to_pylist()), strict=True) if batch.num_rows else ((), (), ())
            owner, offset = np.array(owner, dtype=np.int64), np.array(offset, dtype=np.int64)
            for first, data, starts, ends in blocks(list(parts)):
                hashes = Hashes(data)
                text, begin, last, lead = spans(data, starts, ends, hashes)
                if not len(text):
                    continue
                gram = hashes.of(lead, lead + GRAM, 0)
                span = mix(hashes.of(begin, last + LENGTH, 1) + (lead - begin).astype(np.uint64) * np.uint64(_BASES[0]))
                of = pa.array(owner[first + text])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram.view(np.int64)), pa.array(span.view(np.int64)), batch.column(0).take(of), batch.column(1).take(of), pa.array(begin - starts[text] + offset[first + text]), pa.array((last - begin + 1).astype(np.int32)), pa.array((lead - begin).astype(np.int32))],
                    names=["gram", "span", *KEYS, "at", "size", "place"],
                )

    return rows.mapInArrow(find, "gram long, span long, key long, key2 int, at long, size int, place int")


class SuffixArray:
    """Enhanced suffix array of the windows (starts) of data, for common prefixes of up to 512 bytes; they end where a start's content ends."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, limits: np.ndarray):
        """limits: where each start's span ends; common prefixes stop there."""
        self.data, n = data, len(data)
        padded = np.concatenate([data, np.zeros(1024, dtype=np.uint8)])
        code = padded[:n].astype(np.uint64)
        for k in range(1, 8):
            code = (code << np.uint64(8)) | padded[k : n + k]
        self.levels: list[tuple[int, np.ndarray]] = []
        rank, h = np.unique(code, return_inverse=True)[1], 8
        self.levels.append((h, rank))
        while h < 256:
            ahead = np.concatenate([rank[h:], np.zeros(min(h, n), dtype=rank.dtype)])[:n]
            rank, h = np.unique(rank.astype(np.uint64) * np.uint64(n + 1) + ahead.astype(np.uint64), return_inverse=True)[1], 2 * h
            self.levels.append((h, rank))
        order = np.lexsort((starts, rank[np.minimum(starts + 256, n - 1)], rank[starts]))
        self.suffixes = starts[order]
        self.limits = limits[order]
        self.common = self._common(self.suffixes[:-1], self.suffixes[1:], np.minimum(self.limits[:-1] - self.suffixes[:-1], self.limits[1:] - self.suffixes[1:]))

    def _common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Common prefix lengths of suffixes a and b, at most most."""
        n, out = len(self.data), np.zeros(len(a), dtype=np.int64)
        for h, rank in [self.levels[-1], *reversed(self.levels)]:
            i, j = a + out, b + out
            ok = (i < n) & (j < n)
            ok[ok] = rank[i[ok]] == rank[j[ok]]
            out[ok] += h
        for _ in range(8):
            i, j = a + out, b + out
            ok = (i < n) & (j < n)
            ok[ok] = self.data[i[ok]] == self.data[j[ok]]
            out[ok] += 1
        return np.minimum(out, most)

    def maximal_repeats(self, left: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
        """(length, low, high): suffixes[low:high] share length >= least bytes and differ to the left.

        left: a code for what stands before each suffix of ``suffixes``; codes below 0 differ from all others.
        The interval tree comes from one scan of the common-prefix array with a stack; an interval knows
        the one code to its members' left, or that there are several.
        """
        common, several = self.common, -1
        for low, high in _runs(common >= least):
            stack: list[list[int]] = []
            codes = left[low : high + 2].tolist()
            depths = common[low : high + 1].tolist()
            for k, depth in enumerate([*depths, least - 1]):
                at, code = low + k, codes[k] if codes[k] >= 0 else several
                while stack and stack[-1][0] > depth:
                    length, at, own = stack.pop()
                    own = own if own == code else several
                    if own == several:
                        yield length, at, low + k + 1
                    code = own
                if stack and stack[-1][0] == depth:
                    stack[-1][2] = stack[-1][2] if stack[-1][2] == code else several
                elif depth >= least:
                    stack.append([depth, at, code])


def _runs(mask: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) of each run of True."""
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1).tolist(), strict=True))


def _array_of(contents: list[bytes], windows: list[int]) -> tuple[SuffixArray, np.ndarray, np.ndarray, np.ndarray]:
    """(array, content of each suffix, its place there, code of the byte before it)."""
    data, starts, ends = _joined(contents)
    count = np.array(windows)
    owner = np.repeat(np.arange(len(contents)), count)
    suffix = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + starts[owner]
    array = SuffixArray(data, suffix, ends[owner])
    own = np.searchsorted(starts, array.suffixes, side="right") - 1
    before = np.where(array.suffixes > starts[own], data[np.maximum(array.suffixes - 1, 0)].astype(np.int64), -1)
    return array, own, array.suffixes - starts[own], before


def repeats_among(contents: list[bytes], windows: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(content, begin, end) of the longest repeat of LENGTH bytes or more from each place of the contents.

    windows: how many windows each content has, from its first byte. Common prefixes end with a content, so
    contents that stand side by side do not run together.
    """
    array, own, place, before = _array_of(contents, windows)
    reach = np.zeros(len(own), dtype=np.int64)
    for length, low, high in array.maximal_repeats(before, LENGTH):
        np.maximum(reach[low:high], length, out=reach[low:high])
    hit = np.flatnonzero(reach)
    return own[hit].tolist(), place[hit].tolist(), (place[hit] + reach[hit]).tolist()


def groups_among(contents: list[bytes], windows: list[int]) -> Iterator[tuple[int, int, int, list[tuple[int, int]]]]:
    """(number, number of the enclosing group or -1, length, occurrences) of the maximal repeats.

    An occurrence (content, place) is given with its longest repeat only; a group also occurs wherever the
    groups that it encloses do.
    """
    array, own, place, before = _array_of(contents, windows)
    owner, found, tops = np.full(len(own), -1), [], []
    for length, low, high in array.maximal_repeats(before, LENGTH):
        k = len(found)
        while tops and found[tops[-1]][2] >= low:
            found[tops.pop()][0] = k
        mine = low + np.flatnonzero(owner[low:high] < 0)
        owner[mine] = k
        tops.append(k)
        found.append([-1, length, low, mine])
    for k, (outer, length, _, mine) in enumerate(found):
        yield k, outer, length, list(zip(own[mine].tolist(), place[mine].tolist(), strict=True))


PIECES = "group long, span long, key long, key2 int, at long, size int, place int, low int, high int, twice boolean, content binary"


def halves(pieces: DataFrame) -> DataFrame:
    """Each piece cut in two by the minimiser's offset, grouped by the stretch that the windows of a half share."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for group, key, key2, at, size, place, low, high, twice, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                middle = (low + high) // 2
                behind = content[place + GRAM : place + LENGTH - middle]
                ahead = content[max(0, place - middle - 1) : place]
                for side, a, b, stretch in ((b"b", low, middle, behind), (b"a", middle + 1, high, ahead)):
                    # windows whose offset of the minimiser is in a..b
                    last, first = max(a, place - size + 1), min(b, place)
                    if last > first:
                        continue
                    text = content[place - first : place - last + LENGTH]
                    of = xxhash.xxh3_64_intdigest(side + bytes([a, b]) + stretch, group & (1 << 64) - 1) - (1 << 63)
                    span = xxhash.xxh3_64_intdigest(text, first) - (1 << 63)
                    out.append((of, span, key, key2, at + place - first, first - last + 1, first, a, b, twice, text))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=[x.split()[0] for x in PIECES.split(", ")])

    return pieces.select("group", *KEYS, "at", "size", "place", "low", "high", "twice", "content").mapInArrow(cut, PIECES)


def split_large(edges: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """(pieces in groups of at most most, intervals found on the way); edges: pieces with kinds, those of their group."""
    small, found = edges.filter(F.col("kinds") <= most), None
    large = edges.filter(F.col("kinds") > most)
    while not large.isEmpty():
        pieces = written(halves(large), "halves")
        counted = written(pieces.groupBy("group", "span").agg(F.count(F.lit(1)).alias("n")), "halves-counted")
        # written, so that the joins with it are plain ones, which adaptive execution splits where a group is large
        groups = written(counted.groupBy("group").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("kinds")).filter("all > 1"), "halves-groups")
        placed = written(pieces.join(counted.join(groups, "group"), ["group", "span"]), "halves-placed")
        twice = placed.filter("n > 1 and not twice").select(*KEYS, F.col("at").alias("begin"), (F.col("at") + F.col("size") + LENGTH - 1).alias("end"))
        found = twice if found is None else found.unionByName(twice)
        kept = ["key", "key2", "at", "size", "place", "low", "high", "content"]
        one = placed.filter("kinds > 1").groupBy("group", "span").agg(F.first("kinds").alias("kinds"), F.min(F.struct(*kept)).alias("x"), (F.max("twice") | (F.first("n") > 1)).alias("twice"))
        left = written(one.select("group", "span", "kinds", "twice", *[f"x.{c}" for c in kept]), "halves-left")
        small = small.unionByName(left.filter(F.col("kinds") <= most))
        large = left.filter(F.col("kinds") > most)
    return small, found


def shared_spans(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows, placed): rows (id, key, key2, bytes) of docs, and the spans whose minimiser occurs again, with counts."""
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), text).alias("key"), F.hash(F.col(id_col), text).alias("key2"), text.cast("binary").alias("bytes"))
    found = find_spans(rows.select(*KEYS, "bytes"))
    counted = written(found.groupBy("gram", "span").agg(F.count(F.lit(1)).alias("n")), "spans")
    grams = counted.groupBy("gram").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least")).filter("all > 1")
    shared = written(counted.join(grams, "gram").select("gram", "span", "n", "kinds", "least"), "shared")
    return rows, written(found.join(shared, ["gram", "span"]), "placed")


def representatives(rows: DataFrame, placed: DataFrame) -> DataFrame:
    """Pieces (PIECES, kinds): one of each (gram, span) of placed, with its bytes; twice if it occurs again."""
    ones = placed.filter("n = 1").select("gram", "span", "kinds", *KEYS, "at", "size", "place", F.lit(False).alias("twice"))
    twos = placed.filter("n > 1").groupBy("gram", "span").agg(F.first("kinds").alias("kinds"), F.min(F.struct(*KEYS, "at", "size", "place")).alias("x")).select("gram", "span", "kinds", *[f"x.{k}" for k in (*KEYS, "at", "size", "place")], F.lit(True).alias("twice"))
    wanted = ones.unionByName(twos).groupBy(*KEYS).agg(F.collect_list(F.struct("gram", "span", "kinds", "at", "size", "place", "twice")).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for key, key2, content, wants in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out += [(x["gram"], x["span"], key, key2, x["at"], x["size"], x["place"], 0, LENGTH - GRAM, x["twice"], content[x["at"] : x["at"] + x["size"] + LENGTH - 1], x["kinds"]) for x in wants]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=[*(x.split()[0] for x in PIECES.split(", ")), "kinds"])

    # rows alike in id and text share a key: one of them gives the pieces
    keys = wanted.select(*KEYS)
    alike = written(rows.join(keys, KEYS, "left_semi").groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "alike")
    mine = rows.select(*KEYS, "bytes")
    if not alike.isEmpty():
        mine = mine.join(alike, KEYS, "left_anti").select(*KEYS, "bytes").unionByName(mine.join(alike.select(*KEYS), KEYS, "left_semi").groupBy(*KEYS).agg(F.min("bytes").alias("bytes")))
    return written(mine.join(wanted, KEYS).select(*KEYS, "bytes", "spans").mapInArrow(cut, PIECES + ", kinds long"), "pieces")


def _by_group(pieces: DataFrame, schema: str, function) -> DataFrame:
    """function(list of rows) of whole groups at a time, about BLOCK_BYTES together; rows (group, span, key, key2, at, size, twice, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size > BLOCK_BYTES and row[0] != held[-1][0]:
                    yield function(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[7])
        if held:
            yield function(held)

    return pieces.select("group", "span", *KEYS, "at", "size", "twice", "content").repartition("group").sortWithinPartitions("group").mapInArrow(run, schema)


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, intervals): rows (id, key, key2, bytes) of docs, and (key, key2, begin, end) of repeated strings."""
    rows, placed = shared_spans(docs, id_col, text_col)
    whole = placed.filter("n > 1").select(*KEYS, F.col("at").alias("begin"), (F.col("at") + F.col("size") + LENGTH - 1).alias("end"))
    edges, found = split_large(representatives(rows, placed.filter("kinds > 1 and least = 1")), most or MOST_SPANS)

    def search(held: list[tuple]) -> pa.RecordBatch:
        which, begin, end = repeats_among([r[7] for r in held], [r[5] for r in held])
        keep = [(held[i][2], held[i][3], held[i][4] + b, held[i][4] + e) for i, b, e in zip(which, begin, end, strict=True) if not held[i][6]]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in keep], k) for i, k in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64()))], names=[*KEYS, "begin", "end"])

    partial = _by_group(edges, "key long, key2 int, begin long, end long", search)
    return rows, whole.unionByName(partial) if found is None else whole.unionByName(partial).unionByName(found)


def repeat_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(repeat, within, length, id, begin): the maximal repeats of LENGTH bytes or more with all their occurrences.

    An occurrence stands with its longest repeat; a repeat also occurs wherever those within it (within = its
    number, null for none) do. Every copy of a text that occurs again is an occurrence.
    """
    rows, placed = shared_spans(docs, id_col, text_col)

    def search(held: list[tuple]) -> pa.RecordBatch:
        out = []
        for first, last in _same([r[0] for r in held]):
            part = held[first:last]
            for k, outer, length, at in groups_among([r[7] for r in part], [r[5] for r in part]):
                name = [xxhash.xxh3_64_intdigest(f"{part[0][0]} {x}") - (1 << 63) if x >= 0 else None for x in (k, outer)]
                out += [(*name, length, part[i][0], part[i][1], place) for i, place in at] or [(*name, length, part[0][0], None, None)]
            # the whole of a span that occurs again, where no other span has it
            out += [(xxhash.xxh3_64_intdigest(f"{r[0]} whole {r[1]}") - (1 << 63), None, r[5] + LENGTH - 1, r[0], r[1], 0) for r in part if r[6]]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["repeat", "within", "length", "gram", "span", "place_in"])

    found = _by_group(representatives(rows, placed).dropDuplicates(["group", "span"]), "repeat long, within long, length long, gram long, span long, place_in long", search)
    at = placed.select("gram", "span", *KEYS, "at").join(rows.select("id", *KEYS).distinct(), KEYS)
    return found.join(at, ["gram", "span"]).select("repeat", "within", "length", F.col("id").alias(id_col), (F.col("at") + F.col("place_in")).alias("begin"))


def _same(values: list[int]) -> list[tuple[int, int]]:
    """(first, end) of each run of equal values."""
    edge = [0, *(i for i in range(1, len(values)) if values[i] != values[i - 1]), len(values)]
    return list(zip(edge, edge[1:], strict=False))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept_sha256; with_text adds kept_bytes."""
    rows, intervals = repeated(docs, id_col, text_col)
    per_row = intervals.distinct().groupBy(*KEYS).agg(F.collect_list(F.struct("begin", "end")).alias("cuts"))
    kind = docs.schema[id_col].dataType.simpleString()

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes")}
            cuts = batch.column(2)
            for i, content in enumerate(batch.column(1).to_pylist()):
                merged: list[list[int]] = []
                for x in sorted((x["begin"], x["end"]) for x in cuts[i].as_py() or ()):
                    if merged and x[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], x[1])
                    else:
                        merged.append(list(x))
                at = [0, *(y for x in merged for y in x), len(content)]
                kept = b"".join(content[b:e] for b, e in zip(at[0::2], at[1::2], strict=True))
                out["n_bytes"].append(len(content)), out["n_removed"].append(len(content) - len(kept)), out["n_spans"].append(len(merged)), out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    out["kept_bytes"].append(kept)
            columns = [pa.array(out[k], pa.int64()) for k in ("n_bytes", "n_removed", "n_spans")] + [pa.array(out["kept_sha256"], pa.string())] + ([pa.array(out["kept_bytes"], pa.binary())] if with_text else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[id_col, *list(out)[: len(columns)]])

    schema = f"{id_col} {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept_bytes binary" if with_text else "")
    return rows.join(per_row, KEYS, "left").select("id", "bytes", "cuts").mapInArrow(remove, schema)
