"""Near-duplicate detection: improved consistent weighted sampling of TF-IDF shingles, in bands.

1. Document frequencies of words over all rows give the shingles' TF-IDF weights (``shingles``). A
   shingle's IDF comes from its words and not from its own count, because copies raise the count of
   what they share: by its own count a group would weigh less and seem less alike the larger it is.
2. Texts of equal word sequence form a class at once (128-bit hash, partial aggregation first), and
   only one of each goes on.
3. Improved consistent weighted sampling draws SAMPLES elements (shingle, level) per text, such that two
   texts share each with the probability of their weighted Jaccard similarity; BANDS bands of ROWS.
4. A band's bucket of at most SMALL texts gives all its pairs (with ``least_agreed`` only those that agree in as
   many samples, which may lose some); each is verified by the weighted Jaccard similarity of the whole texts, at least ``similarity``.
5. A larger bucket is dealt into chunks of about CHUNK texts. A task takes one chunk with its texts, works
   out the weighted Jaccard similarity of every two of them as sums of matrix products, and gives out
   a spanning forest of the links, which connects what all of them connect: at most one row for each text.
6. Links give classes by contraction on written tables that shrink from round to round. Where a bucket of
   several chunks still holds several classes, texts leave it that so much of their weight is in no other text
   that they can be similar to none; then chunks of its largest class meet chunks of the rest, and those
   one another, each two in a task of their own.

So every two texts that share a bucket are compared or already in one class, however large the bucket.
A group of similar texts costs its size times CHUNK comparisons; only texts that share a bucket, have nearly all they
hold in common with others, and still stay apart cost the square of their number, without any row for a pair.

Defined results: texts without a word, null texts and null ids are a class of their own (null ids
have a null class); the class id is its smallest id, which is the document that stays; rows repeated
with the same id and text are one document; of one id's different texts that no smaller id has, the one of
the smallest hash stands for all of them; ties of similarity count as links; very long texts are compared
whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.bloom import Bloom, packed_texts, unpacked
from barloom.llm.common import give_back, slices, written
from barloom.llm.shingles import Idf, Shingles, fit_idf, mix, shingles

BANDS, ROWS = 12, 2
SAMPLES = BANDS * ROWS
SMALL, CHUNK = 16, 256
#: Samples that a pair of a small bucket must agree in; over 0 pairs may be lost.
LEAST_AGREED = 0
SIMILARITY = 0.8
#: Compressed bytes of the texts whose elements one task counts.
PART_BYTES = 1 << 20
_STEPS = 1 << 16
_LEVEL = np.uint64(0x9E3779B97F4A7C15)


def _gamma_tables() -> tuple[np.ndarray, np.ndarray]:
    """Quantiles of Gamma(2, 1), by the inverse of 1 - (1 + x) exp(-x), and their logarithms."""
    q = (np.arange(_STEPS) + 0.5) / _STEPS
    x = np.full(_STEPS, 2.0)
    low, high = np.zeros(_STEPS), np.full(_STEPS, 40.0)
    for _ in range(60):
        below = 1 - (1 + x) * np.exp(-x) < q
        low, high = np.where(below, x, low), np.where(below, high, x)
        x = (low + high) / 2
    return x.astype(np.float32), np.log(x).astype(np.float32)


_R, _LOG_C = _gamma_tables()


def samples(text: np.ndarray, value: np.ndarray, weight: np.ndarray, first: int, end: int, n: int = SAMPLES) -> np.ndarray:
    """[text, sample] of 32-bit hashes of the drawn (shingle, level); texts must be in order."""
    out = np.zeros((end - first, n), dtype=np.int32)
    if not len(value):
        return out
    bounds = np.searchsorted(text, np.arange(first, end + 1))
    lengths = np.diff(bounds)
    busy = np.flatnonzero(lengths)
    begin, spread = bounds[:-1][busy], np.repeat(np.arange(len(busy)), lengths[busy])
    log_weight = np.log(weight).astype(np.float32)
    for k in range(n):
        h = mix(value + np.uint64((k + 1) * 0xD1342543DE82EF95 & (1 << 64) - 1))
        r = _R.take((h & np.uint64(_STEPS - 1)).astype(np.int64))
        beta = ((h >> np.uint64(32)) & np.uint64(_STEPS - 1)).astype(np.float32) / _STEPS
        level = np.floor(log_weight / r + beta)
        log_a = _LOG_C.take(((h >> np.uint64(16)) & np.uint64(_STEPS - 1)).astype(np.int64)) - r * (level - beta + 1)
        least = np.minimum.reduceat(log_a, begin)
        hit = np.flatnonzero(log_a == least[spread])
        owner = spread[hit]
        take = hit[np.concatenate([[True], owner[1:] != owner[:-1]])]
        out[busy, k] = (mix(value[take] * np.uint64(31) + level[take].astype(np.int64).view(np.uint64)) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return out


def signatures(docs: DataFrame, idf: Idf, id_col: str, text_col: str) -> DataFrame:
    """(id, text_hash, s1, s2, sig): hash of the text, of the word sequence, and samples; s1 and sig are null without a word."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sequence, sig = [], []
            for x in shingles(batch.column(2).to_pylist(), idf):
                sequence.append(x.sequence), sig.append(samples(x.text, x.hash, x.weight, x.first, x.end))
            if not sequence:
                continue
            sequence, sig = np.concatenate(sequence), np.concatenate(sig)
            none = ~sequence.any(axis=1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(sequence[:, 0].view(np.int64), mask=none),
                    pa.array(sequence[:, 1].view(np.int64), mask=none),
                    pa.ListArray.from_arrays(np.arange(0, sig.size + 1, SAMPLES, dtype=np.int32), pa.array(sig.ravel()), mask=pa.array(none)),
                ],
                names=["id", "text_hash", "s1", "s2", "sig"],
            )
        give_back()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.xxhash64(F.col(text_col).cast("string")), F.col(text_col).cast("string")).mapInArrow(sign, f"id {kind}, text_hash long, s1 long, s2 long, sig array<int>")


def buckets(signed: DataFrame) -> DataFrame:
    """(key, n, id): the members of all buckets of two or more; rows (id, sig)."""
    bands = F.array(*[F.xxhash64(F.lit(b), *[F.col("sig")[b * ROWS + r] for r in range(ROWS)]) for b in range(BANDS)])
    rows = signed.select("id", F.explode(bands).alias("key"))
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return written(rows.join(sizes, "key").select("key", "n", "id"), "buckets")


def candidates(members: DataFrame, signed: DataFrame, least_agreed: int = LEAST_AGREED) -> DataFrame:
    """Candidate pairs (a, b), a < b, of buckets of at most SMALL: those that agree in least_agreed samples."""
    small = members.filter(F.col("n") <= SMALL).select("key", "id")
    every = small.alias("x").join(small.alias("y"), "key").filter(F.col("x.id") < F.col("y.id")).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    if not least_agreed:
        return every
    sig_a, sig_b = signed.select(F.col("id").alias("a"), F.col("sig").alias("sig_a")), signed.select(F.col("id").alias("b"), F.col("sig").alias("sig_b"))
    agreed = F.aggregate(F.zip_with("sig_a", "sig_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return every.join(sig_a, "a").join(sig_b, "b").filter(agreed >= least_agreed).select("a", "b")


def elements(x: Shingles) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, weight and key of the elements of a block: a shingle that occurs c times is c elements of its IDF each.

    So the smaller of two weights of a shingle is the weight of the common elements.
    """
    unit = x.weight.astype(float) / np.maximum(x.times, 1)
    level = np.arange(int(x.times.sum())) - np.repeat(np.cumsum(x.times) - x.times, x.times)
    return np.repeat(x.text, x.times), np.repeat(unit, x.times), mix(np.repeat(x.hash, x.times) + level.astype(np.uint64) * _LEVEL)


def all_similarities(texts: list[str | None], idf: Idf) -> np.ndarray:
    """[text, text] weighted Jaccard similarities.

    Elements of few texts are counted pair by pair, all others by
    matrix products over blocks of elements.
    """
    n = len(texts)
    parts = [elements(x) for x in shingles(texts, idf)]
    text, unit, key = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.uint64))
    total, common = np.bincount(text, unit, n), np.zeros((n, n))
    order = np.argsort(key, kind="stable")
    text, unit, key = text[order], unit[order], key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(key)))
    element, many = np.repeat(np.arange(len(first)), size), np.repeat(size, size)
    few = np.flatnonzero((many > 1) & (many <= 16))
    t, e, w = text[few], element[few], unit[few]
    for d in range(1, min(16, len(few))):
        same = np.flatnonzero(e[d:] == e[:-d])
        common += np.bincount(t[same] * n + t[same + d], w[same], n * n).reshape(n, n)
    common += common.T
    often = np.flatnonzero(many > 16)
    place = np.unique(element[often], return_inverse=True)[1]
    for begin in range(0, int(place.max(initial=-1)) + 1, 2048):
        here = often[(place >= begin) & (place < begin + 2048)]
        has, weight = np.zeros((n, 2048)), np.zeros(2048)
        column = place[(place >= begin) & (place < begin + 2048)] - begin
        has[text[here], column], weight[column] = 1, unit[here]
        common += (has * weight) @ has.T
    np.fill_diagonal(common, total)
    whole = total[:, None] + total[None, :] - common
    return np.divide(common, whole, out=np.zeros((n, n)), where=whole > 0)


def spanning_forest(linked: np.ndarray, label: np.ndarray) -> list[tuple[int, int]]:
    """Links (x, y) between labels that connect what all links connect; equal labels are connected already."""
    n, found = len(label), []
    near = linked | (label[:, None] == label[None, :])
    new = np.ones(n, dtype=bool)
    for start in range(n):
        front = np.array([start]) if new[start] else np.zeros(0, np.int64)
        new[start] = False
        while len(front):
            reached = np.flatnonzero(near[front].any(axis=0) & new)
            parent = front[near[np.ix_(front, reached)].argmax(axis=0)]
            found += [(x, y) for x, y in zip(parent.tolist(), reached.tolist(), strict=True) if label[x] != label[y]]
            new[reached] = False
            front = reached
    return found


def shared_weights(texts: DataFrame, idf: Idf) -> DataFrame:
    """(id, total, shared): weight of each text, and of those of its elements that another of the texts has too.

    texts: (id, text), compressed. A block of texts sends each of its elements once, packed into an array for each of the
    parts that elements are dealt into by hash; a part counts in how many blocks an element is.
    """
    kind = texts.schema["id"].dataType.simpleString()
    parts = 1 + (texts.agg(F.sum(F.length("text"))).first()[0] or 0) // PART_BYTES

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for x in shingles(unpacked(batch.column(1)), idf):
                text, unit, key = elements(x)
                text = text - x.first
                found, first, place, times = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
                total, shared = (np.bincount(text, w, x.end - x.first) for w in (unit, unit * (times > 1)[place]))
                owner, weight = np.where(times > 1, -1, text[first]), unit[first]
                part = (found % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                cuts = np.searchsorted(part[order], np.arange(parts + 1))
                for p in np.flatnonzero(np.diff(cuts)).tolist():
                    at = order[cuts[p] : cuts[p + 1]]
                    columns = (batch.column(0)[x.first : x.end], pa.array(total), pa.array(shared), pa.array(found[at].view(np.int64)), pa.array(owner[at], pa.int32()), pa.array(weight[at]))
                    yield pa.RecordBatch.from_arrays([pa.array([p], pa.int64()), *(pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns)], names=["part", "id", "total", "shared", "key", "owner", "weight"])
                    total, shared = np.zeros_like(total), np.zeros_like(shared)  # of a block, one part counts them
        give_back()

    def count(rows: pa.Table) -> pa.Table:
        flat = {c: rows[c].combine_chunks().flatten() for c in ("id", "total", "shared", "key", "owner", "weight")}
        n, m = (pc.list_value_length(rows[c]).to_numpy() for c in ("id", "key"))
        owner = flat["owner"].to_numpy()
        _, place, times = np.unique(flat["key"].to_numpy(), return_inverse=True, return_counts=True)
        hit = (owner >= 0) & (times[place] > 1)
        owner = owner + np.repeat(np.cumsum(n) - n, m)
        shared = flat["shared"].to_numpy() + np.bincount(owner[hit], flat["weight"].to_numpy()[hit], len(flat["id"]))
        total = flat["total"].to_numpy()
        give_back()
        return pa.table({"id": flat["id"], "total": total, "shared": shared}).filter(pa.array((total > 0) | (shared > 0)))

    dealt = texts.select("id", "text").mapInArrow(deal, f"part long, id array<{kind}>, total array<double>, shared array<double>, key array<long>, owner array<int>, weight array<double>")
    return dealt.groupBy("part").applyInArrow(count, f"id {kind}, total double, shared double").groupBy("id").agg(F.sum("total").alias("total"), F.sum("shared").alias("shared"))


def may_link(named: DataFrame, weights: DataFrame, similarity: float) -> DataFrame:
    """The rows of named (key, id, label) that may be as similar to another member of their bucket.

    What x and y have in common weighs shared(x) at most, and of similar ones similarity / (1 + similarity) of both totals
    at least; so total(y) is at most the reach of x below. The rest is similar to none.
    """
    reach = F.col("shared") * ((1 + similarity) / similarity) - F.col("total")
    rows = written(named.join(weights, "id").select(*named.columns, "total", reach.alias("reach")), "reach")
    least = rows.groupBy("key").agg(F.min("total").alias("least"))
    return rows.join(least, "key").filter(F.col("reach") * 1.001 >= F.col("least")).select(*named.columns)


def within_chunks(large: DataFrame, chunk: int) -> DataFrame:
    """(key, i, j, id, label): the members of each bucket, dealt into chunks, each a class of its own."""
    own = F.pmod(F.xxhash64("key", "id"), F.ceil(F.col("n") / chunk).cast("int")).cast("int")
    return large.select("key", own.alias("i"), own.alias("j"), "id", F.col("id").alias("label"))


def across_classes(named: DataFrame, chunk: int) -> DataFrame:
    """(key, i, j, id, label): the meetings of two chunks in which every two classes of a bucket meet whole.

    named: (key, id, label). The members of a bucket's largest class, which are connected, meet the rest and not
    one another; chunks of the rest meet each other too. Buckets of one class have no rows.
    """
    classes = named.groupBy("key", "label").agg(F.count(F.lit(1)).alias("m")).groupBy("key")
    apart = classes.agg(F.max(F.struct("m", "label")).alias("top"), F.sum("m").alias("n"), F.count(F.lit(1)).alias("classes")).filter("classes > 1")
    rows = named.join(apart.select("key", "n", F.col("top.m").alias("m"), F.col("top.label").alias("top")), "key")
    mains, rests = F.ceil(F.col("m") / chunk).cast("int"), F.ceil((F.col("n") - F.col("m")) / chunk).cast("int")
    rows = rows.select("key", "id", "label", (F.col("label") == F.col("top")).alias("main"), mains.alias("mains"), rests.alias("rests"))
    own, last = F.col("own"), F.sequence(F.lit(0), F.col("rests") - 1)
    rows = rows.withColumn("own", F.pmod(F.xxhash64("key", "id"), F.when(F.col("main"), F.col("mains")).otherwise(F.col("rests"))).cast("int"))
    pair = lambda i, j: F.struct(i.alias("i"), j.alias("j"))
    of_main = F.transform(last, lambda c: pair(own, c))
    of_rest = F.concat(
        F.transform(F.sequence(F.lit(0), F.col("mains") - 1), lambda c: pair(c, own)),
        F.transform(F.filter(last, lambda c: c != own), lambda c: pair(F.col("mains") + F.least(own, c), F.greatest(own, c))),
    )
    rows = rows.withColumn("at", F.explode(F.when(F.col("main"), of_main).otherwise(of_rest)))
    return rows.select("key", "at.i", "at.j", "id", "label")


def chunk_links(dealt: DataFrame, texts: DataFrame, idf: Idf, similarity: float) -> DataFrame:
    """Links (a, b) of labels that connect the similar texts of each (key, i, j).

    dealt: (key, i, j, id, label); texts: (id, text), compressed.
    """
    kind = dealt.schema["id"].dataType.simpleString()

    def meet(rows: pa.Table) -> pa.Table:
        labels = rows["label"].combine_chunks()
        label = labels.dictionary_encode().indices.to_numpy()
        links: list[tuple[int, int]] = []
        if label.max() > 0:
            links = spanning_forest(all_similarities(unpacked(rows["text"]), idf) >= similarity - 1e-6, label)
        a, b = (pa.array([x[k] for x in links], pa.int64()) for k in (0, 1))
        give_back()
        return pa.table({"a": labels.take(a), "b": labels.take(b)})

    return dealt.join(texts, "id").select("key", "i", "j", "id", "label", "text").groupBy("key", "i", "j").applyInArrow(meet, f"a {kind}, b {kind}")


def similarities(texts_a: list[str | None], texts_b: list[str | None], idf: Idf) -> np.ndarray:
    """Weighted Jaccard similarity of each pair."""
    n = len(texts_a)
    both = [t for pair in zip(texts_a, texts_b, strict=True) for t in pair]
    common, total = np.zeros(n), np.zeros(n)
    block, at, size = [], 0, 0

    def compare(first: int, texts: list[str | None]) -> None:
        for x in shingles(texts, idf, block_bytes=1 << 62):
            pair = x.text // 2
            order = np.lexsort((x.hash, pair))
            p, h, w = pair[order], x.hash[order], x.weight[order].astype(float)
            same = np.flatnonzero((p[1:] == p[:-1]) & (h[1:] == h[:-1]))
            m = len(texts) // 2
            common[first : first + m] = np.bincount(p[same], np.minimum(w[same], w[same + 1]), m)
            total[first : first + m] = np.bincount(p, w, m)

    for i in range(0, 2 * n, 2):
        block += both[i : i + 2]
        size += len(both[i] or "") + len(both[i + 1] or "")
        if size > 1 << 20:
            compare(at, block)
            block, size, at = [], 0, i // 2 + 1
    if block:
        compare(at, block)
    return np.divide(common, total - common, out=np.zeros(n), where=total > 0)


def candidate_texts(ids: DataFrame, signed: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text): the compressed texts of the ids, by the text hashes in signed."""
    ids = written(ids.distinct().join(signed.select("id", "text_hash"), "id"), "candidate-ids")
    text = F.col(text_col).cast("string")
    texts = packed_texts(docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text")), Bloom.of(ids.select("id")))
    return written(texts.join(ids, ["id", "text_hash"], "left_semi").dropDuplicates(["id"]).select("id", "text"), "candidate-texts")


def verified(pairs: DataFrame, texts: DataFrame, idf: Idf, similarity: float) -> DataFrame:
    """Links (a, b) among the candidate pairs."""
    rows = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    kind = pairs.schema["a"].dataType.simpleString()

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            s = similarities(unpacked(batch.column(2)), unpacked(batch.column(3)), idf)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(s >= similarity - 1e-6))
        give_back()

    return rows.select("a", "b", "text_a", "text_b").mapInArrow(check, f"a {kind}, b {kind}")


def components(links: DataFrame) -> DataFrame:
    """(id, label) of every id in links (a, b): the smallest id that it is connected to.

    Each round an id moves to the first of itself and its neighbours in an order by hash, of that round's own, and links
    that became one or a loop go. So the tables of all rounds together are in proportion to the links.
    """

    def different(a: Column, b: Column, rows: DataFrame) -> DataFrame:
        return written(rows.filter(a != b).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct(), "edges")

    edges, hops = different(F.col("a"), F.col("b"), links), []
    while not edges.isEmpty():
        rank = lambda x: F.struct(F.xxhash64(F.lit(len(hops)), x).alias("rank"), F.col(x).alias("to"))  # noqa: B023, E731
        both = edges.select(F.col("a").alias("id"), F.col("b").alias("other")).union(edges.select("b", "a"))
        first = both.groupBy("id").agg(F.min(rank("other")).alias("near")).select("id", F.least("near", rank("id"))["to"].alias("to"))
        hops.append(written(first, "hops"))
        moved = edges.join(hops[-1].select(F.col("id").alias("a"), F.col("to").alias("to_a")), "a").join(hops[-1].select(F.col("id").alias("b"), F.col("to").alias("to_b")), "b")
        edges = different(F.col("to_a"), F.col("to_b"), moved)
    if not hops:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("label"))
    ends = hops.pop()
    while hops:
        after = ends.select(F.col("id").alias("to"), F.col("to").alias("end"))
        ends = written(hops.pop().join(after, "to", "left").select("id", F.coalesce("end", "to").alias("to")), "hops")
    return written(ends.join(ends.groupBy("to").agg(F.min("id").alias("label")), "to").select("id", "label"), "labels")


def links_of(signed: DataFrame, docs: DataFrame, idf: Idf, id_col: str, text_col: str, similarity: float, least_agreed: int, chunk: int) -> DataFrame:
    """(id, label) of all that share a class with others; signed: (id, text_hash, sig), one row for each id."""
    members = buckets(signed)
    pairs = written(candidates(members, signed, least_agreed), "pairs")
    large = members.filter(F.col("n") > SMALL)
    texts = candidate_texts(pairs.select(F.explode(F.array("a", "b")).alias("id")).union(large.select("id")), signed, docs, id_col, text_col)
    labels = components(verified(pairs, texts, idf, similarity).union(chunk_links(within_chunks(large, chunk), texts, idf, similarity)))
    named = large.filter(F.col("n") > chunk).join(labels, "id", "left").select("key", "id", F.coalesce("label", "id").alias("label"))
    apart = named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low != high").select("key")
    named = written(named.join(apart, "key", "left_semi"), "apart")
    if named.isEmpty():
        return labels
    weights = shared_weights(texts.join(named.select("id").distinct(), "id", "left_semi"), idf)
    named = written(may_link(named, weights, similarity), "apart")
    # links of classes, so that only their labels are to be joined
    ends = components(chunk_links(across_classes(named, chunk), texts, idf, similarity))
    if ends.isEmpty():
        return labels
    known = labels.join(ends.select(F.col("id").alias("label"), F.col("label").alias("end")), "label", "left").select("id", F.coalesce("end", "label").alias("label"))
    return written(known.union(ends.join(labels, "id", "left_anti").select("id", "label")), "labels")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, least_agreed: int = LEAST_AGREED, chunk: int = CHUNK, with_text_hash: bool = False) -> DataFrame:
    """One row per input row: id, class_id, class_size (distinct word sequences), kept.

    with_text_hash adds text_hash, xxhash64 of the text, which tells rows of the same id apart.
    """
    idf = fit_idf(docs, text_col)
    rows = written(signatures(docs, idf, id_col, text_col), "signatures")
    known = rows.filter("id is not null and s1 is not null")
    sequences = known.groupBy("s1", "s2").agg(F.min("id").alias("rep"), F.min_by("text_hash", F.struct("id", "text_hash")).alias("text_hash"), F.first("sig").alias("sig"))
    sequences = written(sequences, "sequences")
    signed = written(sequences.groupBy(F.col("rep").alias("id")).agg(F.min("text_hash").alias("text_hash"), F.min_by("sig", "text_hash").alias("sig")), "signed")
    labels = links_of(signed, docs, idf, id_col, text_col, similarity, least_agreed, chunk)
    placed = sequences.select("s1", "s2", "rep").join(labels, F.col("rep") == F.col("id"), "left").select("s1", "s2", F.coalesce("label", "rep").alias("class_id"))
    sizes = placed.groupBy("class_id").agg(F.count(F.lit(1)).alias("class_size"))
    placed = placed.join(sizes, "class_id")
    out = rows.select("id", "s1", "s2", "text_hash").join(placed, ["s1", "s2"], "left")
    alone = F.col("id").isNull() | F.col("s1").isNull()
    return out.select(
        F.col("id").alias(id_col),
        F.when(alone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.lit(1)).otherwise(F.col("class_size")).alias("class_size"),
        (alone | (F.col("id") == F.col("class_id"))).alias("kept"),
        *(["text_hash"] if with_text_hash else []),
    )
