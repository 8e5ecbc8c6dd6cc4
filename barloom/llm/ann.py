"""Nearest neighbours by largest inner product with additive quantisation.

* Training: M codebooks of K full-dimensional codewords are fitted on a bounded sample (``sample``
  distinct vectors by hash order): each book by k-means on what the books before leave, then all books
  together by least squares, in turns with encoding.
* Encoding: beam search. Every vector keeps its ``beam`` best partial codes book by book, so that a
  vector is a sum of M codewords. Beside it stands its norm, over that of the sum.
* Search: a query's products with all codewords form a lookup table; a vector's rough score is M look-ups,
  times the stored norm ratio. Queries meet the codes block by block (QUERY_BLOCK x CODE_BLOCK), the stated query
  set against all rows, each meeting a task of its own: codes go over, 32 bytes a vector, and no vectors. Of
  a block the ``shortlist`` / blocks best rough scores go on, LEAST_OF_BLOCK at least, and of those of all
  blocks the ``shortlist`` best of each query.
* Reranking: one join fetches the original vectors of the shortlists, which are scored exactly, in
  double precision; ties go to the smaller id.

Equal vectors share one code: each distinct vector is encoded once and carries its k + 1 smallest ids,
which is exact, as ties go to smaller ids.

Defined results: vectors that are null, zero, of another length than most or hold null or non-finite
components, and null ids, take no part; a query with fewer candidates than k returns them all; rows repeated
with the same id and vector are one candidate; of one id's different vectors each is a candidate of
other ids, and the smallest is its query; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import first_by_hash, written

BOOKS, WORDS, BEAM = 32, 64, 4
QUERY_BLOCK, CODE_BLOCK, AT_ONCE = 4096, 16_384, 256
SHORTLIST, LEAST_OF_BLOCK = 512, 32


@dataclass
class Quantiser:
    books: np.ndarray  # [book, word, dimension]

    def encode(self, x: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """Codes [vector, book] by beam search for the least residual."""
        n, out = len(x), np.zeros((len(x), len(self.books)), dtype=np.uint8)
        for first in range(0, n, 2048):
            part = x[first : first + 2048].astype(np.float64)
            rest, codes = part[:, None, :], np.zeros((len(part), 1, 0), dtype=np.uint8)
            for book in self.books:
                # |rest - word|^2 without |rest|^2 would not compare between partial codes
                loss = (rest**2).sum(2)[:, :, None] - 2 * rest @ book.T + (book**2).sum(1)
                flat = loss.reshape(len(part), -1)
                keep = min(beam, flat.shape[1])
                best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
                best = np.take_along_axis(best, np.argsort(np.take_along_axis(flat, best, 1), axis=1, kind="stable"), 1)
                old, word = best // len(book), best % len(book)
                rest = np.take_along_axis(rest, old[:, :, None], 1) - book[word]
                codes = np.concatenate([np.take_along_axis(codes, old[:, :, None], 1), word[:, :, None].astype(np.uint8)], axis=2)
            out[first : first + len(part)] = codes[:, 0]
        return out

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(book[codes[:, m]] for m, book in enumerate(self.books))


def _means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10) -> np.ndarray:
    words = x[rng.choice(len(x), k, replace=len(x) < k)]
    for _ in range(rounds):
        near = np.argmax(x @ words.T - (words**2).sum(1) / 2, axis=1)
        counts = np.bincount(near, minlength=k)
        total = np.zeros_like(words)
        np.add.at(total, near, x)
        words = np.where(counts[:, None] > 0, total / np.maximum(counts, 1)[:, None], x[rng.choice(len(x), k)])
    return words


def fit_arrays(x: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = 2, seed: int = 5) -> Quantiser:
    rng, x = np.random.default_rng(seed), x.astype(np.float64)
    rest, found = x.copy(), []
    for _ in range(books):
        book = _means(rest, words, rng)
        rest -= book[np.argmax(rest @ book.T - (book**2).sum(1) / 2, axis=1)]
        found.append(book)
    q = Quantiser(np.stack(found))
    for _ in range(rounds):
        codes = q.encode(x)
        chosen = (codes.astype(int) + np.arange(books) * words).ravel()
        row = np.repeat(np.arange(len(x)), books)
        gram, right = np.zeros((books * words,) * 2), np.zeros((books * words, x.shape[1]))
        for m in range(books):
            np.add.at(gram, (chosen.reshape(-1, books)[:, [m]], chosen.reshape(-1, books)), 1.0)
        np.add.at(right, chosen, x[row])
        gram[np.diag_indices_from(gram)] += 1e-3 * max(len(x) / words, 1)
        right += 1e-3 * max(len(x) / words, 1) * q.books.reshape(-1, x.shape[1])
        q = Quantiser(np.linalg.solve(gram, right).reshape(books, words, -1))
    return q


def usable(vector: Column) -> Column:
    """Not null, not zero, all components finite."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda v: v != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def norm_ratios(x: np.ndarray, decoded: np.ndarray) -> np.ndarray:
    """The norms of x over those of its codes."""
    norm = np.linalg.norm(decoded, axis=1)
    return np.divide(np.linalg.norm(x, axis=1), norm, out=np.ones(len(x)), where=norm > 0).astype(np.float32)


def rough_best(q: np.ndarray, codes: np.ndarray, ratios: np.ndarray, quantiser: Quantiser | None, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) [query, up to most] of the largest rough products of queries and coded vectors, by look-ups."""
    if quantiser is None:
        rough = q @ codes.T
    else:
        table = np.einsum("qd,mwd->mqw", q, quantiser.books, optimize=True).astype(np.float32)
        rough = np.zeros((len(q), len(codes)), dtype=np.float32)
        for m in range(codes.shape[1]):
            rough += table[m].take(codes[:, m], axis=1)
        rough *= ratios
    keep = min(most, len(codes))
    place = np.argpartition(-rough, keep - 1, axis=1)[:, :keep]
    return place, np.take_along_axis(rough, place, 1)


def of_block(shortlist: int, blocks: int) -> int:
    """How many of a block go on."""
    return max(LEAST_OF_BLOCK, -(-shortlist // blocks))


def _best(rows: DataFrame, score: str, n: int) -> DataFrame:
    """The n rows of largest score of each query, ties to the smaller first."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(score), "first"))
    return rows.withColumn("r", rank).filter(F.col("r") <= n).drop("r")


def nearest(vectors: DataFrame, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, shortlist: int = SHORTLIST, sample: int = 10_000, books: int = BOOKS, words: int = WORDS, exact: bool = False) -> DataFrame:
    """(query_id, rank, id, score) of the k nearest rows to each row that queries selects.

    exact: score every vector exactly instead (the brute force that recall is measured against).
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("q")).filter(F.col("id").isNotNull() & usable(F.col("v")))
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    dimension = lengths[0]["d"] if lengths else 0
    rows = rows.filter(F.size("v") == dimension)
    # the smallest ids of each distinct vector: first within salted groups, then over those
    few = rows.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(64)).alias("salt")).groupBy("v", "salt").agg(F.collect_set("id").alias("ids")).select("v", F.slice(F.array_sort("ids"), 1, k + 1).alias("ids"))
    distinct = few.groupBy("v").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids"))
    # one id's different vectors have a number each
    first = F.struct(F.element_at("ids", 1).alias("id"), F.row_number().over(Window.partitionBy(F.element_at("ids", 1)).orderBy("v")).alias("n"))
    distinct = written(distinct.select(F.xxhash64("v").alias("h"), first.alias("first"), "ids", "v"), "vectors")
    asked = written(rows.filter("q").groupBy(F.col("id").alias("query_id")).agg(F.min("v").alias("qv")), "queries")
    n_queries, n_vectors = asked.count(), distinct.count()
    fitted = None
    if n_queries and not exact:
        taken = first_by_hash(distinct, F.col("h"), sample).select("h", "first.id", "first.n", "v").toPandas().sort_values(["h", "id", "n"])
        x = np.stack(taken["v"].to_numpy())
        fitted = fit_arrays(x, books, min(words, len(x)))
    near = _shortlists(asked, distinct, fitted, n_queries, n_vectors, k + 1 if exact else max(shortlist, k + 1))
    near = near.join(distinct.select("first", "v"), "first").join(asked, "query_id")
    scored = near.select("query_id", "first", F.aggregate(F.zip_with("qv", "v", lambda a, b: a * b), F.lit(0.0), lambda s, p: s + p).alias("score"))
    found = _best(scored, "score", k + 1).join(distinct.select("first", "ids"), "first").select("query_id", "score", F.explode("ids").alias("id")).filter("id != query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")


def _shortlists(asked: DataFrame, distinct: DataFrame, fitted: Quantiser | None, n_queries: int, n_vectors: int, shortlist: int) -> DataFrame:
    """(query_id, first): the vectors of each query's shortlist; without a quantiser, by the vectors themselves."""
    query_blocks, code_blocks = (max(1, -(-n // size)) for n, size in ((n_queries, QUERY_BLOCK), (n_vectors, CODE_BLOCK)))
    grouped = asked.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).cast("int").alias("query_block")).agg(F.collect_list("query_id").alias("query_ids"), F.collect_list("qv").alias("query_vectors"))

    def encode(block: pa.Table) -> pa.Table:
        x = _matrix(block["v"].combine_chunks())
        codes = x if fitted is None else fitted.encode(x)
        ratios = np.ones(len(x), np.float32) if fitted is None else norm_ratios(x, fitted.decode(codes))
        parts = {"ids": block["id"].to_numpy(), "numbers": block["n"].to_numpy(), "codes": codes, "ratios": ratios}
        return pa.table({"code_block": block["code_block"][:1]} | {k: pa.array([p.tobytes()], pa.binary()) for k, p in parts.items()})

    # blocks by hash, so that a block has about CODE_BLOCK vectors whatever the partitions
    dealt = distinct.select(F.pmod(F.xxhash64("first"), F.lit(code_blocks)).cast("int").alias("code_block"), "first.id", "first.n", "v")
    codes = written(dealt.groupBy("code_block").applyInArrow(encode, "code_block int, ids binary, numbers binary, codes binary, ratios binary"), "codes")
    meetings = codes.withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))).join(grouped, "query_block")
    most = shortlist if fitted is None else of_block(shortlist, code_blocks)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, numbers, codes, ratios = (np.frombuffer(batch.column(c)[i].as_py(), dtype=t) for c, t in enumerate((np.int64, np.int32, np.float64 if fitted is None else np.uint8, np.float32)))
                codes = codes.reshape(len(ids), -1)
                query_ids, q = np.array(batch.column(4)[i].as_py(), dtype=np.int64), np.array(batch.column(5)[i].as_py(), dtype=np.float64)
                for b in range(0, len(query_ids), AT_ONCE):
                    place, rough = rough_best(q[b : b + AT_ONCE], codes, ratios, fitted, most)
                    first = pa.StructArray.from_arrays([pa.array(ids[place.ravel()]), pa.array(numbers[place.ravel()])], ["id", "n"])
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(query_ids[b : b + AT_ONCE], place.shape[1])), first, pa.array(rough.ravel().astype(np.float64))], names=["query_id", "first", "rough"])

    tasks = max(1, min(4 * query_blocks * code_blocks, 1 << 16))
    dealt = meetings.select("ids", "numbers", "codes", "ratios", "query_ids", "query_vectors", "query_block", "code_block").repartition(tasks, "query_block", "code_block")
    return _best(dealt.mapInArrow(search, "query_id long, first struct<id:long,n:int>, rough double"), "rough", shortlist).select("query_id", "first")
