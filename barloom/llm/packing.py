"""Best-fit packing with exact-complement hashing.

Pieces of at most ``limit`` tokens are packed by their lengths alone, and there are at most ``limit``
different lengths, so the plan is made on the length histogram (at most 2048 counts, whatever the
corpus): a plan is a list of patterns (lengths that share a sequence) with how often each is used.

1. Exact complements: from the longest length down, the gap it leaves is looked up among the
   available lengths as one length, as a sum of two, then of three; each hit is used as often as the
   availability counts allow. Long partners go first.
2. Best fit: what is left goes, longest first, into the open pattern with the smallest room that
   holds it, in bulk; new sequences are opened only when nothing fits.

Pieces then take their places by rank within their length. A length's pieces are dealt by hash to
chunks of about ``CHUNK`` rows; chunk counts are summed up within groups of ``CHUNKS`` chunks and then over the
groups, and only inside a chunk are rows numbered. So no length, however common, meets in one task. The hash
takes in where a row stood in its batch, so that null and repeated ids are dealt apart too.

Defined results: null or empty text is one piece of one token (the end id); rows repeated with the
same id, and null ids, are packed as often as they occur; which of the pieces of one length takes which place is
left open; very long texts are cut at every 2048 tokens; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import slices, written

LIMIT = 2048
CHUNK, CHUNKS = 256, 4096
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
STOOD = "__stood"


def token_pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """The pieces of every document: ids by the tokenizer, then end_id, cut at limit only if longer.

    A last column says where the document stood in its batch. with_ids adds the piece's ids as an array.
    """
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, id_type), *T._parse_datatype_string(PIECES).fields[1:]] + ([T.StructField("ids", T.ArrayType(T.LongType(), False))] if with_ids else []) + [T.StructField(STOOD, T.IntegerType())])
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from barloom.llm.tokens import word_ids

        ids_of = word_ids(tokenizer_path)
        for batch in slices(batches):
            names, out = batch.column(0), {k: [] for k in ("row", "piece", "start", "length", "crc", "ids")}
            for row, ids in enumerate(ids_of.encode(batch.column(1).cast(pa.binary()).to_pylist())):
                raw = memoryview(ids + end)
                for k, at in enumerate(range(0, len(raw), 4 * limit)):
                    part = raw[at : at + 4 * limit]
                    out["row"].append(row), out["piece"].append(k), out["start"].append(at // 4), out["length"].append(len(part) // 4), out["crc"].append(zlib.crc32(part))
                    if with_ids:
                        out["ids"].append(np.frombuffer(part, dtype="<u4").astype(np.int64))
            columns = [names.take(pa.array(out["row"], pa.int64())), pa.array(out["piece"], pa.int32()), *(pa.array(out[k], pa.int64()) for k in ("start", "length", "crc"))]
            if with_ids:
                columns.append(pa.array(out["ids"], pa.list_(pa.int64())))
            columns.append(pa.array(out["row"], pa.int32()))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(cut, schema)


def plan(counts: dict[int, int], limit: int = LIMIT) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths that share a sequence, at most limit together) and how often each is used."""
    have = np.zeros(limit + 1, dtype=np.int64)
    for length, n in counts.items():
        if not 1 <= length <= limit:
            raise ValueError(f"length {length} is not in 1..{limit}")
        have[length] = n
    used: list[tuple[tuple[int, ...], int]] = []

    def use(*lengths: int) -> None:
        kinds, times = np.unique(lengths, return_counts=True)
        n = int((have[kinds] // times).min())
        if n:
            have[kinds] -= n * times
            used.append((lengths, n))

    def pairs(total: int, most: int) -> np.ndarray:
        """Available a with a >= total - a, a <= most and total - a available too, longest first."""
        a = np.arange(min(most, total - 1), (total - 1) // 2, -1)
        return a[(have[a] > 0) & (have[total - a] > 0)] if len(a) else a

    for top in range(limit, 0, -1):
        if not have[top]:
            continue
        gap = limit - top
        if gap == 0:
            use(top)
            continue
        if gap <= top:
            use(top, gap)
        for a in pairs(gap, top).tolist():
            if not have[top]:
                break
            use(top, a, gap - a)
        if have[top]:
            firsts = np.arange(min(top, gap - 2), (gap + 2) // 3 - 1, -1)
            for a in firsts[have[firsts] > 0].tolist() if len(firsts) else ():
                if not have[top]:
                    break
                for b in pairs(gap - a, a).tolist():
                    if not have[top] or not have[a]:
                        break
                    use(top, a, b, gap - a - b)
    rooms: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    open_rooms = np.zeros(limit + 1, dtype=bool)

    def put(pattern: tuple[int, ...], n: int) -> None:
        room = limit - sum(pattern)
        rooms.setdefault(room, []).append((pattern, n))
        open_rooms[room] = True

    for length in range(limit, 0, -1):
        left = int(have[length])
        while left:
            fitting = np.flatnonzero(open_rooms[length:])
            if not len(fitting):
                fit = limit // length
                if left >= fit:
                    put((length,) * fit, left // fit)
                if left % fit:
                    put((length,) * (left % fit), 1)
                break
            room = length + int(fitting[0])
            pattern, n = rooms[room].pop()
            open_rooms[room] = bool(rooms[room])
            fit = room // length
            if left >= fit:
                times = min(n, left // fit)
                put(pattern + (length,) * fit, times)
                left -= times * fit
                if n > times:
                    put(pattern, n - times)
            else:
                put(pattern + (length,) * left, 1)
                if n > 1:
                    put(pattern, n - 1)
                left = 0
    return used + [x for room in rooms.values() for x in room]


class Places:
    """Where the r-th piece of a length goes, from the patterns in order."""

    def __init__(self, patterns: list[tuple[tuple[int, ...], int]]):
        taken: dict[int, int] = {}
        by: dict[int, list[tuple[int, int, int]]] = {}
        base = 0
        for lengths, n in patterns:
            at = 0
            for length in lengths:
                first = taken.get(length, 0)
                by.setdefault(length, []).append((first, base, at))
                taken[length] = first + n
                at += length
            base += n
        self.sequences = base
        self.by = {k: tuple(np.array(x, dtype=np.int64) for x in zip(*v, strict=True)) for k, v in by.items()}

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(rank), dtype=np.int64), np.zeros(len(rank), dtype=np.int64)
        for k in np.unique(length):
            here = length == k
            first, base, at = self.by[int(k)]
            i = np.searchsorted(first, rank[here], side="right") - 1
            sequence[here], offset[here] = base[i] + rank[here] - first[i], at[i]
        return sequence, offset


def pack(pieces: DataFrame, length_col: str = "length", order: tuple[str, ...] = ("doc_id", "piece"), limit: int = LIMIT) -> DataFrame:
    """pieces with sequence_id and offset. pieces should be cheap to read twice (a written table)."""
    histogram = {int(r[0]): int(r[1]) for r in pieces.groupBy(length_col).count().collect()}  # at most limit rows
    places = Places(plan(histogram, limit))
    n_chunks = F.create_map(*[F.lit(x) for k, n in sorted(histogram.items()) if n > CHUNK for x in (k, -(-n // CHUNK))]) if any(n > CHUNK for n in histogram.values()) else None
    many = F.coalesce(F.element_at(n_chunks, F.col(length_col).cast("int")), F.lit(1)) if n_chunks is not None else F.lit(1)
    stood = [STOOD] if STOOD in pieces.columns else []
    dealt = pieces.withColumn("__chunk", F.pmod(F.xxhash64(*order, *stood), many).cast("int"))
    per_chunk = dealt.groupBy(F.col(length_col).alias("__length"), F.col("__chunk").alias("__c")).agg(F.count(F.lit(1)).alias("__n")).withColumn("__group", F.floor(F.col("__c") / CHUNKS))

    def upto(n: str, by: list[str], at: str):
        return F.coalesce(F.sum(n).over(Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    groups = per_chunk.groupBy("__length", "__group").agg(F.sum("__n").alias("__of_group")).select("__length", "__group", upto("__of_group", ["__length"], "__group").alias("__first"))
    before = per_chunk.withColumn("__in_group", upto("__n", ["__length", "__group"], "__c")).join(groups, ["__length", "__group"]).select("__length", "__c", (F.col("__first") + F.col("__in_group")).alias("__before"))
    inside = F.row_number().over(Window.partitionBy(length_col, "__chunk").orderBy(*order, *stood))
    ranked = dealt.join(before, (F.col(length_col) == F.col("__length")) & (F.col("__chunk") == F.col("__c"))).withColumn("__rank", F.col("__before") + inside - 1)
    kept = [c for c in pieces.columns if c != STOOD]

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        s, o = places.of(length.to_numpy(), rank.to_numpy())
        return pd.DataFrame({"sequence_id": s, "offset": o})

    return ranked.select(*kept, place(F.col(length_col), F.col("__rank")).alias("__at")).select(*kept, "__at.sequence_id", "__at.offset")


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, end_id: int = 0) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = written(token_pieces(docs, tokenizer_path, id_col, text_col, limit, end_id), "pieces")
    return pack(pieces, order=(id_col, "piece"), limit=limit)
