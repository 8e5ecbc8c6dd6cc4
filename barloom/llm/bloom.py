"""A Bloom filter of ids, to send on the few texts that a later join needs, and compressed.

The filter has at most MOST_BITS bits, so what the driver holds and ships is bounded whatever the number
of ids; where they are too many it lets more rows through, and the exact join after it decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import slices

BITS_PER_ID, MOST_BITS = 16, 1 << 26
HASHES = 4


def _places(id_: Column) -> Column:
    return F.array(*[F.xxhash64(F.lit(k), id_) for k in range(HASHES)])


@dataclass
class Bloom:
    words: np.ndarray

    @classmethod
    def of(cls, ids: DataFrame) -> "Bloom":
        """The filter of the rows (id); ids should be cheap to read twice."""
        size = 64
        need = min(MOST_BITS, BITS_PER_ID * ids.count())
        while size < need:
            size *= 2
        place = F.explode(F.transform(_places(F.col("id")), lambda h: F.pmod(h, F.lit(size).cast("long"))))
        marks = ids.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits"))
        got = marks.toPandas()
        words = np.zeros(size // 64, dtype=np.uint64)
        words[got["word"].to_numpy(dtype=np.int64)] = got["bits"].to_numpy(dtype=np.int64).view(np.uint64)
        return cls(words)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        """[row, hash] -> whether the row's id may be in."""
        place = np.mod(hashes, np.int64(64 * len(self.words)))
        return ((self.words[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1)).all(axis=1)


def packed_texts(rows: DataFrame, bloom: Bloom) -> DataFrame:
    """(id, text_hash, text) of the rows that the filter lets through, text as compressed bytes; null stays null."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor()
        for batch in slices(batches):
            hashes = batch.column(2).flatten().to_numpy().reshape(-1, HASHES)
            keep = pa.array(bloom.has(hashes))
            texts = batch.column(3).filter(keep).cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array([None if t is None else press.compress(t) for t in texts], pa.binary())], names=["id", "text_hash", "text"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.filter("id is not null").select("id", "text_hash", _places(F.col("id")), "text").mapInArrow(pack, f"id {kind}, text_hash long, text binary")


def unpacked(texts: pa.Array) -> list[str | None]:
    import zstandard

    press = zstandard.ZstdDecompressor()
    return [None if t is None else press.decompress(t).decode("utf-8", "replace") for t in texts.to_pylist()]
