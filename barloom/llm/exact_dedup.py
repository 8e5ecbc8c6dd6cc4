"""Exact deduplication by 128-bit content hash, with byte comparison inside each hash group.

Everything is DataFrame code. Texts are equal when identical after lower-casing A-Z only.

1. ``groupBy(hash, text)`` finds the classes. The hash leads the key, so texts are only compared
   byte by byte with texts of the same hash; partial aggregation folds copies before the shuffle, so
   a text that fills a third of the table sends one row per task.
2. The classes are written without their texts. A hash with two classes is a collision; its rows
   are joined by hash and text, all others by hash alone.
3. The join back to the rows is an ordinary equi-join of thin rows, which adaptive execution splits
   where one hash is hot.

Defined results: null text counts as empty, empty texts form a class, null ids never win over
others (a class with null ids only has keep_id null and keeps its rows), rows repeated with the same
id and text count in group_size and are all marked kept, very long texts are hashed and compared whole, an
empty table gives no rows, other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import text_or_empty, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; pure ASCII takes the fast built-in."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def md5_128(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", content_hash: Callable[[Column], Column] = md5_128) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    keep: "max" or "min", which id of a class stays.
    """
    pick = {"max": F.max, "min": F.min}[keep]
    rows = docs.select(F.col(id_col).alias("id"), ascii_lower(text_or_empty(text_col)).alias("norm")).select("id", content_hash(F.col("norm")).alias("h"), "norm")

    def classes(of: DataFrame) -> DataFrame:
        return of.groupBy("h", "norm").agg(pick("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))

    found = written(classes(rows).select("h", "keep_id", "group_size", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256")), "classes")
    collided = found.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h")
    none_collided = collided.isEmpty()

    thin = rows.select("id", "h")
    out = thin.join(found, "h")
    if not none_collided:
        collided = written(collided, "collided")
        apart = rows.join(collided, "h", "left_semi")
        by_text = classes(apart).withColumn("text_sha256", F.sha2(F.col("norm").cast("binary"), 256))
        out = thin.join(collided, "h", "left_anti").join(found, "h").select("id", "keep_id", "group_size", "text_sha256").unionByName(apart.join(by_text, ["h", "norm"]).select("id", "keep_id", "group_size", "text_sha256"))
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", content_hash: Callable[[Column], Column] = md5_128) -> DataFrame:
    """The rows of docs that stay, with all their columns: one of each class of equal texts.

    It is the row of the class's largest id; of several such rows, one with the smallest text before
    lower-casing. Rows are matched to their class and not to an id alone, so null and repeated ids are
    judged by their texts.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    id_, text = (names[docs.columns.index(c)] for c in (id_col, text_col))
    norm = ascii_lower(text_or_empty(text))
    rows = docs.toDF(*names).withColumn("h", content_hash(norm))
    classes = rows.select("h", F.col(id_).alias("id"), norm.alias("norm")).groupBy("h", "norm").agg(F.max("id").alias("keep_id"))
    winners = written(classes.select("h", "keep_id"), "winners")
    mine = (rows["h"] == winners["h"]) & rows[id_].eqNullSafe(winners["keep_id"])
    often = written(rows.select("h", F.col(id_).alias("id")).join(winners, "h").filter(F.col("id").eqNullSafe(F.col("keep_id"))).groupBy("h", "id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "often")
    stays = rows.join(winners, mine, "left_semi")
    if not often.isEmpty():
        several = (stays["h"] == often["h"]) & stays[id_].eqNullSafe(often["id"])
        first = stays.join(often, several, "left_semi").withColumn("norm", norm).groupBy("h", "norm", id_).agg(F.min_by(F.struct(*names), text_or_empty(text)).alias("row"))
        stays = stays.join(often, several, "left_anti").select(*names).unionByName(first.select("row.*"))
    return stays.select(*names).toDF(*docs.columns)
