"""Training-corpus pipeline over ``documents``: language ID, exact and near deduplication, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and read again as the
next one's docs; all but the last return the columns of documents. Every stage takes null ids, texts, languages
and sources, repeated rows, very long texts and extra columns, and gives no rows for an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import small_arrow_batches, written
from barloom.llm.exact_dedup import drop_exact_copies
from barloom.llm.language_id import fit, fold, identify
from barloom.llm.minhash import near_duplicates
from barloom.llm.mixing import mixed
from barloom.llm.packing import pack_documents
from barloom.llm.queries import tokenizer_path

#: An ambiguous text with a lower score is rejected, as is one without a letter.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: rejected are texts without a letter and ambiguous ones of low score.

    Null and empty texts have no letter. Repeated rows are judged alike. Without any known language none stays.
    """
    model = fit(docs.filter(fold("doc_id", 4) != 2))
    names = [f"c{i}" for i in range(len(docs.columns))]
    named = identify(docs.toDF(*names), model, names[docs.columns.index("text")], tuple(names))
    rejected = (F.col("lang_pred") == "und") | (F.col("ambiguous") & (F.col("score") < LEAST_SCORE))
    return named.filter(~rejected).select(*names).toDF(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the largest id, null ids only if there is no other."""
    return drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: the one with the smallest id.

    Documents without a word or with a null id stay. Of repeated rows of one id and text one stays; different
    texts of the id that stays all stay.
    """
    text_hash = F.xxhash64(docs["text"].cast("string"))
    found = near_duplicates(docs, with_text_hash=True).filter("kept").groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    found = written(found.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "n"), "kept")
    mine = docs["doc_id"].eqNullSafe(found["__id"]) & (text_hash == found["__hash"])
    often = found.filter("n > 1 and __id is not null")
    if often.isEmpty():
        return docs.join(found, mine, "left_semi")
    again = docs["doc_id"].eqNullSafe(often["__id"]) & (text_hash == often["__hash"])
    return docs.join(found, mine, "left_semi").join(often, again, "left_anti").unionByName(docs.join(often, again, "left_semi").dropDuplicates(["doc_id", "text"]))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents drawn to the sources' targets; a document drawn twice is there twice.

    Documents without a word are in no draw; a null source is a source of its own.
    """
    return mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens; a null text is empty, and repeated rows are packed each."""
    return pack_documents(docs, tokenizer_path())


STAGES = [("language_id", language), ("exact_dedup", exact), ("near_dedup", near), ("mix_sources", mix), ("best_fit_packing", pack)]

#: The classifier and the samplers cannot be stated in SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with small_arrow_batches(spark):
        for name, stage in STAGES:
            docs = stage(spark, docs, sf_dir)
            if name != STAGES[-1][0]:
                docs = written(docs, name)
    return docs
