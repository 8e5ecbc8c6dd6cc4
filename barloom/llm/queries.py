"""The training-data operators as queries over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import TOKENIZER_FILE, table


def tokenizer_path(name: str = TOKENIZER_FILE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.llm.suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.llm.language_id import identify_by_folds

    return identify_by_folds(table(spark, sf_dir, "documents"))


def op4_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.llm.ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.llm.exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"), keep="max")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.llm.toxicity import score_by_folds

    return score_by_folds(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.llm.lm_scores import score_documents

    scored = score_documents(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_tokens", *[F.round(c, 4).alias(c) for c in ("log_score", "mean_log", "perplexity", "others_log_score")])


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.llm.html_extract import extract

    return extract(table(spark, sf_dir, "pages"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.llm.mixing import draws

    mix = draws(table(spark, sf_dir, "documents"), keep=("doc_id",))
    return mix.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), F.aggregate("mix_draws", F.lit(0).cast("long"), lambda n, d: n + d["words"]).alias("taken"))


def op11_bin_packing_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.llm.sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"), shards=24)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.llm.spelling import group_variants

    return group_variants(table(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.llm.alignment import align_documents

    return align_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_best_fit_packing, op2_suffix_array_dedup, op3_language_id, op4_additive_quantisation, op5_exact_dedup, op6_toxicity, op7_mix_sources, op8_lm_scores, op9_html_extraction, op10_minhash_near_dedup, op11_bin_packing_shards, op12_spelling_variants, op13_token_alignment)}


def oracle_sql() -> dict[str, str]:
    return {
        "op5_exact_dedup": """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm)""",
        "op8_lm_scores": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9\x{80}-\x{10FFFF}]+') AS words FROM documents),
w AS (SELECT r, unnest(words) AS c, generate_subscripts(words, 1) AS i, len(words) AS n FROM d),
g AS (SELECT r, i, n, c, lag(c) OVER t AS b, lag(c, 2) OVER t AS a FROM w WINDOW t AS (PARTITION BY r ORDER BY i)),
k AS (SELECT r, i, n, (SELECT sum(len(words)) FROM d) AS total,
             count(*) OVER (PARTITION BY c) AS c1, count(*) OVER (PARTITION BY b, c) AS c2, count(*) OVER (PARTITION BY a, b, c) AS c3,
             count(*) OVER (PARTITION BY r, c) AS o1, count(*) OVER (PARTITION BY r, b, c) AS o2, count(*) OVER (PARTITION BY r, a, b, c) AS o3
      FROM g),
p AS (SELECT *, lag(c1) OVER t AS x1, lag(c2) OVER t AS x2, lag(c1 - o1) OVER t AS y1, lag(c2 - o2) OVER t AS y2 FROM k WINDOW t AS (PARTITION BY r ORDER BY i)),
l AS (SELECT r, CASE WHEN i > 2 THEN ln(c3 / x2) WHEN i = 2 THEN ln(c2 / x1) + ln(0.4e0) ELSE ln(c1 / total) + 2 * ln(0.4e0) END AS every,
             CASE WHEN i > 2 AND c3 > o3 AND y2 > 0 THEN ln((c3 - o3) / y2)
                  WHEN i > 1 AND c2 > o2 AND y1 > 0 THEN ln((c2 - o2) / y1) + ln(0.4e0)
                  ELSE ln(CASE WHEN c1 > o1 THEN c1 - o1 ELSE 0.5e0 END / greatest(total - n, 1)) + 2 * ln(0.4e0) END AS others FROM p),
s AS (SELECT r, sum(every) AS every, sum(others) AS others FROM l GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_tokens, round(coalesce(every, 0), 4) AS log_score, round(every / len(words), 4) AS mean_log,
       round(exp(-every / len(words)), 4) AS perplexity, round(coalesce(others, 0), 4) AS others_log_score
FROM d LEFT JOIN s USING (r)""",
        "op12_spelling_variants": r"""
WITH RECURSIVE
t AS (SELECT list_transform(range(256), lambda x: list_reduce(list_concat([x], range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
r AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
u AS (SELECT w, count(*) AS n, hex(coalesce(doc_id::VARCHAR, '') || ':' || w) AS x FROM r GROUP BY doc_id, w),
h AS (SELECT w, n, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
                              lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM u, t),
m AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM h),
words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM m WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
p AS (SELECT word, unnest(range(length(word))) AS i FROM words),
d AS MATERIALIZED (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS less FROM p),
near AS (SELECT x.word, y.word AS near FROM d x JOIN d y ON x.i = y.i AND x.less = y.less AND x.word <> y.word
         UNION SELECT d.word, v.word FROM d JOIN words v ON d.less = v.word
         UNION SELECT v.word, d.word FROM d JOIN words v ON d.less = v.word),
k AS (SELECT near.word, near, v.n AS near_n, count(*) OVER (PARTITION BY near.word) AS n_near, row_number() OVER (PARTITION BY near.word ORDER BY v.n DESC, near) AS place FROM near JOIN words v ON v.word = near),
told AS MATERIALIZED (SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * words.n THEN near END AS form, CASE WHEN near_n >= 2 * words.n THEN near_n END AS form_n
         FROM words LEFT JOIN k ON k.word = words.word AND place = 1),
chain AS (SELECT word, form, word AS root FROM told UNION ALL SELECT chain.word, told.form, told.word FROM chain JOIN told ON told.word = chain.form)
SELECT word, told.form, root, n, n_near, form_n FROM told JOIN (SELECT word, root FROM chain WHERE form IS NULL) USING (word)""",
    }
