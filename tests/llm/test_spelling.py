"""Spelling variants against brute force, also with keys taken apart and odd tables."""

import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from barloom.llm.queries import op12_spelling_variants, oracle_sql
from barloom.llm.spelling import group_variants, near_words, one_edit


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def plain(rows):
    total = Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            total[w] += 1
    n = {w: k for w, k in total.items() if len(w) >= 5 and k >= 3}
    out = {}
    by_length = {}
    for w in n:
        by_length.setdefault(len(w), []).append(w)
    for w in n:
        near = [u for m in (-1, 0, 1) for u in by_length.get(len(w) + m, ()) if one_edit(w, u)]
        best = min(near, key=lambda u: (-n[u], u), default=None)
        form = best if best is not None and n[best] >= 2 * n[w] else None
        out[w] = [form, n[w], len(near), n[form] if form else None]
    for w in out:
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w].insert(1, root)
    return {w: tuple(x) for w, x in out.items()}


def result(df):
    rows = df.collect()
    assert len(rows) == len({r.word for r in rows})
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def test_one_edit_is_distance_one():
    rng = random.Random(4)
    for _ in range(3000):
        a, b = ("".join(rng.choice("abé") for _ in range(rng.randrange(6))) for _ in range(2))
        assert one_edit(a, b) == (plain_distance(a, b) == 1)


def test_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = plain([tuple(r) for r in docs.select("doc_id", "text").collect()])
    got = result(group_variants(docs))
    assert got == want and sum(x[0] is not None for x in got.values()) > 100


def test_the_query_equals_its_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = op12_spelling_variants(spark, sf)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({oracle_sql()['op12_spelling_variants']})").fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


@pytest.mark.parametrize("most", [3, 20_000])
def test_many_words_with_one_half(spark, most):
    """All words share halves, so that every key is over the bound and is taken apart."""
    rng = random.Random(most)
    words = {"".join(rng.choice("ab") for _ in range(rng.randrange(1, 9))) + "zz" for _ in range(250)} | {"prefix" + "".join(rng.choice("abc") for _ in range(rng.randrange(4))) for _ in range(120)}
    words = sorted(w for w in words if len(w) >= 5)
    n = {w: rng.randrange(3, 50) for w in words}
    got = [tuple(r) for r in near_words(spark.createDataFrame(list(n.items()), "word string, n long"), most_holders=most).collect()]
    want = [(a, n[a], b, n[b]) for a in words for b in words if plain_distance(a, b) == 1]
    assert sorted(got) == sorted(want)


def test_odd_rows_and_clashing_columns(spark):
    texts = [(1, None), (None, ""), (None, "house house HOUSE Hause hause hause"), (2, "Straße straße straße Stra×e 12house house"), (2, "x" * 300_000), (2, "x" * 300_000), (2, "x" * 300_000), (2, ("x" * 299_999 + "y ") * 7), (2, "x" * 300_001), (2, "x" * 300_001), (2, "x" * 300_001), (3, "y".join(["ÀÉÎÕÜ"] * 4) + " İstanbul istanbul"), (4, "houses houses houses " * 5), (4, "houses houses houses " * 5)]
    docs = spark.createDataFrame([(d, t, "w") for d, t in texts], "doc_id long, text string, word string").withColumn("n", F.lit("x")).withColumn("id", F.lit(None).cast("string"))
    got = result(group_variants(docs))
    assert got == plain(texts) and sum(x[3] for w, x in got.items() if len(w) > 200_000) > 0
    assert group_variants(docs.limit(0)).collect() == []
