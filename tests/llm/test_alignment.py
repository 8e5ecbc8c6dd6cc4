"""Alignment against byte intervals worked out for each whole text by the libraries."""

import hashlib
import random
from collections import Counter
from itertools import accumulate

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from barloom.llm.alignment import Mismatch, Transducer, align_documents, cut

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def libraries():
    import sentencepiece
    from tokenizers import Tokenizer, decoders

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(x): x for x in visible} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in visible)}
    assert decoders.ByteLevel().decode(["Ġ"]) == " "
    of_a = lambda i: bytes(byte[c] for c in a.id_to_token(i))
    of_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    return lambda t: a.encode(t, add_special_tokens=False).ids, b.encode, of_a, of_b


def plain(rows):
    encode_a, encode_b, of_a, of_b = libraries()
    docs, holds = [], Counter()
    for d, text in rows:
        links, groups = [], []
        if text:
            a, b = encode_a(" " + text), encode_b(text)
            spelt = [b"".join(map(of_a, a)), b"".join(map(of_b, b))]
            if spelt == [(" " + text).encode()] * 2:
                ends_a, ends_b = (list(accumulate(len(of(i)) for i in ids)) for of, ids in ((of_a, a), (of_b, b)))
                i = j = from_i = from_j = 0
                while i < len(a):
                    links.append((a[i], b[j]))
                    x, y = ends_a[i], ends_b[j]
                    i, j = i + (x <= y), j + (y <= x)
                    if x == y:
                        groups.append(",".join(map(str, a[from_i:i])) + "|" + ",".join(map(str, b[from_j:j])))
                        from_i, from_j = i, j
        holds.update(set(links))
        docs.append((d, len(a) if links else 0, len(b) if links else 0, links, groups))
    top = {}
    for (x, _), n in holds.items():
        top[x] = max(n, top.get(x, 0))
    return sorted((d is None, d or 0, n_a, n_b, len(g), len(links), sum(holds[p] == top[p[0]] for p in links), sum(holds[p] for p in links), hashlib.sha256(";".join(g).encode()).hexdigest() if links else "") for d, n_a, n_b, links, g in docs)


def result(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect())


def test_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert result(align_documents(docs, A, B)) == plain([tuple(r) for r in docs.select("doc_id", "text").collect()])


@pytest.mark.parametrize("slice_pairs", [50, 4_000_000])
def test_odd_texts_and_clashing_columns(spark, slice_pairs):
    rng = random.Random(6)
    texts = [None, "", " ", "  a  b ", "\n", "a\n b", "a \nb", "<|endoftext|> <s> </s> <0x0A>", "▁x y", " a　b ﬁ ＡＢ", "\x00 a\x1c b", "it's we'll  I'm", "日本 語 👍🏽", "x" * 20_000, " ".join(["word"] * 30_000)]
    texts += ["".join(rng.choice(" \n\ta'b1.éß日👍<|s  ,Zx") for _ in range(rng.randrange(1, 25))) for _ in range(400)]
    rows = [(i % 300, t) for i, t in enumerate(texts)] + [(None, "again and again")] * 3
    docs = spark.createDataFrame([(d, t, "p") for d, t in rows], "doc_id long, text string, pairs string").withColumn("id", F.lit(1)).withColumn("n_a", F.lit("x"))
    assert result(align_documents(docs, A, B, slice_pairs=slice_pairs)) == plain(rows)
    assert align_documents(docs.limit(0), A, B).collect() == []


def test_cuts_give_the_text_back():
    rng = random.Random(7)
    for _ in range(500):
        text = "".join(rng.choice(" \n\tab.") for _ in range(rng.randrange(1, 20)))
        assert "".join(" " + p for p in cut(text)) == " " + text
    assert cut("a b  c \nd e") == ["a", "b  c \nd", "e"]


def test_transducer_by_hand():
    t = Transducer([b"ab", b"c", b"abc", b"x"], [b"a", b"bc", b"abc", b""])
    ends = lambda a, b: [(len(a), len(b))]
    n_a, n_b, n_groups, groups, links = t.align([0, 1, 2], [0, 1, 2], ends([0, 1, 2], [0, 1, 2]))[0]
    assert (n_a, n_b, n_groups, groups) == (3, 3, 2, "0,1|0,1;2|2") and len(links) == 8 * 4
    for a, b in (([0], [0]), ([3], [0]), ([0, 1], [0, 3]), ([2], [2, 0])):
        with pytest.raises(Mismatch):
            t.align(a, b, ends(a, b))
