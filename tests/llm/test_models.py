"""Language ID, toxicity, language-model scores and search: held-out accuracy, brute force, edge cases."""

import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import ann, chargrams, language_id, lm_scores, toxicity
from barloom.llm.ann import fit_arrays, nearest
from barloom.llm.language_id import BITS, ORDERS, codewords, fit, identify, identify_by_folds
from barloom.llm.lm_scores import pack_sorted, score_documents, unpack_sorted

SYLLABLES = {"aa": "the ing and er tion".split(), "bb": "der ung sch ein ich".split(), "cc": "que eau oui les ais".split()}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


# ---- language


def test_codewords_differ_and_every_bit_parts_the_languages():
    for n in (2, 3, 4, 5, 12, 40):
        code = codewords(n)
        assert len({tuple(r) for r in code}) == n and (np.abs(code.sum(axis=0)) < n).all()
    distance = min((codewords(4)[i] != codewords(4)[j]).sum() for i in range(4) for j in range(i))
    assert codewords(4).shape == (4, 7) and distance == 4


def test_language_held_out_and_edge_cases(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, lang := rng.choice("abc") * 2, rng.randint(3, 60)), lang) for i in range(400)]
    odd = [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 ?!", "bb"), (1003, "the " * 50_000, None), (None, prose(rng, "cc", 30), "cc")]
    df = spark.createDataFrame(rows + odd + rows[:1], "doc_id long, text string, lang string").withColumns({"score": F.lit(5), "lang_pred": F.lit("q")})
    got = identify_by_folds(df).collect()
    assert len(got) == len(rows) + len(odd) + 1
    by = {r.doc_id: r for r in got}
    assert all(r.held_out == (r.doc_id is not None and fold(r.doc_id, 4) == 2) for r in got)
    held = [(i, lang) for i, _, lang in rows if fold(i, 4) == 2]
    assert sum(by[i].lang_pred == lang for i, lang in held) / len(held) > 0.97
    assert [by[i].lang_pred for i in (1000, 1001, 1002, 1003, None)] == ["und"] * 3 + ["aa", "cc"]
    assert all(0 <= r.score <= 1 for r in got) and by[1000].score == 0
    model = fit(df.filter("doc_id < 1000"))
    mixed = identify(spark.createDataFrame([(1, " ".join(prose(rng, x, 40) for x in ("aa", "bb")))], "doc_id long, text string"), model).first()
    assert mixed.score < 0.9


def test_language_of_texts_longer_than_a_piece(spark, monkeypatch):
    """Margins don't depend on how texts are cut into pieces, and a text of megabytes takes little beside its own size."""
    rng = random.Random(5)
    docs = spark.createDataFrame([(i, prose(rng, x, 40), x) for i in range(30) for x in SYLLABLES], "doc_id long, text string, lang string")
    model = fit(docs)
    texts = [prose(rng, x, n) for n in (1, 7, 60) for x in SYLLABLES] + [None, "", "a"]
    whole = model.margins(texts)
    for piece in (1, 2, 9, 1000):
        monkeypatch.setattr(language_id, "PIECE", piece)
        np.testing.assert_allclose(model.margins(texts), whole, rtol=1e-4, atol=1e-6)
    monkeypatch.undo()
    long = "the ing und ".join([""] * 400_000)
    tracemalloc.start()
    model.margins([long])
    assert tracemalloc.get_traced_memory()[1] < 45 * len(long)
    tracemalloc.stop()


def test_language_sample_is_the_same_at_every_run(spark):
    """Also where ids are null or repeated, and one row fills most of the table."""
    rng = random.Random(6)
    rows = [(None, prose(rng, x, 9), x) for _ in range(40) for x in SYLLABLES] + [(7, prose(rng, "aa", 9), "aa")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = [fit(docs.repartition(n), calibration_rows=30) for n in (1, 3, 7)]
    for m in models[1:]:
        np.testing.assert_allclose(m.spread, models[0].spread)
        np.testing.assert_array_equal(m.trust, models[0].trust)


def test_language_with_none_or_one_language(spark):
    df = spark.createDataFrame([(i, "some words", None) for i in range(5)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in identify_by_folds(df).collect()} == {"und"}
    one = df.withColumn("lang", F.lit("xx"))
    assert {(r.lang_pred, r.score) for r in identify_by_folds(one).collect()} == {("xx", 1.0)}
    assert identify_by_folds(df.filter("false")).count() == 0


def plain_windows(text):
    """The 2- and 3-byte strings of a text between blanks, as the classifiers see them."""
    raw = "".join(c if ord(c) >= 128 or c.isalpha() else " " for c in (text or "").lower()).encode()
    padded = b" " * chargrams.GAP + raw + b" " * chargrams.GAP
    return [[padded[k : k + n] for k in range(chargrams.GAP + len(raw))] for n in ORDERS]


def plain_bucket(gram):
    return int(chargrams.hashed(np.array([int.from_bytes(gram, "big")], dtype=np.uint64), BITS, len(gram))[0]) + (ORDERS.index(len(gram)) << BITS)


def test_language_equals_a_plain_version(spark):
    rng = random.Random(31)
    rows = [(i, prose(rng, lang, rng.randint(3, 25)), lang) for i in range(90) for lang in [rng.choice(["aa", "bb", "cc"])]] + [(90, "été ähnlich", "cc"), (91, "12 ?", "aa"), (92, None, "aa"), (93, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = fit(df.filter(~F.col("doc_id").isin([i for i, *_ in rows if fold(i, 4) == 2])))
    counts = {x: Counter() for x in model.languages}
    for i, t, lang in rows:
        if fold(i, 4) != 2 and t is not None and lang is not None:
            for grams in plain_windows(t):
                counts[lang].update(plain_bucket(g) for g in grams)
    blank = {plain_bucket(b" " * n) for n in ORDERS}  # texts side by side share their blanks
    total = [{x: sum(v for b, v in counts[x].items() if b >> BITS == k) for x in counts} for k in range(len(ORDERS))]
    floor = 0.5 / sum(map(sum, (c.values() for c in counts.values()))) * len(ORDERS) + 1e-7
    for b in range(model.code.shape[1]):
        for bucket in set().union(*counts.values()) - blank:
            share = [counts[x][bucket] / total[bucket >> BITS][x] for x in model.languages]
            up, down = (np.mean([p for p, bit in zip(share, model.code[:, b]) if bit == side]) for side in (1, -1))
            assert model.weights[bucket, b] == pytest.approx(math.log((up + floor) / (down + floor)), abs=0.02)
    got = {r.doc_id: r for r in identify(df, model).collect()}
    for i, t, _ in rows:
        grams = plain_windows(t)
        margins = sum(model.weights[plain_bucket(g)].astype(float) for row in grams for g in row) / (max(len(grams[0]) - chargrams.GAP, 1) * len(ORDERS))
        z = np.clip(margins / model.spread, -8, 8)
        losses = [sum(math.exp(-z[b] * model.code[k, b]) * model.trust[k, b] for b in range(len(z))) for k in range(3)]
        if t is None or not any(c.isalpha() for c in t):
            assert (got[i].lang_pred, got[i].score, got[i].ambiguous) == ("und", 0.0, False)
            continue
        first, second = sorted(losses)[:2]
        assert got[i].lang_pred == model.languages[losses.index(first)]
        assert got[i].score == pytest.approx(1 / sum(math.exp(-4 * (x - first)) for x in losses)) and got[i].ambiguous == (second - first < 0.1 * second)


# ---- toxicity


def test_toxicity_held_out_and_edge_cases(spark):
    rng = random.Random(2)
    bad = ["idiot", "moron", "scum"]
    rows, labels = [], []
    for i in range(600):
        toxic = rng.random() < 0.2
        w = prose(rng, "aa", rng.randint(20, 200)).split()
        for _ in range(toxic * 3):
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    odd = [(1000, None), (1001, ""), (1002, "scum " * 30_000), (None, "idiot moron")]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string").withColumn("toxic", F.lit(1))
    lab = spark.createDataFrame([*labels, (5, None), (None, 1), (99_999, 1)], "doc_id long, toxic int")
    by = {r.doc_id: r for r in toxicity.score_by_folds(df, lab).collect()}
    held = [(i, t) for i, t in labels if fold(i, 5) == 0]
    assert sum(by[i].predicted == t for i, t in held) / len(held) > 0.97
    assert all(by[i].held_out for i, _ in held) and not by[1000].held_out | by[None].held_out if fold(1000, 5) else True
    assert by[1000].score == by[1001].score < 0.5 < by[1002].score
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in by.values())


def test_toxicity_with_one_label_or_none(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    clean = spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity.score_by_folds(df, clean).collect()} == {0}
    assert {r.predicted for r in toxicity.score_by_folds(df, clean.filter("false")).collect()} == {0}
    assert toxicity.score_by_folds(df.filter("false"), clean).count() == 0


def test_toxicity_with_few_rows_and_labels_of_other_ids(spark):
    df = spark.createDataFrame([(1, "you bad fool"), (2, "nice calm day"), (2, "nice calm day")], "doc_id long, text string")
    lab = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    model = toxicity.fit(df, lab)
    assert len(model.codes) == 0 and toxicity.score(df, model).first().score == pytest.approx(1 / 3, abs=1e-6)
    others = lab.unionByName(spark.range(10, 5000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic")))
    assert toxicity.fit(df, others, rows_per_label=2).bias == pytest.approx(model.bias)


def test_toxicity_n_grams_are_of_characters():
    texts = ["Ünï ÇÖDÉ 日本語", "", None, "ab", "🙂x日"]
    got = [x for *_, points, starts in chargrams.layout_characters(texts) for x in ["".join(map(chr, points)), *starts.tolist()]]
    assert got[0].replace(" ", "") == "ünïçödé日本語ab🙂x日" and got[1:] == [0, 20, 28, 36, 46]
    plain = {g for t in texts for k in range(len(t or "") + 8) for g in [(" " * 8 + (t or "").lower() + " " * 8)[k : k + 3]]}
    codes = [c for *_, points, _ in chargrams.layout_characters(texts) for c in list(chargrams.character_codes(points, (3, 4)))[0].tolist()]
    assert len(set(codes)) == len(plain | {"   "})


def test_toxicity_equals_a_plain_version_of_its_features(spark):
    """Counts, ratios and choice of n-grams against a loop over the texts."""
    rng = random.Random(4)
    texts = [prose(rng, "aa", 12) + (" scum" if i % 3 == 0 else "") for i in range(60)]
    sample = spark.createDataFrame([(int(i % 3 == 0), t) for i, t in enumerate(texts)], "toxic int, text string")
    model, n_pos, n_neg = toxicity.fit_sample(sample, features=60)
    seen = [Counter(), Counter()]
    for i, t in enumerate(texts):
        padded = " " * 8 + "".join(c if c.isalpha() else " " for c in t.lower()) + " " * 8
        seen[int(i % 3 == 0)].update({padded[k : k + n] for n in toxicity.ORDERS for k in range(len(padded) - n + 1)})
    r = {g: np.log((seen[1][g] + 1) / (n_pos + 1)) - np.log((seen[0][g] + 1) / (n_neg + 1)) for g in seen[0] | seen[1]}
    good = {g: abs(x) * np.sqrt(seen[0][g] + seen[1][g]) for g, x in r.items() if seen[0][g] + seen[1][g] >= 3}
    assert (n_pos, n_neg) == (20, 40) and len(model.codes) == 60
    of = {}
    for g in good:
        points = np.frombuffer(g.encode("utf-32-le"), dtype="<u4")
        of[int(list(chargrams.character_codes(points, (len(g),)))[0][0])] = g
    chosen = [of[int(c)] for c in model.codes]
    for n in toxicity.ORDERS:
        best = sorted((x for g, x in good.items() if len(g) == n), reverse=True)[:10]
        assert sorted((good[g] for g in chosen if len(g) == n), reverse=True) == pytest.approx(best)


def test_logistic_finds_the_optimum():
    rng = np.random.default_rng(0)
    x, w = rng.random((200, 3)), np.array([2.0, -3.0, 1.0])
    y = (rng.random(200) < 1 / (1 + np.exp(-(x @ w)))).astype(float)
    rows, columns = (a.ravel() for a in np.indices(x.shape))
    got, b = toxicity.logistic(rows, columns, x.ravel(), y, 3, 1e-2, 3000)
    p = 1 / (1 + np.exp(-(x @ got + b)))
    assert np.abs(x.T @ (p - y) / 200 + 1e-2 * got).max() < 1e-4 and abs((p - y).mean()) < 1e-4


# ---- language model


def lm_brute(texts):
    tokens = [re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (t or "").lower()) for t in texts]
    own = [[Counter(zip(*[w[k:] for k in range(n)])) for n in (1, 2, 3)] for w in tokens]
    every = [sum((o[n] for o in own), Counter()) for n in range(3)]
    total, out = sum(map(len, tokens)), []
    for w, o in zip(tokens, own, strict=True):
        sums = []
        for own in (0, 1):
            count = lambda g: every[len(g) - 1][g] - own * o[len(g) - 1][g]  # noqa: B023, E731
            s = 0.0
            for k in range(len(w)):
                g = tuple(w[max(0, k - 2) : k + 1])
                a = 0.4 ** (3 - len(g))
                while len(g) > 1 and not (count(g) and count(g[:-1])):
                    g, a = g[1:], a * 0.4
                s += math.log(a * (count(g) / count(g[:-1]) if len(g) > 1 else (count(g) or 0.5) / max(total - own * len(w), 1)))
            sums.append(s)
        out.append((len(w), *sums))
    return out


@pytest.mark.parametrize("block,part", [(1 << 23, 1 << 20), (2000, 64)])
def test_lm_scores_equal_brute_force(spark, monkeypatch, block, part):
    monkeypatch.setattr(lm_scores, "BLOCK_BYTES", block)
    monkeypatch.setattr(lm_scores, "PARTITION_GRAMS", part)
    rng = random.Random(3)
    texts = [prose(rng, rng.choice(["aa", "bb"]), rng.randint(1, 80)) for _ in range(120)] + [None, "", "?", "one", "ein ein", "the " * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"block": F.lit(1), "log_score": F.lit("x")})
    rows = score_documents(df).orderBy("doc_id").collect()
    for r, (n, s, rest) in zip(rows, lm_brute(texts), strict=True):
        assert r.n_tokens == n and r.log_score == pytest.approx(s) and r.others_log_score == pytest.approx(rest)
        assert (r.perplexity is None) == (n == 0)


def test_lm_scores_by_another_corpus(spark):
    rng = random.Random(5)
    texts = [prose(rng, "aa", 30) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    corpus, asked = df.filter("doc_id < 30"), df.filter("doc_id >= 30")
    tokens = [t.split() for t in texts]
    every = [Counter(g for w in tokens[:30] for g in zip(*[w[k:] for k in range(n)])) for n in (1, 2, 3)]
    for r in score_documents(asked, corpus=corpus).collect():
        w, s = tokens[r.doc_id], 0.0
        for k in range(len(w)):
            g, a = tuple(w[max(0, k - 2) : k + 1]), 1.0
            a = 0.4 ** (3 - len(g))
            while len(g) > 1 and not (every[len(g) - 1][g] and every[len(g) - 2][g[:-1]]):
                g, a = g[1:], a * 0.4
            s += math.log(a * (every[len(g) - 1][g] / every[len(g) - 2][g[:-1]] if len(g) > 1 else (every[0][g] or 0.5) / sum(every[0].values())))
        assert r.log_score == pytest.approx(s) == r.others_log_score


def test_lm_nulls_repeats_and_empty(spark):
    df = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b")], "doc_id long, text string")
    got = score_documents(df).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "1", "None"] and len({round(r.log_score, 9) for r in got}) == 1
    assert score_documents(df.filter("false")).count() == 0


def shuffle_files(spark):
    """Bytes of each shuffle file that the session's block manager holds, by name."""
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f.getName(): f.length() for f in map(found.apply, range(found.size())) if f.getName().startswith("shuffle_") and f.getName().endswith(".data")}


def test_lm_scores_leave_no_shuffle_of_ngrams(spark, monkeypatch):
    """Disk holds the n-grams of one order at a time, and none once all are counted."""
    rng = random.Random(7)
    texts = [prose(rng, rng.choice(["aa", "bb"]), 400) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    before, at_once, put = set(shuffle_files(spark)), [], lm_scores.written

    def watched(df, name):
        at_once.append(sum(n for f, n in shuffle_files(spark).items() if f not in before))
        return put(df, name)

    monkeypatch.setattr(lm_scores, "written", watched)
    scored = score_documents(df)
    at_once.append(sum(n for f, n in shuffle_files(spark).items() if f not in before))
    assert max(at_once) < 10_000
    for r, (n, s, rest) in zip(scored.orderBy("doc_id").collect(), lm_brute(texts), strict=True):
        assert r.n_tokens == n and r.log_score == pytest.approx(s) and r.others_log_score == pytest.approx(rest)


def test_pressed_numbers_round_trip():
    for x in ([], [0], [0, 0, 255], [1, 256, 3], [(1 << 64) - 1, 0]):
        a = np.array(x, dtype=np.uint64)
        for begin in ([0], range(len(x))):
            assert lm_scores.unpress(lm_scores.press(a, np.array(begin, dtype=np.int64))).tolist() == x


def test_cuts_are_packed_apart():
    a = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 500, dtype=np.uint64))
    begin = np.array([0, 1, 2, 90, 499])
    packed = pack_sorted(a, begin)
    assert lm_scores.packed_lengths(packed).tolist() == [1, 1, 88, 409, 1] and unpack_sorted(packed).tolist() == a.tolist()
    assert [x for b in packed for x in unpack_sorted([b]).tolist()] == a.tolist()


def test_packed_hashes_round_trip():
    for x in ([], [0], [5, 6, 7], [1, 1 << 40, (1 << 62) + 3], [0, (1 << 64) - 1]):
        a = np.array(x, dtype=np.uint64)
        assert unpack_sorted(pack_sorted(a)).tolist() == x


# ---- search


def test_nearest_recall_ties_and_edge_cases(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 24)).astype(np.float32)
    x[1000:1400] = x[7]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(5000, None), (5001, [0.0] * 24), (5002, [float("nan")] + [1.0] * 23), (5003, [None] + [1.0] * 23), (5004, [1.0]), (5020, [float("inf")] * 24), (None, [1.0] * 24), (8, x[8].tolist())]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumns({"score": F.lit(1), "rank": F.lit("r")})
    got = nearest(df, F.col("vec_id") % 20 == 0, sample=2000).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(by) == set(range(0, 3000, 20))
    d, hits = x.astype(np.float64), 0
    for q, found in by.items():
        found.sort()
        assert [r for r, *_ in found] == list(range(1, 21))
        s = d @ d[q]
        assert all(score == pytest.approx(s[i], abs=1e-12) for _, i, score in found)
        assert [(-score, i) for _, i, score in found] == sorted((-score, i) for _, i, score in found)
        s[q] = -np.inf
        hits += len({i for _, i, _ in found} & set(np.lexsort((np.arange(3000), -s))[:20].tolist()))
    assert hits / (20 * len(by)) >= 0.9
    exact = {(r.query_id, r["rank"]): r.vec_id for r in nearest(df, F.col("vec_id") == 1000, exact=True).collect()}
    assert [exact[1000, k] for k in range(1, 21)] == [7, *range(1001, 1020)]


def test_recall_at_the_least_share_of_a_block():
    """The LEAST_OF_BLOCK best of a full block, as in tables of many blocks, hold most of its 20 nearest."""
    x = np.random.default_rng(6).normal(size=(ann.CODE_BLOCK, 24))
    q = fit_arrays(x[:2000])
    codes = q.encode(x)
    for most, least in ((ann.LEAST_OF_BLOCK, 0.9), (ann.of_block(ann.SHORTLIST, 4), 0.97), (ann.SHORTLIST, 0.99)):
        place, _ = ann.rough_best(x[:100], codes, ann.norm_ratios(x, q.decode(codes)), q, most)
        want = np.argsort(-(x[:100] @ x.T), axis=1, kind="stable")[:, :20]
        assert np.mean([len({*a} & {*b}) / 20 for a, b in zip(place.tolist(), want.tolist(), strict=True)]) >= least, most


def test_several_blocks_and_vectors_of_one_id(spark, monkeypatch):
    monkeypatch.setattr(ann, "CODE_BLOCK", 100)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 16)
    x = np.random.default_rng(7).normal(size=(900, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(3, (9 * x[0]).tolist()), (40, (8 * x[0]).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in nearest(df, F.col("vec_id") % 20 == 0).collect()}
    want = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in nearest(df, F.col("vec_id") % 20 == 0, exact=True).collect()}
    assert got.keys() == want.keys() and sum(got[i] == want[i] for i in want) >= 0.95 * len(want)
    assert [got[0, k][0] for k in (1, 2)] == [3, 40]


def test_few_candidates_and_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.0]), (2, [2.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in nearest(df, F.col("vec_id") == 0).orderBy("rank").collect()] == [(2, 2.0), (1, 0.5)]
    assert nearest(df, F.lit(False)).count() == 0 and nearest(df.filter("false"), F.lit(True)).count() == 0


def test_beam_search_and_joint_fit_lower_the_residual():
    x = np.random.default_rng(5).normal(size=(1500, 16))
    plain, joint = fit_arrays(x, 4, 16, rounds=0), fit_arrays(x, 4, 16, rounds=2)
    error = lambda q, beam: ((x - q.decode(q.encode(x, beam))) ** 2).sum()
    assert error(plain, 8) < error(plain, 1) and error(joint, 8) < error(plain, 8)
