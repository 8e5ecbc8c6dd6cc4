"""Exact, near and repeated-string deduplication against brute force, with the edge cases each defines."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import minhash, suffix_dedup
from barloom.llm.exact_dedup import drop_exact_copies, exact_dedup
from barloom.llm.minhash import components, near_duplicates, samples, similarities
from barloom.llm.shingles import Idf, fit_idf, shingles
from barloom.llm.suffix_dedup import remove_repeats, repeats_among

SCHEMA = "doc_id long, text string, lang string, source string"


def docs(spark, texts, schema=SCHEMA):
    rows = [(i, t, "en", "s") for i, t in (texts.items() if isinstance(texts, dict) else enumerate(texts))]
    return spark.createDataFrame(rows, schema)


def words(rng, n, vocabulary=5000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


# ---- exact


def test_exact_cases(spark):
    rows = [(1, "Ab c"), (2, "aB C"), (3, "ÄB"), (4, "äb"), (5, None), (6, ""), (None, "ab c"), (None, "x"), (7, "y"), (7, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"h": F.lit(1), "norm": F.lit(2), "kept": F.lit(3)})
    got = defaultdict(list)
    for r in exact_dedup(df).collect():
        got[r.doc_id].append((r.keep_id, r.group_size, r.kept, r.text_sha256))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1] == [(2, 3, False, sha("ab c"))] and got[2] == [(2, 3, True, sha("ab c"))]
    assert got[3] == [(3, 1, True, sha("Äb"))] and got[4] == [(4, 1, True, sha("äb"))]
    assert got[5] == [(6, 2, False, sha(""))] and got[6] == [(6, 2, True, sha(""))]
    assert sorted(got[None], key=str) == sorted([(2, 3, False, sha("ab c")), (None, 1, True, sha("x"))], key=str)
    assert got[7] == [(7, 2, True, sha("y"))] * 2
    assert exact_dedup(df.filter("false")).count() == 0
    assert exact_dedup(df.filter("doc_id < 3"), keep="min").filter("kept").first().doc_id == 1


def test_exact_collisions_are_told_apart_by_bytes(spark):
    df = docs(spark, ["a", "A", "b", "c", "c", "long " * 30000])
    weak = exact_dedup(df, content_hash=lambda t: F.unhex(F.when(F.length(t) == 1, F.lit("00")).otherwise(F.md5(t.cast("binary"))))).orderBy("doc_id").collect()
    assert [tuple(r) for r in weak] == [tuple(r) for r in exact_dedup(df).orderBy("doc_id").collect()]


def test_exact_rows_stay_whole_and_once(spark):
    df = docs(spark, ["a", "A", None, "b"]).unionByName(docs(spark, {3: "b"}))
    got = drop_exact_copies(df)
    assert got.columns == df.columns and sorted(r.doc_id for r in got.collect()) == [1, 2, 3]


def test_exact_rows_are_kept_by_class(spark):
    rows = [(None, "x"), (5, "x"), (None, "y"), (7, "Abc"), (7, "abc"), (3, "aBC"), (7, "other"), (None, None), (None, "y")]
    got = drop_exact_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(5, "x"), (None, "y"), (7, "Abc"), (7, "other"), (None, None)]))
    assert drop_exact_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# ---- near


def near_brute(texts, limit=0.8):
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (t or "").lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= limit}


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


def test_near_duplicates_find_all_planted_and_join_no_others(spark):
    rng = random.Random(7)
    texts = {i: words(rng, rng.choice((60, 150, 300))) for i in range(150)}
    for i in range(40):
        texts[200 + i] = edited(rng, texts[i], 1)
    passage = words(rng, 40)
    for i in range(100, 150):
        texts[i] = texts[i] + " " + passage
    base = words(rng, 400)
    for i in range(60):  # more than SMALL in one bucket
        texts[300 + i] = edited(rng, base, 3)
    texts |= {400: texts[5].upper() + " !", 401: None, 402: "", 403: "?! ...", 404: "one two", 405: "One, two.", 406: "three"}
    df = docs(spark, texts).withColumns({"sig": F.lit(1), "class_id": F.lit("x")})
    rows = {r.doc_id: r for r in near_duplicates(df).collect()}
    assert rows.keys() == texts.keys()
    label = {i: r.class_id for i, r in rows.items()}
    for a, b in near_brute(texts, 0.82):
        assert label[a] == label[b], (a, b)
    groups = defaultdict(set)
    for i, c in label.items():
        groups[c].add(i)
    linked = defaultdict(set)
    for a, b in near_brute(texts, 0.75):
        linked[a].add(b), linked[b].add(a)
    for c, members in groups.items():
        assert c == min(members)
        assert len(members) == 1 or all(linked[i] & members for i in members)
        assert [i for i in members if rows[i].kept] == [c]
    assert label[400] == label[5] and label[405] == label[404] and all(label[i] == i for i in (401, 402, 403, 406))


def test_near_copies_of_an_original_with_a_middle_id(spark):
    rng = random.Random(12)
    base = words(rng, 400)
    texts = {i: base if i == 150 else edited(rng, base, 7) for i in range(300)}
    texts |= {1000 + i: " ".join(f"o{rng.randrange(5000)}" for _ in range(10)) for i in range(3000)}
    df = docs(spark, texts)
    copies = [i for i in range(300) if i != 150]
    close = similarities([texts[i] for i in copies], [base] * len(copies), fit_idf(df)) >= 0.8
    label = {r.doc_id: r.class_id for r in near_duplicates(df).collect()}
    lost = [i for i, c in zip(copies, close, strict=True) if c and label[i] != label[150]]
    assert close.sum() > 200 and not lost


def weighted_brute(texts, idf, limit=0.8):
    ids = sorted(texts)
    for at, a in enumerate(ids):
        rest = ids[at + 1 :]
        for b, x in zip(rest, similarities([texts[a]] * len(rest), [texts[b] for b in rest], idf), strict=True):
            if x >= limit - 1e-6:
                yield a, b


def test_all_similarities_equal_those_of_pairs():
    rng = random.Random(14)
    base = words(rng, 200)
    texts = [edited(rng, base, rng.randrange(12)) for _ in range(40)] + ["a a a a a a a a", "a a a a a a", "", None, "one two", words(rng, 30) * 3]
    idf = Idf(np.sort(list(shingles(["w1 w2 w3 w4 w5 a"], Idf(np.zeros(0, np.uint64), np.zeros(0, np.float32))))[0].hash), np.full(2, 0.5, np.float32))
    got = minhash.all_similarities(texts, idf)
    for i, t in enumerate(texts):
        want = similarities([t] * len(texts), texts, idf)
        assert got[i] == pytest.approx(want, abs=1e-6)


def test_spanning_forest_connects_what_the_links_connect():
    linked = np.zeros((7, 7), dtype=bool)
    for a, b in ((0, 1), (1, 2), (0, 2), (3, 4), (5, 6), (2, 5)):
        linked[a, b] = linked[b, a] = True
    assert len(minhash.spanning_forest(linked, np.arange(7))) == 5
    assert len(minhash.spanning_forest(linked, np.array([0, 0, 0, 1, 2, 3, 3]))) == 2


@pytest.mark.parametrize("chunk", [512, 40])
def test_no_similar_pair_of_a_large_bucket_is_lost(spark, chunk):
    """Documents that share a long passage, some with a copy, in chunks: classes equal brute force."""
    rng = random.Random(15)
    passage = words(rng, 300)
    texts = {i: passage + " " + words(rng, 12, 10**6) for i in range(240)}
    for i in range(60):
        texts[1000 + i] = edited(rng, texts[4 * i], 1)
    df = docs(spark, texts)
    want = list(weighted_brute(texts, fit_idf(df)))
    label = {r.doc_id: r.class_id for r in near_duplicates(df, chunk=chunk).collect()}
    top = {i: i for i in texts}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, b in want:
        top[max(root(a), root(b))] = min(root(a), root(b))
    assert label == {i: root(i) for i in texts} and len(want) >= 50


def rows_made(spark, run):
    """Rows that the joins and generators of run made."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = {e.executionId() for e in listed(store.executionsList())}
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    total = 0
    for e in listed(store.executionsList()):
        if e.executionId() in before:
            continue
        values = store.executionMetrics(e.executionId())
        for node in listed(store.planGraph(e.executionId()).allNodes()):
            if re.search("Join|Generate", node.name()):
                for m in listed(node.metrics()):
                    if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                        total += int(values.apply(m.accumulatorId()).replace(",", ""))
    return total


def listed(seq):
    return [seq.apply(i) for i in range(seq.size())]


def test_rows_of_a_group_grow_with_its_size(spark):
    """Near copies of one text, half of them too far from all others: twice as many make about twice the rows."""
    rng = random.Random(21)
    base = words(rng, 200)
    texts = {i: edited(rng, base, i % 9) for i in range(640)}
    made = [rows_made(spark, lambda n=n: near_duplicates(docs(spark, dict(list(texts.items())[:n])), chunk=20).collect()) for n in (320, 640)]
    assert made[1] < 2.6 * made[0]


def test_shared_weights_and_what_may_link(spark, monkeypatch):
    rng = random.Random(22)
    base, apart = words(rng, 150), words(rng, 40)
    texts = {i: edited(rng, base, rng.randrange(12)) for i in range(90)} | {100: apart, 101: apart + " " + apart, 102: "one two", 103: words(rng, 20)}
    df = docs(spark, texts)
    idf = fit_idf(df)
    has = {i: {k: u for x in shingles([t], idf) for _, u, k in zip(*minhash.elements(x), strict=True)} for i, t in texts.items()}
    often = Counter(k for h in has.values() for k in h)
    monkeypatch.setattr(minhash, "PART_BYTES", 3000)
    monkeypatch.setattr(minhash, "slices", lambda batches: (b.slice(at, 7) for b in batches for at in range(0, b.num_rows, 7)))
    packed = minhash.packed_texts(df.select(F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("text_hash"), "text"), minhash.Bloom.of(df.select(F.col("doc_id").alias("id"))))
    weights = minhash.shared_weights(packed.select("id", "text"), idf).cache()
    got = {r.id: (r.total, r.shared) for r in weights.collect()}
    assert got.keys() == texts.keys()
    for i, h in has.items():
        assert got[i] == pytest.approx((sum(h.values()), sum(u for k, u in h.items() if often[k] > 1)))
    stay = {r.id for r in minhash.may_link(df.select(F.lit(1).alias("key"), F.col("doc_id").alias("id"), F.col("doc_id").alias("label")), weights, 0.8).collect()}
    assert stay >= {i for pair in weighted_brute(texts, idf) for i in pair} and not stay & {102, 103} and len(stay) < len(texts)


def test_every_two_classes_of_a_bucket_meet(spark):
    rows = [(k, 100 * k + i, 100 * k + (0 if i < m else i - i % 2)) for k, n, m in ((1, 70, 40), (2, 9, 8), (3, 30, 30), (4, 50, 1)) for i in range(n)]
    met = defaultdict(list)
    for r in minhash.across_classes(spark.createDataFrame(rows, "key long, id long, label long"), 8).collect():
        met[r.key, r.i, r.j].append(r)
    pairs = {frozenset((x.id, y.id)) for rs in met.values() for x, y in itertools.combinations(rs, 2)}
    assert pairs >= {frozenset((x[1], y[1])) for x, y in itertools.combinations(rows, 2) if x[0] == y[0] and x[2] != y[2]}
    assert {k for k, _, _ in met} == {1, 2, 4} and max(map(len, met.values())) < 40


def test_near_links_of_one_id_with_different_texts(spark):
    rng = random.Random(16)
    a, b = words(rng, 80), words(rng, 80)
    df = spark.createDataFrame([(7, a), (7, b), (8, a), (9, b), (10, words(rng, 80))], "doc_id long, text string")
    got = sorted((r.doc_id, r.class_id, r.kept) for r in near_duplicates(df).collect())
    assert got == [(7, 7, True), (7, 7, True), (8, 7, False), (9, 7, False), (10, 10, True)]


def test_near_nulls_repeats_and_empty(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.class_id, r.kept) for r in near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, None, True)] * 2 + [(1, 1, True)] * 2 + [(2, 1, False)], key=str)
    assert near_duplicates(df.filter("false")).count() == 0


def test_samples_agree_as_often_as_the_weighted_similarity():
    rng = random.Random(8)
    a = words(rng, 400)
    none = Idf(np.zeros(0, np.uint64), np.zeros(0, np.float32))
    for n in (2, 8, 20):
        b = edited(rng, a, n)
        x, y = (list(shingles([t], none))[0] for t in (a, b))
        sa, sb = (samples(s.text, s.hash, s.weight, 0, 1, 2000) for s in (x, y))
        assert (sa == sb).mean() == pytest.approx(similarities([a], [b], none)[0], abs=0.04)


def test_weighted_similarity_and_idf(spark):
    none = Idf(np.zeros(0, np.uint64), np.zeros(0, np.float32))
    assert similarities(["a b c d e", "a b c d e f", None], ["a b c d e", "x a b c d e", "a"], none).tolist() == pytest.approx([1.0, 1 / 3, 0.0])
    idf = fit_idf(docs(spark, ["the cat", "the dog", "the the", "a", None, ""]))
    assert sorted(idf.weight.tolist())[0] == pytest.approx(0.25 + 0.75 * np.log(4 / 3) / np.log(1000), rel=1e-3) and len(idf.hash) == 1


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 4), (10, 11), (11, 12), (4, 5), *((20 + i, 21 + i) for i in range(30))]
    got = {r.id: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in range(1, 6)} == {1} and {got[i] for i in (10, 11, 12)} == {10} and {got[20 + i] for i in range(31)} == {20}


# ---- repeated strings


def repeats_brute(texts, length):
    raw = {i: (t or "").encode() for i, t in texts.items()}
    seen = Counter(r[p : p + length] for r in raw.values() for p in range(len(r) - length + 1))
    out = {}
    for i, r in raw.items():
        mark = bytearray(len(r))
        for p in range(len(r) - length + 1):
            if seen[r[p : p + length]] > 1:
                mark[p : p + length] = b"\1" * length
        kept = bytes(b for b, m in zip(r, mark, strict=True) if not m)
        runs = sum(1 for p in range(len(mark)) if mark[p] and (p == 0 or not mark[p - 1]))
        out[i] = (len(r), sum(mark), runs, hashlib.sha256(kept).hexdigest())
    return out


def repeat_texts():
    rng = random.Random(9)
    passage, line = words(rng, 60), words(rng, 36)
    texts = {i: words(rng, rng.choice((5, 60, 200))) for i in range(60)}
    for i in range(20):
        texts[100 + i] = words(rng, rng.randrange(30)) + " " + passage + " " + words(rng, rng.randrange(30))
    for i in range(10):
        texts[200 + i] = passage[i * 7 : 250 + i * 9] + words(rng, 10) + line[: 190 + i * 3]
    texts |= {300: texts[7], 301: None, 302: "", 303: "ab" * 400, 304: "x" * 199, 305: "x" * 200, 306: "y" * 201, 307: (passage + " ") * 3, 308: "é" * 150 + line, 309: line + "é" * 150}
    return texts


@pytest.mark.parametrize("most_spans,block", [(1024, 1 << 20), (3, 1 << 20), (1, 700)])
def test_repeats_equal_brute_force(spark, monkeypatch, most_spans, block):
    monkeypatch.setattr(suffix_dedup, "MOST_SPANS", most_spans)
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", block)
    texts = repeat_texts()
    df = docs(spark, texts).withColumns({"key": F.lit(1), "span": F.lit(2)})
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(df).collect()}
    assert got == repeats_brute(texts, 200)


@pytest.mark.parametrize("most_spans", [1024, 8])
def test_repeats_of_a_hot_minimiser(spark, monkeypatch, most_spans):
    """One passage in many texts, cut at every place and followed by different bytes, so that its minimisers have many spans."""
    monkeypatch.setattr(suffix_dedup, "MOST_SPANS", most_spans)
    rng = random.Random(17)
    passage = words(rng, 80)
    texts = {i: words(rng, 12) + passage[rng.randrange(150) : 160 + rng.randrange(len(passage) - 160)] + rng.choice("abc") * rng.randrange(3) + words(rng, 12) for i in range(150)}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(docs(spark, texts)).collect()}
    assert got == repeats_brute(texts, 200)


def test_large_groups_are_halved_until_small(spark):
    rng = random.Random(18)
    gram = words(rng, 20).encode()[: suffix_dedup.GRAM]
    rows = []
    for i in range(40):
        ahead, behind = (words(rng, 60, 10**6).encode()[:150] for _ in range(2))
        if i % 4 == 0:
            ahead = b"same " * 30
        text = ahead + gram + behind
        rows.append((1, i, i, 0, 0, 151, 150, 0, 150, False, text, 40))
    edges = spark.createDataFrame(rows, suffix_dedup.PIECES + ", kinds long")
    small, found = suffix_dedup.split_large(edges, 4)
    rows = small.collect()
    sizes = Counter(r.group for r in rows)
    assert max(sizes.values()) <= 4 and len({(r.group, r.span) for r in rows}) == len(rows)
    # the windows at the largest offset are all the same ahead of the gram and at once done as equal
    assert {r.key for r in found.collect()} == set(range(0, 40, 4))


def test_repeat_groups_have_all_occurrences(spark):
    rng = random.Random(19)
    p = words(rng, 90)
    texts = {0: "A" + p[:300] + "!", 1: "B" + p[:260] + "?", 2: words(rng, 40), 3: p[:300] + "x" + words(rng, 50), 4: "C" + p[20:240], 5: words(rng, 60)}
    texts[6] = texts[5]
    rows = suffix_dedup.repeat_groups(docs(spark, texts)).collect()
    inner = defaultdict(set)
    for r in rows:
        inner[r.within].add(r.repeat)

    def below(group):
        return {group}.union(*(below(x) for x in inner[group]))

    covered = defaultdict(set)
    for group in {r.repeat for r in rows}:
        tree = below(group)
        length = {r.length for r in rows if r.repeat == group}
        at = {(r.doc_id, r.begin) for r in rows if r.repeat in tree}
        assert len(length) == 1 and len(at) > 1
        (length,) = length
        strings = {texts[i][b : b + length] for i, b in at}
        assert len(strings) == 1 and length >= 200
        (string,) = strings
        assert at == {(i, m.start()) for i, t in texts.items() for m in re.finditer("(?=" + re.escape(string) + ")", t)}
        for i, b in at:
            covered[i].update(range(b, b + length))
    removed = {r.doc_id: r.n_removed for r in remove_repeats(docs(spark, texts)).collect()}
    assert {i: len(covered[i]) for i in texts} == removed


def test_repeats_nulls_repeated_rows_and_empty(spark):
    rng = random.Random(10)
    a, b = words(rng, 60), words(rng, 60)
    df = spark.createDataFrame([(1, a), (1, a), (2, b), (None, b + "!"), (None, None), (3, "short")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed) for r in remove_repeats(df).collect())
    assert got == sorted([("1", len(a), len(a))] * 2 + [("2", len(b), len(b)), ("None", len(b) + 1, len(b)), ("None", 0, 0), ("3", 5, 0)])
    assert remove_repeats(df.filter("false")).count() == 0
    text = remove_repeats(df.filter("doc_id = 3"), with_text=True).first()
    assert bytes(text.kept_bytes) == b"short"


def test_maximal_repeats_have_all_occurrences():
    rng = random.Random(11)
    p = words(rng, 80).encode()[:300]
    contents = [b"A" + p[:260], b"B" + p[:230], b"C" + p[:260], b"D" * 250]
    which, begin, end = repeats_among(contents, [len(c) - 199 for c in contents])
    longest = {}
    for w, b, e in zip(which, begin, end, strict=True):
        longest[w] = max(longest.get(w, (0, 0)), (e - b, b))
    assert longest[0] == longest[2] == (260, 1) and longest[1] == (230, 1) and 3 in longest


def test_every_pair_of_a_small_bucket_is_verified(spark):
    """A pair that shares one band and differs in all other samples is a candidate by default."""
    sig = lambda first: list(range(first, first + minhash.SAMPLES))
    signed = spark.createDataFrame([(1, [7, 7, *sig(0)[2:]]), (2, [7, 7, *sig(100)[2:]]), (3, sig(200))], "id long, sig array<long>")
    members = minhash.buckets(signed)
    assert [tuple(r) for r in minhash.candidates(members, signed).collect()] == [(1, 2)]
    assert minhash.candidates(members, signed, 3).isEmpty()


def test_rows_alike_do_not_grow_a_group_of_repeats(spark):
    """Thousands of rows of one id and text beside a variant: one of them goes into the array, all are cut."""
    import random

    from barloom.llm import suffix_dedup

    rng = random.Random(9)
    text = "".join(rng.choice("abcdefgh ") for _ in range(600))
    rows = [(None, text)] * 1500 + [(1, text[:250] + "#" + text[250:])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans, placed = suffix_dedup.shared_spans(docs, "doc_id", "text")
    pieces = suffix_dedup.representatives(spans, placed.filter("kinds > 1 and least = 1"))
    assert (pieces.groupBy("group").count().agg({"count": "max"}).first()[0] or 0) <= 4
    got = {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got[None] == 600 and got[1] == 600
