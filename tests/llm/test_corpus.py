"""Packing, mixing, extraction and the pipeline, against plain versions."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from barloom.llm import html_extract
from barloom.llm.exact_dedup import UPPER, LOWER
from barloom.llm.html_extract import extract, main_text, markup, nesting, read_page
from barloom.llm.mixing import draws, mixed, splitting_tree, targets
from barloom.llm.packing import pack, pack_documents, plan, token_pieces
from barloom.llm.queries import tokenizer_path


# ---- packing


def ids_of(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    return [*t.encode(text or "", add_special_tokens=False).ids, 0]


TEXTS = ["It's a TEST, isn't it?", None, "", "x" * 5000, "word " * 5000, "été ́á \x85 a b \x1c", "a<|endoftext|>b <|startoftext|>", "\x00 a\x00b", "don't 12ab3 ''s 'll. (foo) foo)", "İstanbul ΣΑΣ", "日本語 テキスト 한국어", "🙂🙂 ok"]


def test_pieces_equal_the_tokenizer(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = defaultdict(list)
    for r in token_pieces(df, tokenizer_path(), with_ids=True).collect():
        got[r.doc_id].append(r)
    for i, t in enumerate(TEXTS):
        want, at = ids_of(t), 0
        for r in sorted(got[i], key=lambda r: r.piece):
            part = want[at : at + 2048]
            assert (r.start, r.length, r.ids) == (at, len(part), part)
            assert r.ids_crc32 == zlib.crc32(np.array(part, dtype="<u4").tobytes())
            at += len(part)
        assert at == len(want)


def check_packing(rows, limit=2048):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for s in by.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= limit
    return len(by)


def test_words_whose_lower_case_is_no_letter():
    """Lower-casing a dotted capital leaves a combining mark; ids equal the tokenizer's on odd words."""
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    from barloom.llm.tokens import WordIds

    path = public_tokenizers.path("word_bpe_49k.json")
    mine, whole, rng = WordIds(path), Tokenizer.from_file(path), random.Random(5)
    texts = ["İ|", "TÜRKİYESİ.", "aİ, bİ!"] + ["".join(rng.choice("aİßé.,|!ŉ'Ǆ1 ̇") for _ in range(rng.randrange(1, 9))) for _ in range(3000)]
    for text, got in zip(texts, mine.encode([t.encode() for t in texts]), strict=True):
        assert list(memoryview(got).cast("I")) == whole.encode(text, add_special_tokens=False).ids, text


def test_latin_words_need_the_merges_alone(monkeypatch):
    """Ids equal the tokenizer's on every letter below U+0180 and over changes of the cache's generation; words of such letters do not go through it."""
    from tokenizers import Tokenizer

    from barloom.llm import tokens

    whole, rng = Tokenizer.from_file(tokenizer_path()), random.Random(7)
    letters = [c for c in map(chr, range(0x180)) if c.isalpha() and c != "\u0130"]
    words = [c * n for c in letters for n in (1, 3)] + ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 12))) for _ in range(3000)]
    texts = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(200)]
    want = [whole.encode(t, add_special_tokens=False).ids for t in texts]
    monkeypatch.setattr(tokens, "CACHE_WORDS", 700)
    monkeypatch.setattr(tokens, "SPLIT_BYTES", 3000)
    mine = tokens.WordIds(tokenizer_path())
    mixed = [t.replace(" ", ", ", 5) + " \u0130x \u03a3\u0391\u03a3. a\u0301" for t in texts]
    for text, got in zip(mixed, mine.encode([t.encode() for t in mixed]), strict=True):
        assert list(memoryview(got).cast("I")) == whole.encode(text, add_special_tokens=False).ids
    mine = tokens.WordIds(tokenizer_path())
    mine.tokenizer = None
    assert [list(memoryview(got).cast("I")) for got in mine.encode([t.encode() for t in texts])] == want


def test_packing_is_gapless_whole_and_near_the_bound(spark):
    rng = random.Random(1)
    lengths = [rng.choice((rng.randint(1, 2048), rng.randint(1, 300), 90)) for _ in range(6000)]
    df = spark.createDataFrame([(i, 0, n) for i, n in enumerate(lengths)], "doc_id long, piece int, length long").withColumn("source", F.lit("x"))
    rows = pack(df).collect()
    assert Counter(r.length for r in rows) == Counter(lengths) and rows[0].source == "x"
    assert check_packing(rows) <= 1.005 * sum(lengths) / 2048 + 1


def test_packing_edge_cases(spark):
    df = spark.createDataFrame([(1, None), (1, None), (None, ""), (2, "a " * 3000), (2, "b")], "doc_id long, text string").withColumns({"length": F.lit(1), "sequence_id": F.lit(2)})
    rows = pack_documents(df, tokenizer_path()).collect()
    assert sum(r.length for r in rows) == 3 + 3001 + 2 and check_packing(rows) == 2
    assert pack_documents(df.filter("false"), tokenizer_path()).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_every_length_once(seed):
    rng = random.Random(seed)
    counts = {rng.randint(1, 64): rng.randint(1, 50) for _ in range(40)}
    used, total = Counter(), 0
    for pattern, n in plan(counts, 64):
        assert sum(pattern) <= 64
        total += n
        for length in pattern:
            used[length] += n
    assert used == counts and total >= -(-sum(k * n for k, n in counts.items()) // 64)


def test_plan_finds_exact_complements():
    assert sum(n for _, n in plan({1500: 3, 548: 3})) == 3
    assert sum(n for _, n in plan({1000: 2, 600: 2, 448: 2})) == 2
    assert sum(n for _, n in plan({1000: 1, 500: 1, 300: 1, 248: 1})) == 1


# ---- mixing


def plain_targets(sizes, weights=(3, 1, 2), share=1.5):
    w, got, open_ = [weights[i % 3] for i in range(len(sizes))], {}, set(range(len(sizes)))
    left = share * sum(sizes)
    while open_:
        unit = left / sum(w[i] for i in open_)
        over = {i for i in open_ if unit * w[i] > 2 * sizes[i]}
        got |= {i: 2.0 * sizes[i] for i in over} if over else {i: unit * w[i] for i in open_}
        left -= sum(got[i] for i in over)
        open_ = open_ - over if over else set()
    return [got[i] for i in range(len(sizes))]


def test_targets():
    for sizes in ([10, 10, 10], [1000, 1, 5, 90], [7], [0, 5, 0], [3, 1, 2, 900, 5, 40]):
        got = targets(list(map(float, sizes)), (3, 1, 2), 1.5, 2)
        assert got == pytest.approx(plain_targets(sizes)) and sum(got) == pytest.approx(1.5 * sum(sizes))
        assert all(t <= 2 * s + 1e-9 for t, s in zip(got, sizes, strict=True))


def test_splitting_tree_keeps_totals():
    q = splitting_tree([100, 0, 7, 1], 8, 3)
    assert q.sum(axis=0).tolist() == [100, 0, 7, 1] and set(q.sum(axis=1)) <= {13, 14} and (q >= 0).all()
    assert (splitting_tree([100, 0, 7, 1], 8, 3) == q).all()


def mix_docs(spark, n=600):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randint(0, 120)), rng.choice(["b", "a", "é", None, "hot", "hot", "hot"])) for i in range(n)]
    rows += [(n, None, "a"), (n + 1, "x y \x1c z\x0b\x0cq", "b"), (None, "n n n", "solo")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string"), rows


def test_mix_meets_its_targets(spark):
    df, rows = mix_docs(spark)
    got = draws(df.withColumns({"u": F.lit(1), "rest": F.lit(2), "s_source": F.lit("q")}), block_words=500).collect()
    again = draws(df, block_words=500).collect()
    assert sorted((str(r.doc_id), r.mix_taken) for r in got) == sorted((str(r.doc_id), r.mix_taken) for r in again)
    size = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows}
    names = sorted({r[2] for r in rows} - {None}) + [None]
    total = Counter()
    for i, _, s in rows:
        total[s] += size[i]
    goal = dict(zip(names, plain_targets([total[s] for s in names]), strict=True))
    taken, shards = Counter(), Counter()
    for r in got:
        assert r.mix_size == size[r.doc_id] and r.mix_source_size == total[r.source] and r.mix_target == pytest.approx(goal[r.source])
        assert 0 <= r.mix_taken <= 2 * r.mix_size and r.mix_taken == sum(d.words for d in r.mix_draws)
        taken[r.source] += r.mix_taken
        shards.update(d.shard for d in r.mix_draws)
    assert all(abs(taken[s] - goal[s]) <= 1 for s in names)
    assert all(0 <= s < 64 for s in shards)


def test_whole_documents_and_empty(spark):
    df, rows = mix_docs(spark)
    got = mixed(df, block_words=500)
    assert got.columns == df.columns and mixed(df, placed=True).columns[3:] == ["mix_copy", "mix_shard", "mix_place"]
    assert mixed(df.withColumns({"mix_draws": F.lit(1), "d": F.lit(2)})).columns == [*df.columns, "mix_draws", "d"]
    counts = Counter(r.doc_id for r in got.collect())
    assert max(counts.values()) <= 2
    assert draws(df.filter("false")).count() == 0
    with pytest.raises(ValueError):
        draws(df, max_sources=2)


def plain_draws(spark, df, seed=11, shards=64, block_words=500):
    """Taken words of each row by the tree's quotas, one source, shard and block after the other."""
    from barloom.llm.mixing import WORD

    rows = df.select("doc_id", F.coalesce("text", F.lit("")).alias("t"), "source").select(
        "doc_id", "t", "source", F.xxhash64(F.lit(seed), "doc_id", F.xxhash64("t")).bitwiseAND(F.lit(2**31 - 1)).alias("u"), F.xxhash64(F.lit(seed + 1), "doc_id", F.xxhash64("t")).alias("h"))
    by = defaultdict(list)
    for r in rows.collect():
        by[r.source].append((r.u, r.h, len(re.findall(WORD, r.t)), r.doc_id))
    names = sorted(set(by) - {None}) + [None] * (None in by)
    sizes = [sum(x[2] for x in by[n]) for n in names]
    goal = plain_targets(sizes)
    n_blocks = [max(32 * shards, -(-x // block_words)) for x in sizes]
    quotas = splitting_tree(n_blocks, shards, seed)
    out = Counter()
    for i, name in enumerate(names):
        full = min(2, int(goal[i] // sizes[i])) if sizes[i] else 0
        rest, first, words = max(0, round(goal[i]) - full * sizes[i]), 0, 0
        for x in by[name]:
            out[str(x[3]), x[2], full * x[2]] += 1
        for k in range(shards):
            mine = sorted(x for x in by[name] if first <= x[0] * n_blocks[i] >> 31 < first + quotas[k, i])
            first, held = first + quotas[k, i], sum(x[2] for x in mine)
            part = rest * (words + held) // max(sizes[i], 1) - rest * words // max(sizes[i], 1)
            words += held
            for x in mine:
                more = min(x[2], part)
                part -= more
                out[str(x[3]), x[2], full * x[2]] -= 1
                out[str(x[3]), x[2], full * x[2] + more] += 1
    return +out


def test_draws_equal_a_plain_version_and_depend_on_the_tree(spark):
    df, _ = mix_docs(spark)
    df = df.unionByName(spark.createDataFrame([(None, " ".join(["w"] * (3 + i % 5)), "b") for i in range(400)] + [(5, "same words here", "a")] * 200, df.schema))
    for shards in (1, 64):
        got = draws(df, block_words=500, shards=shards, keep=("doc_id",))
        assert got.columns[0] == "doc_id" and len(got.columns) == 6
        assert Counter((str(r.doc_id), r.mix_size, r.mix_taken) for r in got.collect()) == plain_draws(spark, df, shards=shards)
    assert plain_draws(spark, df, shards=1) != plain_draws(spark, df, shards=64)


def test_every_shard_holds_every_source_near_its_share(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * rng.randint(20, 60)), "abcde"[min(4, int(rng.expovariate(0.8)))]) for i in range(6000)]
    got = draws(spark.createDataFrame(rows, "doc_id long, text string, source string"), shards=8).select("source", "mix_target", F.explode("mix_draws").alias("d")).select("source", "mix_target", "d.*").groupBy("source", "shard").agg(F.sum("words").alias("n"), F.first("mix_target").alias("target")).collect()
    assert len(got) == 5 * 8
    for r in got:
        assert 0.5 < 8 * r.n / r.target < 1.6, r


def test_shards_are_disjoint_and_shuffled(spark):
    df, _ = mix_docs(spark)
    got = mixed(df, block_words=500, shards=8, placed=True).filter("doc_id is not null").collect()
    of = defaultdict(set)
    for r in got:
        of[r.doc_id].add(r.mix_shard)
    assert all(len(x) == 1 for x in of.values()) and len({x for y in of.values() for x in y}) == 8
    for k in range(8):
        places = [r.mix_place for r in got if r.mix_shard == k]
        assert places == sorted(places)


def test_ties_and_null_ids_meet_their_targets(spark):
    rows = [(None, " ".join(["w"] * 50), "b")] * 400 + [(7, " ".join(["v"] * 41), "a")] * 200 + [(1, "x", "c")]
    got = draws(spark.createDataFrame(rows, "doc_id long, text string, source string"), keep=("source",)).collect()
    for name in "abc":
        mine = [r for r in got if r.source == name]
        assert abs(sum(r.mix_taken for r in mine) - mine[0].mix_target) <= 1 and all(r.mix_taken <= 2 * r.mix_size for r in mine)


# ---- extraction


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<article><h1>Head &amp; line</h1><p><b>One<br>two <i>thr</i>ee&nbsp; four<p>Next &#8212; para</p><!-- no --><ul><li>a<li>b</ul><div class="share">Share</div><form><p>mail</p></form>
<section class="comments"><p>reader says</p></section></article><aside>side</aside><footer>&copy; me</footer></body></html>"""


def test_main_text_of_an_article():
    assert main_text(PAGE) == "Head & line\n\nOne two three four\n\nNext — para\n\na\n\nb"


def test_broken_markup_and_empty():
    assert main_text(None) == main_text("") == main_text("<nav>x") == ""
    assert main_text("plain &lt;text&gt;") == "plain <text>"
    assert main_text("<p>a<script>if (1<2) {") == "a"
    assert main_text("<nav>menu<article><p>a</article>") == "a"
    assert main_text('<p title="a>b">c</p></div></p>d') == "c\n\nd"
    assert main_text("a < b <3 <p title='x>y") == "a < b <3\n\ny"
    assert read_page("<p>a</p><p>a</p>").sequence and read_page("<p>" * 3000 + "x").blocks[0].text == "x"


@pytest.mark.parametrize("wrap", ['<div class="layout has-sidebar">', '<div class="right-sidebar">', '<div id="with-header">', '<section class="search-results-page">', "<form action='/x'>", "<div class='a has-menu'><div class='no-sidebar'>"])
@pytest.mark.parametrize("element", ["<article>", "<main>", "<div class='content'>"])
def test_a_wrapper_with_a_hint_in_its_name_does_not_empty_the_page(wrap, element):
    end = element.replace("<", "</").split(" ")[0].rstrip(">") + ">"
    page = f"<html><body>{wrap}<nav>Home</nav><div class='my-sidebar'>Links here</div>{element}<p>The story with its many words.</p><div class='notice'>Cookie notice</div><p>E = <math><mi>mc</mi></math> it says. <!-- c --!></p><form>Your mail</form></div>".replace("</div>", "</div>")
    if element.startswith("<div"):
        page = page.replace("<div class='notice'>", "<div class='notice-box'>")
    got = main_text(page + f"{end}<div class='related-posts'>Others</div></body></html>")
    assert got == "The story with its many words.\n\nE = mc it says."


def test_names_inside_an_article_need_only_such_words():
    kept = '<header class="entry-header"><h1>Title</h1></header><p class="share-text">a</p><ul class="search-list"><li>b</ul>'
    gone = '<div class="comments-area"><p>c</p></div><div id="share-buttons">d</div><ul class="comment-list"><li>e</ul><div class="related posts">f</div>'
    assert main_text(f"<article>{kept}{gone}</article>") == "Title\n\na\n\nb"
    assert main_text('<div><p>text</p><p><a href="x">a whole link</a></p></div>') == "text\n\na whole link"


@pytest.mark.parametrize("piece", ['<a "', "<script ", "<div>", "<div><b>", "</p>", "<p><span>", "<x y='", '<a ">', "<!--", "<svg>", "&", "<p class='a", "<li>"])
def test_hostile_pages_take_linear_time(piece):
    import time

    start = time.time()
    for page in (piece * (500_000 // len(piece)), "<p><div>" + "<span>" * 40_000 + "<h1></h1>" * 40_000 + piece):
        main_text(page)
    assert time.time() - start < 8


def test_nesting_of_classes():
    place = {1: 7, 2: 7, 3: 7, 4: 8, 5: 8, 9: 6, 10: 6}
    good = nesting([1, 4, 5, 4, 5, 2, 9, 10, 3], place)
    assert {c: x[1:] for c, x in good.items()} == {7: (False, 0, 0), 8: (False, 7, 1), 6: (False, 7, 2)}
    assert good[7][0] == nesting([1, 2, 3], place)[7][0] != nesting([1, 3, 2], place)[7][0]
    assert nesting([1, 4, 2, 5, 3], place)[8][1] and nesting([4, 5, 5, 4], place)[8][0] == 0
    assert nesting([1, 4, 5, 2, 4, 5, 3], place)[8][1]


def test_template_of_a_host_without_article(spark):
    rng = random.Random(3)
    page = lambda i: f"<html><body><div class='top'>Great site</div><div class='x'>All rights</div><div class='c'><p>Story {i} {rng.random()}</p><p>More {i}</p></div></body></html>"
    rows = [(i, "http://h.example/" + str(i), page(i)) for i in range(8)] + [(100, "http://one.example/", page(100)), (101, None, None), (102, "http://h.example/e", ""), (100, "http://one.example/", page(100))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit(1), "text": F.lit("x")})
    got = defaultdict(list)
    for r in extract(df).collect():
        assert r.n_chars == len(r.text)
        got[r.page_id].append(r.text)
    assert all(got[i][0].startswith(f"Story {i} ") and got[i][0].endswith(f"\n\nMore {i}") and "Great" not in got[i][0] for i in range(8))
    assert len(got[100]) == 2 and "Great site" in got[100][0] and got[101] == got[102] == [""]
    assert extract(df.filter("false")).count() == 0


def test_layouts_of_a_host_have_templates_of_their_own(spark):
    rng = random.Random(8)
    story = lambda i: f"Story {i} " + " ".join(str(rng.random()) for _ in range(9))
    kinds = [lambda i, k=k: f"<body><div class='t{k}'>Great site {k}</div><div class='links'><a href='x'>{rng.random()}</a></div><div class='c{k}'><p>{story(i)}</p><p><a>all a link {i}</a></p></div><div class='z'>Rights {k}</div></body>" for k in range(3)]
    rows = [(10 * k + i, "http://h.example/x", kind(i)) for k, kind in enumerate(kinds) for i in range(5)]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(3):
        for i in range(5):
            assert got[10 * k + i].startswith(f"Story {i} ") and got[10 * k + i].endswith(f"\n\nall a link {i}") and "Great" not in got[10 * k + i]


def test_classes_and_templates_equal_a_plain_version(spark):
    """Occurrence vectors, classes and their order over the pages of groups, by dictionaries."""
    rng = random.Random(41)
    pages = []
    for i in range(30):
        odd = "<div class='n'>Notice</div>" if rng.random() < 0.7 else ""
        swap = ["<div class='a'>One</div>", "<div class='b'>Two</div>"]
        if rng.random() < 0.5:
            swap.reverse()  # a class without a fixed order
        items = "".join(f"<section><h2>Part</h2><p>{rng.random()}</p></section>" for _ in range(rng.randint(1, 3)))
        pages.append((i, f"http://{'xy'[i % 2]}.example/{i}", f"<body><div class='top'>Site</div>{odd}{''.join(swap)}{items}<footer><p>Rights</p></footer></body>"))
    df = spark.createDataFrame(pages, "id long, url string, html string")
    rows = df.select("id", "url", html_extract.host(F.col("url")).alias("host"), "html")
    got = {(r.host, r.layout): (set(r.tokens), set(r.menus)) for r in html_extract.templates(html_extract.parsed(rows)).collect()}
    groups = defaultdict(list)
    for _, url, content in pages:
        page = read_page(content)
        groups[url.split("/")[2], html_extract.layout(page)].append(page)
    want = {}
    for group, of in groups.items():
        vectors = defaultdict(lambda: [0] * len(of))  # noqa: B023
        for k, page in enumerate(of):
            for token in page.sequence:
                vectors[token][k] += 1
        by = defaultdict(set)
        for token, vector in vectors.items():
            on = sum(v > 0 for v in vector)
            if on >= 4 and on >= len(of) / 2:
                by[tuple(vector)].add(token)
        place = {t: k for k, tokens in enumerate(by.values()) if len(tokens) >= 2 for t in tokens}
        seen = defaultdict(Counter)
        for page in of:
            for c, way in nesting(page.sequence, place).items():
                seen[c][way] += 1
        good = {c for c, ways in seen.items() for (way, n) in ways.most_common(1) if way[0] and not way[1] and n >= 0.9 * sum(ways.values())}
        if by:
            want[group] = ({t for t, c in place.items() if c in good}, set())
    assert got == want and any(tokens for tokens, _ in want.values())


def test_template_decides_on_pages_with_an_article(spark):
    rng = random.Random(5)
    story = lambda i: f"Story {i} " + " ".join(str(rng.random()) for _ in range(9))
    boiler = lambda i: f"<body><article><p>{story(i)}</p><div class='z'>Read more on our site</div></article></body>"
    teaser = lambda i: f"<body><div class='top'>Great site</div><article><h3>Teaser {i}</h3></article><div class='c'><p>{story(i)}</p></div></body>"
    copied = lambda i: f"<body><div class='top'>Great site</div><article><p>{'the same long text ' * 9}</p><p>{i}</p></article></body>"
    rows = [(100 * h + i, f"http://{h}.example/{i}", page(i)) for h, page in enumerate((boiler, teaser, copied)) for i in range(8)]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(8):
        assert got[i].startswith(f"Story {i} ") and "Read more" not in got[i]
        assert f"Story {i} " in got[100 + i] and "Great" not in got[100 + i]
        assert got[200 + i] == " ".join(["the same long text"] * 9) + f"\n\n{i}"


# ---- pipeline


def test_pipeline_stages_and_result(spark, tmp_path):
    rng = random.Random(4)
    syllables = {"aa": "the ing and er tion".split(), "bb": "der ung sch ein ich".split()}

    def prose(lang, n):
        return " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randint(2, 4))) for _ in range(n))

    rows = [(i, prose(lang, rng.randint(30, 90)), lang, f"s{i % 4}") for i in range(200) for lang in [("aa", "bb")[i % 2]]]
    rows += [(300 + i, rows[i][1].upper(), rows[i][2], "s0") for i in range(20)]
    rows += [(400 + i, rows[50 + i][1] + " end", rows[50 + i][2], "s1") for i in range(20)]
    rows += [(500, None, None, None), (501, "123 !!", "aa", "s1"), (502, "", None, "s2")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long"))
    df.write.parquet(str(tmp_path / "documents.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path)).cache()
        seen[name] = docs
        if name != "best_fit_packing":
            assert docs.columns == df.columns
    ids = {n: sorted(r.doc_id for r in d.select("doc_id").collect()) for n, d in seen.items()}
    # language: only texts without a letter go
    assert ids["language_id"] == sorted(r[0] for r in rows if r[0] < 500)
    # exact: the largest id of equal texts
    norm = lambda t: t.translate(str.maketrans(UPPER, LOWER))
    last = {norm(r[1]): r[0] for r in sorted(rows[:-3])}
    assert ids["exact_dedup"] == sorted(last.values())
    # near: of each planted pair the smaller id
    want = [i for i in ids["exact_dedup"] if not 400 <= i < 420]
    assert ids["near_dedup"] == want
    # mixing: whole copies, at most two, each source near its target
    sizes, taken = Counter(), Counter()
    words = {r[0]: len(r[1].split()) for r in rows[:-3]}
    source = {r[0]: r[3] for r in rows}
    for i in want:
        sizes[source[i]] += words[i]
    for i, n in Counter(ids["mix_sources"]).items():
        assert n <= 2 and i in want
        taken[source[i]] += n * words[i]
    for s, t in zip(sorted(sizes), plain_targets([sizes[s] for s in sorted(sizes)]), strict=True):
        assert abs(taken[s] - t) <= 90
    # packing: every copy's tokens
    packed = seen["best_fit_packing"].collect()
    check_packing(packed)
    tokens_of = {i: len(ids_of(r[1])) for r in rows for i in [r[0]] if i in set(ids["mix_sources"])}
    assert sum(r.length for r in packed) == sum(tokens_of[i] for i in ids["mix_sources"])
    run = corpus_pipeline.run(spark, str(tmp_path)).collect()
    key = lambda rs: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rs)
    assert key(run) == key(packed)


def test_stages_take_nulls_repeats_and_empty_tables(spark):
    rng = random.Random(21)
    text = [" ".join(f"w{rng.randrange(400)}" for _ in range(60)) for _ in range(6)]
    rows = [(1, text[0], "en", "a"), (1, text[0], "en", "a"), (None, text[1], "en", None), (None, text[1], "en", None), (2, text[0].upper(), "en", "a"), (3, None, None, None), (4, "", "en", "b"), (5, text[2] + " x", "en", "b"), (6, text[2] + " y", "en", "b"), (7, text[3], None, "b"), (7, text[4], "en", "b"), (8, "word " * 50_000, "en", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({"kept": F.lit(1), "__hash": F.lit(2), "h": F.lit("h")})
    none = df.filter("false")
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, df, "")
        assert stage(spark, none, "").count() == 0
        if name != "best_fit_packing":
            assert got.columns == df.columns
        ids = sorted(str(r.doc_id) for r in got.collect())
        if name == "exact_dedup":
            assert ids == ["2", "4", "5", "6", "7", "7", "8", "None"]
        if name == "near_dedup":
            assert ids == ["1", "3", "4", "5", "7", "7", "8", "None", "None"]
        if name == "mix_sources":
            assert set(ids) <= {"1", "2", "5", "6", "7", "8", "None"} and max(Counter(ids).values()) <= 4
        if name == "best_fit_packing":
            assert set(ids) == {str(r[0]) for r in rows}
