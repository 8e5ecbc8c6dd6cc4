"""Main text of web pages by equivalence-class template deduction across the pages of a host.

1. Every page becomes a sequence of tokens: its markup paths (tags with classes from the root) and its text
   blocks (path and text). The set of its paths is its layout; pages of one host and layout are a group.
   Pages are parsed once; sequences and blocks are written, and all else goes by them.
2. Over a group's pages each token has an occurrence vector. Tokens with equal vectors form an equivalence
   class; vectors are compared by page count and by a weighted sum over pages, with a 62-bit weight for
   each page: ordinary aggregates, so that a host with a third of all pages is folded in every task first. A
   class has at least LEAST_TOKENS tokens on at least LEAST_PAGES pages and LEAST_SHARE of the group's.
3. A class is valid if on LEAST_AGREE of its pages its tokens come in the same order, over and over, its
   rounds do not cross those of other classes, and lie in the same gap of the same enclosing class. Valid
   classes so nest into the group's template.
4. What stands between template tokens are the slots. A path whose text is mostly links over the group's
   pages is a menu there, whatever a single page has in it.

From the slots, those in menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and
reader comments go, by element and by words in class, id and role. A name made of such words alone (and of words
for containers) always counts, inside an article no other; a name that has such a word beside others, and a form, does
not count for what an article or main element inside it holds, nor where it holds most of the page's text: it is
a wrapper then. An article or main element chooses among the slots: what is inside it stays, and the
others only where they hold more text, the element then being a teaser. Where most of an element's text is
in the template, it is a repeated text and stays whole. In a group without a template there is nothing to
deduce, and an article or main element alone decides, or the whole page outside such names.

Defined results: null or empty html gives an empty text; character references are decoded, white space in a
block becomes one space, blocks are joined by two line feeds in page order; a null url is a host of its
own; broken markup is read as browsers do in outline (implied ends, unknown ends ignored, a tag without
end is text); very long pages take time in proportion to their length; rows repeated with the same id, and
null ids, count as several pages and each give a row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import slices, written

LEAST_TOKENS, LEAST_PAGES, LEAST_SHARE, LEAST_AGREE = 2, 4, 0.5, 0.9
LINK_SHARE = 0.6

_NAME = re.compile(r"/?([a-z][\w:-]*)", re.I)
_STOP = re.compile("[>\"']")
_COMMENT_END = re.compile("--!?>")
_ATTRIBUTE = re.compile(r"(class|id|role|aria-label|style|itemprop|hidden|aria-hidden)\b\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_ENDS = {}

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
IMPLIED = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
RAW = frozenset("script style noscript template svg iframe textarea select object canvas title".split())
# Elements that never hold main text, and the words in class, id or role that say the same of others.
OUTSIDE = frozenset("nav aside footer button label menu dialog head fieldset".split())
HINTS = frozenset(
    "nav navbar navigation menu sidebar aside footer header masthead ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice alert newsletter subscribe subscription comment comments commentlist disqus share sharing social related recommended recommendations breadcrumb breadcrumbs pagination pager popup modal overlay widget toolbar login signup signin search skip reply replies respond contentinfo complementary".split()
)
HINTED = frozenset("div section ul ol p span table dl a article header td li figure details small ins".split())
# Inside an article only a name made of these words alone says so.
INSIDE_HINTS = frozenset("ad ads advert adverts advertisement alert alerts banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus gdpr menu nav navigation navbar newsletter notice notices pager pagination promo recommendations recommended related replies reply respond share sharing sidebar social sponsor sponsored subscribe".split())
CONTAINER_WORDS = frozenset("area bar block box button buttons container group holder icons inner links list module outer panel posts section thread wrap wrapper".split())


@dataclass
class Block:
    path: int
    text: str
    links: int
    outside: bool
    inside: bool
    code: int = 0


@dataclass
class Page:
    """Text blocks in page order, and the tokens of paths and texts in page order."""

    blocks: list[Block] = field(default_factory=list)
    sequence: list[int] = field(default_factory=list)
    paths: set[int] = field(default_factory=set)


@dataclass
class Template:
    """What is known of a group: the tokens of its template, and the paths that are menus."""

    tokens: set[int] = field(default_factory=set)
    menus: set[int] = field(default_factory=set)


def _hints(attributes: str, within: bool) -> tuple[bool, bool, bool, str]:
    """(outside, perhaps outside, main, classes) by attributes."""
    outside = perhaps = main = False
    classes = ""
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            outside = True
        elif name in ("class", "id", "role", "aria-label"):
            if name == "class":
                classes = value
            for said in ({w.lower() for w in _WORD.findall(x)} for x in value.split()):
                hints = INSIDE_HINTS if within else HINTS
                outside |= bool(said & hints) and said <= hints | CONTAINER_WORDS
                perhaps |= not within and bool(said & hints)
            main |= value == "main" and name == "role"
        elif name == "itemprop" and value == "articleBody":
            main = True
    return outside, perhaps, main, classes


def markup(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(begin, end, name, ending, attributes) of each piece of markup; comments and raw elements have no name.

    One pass: a scan that finds no end is not made again, quotes are then no longer looked at.
    """
    last = {q: page.rfind(q) for q in ">\"'"}
    at, quotes = page.find("<"), True
    while at >= 0:
        if page.startswith("<!--", at):
            close = _COMMENT_END.search(page, at + 4)
            end = close.end() if close else len(page)
            yield at, end, "", False, ""
        elif (name := _NAME.match(page, at + 1)) or page.startswith(("<!", "<?"), at):
            begin = name.end() if name else at + 2
            if last[">"] < begin:
                return
            end = -1
            for stop in _STOP.finditer(page, begin) if quotes else ():
                if stop.start() < end:
                    continue
                if stop[0] == ">":
                    end = stop.end()
                    break
                if last[stop[0]] > stop.start():
                    end = page.index(stop[0], stop.end()) + 1
            else:
                quotes, end = False, page.index(">", begin) + 1
            tag, ending = (name[1].lower() if name else ""), page[at + 1] == "/"
            attributes = page[begin : end - 1]
            if tag in RAW and not ending:
                close = _ENDS.setdefault(tag, re.compile(rf"</{tag}\b[^>]*>?", re.I)).search(page, end)
                end = close.end() if close else len(page)
                yield at, end, "", tag in BLOCKS, ""
            else:
                yield at, end, tag, ending, attributes
        else:
            end = at + 1
        at = page.find("<", end)


def _code(*parts) -> int:
    return xxhash.xxh64_intdigest("\x00".join(map(str, parts)).encode("utf-8", "replace")) - (1 << 63)


def read_page(content: str | None) -> Page:
    content, page = content or "", Page()
    # name, outside, elements that are perhaps outside, inside an article, path
    stack: list[tuple[str, bool, tuple[int, ...], bool, int]] = [("", False, (), False, 0)]
    doubts: list[tuple[int, ...]] = []
    doubted = 0
    where: dict[str, list[int]] = {}
    text: list[str] = []
    linked = at = 0

    def flush() -> None:
        nonlocal linked
        if text:
            whole = " ".join(html.unescape("".join(text)).split())
            if whole:
                _, outside, doubt, inside, path = stack[-1]
                doubts.append(doubt)
                page.blocks.append(Block(path, whole, min(linked, len(whole)), outside, inside, _code(path, whole)))
                page.sequence.append(page.blocks[-1].code)
            text.clear()
        linked = 0

    def top(names) -> int:
        return max((where[n][-1] for n in names if where.get(n)), default=0)

    def close(names, within=()) -> None:
        k = top(names)
        if k > top(within):
            for name, *_ in stack[k:]:
                where[name].pop()
            del stack[k:]

    for begin, end, name, ending, attributes in markup(content):
        if begin > at:
            text.append(content[at:begin])
            linked += begin - at if where.get("a") else 0
        at = end
        if name in BLOCKS or (not name and ending):
            flush()
        if name == "br":
            text.append(" ")
        if not name or name in VOID:
            continue
        if ending:
            close((name,))
            continue
        if name in BLOCKS:
            close(("p",), ("td", "th", "li", "div", "article", "section", "blockquote"))
        if name in IMPLIED:
            close(IMPLIED[name], ("ul", "ol", "table", "dl", "select", "menu"))
        if name in ("article", "main"):
            close(("nav", "head"))
        _, outside, doubt, inside, path = stack[-1]
        hinted, perhaps, main, classes = _hints(attributes, inside) if attributes else (False, False, False, "")
        if name in OUTSIDE or (hinted and name in HINTED and not main) or (name == "header" and not inside) or (name == "form" and inside):
            outside = True
        elif (perhaps and name in HINTED and not main) or name == "form":
            doubted += 1
            doubt = (*doubt, doubted)
        if name in ("article", "main") or main:
            inside, doubt = True, ()
        if name in BLOCKS:
            path = _code(path, name, classes)
            page.sequence.append(path)
            page.paths.add(path)
        if not (attributes.endswith("/") and name not in BLOCKS):
            where.setdefault(name, []).append(len(stack))
            stack.append((name, outside, doubt, inside, path))
    if at < len(content):
        text.append(content[at:])
        linked += len(content) - at if where.get("a") else 0
    flush()
    held: Counter[int] = Counter()
    for b, doubt in zip(page.blocks, doubts, strict=True):
        held.update(dict.fromkeys(doubt, 0 if b.outside else len(b.text)))
    most = sum(len(b.text) for b in page.blocks if not b.outside) / 2
    for b, doubt in zip(page.blocks, doubts, strict=True):
        b.outside = b.outside or any(held[d] <= most for d in doubt)
    return page


def layout(page: Page) -> int:
    return _code(*sorted(page.paths))


def nesting(sequence: list[int], place: dict[int, int]) -> dict[int, tuple[int, bool, int, int]]:
    """(order, crossed, enclosing class, its turn) of each class on a page; place: token -> class.

    order is a hash of the class's tokens in their turns, or 0 if its rounds differ. One walk with a
    stack of the rounds that are open.
    """
    turns: dict[int, dict[int, int]] = {}
    for token in sequence:
        if token in place:
            turns.setdefault(place[token], {}).setdefault(token, len(turns[place[token]]))
    out = {c: (_code(*t), False, 0, 0) for c, t in turns.items()}
    rounds: dict[int, int] = {}
    open_: list[int] = []
    for token in sequence:
        if token not in place:
            continue
        c = place[token]
        turn = turns[c][token]
        if turn != rounds.get(c, 0):
            out[c] = (0, *out[c][1:])
        if c in rounds:
            while open_[-1] != c:
                inner = open_.pop()
                del rounds[inner]
                out[inner] = (out[inner][0], True, *out[inner][2:])
        else:
            outer = (open_[-1], rounds[open_[-1]]) if open_ else (0, 0)
            if out[c][2:] not in ((0, 0), outer):
                out[c] = (out[c][0], True, *outer)
            out[c] = (*out[c][:2], *outer)
            open_.append(c)
        rounds[c] = turn + 1
        if rounds[c] == len(turns[c]):
            open_.pop()
            del rounds[c]
    return out


def _chars(found: list[Block]) -> int:
    return sum(len(b.text) for b in found)


def main_text(content: str | None, template: Template | None = None) -> str:
    return chosen_text(read_page(content).blocks, template or Template())


def chosen_text(blocks: list[Block], template: Template) -> str:
    found = [b for b in blocks if not b.outside]
    inside = [b for b in found if b.inside]
    slots = [b for b in found if b.code not in template.tokens]
    chosen = [b for b in slots if b.inside]
    if 2 * _chars(chosen) < _chars(inside):
        # most of the element repeats: copies of one text, not a template around it
        slots, chosen = [b for b in found if b.inside or b in slots], inside
    others = [b for b in slots if not b.inside and b.path not in template.menus]
    if not inside:
        kept = others
    elif template.tokens and _chars(others) > _chars(chosen):
        # the element is a teaser beside the main text
        kept = [b for b in slots if b.inside or b.path not in template.menus]
    else:
        kept = chosen
    return "\n\n".join(b.text for b in kept)


def host(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


PARSED = "host string, layout long, sequence array<long>, code array<long>, path array<long>, text array<string>, links array<int>, outside array<boolean>, inside array<boolean>"
GROUP = ["host", "layout"]


def parsed(rows: DataFrame) -> DataFrame:
    """rows (id, url, host, html) with, in place of html, layout, tokens and text blocks of each page."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 100):
            pages = [read_page(content) for content in batch.column(3).to_pylist()]
            blocks = [[[getattr(b, k) for b in page.blocks] for page in pages] for k in ("code", "path", "text", "links", "outside", "inside")]
            columns = [*batch.columns[:3], pa.array([layout(page) for page in pages], pa.int64()), pa.array([page.sequence for page in pages], pa.list_(pa.int64()))]
            columns += [pa.array(x, pa.list_(k)) for x, k in zip(blocks, (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.bool_(), pa.bool_()), strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "url", *(x.split()[0] for x in PARSED.split(", "))])

    return rows.mapInArrow(parse, f"id {rows.schema['id'].dataType.simpleString()}, url string, {PARSED}")


def classes(pages: DataFrame) -> DataFrame:
    """(host, layout, class, tokens, menus): each group's frequent equivalence classes; class is null for too few tokens."""
    weight = F.xxhash64("id", "sequence").bitwiseAND(F.lit((1 << 62) - 1)).cast("decimal(20,0)")
    none, zero = F.lit(None).cast("decimal(20,0)"), F.lit(0).cast("long")
    on = pages.select(*GROUP, F.explode(F.array_distinct("sequence")).alias("token"), F.lit(1).alias("page"), none.alias("weight"), zero.alias("chars"), zero.alias("links"))
    times = pages.select(*GROUP, F.explode("sequence").alias("token"), F.lit(0).alias("page"), weight.alias("weight"), zero.alias("chars"), zero.alias("links"))
    text = pages.select(*GROUP, F.explode(F.arrays_zip("path", "text", "links")).alias("b")).select(*GROUP, F.col("b.path").alias("token"), F.lit(0).alias("page"), none.alias("weight"), F.length("b.text").cast("long").alias("chars"), F.col("b.links").cast("long").alias("links"))
    totals = on.unionByName(times).unionByName(text).groupBy(*GROUP, "token").agg(F.sum("page").alias("pages"), F.sum("weight").alias("vector"), F.sum("chars").alias("chars"), F.sum("links").alias("links"))
    size = pages.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("group_pages")).filter(F.col("group_pages") >= LEAST_PAGES)
    frequent = totals.join(size, GROUP).filter((F.col("pages") >= LEAST_PAGES) & (F.col("pages") >= LEAST_SHARE * F.col("group_pages")))
    menu = F.when((F.col("chars") > 0) & (F.col("links") >= LINK_SHARE * F.col("chars")), F.col("token"))
    of = frequent.groupBy(*GROUP, "pages", "vector").agg(F.sort_array(F.collect_list("token")).alias("tokens"), F.collect_list(menu).alias("menus"))
    return of.select(*GROUP, F.when(F.size("tokens") >= LEAST_TOKENS, F.xxhash64("pages", "vector")).alias("class"), "tokens", "menus")


def templates(pages: DataFrame) -> DataFrame:
    """(host, layout, tokens, menus): each group's template, of its valid classes."""
    found = written(classes(pages), "classes")
    by_group = found.filter("class is not null").groupBy(*GROUP).agg(F.collect_list(F.struct("class", "tokens")).alias("classes"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: Counter = Counter()
            known: dict[tuple[str, int], dict[int, int]] = {}
            for i, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if key not in known:
                    known[key] = {token: x["class"] for x in batch.column(3)[i].as_py() for token in x["tokens"]}
                for c, seen in nesting(batch.column(2)[i].as_py(), known[key]).items():
                    held[(*key, c, *seen)] += 1
            rows = [(*k, n) for k, n in held.items()]
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64())
            names = [*GROUP, "class", "order", "crossed", "outer", "turn", "n"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    seen = pages.select(*GROUP, "sequence").join(by_group, GROUP).mapInArrow(look, "host string, layout long, class long, order long, crossed boolean, outer long, turn long, n long")
    ways = seen.groupBy(*GROUP, "class", "order", "crossed", "outer", "turn").agg(F.sum("n").alias("n"))
    best = F.max(F.struct("n", "order", F.expr("not crossed").alias("whole"))).alias("best")
    valid = ways.groupBy(*GROUP, "class").agg(F.sum("n").alias("all"), best).filter(F.expr(f"best.whole and best.order != 0 and best.n >= {LEAST_AGREE} * all"))
    judged = found.join(valid.select(*GROUP, "class", F.lit(True).alias("valid")), [*GROUP, "class"], "left")
    tokens = F.collect_list(F.when(F.col("valid"), F.col("tokens")))
    return judged.groupBy(*GROUP).agg(F.flatten(tokens).alias("tokens"), F.flatten(F.collect_list("menus")).alias("menus"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text, n_chars."""
    kind = pages.schema[id_col].dataType.simpleString()
    url = F.col(url_col).cast("string")
    read = written(parsed(pages.select(F.col(id_col).alias("id"), url.alias("url"), host(url).alias("host"), F.col(html_col).cast("string").alias("html"))), "parsed")
    found = written(templates(read), "templates")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            known: dict[tuple[str, int], Template] = {}
            out = []
            columns = [batch.column(k).to_pylist() for k in range(2, 10)]
            for i, (name, of, *blocks) in enumerate(zip(*columns, strict=True)):
                if (name, of) not in known:
                    known[name, of] = Template(*(set(batch.column(k)[i].as_py() or ()) for k in (10, 11)))
                code, path, text, links, outside, inside = blocks
                out.append(chosen_text([Block(*x) for x in zip(path, text, links, outside, inside, code, strict=True)], known[name, of]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=[id_col, "url", "text", "n_chars"])

    rows = read.join(found, GROUP, "left").select("id", "url", *GROUP, "code", "path", "text", "links", "outside", "inside", "tokens", "menus")
    return rows.mapInArrow(take, f"{id_col} {kind}, url string, text string, n_chars long")
