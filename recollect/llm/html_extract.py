"""Main text of web pages: flat text blocks, judged by a decision tree (operator 7)."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ARROW_ROWS, Scratch, table

#: Elements that end a block, and those whose content is no text of the page.
BLOCKS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li legend main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
DROPPED = frozenset("iframe math noscript object script select style svg template textarea title".split())
RAW = frozenset("script style".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements and words in class, id or role that hint at what is not the article; both are hints to the tree, no more.
ASIDE_TAGS = frozenset("nav footer aside form menu dialog button fieldset search".split())
ASIDE_WORDS = frozenset(
    "ad ads adbox advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments comentarios commentaires consent contentinfo cookie cookies disclaimer "
    "disqus footer gdpr header kommentare login masthead menu menubar modal navbar nav navigation newsletter notice notices notification overlay pager pagination popup promo promoted "
    "promotion related reactions replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toc toolbar topbar widget widgets".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Start tags that end a dropped element whose end tag is missing.
OUT = r"<(?:address|article|aside|blockquote|body|div|dl|footer|form|h[1-6]|header|main|nav|ol|p|section|table|ul)[\s/>]"
#: Share of a page's words from which an element of a page without a main element is the page, whatever its class says.
WRAPPER = 0.8
MAIN_WORDS = frozenset("article content entry main maincontent post story articlebody".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^\"'<>]++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'=<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


@dataclass
class Element:
    """An element around blocks: whether its tag or its words hint that it is beside the article or holds it."""

    tag: str
    above: Element | None
    beside: bool = False
    named_beside: bool = False
    named_main: bool = False
    words: int = 0
    linked: int = 0
    holds_main: bool = False
    holds_title: bool = False

    def line(self) -> Iterator[Element]:
        e = self
        while e is not None:
            yield e
            e = e.above


@dataclass(frozen=True)
class Block:
    text: str
    words: int
    linked: int
    element: Element
    path: str


def _hints(e: Element, raw: str) -> None:
    main = any(x.tag in ("article", "main") or x.named_main for x in e.line())
    e.beside = e.tag in ASIDE_TAGS or (e.tag == "header" and not main)
    for name, a, b, c in _ATTRIBUTE.findall(raw) if raw.strip(" /") else ():
        name = name.lower()
        if name in ("class", "id", "role"):
            words = set(re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", a or b or c).lower()))
            e.named_beside |= bool(words & ASIDE_WORDS) and not (main and words & {"header", "tags"})
            e.named_main |= bool(words & MAIN_WORDS)
        elif name == "hidden" or (name == "aria-hidden" and (a or b or c) == "true") or (name == "style" and re.search(r"display\s*:\s*none", a or b or c)):
            e.beside = True


def _link(raw: str) -> bool:
    """Whether an `a` is a link, not just a named place."""
    names = {x[0].lower() for x in _ATTRIBUTE.findall(raw)} if raw.strip(" /") else set()
    return "href" in names or not names & {"name", "id"}


def blocks(page: str | None) -> list[Block]:
    """The text blocks of a page in order; broken markup is read as far as it goes.

    A dropped element that is never closed ends where the next block begins (script and style: where the page ends, as
    browsers have it). A link reaches over the blocks inside it, but not out of the element that it stands in.
    """
    out: list[Block] = []
    parts: list[tuple[str, bool]] = []
    top = Element("", None)
    stack = [top]
    link = 0  # depth of the element that an open link stands in, from 1
    endless: set[str] = set()  # tags with no end tag from here on
    page = page or ""

    def close() -> None:
        words = "".join(t for t, _ in parts).split()
        if words:
            linked = min(len(words), len(" ".join(t for t, in_a in parts if in_a).split()))
            out.append(Block(" ".join(words), len(words), linked, stack[-1], "/".join(e.tag for e in stack)))
            for e in stack:
                e.words += len(words)
                e.linked += linked
        parts.clear()

    def text(s: str) -> None:
        if s:
            parts.append((html.unescape(s) if "&" in s else s, link > 0))

    def pop(to: int) -> None:
        nonlocal link
        del stack[to:]
        if link > len(stack):
            link = 0

    at = 0
    while m := _TOKEN.search(page, at):
        text(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                parts.append((m[0][9:].removesuffix("]]>"), link > 0))
            continue
        tag = m[2].lower()
        if tag == "a":
            link = 0 if m[1] or not _link(m[3]) else len(stack)
            continue
        if tag in DROPPED:
            if tag in BLOCKS:
                close()
            if m[1] or m[3].endswith("/"):
                continue
            end = None if tag in endless else re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            if end is None:
                endless.add(tag)
            out_of = None if tag in RAW or (end and tag not in ("math", "object", "select", "svg")) else re.compile(OUT, re.I).search(page, at, end.start() if end else len(page))
            at = out_of.start() if out_of else end.end() if end else len(page) if tag in RAW else at
            continue
        if tag not in BLOCKS:
            continue
        close()
        if tag in VOID:
            continue
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    pop(i)
                    break
            continue
        while stack[-1].tag == "p" or (stack[-1].tag == tag and tag in ("li", "dt", "dd", "option", "td", "th", "tr")):
            pop(len(stack) - 1)
        if not m[3].endswith("/"):
            e = Element(tag, stack[-1])
            _hints(e, m[3])
            if tag in ("article", "main", "h1"):
                for x in stack:
                    x.holds_main |= tag != "h1"
                    x.holds_title |= tag == "h1"
            stack.append(e)
    text(page[at:])
    close()
    return out


FEATURES = (
    "words", "link density", "words before", "link density before", "words after", "link density after", "words around", "link density around",
    "share of words on its path", "heading", "plain box", "in main", "outside of main", "hint: beside",
)


def features(page: list[Block]) -> np.ndarray:
    """A row per block: word count and link density of the block, of its neighbours and of the element around it, how many
    of the page's words stand in elements nested alike, and what the elements around it hint at.

    A hint that an element is beside the article does not count if the element holds a main element; that of its class
    or id not if it holds the title either or, on a page without a main element, nearly all words: class names of page
    wrappers tell of the layout. A form around nearly all words of such a page is no form to be filled in.
    """
    n = len(page)
    x = np.zeros((n, len(FEATURES)))
    if not n:
        return x
    w = np.array([b.words for b in page], float)
    d = np.array([b.linked / b.words for b in page])
    x[:, 0], x[:, 1] = w, d
    x[1:, 2], x[1:, 3] = w[:-1], d[:-1]
    x[:-1, 4], x[:-1, 5] = w[1:], d[1:]
    total = w.sum()
    path: dict[str, int] = {}
    for b in page:
        path[b.path] = path.get(b.path, 0) + b.words
    seen: dict[int, tuple[bool, bool]] = {}
    strict = any(e.tag in ("article", "main") for b in page for e in b.element.line())

    def state(e: Element | None) -> tuple[bool, bool]:
        """(beside, in main) of an element, by those around it and its own hints."""
        todo = []
        while e is not None and id(e) not in seen:
            todo.append(e)
            e = e.above
        beside, main = seen[id(e)] if e is not None else (False, False)
        for e in reversed(todo):
            tagged = e.beside and not e.holds_main and not (e.tag == "header" and e.holds_title and not strict) and not (e.tag == "form" and not strict and e.words > WRAPPER * total)
            named = e.named_beside and e.tag not in ("article", "main", "body") and not (e.holds_main or e.holds_title or (not strict and e.words > WRAPPER * total))
            beside |= tagged or named
            main |= e.tag in ("article", "main") or (not strict and e.named_main and not named)
            seen[id(e)] = beside, main
        return beside, main

    for i, b in enumerate(page):
        around = next((e for e in b.element.line() if e.words > b.words), b.element)
        x[i, 6], x[i, 7] = around.words - b.words, (around.linked - b.linked) / max(1, around.words - b.words)
        x[i, 8] = path[b.path] / total
        x[i, 9] = b.element.tag in HEADINGS
        x[i, 10] = b.element.tag in ("div", "section", "td")
        x[i, 13], x[i, 11] = state(b.element)
    x[:, 12] = (x[:, 11] > x[:, 13]).any() * (1 - x[:, 11])
    return x


#: The labelled table: fragments of pages, and for each of their blocks whether it is main text (1) or not (0). Of each
#: kind there are some that their markup tells and some that only their words and links tell.
TOPS = [
    ("<nav><ul><li><a>Home</a><li><a>News</a><li><a>Sport and more</a></ul></nav>", "000"),
    ("<div><a>Home</a> | <a>About us</a> | <a>Contact</a> | Search</div>", "0"),
    ("<div id=menu><ul><li><a>One</a></li><li><a>Two of them</a></li></ul></div><div class=ad>Buy now, only today in every shop near you</div>", "000"),
    ("<header><p>Our site, the best there is</p><p><a>Log in</a></p></header>", "00"),
    ("<table><tr><td><a>A page</a><td><a>B</a><td>C</table><div><a>All offers of the week in our shop, see them here</a></div>", "0000"),
    ("<div class=k1><a><div>Read this as well</div><div>It is the best story that we have</div></a></div>", "00"),
    ("<ul><li><a>Start</a><li><a>Archive</a></ul><div class=k9>Big sale, come in.</div>", "000"),
    ("<div class=cookie-notice><p>We use cookies on this site to count visits and for more that you will find in our long policy.</p></div>", "0"),
    ("", ""),
]
TEXTS = [
    ("<h1>A title of some words</h1><p>Short.</p><p>A longer paragraph with quite a few words that goes on for a while, as they do.</p><p>The last one has a <a>link</a> in it but also many other words that are not one.</p>", "1111"),
    ("<h1>Title</h1><p>The first paragraph has enough words to be seen as text by anyone who counts them.</p><h2>Part two</h2><p>Some text of the article follows here, and it is long enough as well to be found.</p><ul><li>and a point in a list</li><li>another <a>one</a></li></ul>", "111111"),
    ("<p>In an old page all text is in plain elements, and only the number of words tells what it is about.</p><p>That is why the counts of the blocks before and after matter to the judgement of the short ones.</p><p>Yes.</p><p>It goes on with one more paragraph, so that the short one stands between two long ones here.</p>", "1111"),
    ("<h1>Title of a page with a quote</h1><p>One paragraph of text that leads up to what was said by someone at some time.</p><blockquote>Said someone who had to say it in a few words</blockquote><p>And one that leads away from it again, by way of many more words than it needs.</p>", "1111"),
    ("<header><h1>Title in a header</h1></header><p>Body text of the article, which is of the usual length of a paragraph in a text.</p><form><p>Sign up to our letter</p></form><p>More body <a>text</a> comes after the form, and it is again of the usual length.</p>", "11" + "0" + "1"),
    ("<h1>Title with things to share</h1><p>A paragraph with enough words in it to be no menu and no notice of any kind.</p><div class=share><a>Share</a> <a>Send</a></div><p>Another paragraph with enough words in it, after the links by which to share it.</p>", "11" + "0" + "1"),
    ("<h1>Title of a text in boxes</h1><div>The first box has enough words to be seen as text by anyone who counts them.</div><div>Short.</div><div>The last box has again enough words to be seen as text by anyone who counts.</div>", "1111"),
    ("<h1>Title of a text with a box</h1><p>A paragraph with enough words in it to be no menu and no notice of any kind.</p><p>No.</p><div class=k7>Buy it here now, today.</div><p>Another paragraph with enough words in it, after a box that is there to be sold.</p><blockquote>Short words</blockquote>", "111" + "0" + "11"),
    ("<h1>Title of a long text</h1>" + "<p>A paragraph that is one of many in a long text, each with many words and no other thing than words in it.</p><p>So.</p>" * 9, "1" * 19),
    ("<h1>Title above one long text</h1><p>This page has one long paragraph alone, that holds all there is to say, with a <a>link</a> or <a>two</a> somewhere inside, and it goes on and on as some do.</p>", "11"),
]
ENDS = [
    ("<footer>All rights reserved by the owner</footer>", "0"),
    ("<div>Copyright by us, <a>imprint</a>, <a>privacy</a>, <a>terms</a></div>", "0"),
    ("<div class=comments><p>I do not agree with this text at all, as I have said before in many words.</p><p>First!</p></div><footer>Impressum</footer>", "000"),
    ("<aside><p>More from the same author in this series of ours, which is about the same things</p></aside><div><a>Next</a> <a>Previous</a></div>", "00"),
    ("<ul><li><a>Related story of today</a><li><a>Another story that you may like</a></ul><div class=k4>Reserved</div>", "000"),
    ("<div class=sidebar><p>A sidebar with a long text that is not the article but looks very much like one to a counter of words.</p></div><div>Powered by a machine</div>", "00"),
    ("<div><a>Top</a></div>", "0"),
    ("", ""),
]
WRAPS = [("<article>", "</article>"), ("<div class=k2>", "</div>"), ("<main>", "</main>"), ("", ""), ("<div id=content>", "</div>"), ("<section>", "</section>"), ("<div class=has-sidebar><article class=tags-news>", "</article></div>")]
#: Pages whose main element holds what elsewhere is none, or next to whose main element stands what elsewhere is text.
MORE = [
    ("<main><p>Only.</p></main><p>A long paragraph outside of the main element of a page that has one is not its main text, however long.</p><p>Another one.</p>", "100"),
    ("<article><p><a>All of this paragraph is a link in the article</a></p><p>x</p><p><a>Next</a></p></article><p><a>Other</a></p>", "1110"),
    ("<nav><a>Home</a></nav><article><h1>Word</h1><p>Is.</p></article><div>An advert of quite a few words, more than the article has by far, which is as it is.</div>", "0110"),
    ("<article><p>One long paragraph is all that this page has, and there is nothing else before it or after it at all.</p></article>", "1"),
    ("<div><p>One long paragraph is all that this page has, and there is nothing else before it or after it at all.</p></div>", "1"),
    ("<nav><a>Home</a></nav><div class=x>Look here.</div><article><h1>Title</h1><p>" + "words of one very long paragraph " * 40 + "</p></article><footer>Of the page</footer>", "00110"),
    ("<nav><a>Home</a></nav><div class=x>Look here.</div><article><h1>Title</h1><p>" + "words of one very long paragraph " * 40 + "<br><p>Ending so.</p></article>", "00111"),
    ("<article><ul><li><a>One</a><li><a>Two</a><li>Three</ul></article><footer>Of the page</footer>", "1110"),
    ("<ul><li><a>One</a></ul><article><h1>A | B</h1><p>A | B | C</p></article><div>D | E | F | G</div>", "0110"),
]


def labelled_pages(count: int = 180) -> list[tuple[str, str]]:
    """The table: pages put together from the fragments, each kind in turn, and five times those that are whole."""
    out = []
    for i in range(count):
        top, text, end, wrap = TOPS[i % len(TOPS)], TEXTS[i % len(TEXTS)], ENDS[(i // 9 + i) % len(ENDS)], WRAPS[(i // 8 + 2 * i) % len(WRAPS)]
        out.append((f"<body>{top[0]}{wrap[0]}{text[0]}{wrap[1]}{end[0]}</body>", top[1] + text[1] + end[1]))
    return out + MORE * 5


@dataclass(frozen=True)
class Tree:
    """A leaf (`value`) or a test of one feature against a threshold."""

    value: bool = False
    feature: int = -1
    at: float = 0.0
    low: Tree | None = None
    high: Tree | None = None

    def classify(self, x: np.ndarray) -> np.ndarray:
        if self.feature < 0:
            return np.full(len(x), self.value)
        left = x[:, self.feature] <= self.at
        out = np.empty(len(x), bool)
        out[left], out[~left] = self.low.classify(x[left]), self.high.classify(x[~left])
        return out


def train(x: np.ndarray, y: np.ndarray, depth: int = 10, least: int = 2) -> Tree:
    """A classification tree by Gini impurity; ties go to the first feature and the lowest threshold. No leaf has under `least` rows."""
    if depth == 0 or y.all() or not y.any():
        return Tree(value=bool(2 * y.sum() >= len(y)))
    best = None
    for f in range(x.shape[1]):
        v = np.unique(x[:, f])
        for t in (v[1:] + v[:-1]) / 2:
            left = x[:, f] <= t
            if min(left.sum(), (~left).sum()) < least:
                continue
            gini = sum(k.sum() * (p := y[k].mean()) * (1 - p) for k in (left, ~left))
            if best is None or gini < best[0] - 1e-12:
                best = (gini, f, float(t))
    if best is None:
        return Tree(value=bool(2 * y.sum() >= len(y)))
    _, f, t = best
    left = x[:, f] <= t
    return Tree(feature=f, at=t, low=train(x[left], y[left], depth - 1, least), high=train(x[~left], y[~left], depth - 1, least))


@cache
def default_tree() -> Tree:
    xs, ys = [], []
    for page, labels in labelled_pages():
        x = features(blocks(page))
        if len(x) != len(labels):
            raise ValueError(f"{len(x)} blocks, {len(labels)} labels: {page[:60]}")
        xs.append(x)
        ys.append(np.array([c == "1" for c in labels]))
    return train(np.concatenate(xs), np.concatenate(ys))


def main_text(page: str | None, tree: Tree | None = None) -> str:
    b = blocks(page)
    keep = (tree or default_tree()).classify(features(b)) if b else []
    return " ".join(x.text for x, k in zip(b, keep, strict=True) if k)


def extract(pages: DataFrame, *, tree: Tree | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row's whole html.

    A null or empty page, or one without main text, has an empty text. Ids and urls are passed on as they are, null or
    repeated. Each page is judged by itself and read whole, however long; an empty table gives no rows. Columns of other
    names are not read.
    """
    src = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    schema = src.select("page_id", "url").withColumn("text", F.lit("")).withColumn("n_chars", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x, tree) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return src.mapInArrow(run, schema)


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Scratch(spark).write(extract(table(spark, sf_dir, "pages")), "text", rows=ARROW_ROWS)
