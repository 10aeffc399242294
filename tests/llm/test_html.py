import re
from html.parser import HTMLParser

from recollect.llm import html_extract as H


def test_article_only():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <header class="site">Site name</header><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- ad --><div class="ad">Buy this now today.</div>
    <article><h1>Title &amp; more</h1><p><b>First para<b>graph</b>.<br><p>Second&nbsp;one.</p><p>Ha.</p>
    <div class="comments"><p>I like this very much, thank you for writing it down.</p></div></article>
    <aside>Related</aside><form><label>Mail</label><input></form><footer>&copy; me</footer></body></html>"""
    assert H.main_text(page) == "Title & more First paragraph. Second one. Ha."


def used(tree):
    return set() if tree.feature < 0 else {H.FEATURES[tree.feature]} | used(tree.low) | used(tree.high)


def test_tree_fits_its_table_by_words_and_links():
    tree, n, wrong = H.default_tree(), 0, 0
    for page, labels in H.labelled_pages():
        got = tree.classify(H.features(H.blocks(page)))
        n, wrong = n + len(labels), wrong + sum(k != (c == "1") for k, c in zip(got.tolist(), labels, strict=True))
    assert n > 1500 and wrong / n < 0.005
    print("the tree tests", sorted(used(tree)))
    assert {"words", "link density", "words before", "words after", "link density after"} <= used(tree)


LONG = "<p>Some text of a page that has enough words to be found, and a few more of them.</p>"
TEXT = " ".join(re.sub("<.*?>", "", LONG).split())


def test_templates_and_pages_without_any_names():
    nav = "<div><a>Home</a> <a>About</a> <a>Contact</a></div>"
    for page in (
        f'<article class="post tags-news"><h1>T</h1>{LONG}{LONG}</article>',
        f'<body class="right-sidebar has-sidebar"><h1>T</h1>{LONG}{LONG}</body>',
        f'<body class="has-header">{nav}<div class="header-wrap"><h1>T</h1>{LONG}{LONG}</div>{nav}</body>',
        f"<form id=aspnetForm>{nav}<main><h1>T</h1>{LONG}{LONG}</main></form>",
        f"<div class=a1>{nav}</div><div class=b2><h1>T</h1>{LONG}{LONG}</div><div class=c3>Copyright, <a>imprint</a>, <a>terms</a></div>",
        f"<article><h1>T</h1>{LONG}<div class=k9>Buy it now at our shop</div>{LONG}</article>",
    ):
        assert H.main_text(page) == f"T {TEXT} {TEXT}", page


def test_nothing_is_lost_after_what_is_never_closed():
    assert H.main_text(f"<head><title>x</title><h1>T</h1><article>{LONG}</article>").endswith(TEXT)
    for tag in ("math", "svg", "select", "object", "noscript", "template", "iframe", "textarea"):
        assert H.main_text(f"<article><h1>T</h1><{tag}>{LONG}{LONG}</article>") == f"T {TEXT} {TEXT}", tag
        assert H.main_text(f"<article><h1>T</h1><{tag}><i>x</i></{tag}>{LONG}</article>") == f"T {TEXT}", tag


def test_links_reach_over_blocks():
    b = H.blocks("<div><a href=x><div>One two</div><p>three</p></a>four</div><div><a href=y>five</div><p>six</p><a name=z><p>seven</p>")
    assert [(x.text, x.linked) for x in b] == [("One two", 2), ("three", 1), ("four", 0), ("five", 1), ("six", 0), ("seven", 0)]


class Plain(HTMLParser):
    """A plain reading of well-formed blocks: (text, words, words in links)."""

    def __init__(self):
        super().__init__()
        self.out, self.now, self.depth, self.skip = [], [], 0, 0

    def cut(self):
        words = " ".join("".join(t for t, _ in self.now).split())
        if words:
            self.out.append((words, len(words.split()), len("".join(t for t, k in self.now if k).split())))
        self.now = []

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style", "title")
        self.depth += tag == "a"
        if tag in H.BLOCKS:
            self.cut()

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style", "title")
        self.depth -= tag == "a"
        if tag in H.BLOCKS:
            self.cut()

    def handle_data(self, data):
        if not self.skip:
            self.now.append((data, self.depth > 0))


def test_blocks_of_all_pages_match_a_plain_parser(spark):
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        plain = Plain()
        plain.feed(r.html)
        plain.close()
        plain.cut()
        assert [(b.text, b.words, b.linked) for b in H.blocks(r.html)] == plain.out


def test_broken_pages():
    assert H.main_text(None) == H.main_text("") == ""
    for page in ("<script>never closed", "<!-- never closed", "<p a='x>y'>text", "<a" * 10_000, "<div>" * 20_000 + "x", "&amp;" * 10, "<p>" + "word " * 300_000):
        H.main_text(page)


def test_pages_against_the_generator(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    got = {r.page_id: r for r in H.op7_html_extract(spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == len(rows)
    import html

    for r in rows:
        inner = re.search(r"<article>(.*?)(?:</article>|<footer>|$)", r.html, re.S)[1]
        want = " ".join(html.unescape(re.sub(r"</?(?:p|h1|br)>", " \n ", inner).replace("<b>", "").replace("</b>", "")).split())
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, None, None, 1), (1, "u", "", 2), (1, "u", "", 2)], "page_id long, url string, html string, text int")
    assert [(r.page_id, r.url, r.text, r.n_chars) for r in H.extract(df).collect()] == [(None, None, "", 0), (1, "u", "", 0), (1, "u", "", 0)]
    assert H.extract(df.limit(0)).count() == 0


def test_a_form_around_the_page_is_no_form():
    """As some page builders make them; a form that is one still goes."""
    body = "<h1>Title</h1>" + LONG * 3
    page = f'<body><form action="x"><div>{body}</div></form></body>'
    text = H.main_text(page)
    assert text.startswith("Title") and text.count("enough words to be found") == 3
    small = f"<body><nav><a href=/>Home</a></nav><div>{body}</div><form><p>Sign up to our letter with your address here</p></form></body>"
    assert "Sign up" not in H.main_text(small) and H.main_text(small).count("enough words") == 3
