"""Templates of large hosts, copies of pages, and the joined path of operator 9."""

import time
from collections import defaultdict
from html.parser import HTMLParser
from urllib.parse import urlsplit

from kakari.llm import html

SCHEMA = "page_id long, url string, html string"
PAGE = "<html><body><nav><a href='/{0}'>Section {0}</a></nav><p>article number {1}</p></body></html>"


def test_template_of_a_small_share_of_a_large_host(spark):
    rows = [(i, "https://site.example/a", PAGE.format(f"s{i // 4}", i)) for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = [(i, f"article number {i}", 1) for i in range(200)]
    for options in ({}, {"max_broadcast": 0}):
        assert sorted((r.page_id, r.text, r.n_removed) for r in html.extract(df, **options).collect()) == want


def test_copies_do_not_delete_an_article(spark):
    rows = [(i, "https://site.example/a", f"<script>track({i})</script><p>the same article</p>") for i in range(9)]
    rows += [(9 + i, "https://site.example/b", PAGE.format("s", i)) for i in range(2)]
    df = spark.createDataFrame(rows, SCHEMA)
    for options in ({}, {"max_broadcast": 0}):
        got = {r.page_id: r.text for r in html.extract(df, **options).collect()}
        assert all(got[i] == "the same article" for i in range(9)) and got[9] == "Section s\narticle number 0"


class Plain(HTMLParser):
    """A tree of (start tag as written, children), by the standard library's parser; paragraphs and list items end where the next block begins."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.root = ("", [])
        self.open = [("", self.root)]
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        ends = ("li",) if tag == "li" else ("p",) if tag in BLOCKS else ()
        if ends and any(t in ends for t, _ in self.open):
            while self.open.pop()[0] not in ends:
                pass
        node = (self.get_starttag_text(), [])
        self.open[-1][1][1].append((tag, *node))
        if tag not in ("meta", "br", "img", "link", "hr", "input"):
            self.open.append((tag, node))

    def handle_endtag(self, tag):
        if any(t == tag for t, _ in self.open):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, text):
        if text.strip():
            self.open[-1][1][1].append(text)


BLOCKS = {"address", "article", "aside", "blockquote", "div", "dl", "footer", "form", "h1", "h2", "h3", "h4", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}


def subtrees(children):
    for c in children:
        if not isinstance(c, str):
            yield c
            yield from subtrees(c[2])


def plain_text(children, template):
    out = ""
    for c in children:
        if isinstance(c, str):
            out += c
        elif repr(c) in template or c[0] in ("head", "script", "style", "title", "noscript", "template"):
            continue
        else:
            edge = "\n\x00" if c[0] in BLOCKS | {"br", "li", "body", "html", "td", "tr"} else ""
            out += edge + plain_text(c[2], template) + edge
    return out


def lines(text):
    return "\n".join(x for x in (" ".join(y.split()) for y in text.split("\x00")) if x)


def test_against_the_standard_parser(spark):
    """Texts, templates and all, on whole tables of pages, by another parser and without hashes."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = pages.select("page_id", "url", "html").collect()
    trees = {r.page_id: Plain(r.html or "").root[1] for r in rows}
    hosts = {r.page_id: urlsplit(r.url).hostname for r in rows}
    on = defaultdict(set)
    for i, tree in trees.items():
        for c in subtrees(tree):
            if c[0] not in ("html", "body", "head", "meta", "br"):
                on[hosts[i], repr(c)].add(lines(plain_text(tree, ())))
    got = {r.page_id: r.text for r in html.extract(pages).collect()}
    want = {i: lines(plain_text(tree, {c for (h, c), texts in on.items() if h == hosts[i] and len(texts) >= 3})) for i, tree in trees.items()}
    assert sum(len(x) >= 3 for x in on.values()) > 30
    assert {i: (got[i], want[i]) for i in want if got[i] != want[i]} == {}


def test_deep_pages_are_linear():
    for page in ("<div>" * 200_000, "<p>" * 100_000, "<b>" * 50_000 + "</i>" * 50_000, "<ul><li>" * 50_000, "<div><script>" * 20_000, "<b>" * 50_000 + "<td>" * 50_000):
        began = time.process_time()
        html.hashed(html.parse(page))
        assert time.process_time() - began < 5


def test_implied_ends():
    page = "<ul><li>a<li>b<ul><li>c</ul><li>d</ul><table><tr><td>1<td>2<tr><td>3</table><p>x<div>y</div></b>z"
    assert html.text_of(html.parse(page), ())[0] == "a\nb\nc\nd\n1\n2\n3\nx\ny\nz"
