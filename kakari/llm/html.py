"""Text of web pages without their site's template.

A page is parsed into elements; each element's subtree (tags, attributes, texts, in order) has a hash. Hashes are counted by
host in Spark, each once a page. A subtree found on at least min_pages pages of a host whose texts differ belongs to the
site's template, however large the host is, and every page of the host loses it. Pages of one host with the same text count
once, so copies of a page don't make its article a template. What is left is given as text, with line breaks between blocks.
script, style, template, noscript and head don't count as text.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kakari.llm.util import cut

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template".split())
SILENT = frozenset("script style template noscript head title".split())
BLOCK = frozenset("address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
CLOSES |= {t: ("p",) for t in BLOCK - {"br", "li", "dt", "dd", "tr", "td", "th", "body", "html", "tbody", "thead", "tfoot"}}
STOPS = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "option": ("select",)}
ROOTS = frozenset(("", "html", "body", "head"))
SPACE = re.compile(r"\s+")
NONE = np.zeros(0, np.uint64)


RAW_END = {t: re.compile(f"</{t}[\\s/>]|$(?![\\s\\S])", re.I) for t in RAW}


class Open:
    """The stack of open elements, and for each tag the places at which it is open, so that no search walks the stack."""

    def __init__(self, root: list):
        self.stack, self.at = [root], {}

    def push(self, element: list) -> None:
        self.at.setdefault(element[0], []).append(len(self.stack))
        self.stack.append(element)

    def last(self, tags: tuple[str, ...]) -> int:
        """The place of the innermost open element with one of these tags, 0 without one."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def close(self, place: int) -> None:
        while len(self.stack) > place:
            self.at[self.stack.pop()[0]].pop()


def parse(page: str) -> list:
    """The root element: [tag, attributes, children, hash], a child being an element or a string. Linear in the page's length, however deep it nests."""
    root = ["", "", [], 0]
    opened = Open(root)
    at, n = 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text and not text.isspace():
            opened.stack[-1][2].append(text)
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if place := opened.last((tag,)):
                opened.close(place)
            continue
        if tag in CLOSES and (place := opened.last(CLOSES[tag])) > opened.last(STOPS.get(tag, ())):
            opened.close(place)
        element = [tag, m[3].strip(), [], 0]
        opened.stack[-1][2].append(element)
        if tag in RAW:
            end = RAW_END[tag].search(page, at)
            if end.start() > at:
                element[2].append(page[at : end.start()])
            at = end.start()
            close = page.find(">", at)
            at = n if close < 0 else close + 1
        elif tag not in VOID and not m[3].endswith("/"):
            opened.push(element)
    return root


def hashed(root: list) -> list[int]:
    """Sets the hash of every element, from the leaves up without recursion, and lists those that may be template."""
    order, todo = [], [root]
    while todo:
        e = todo.pop()
        order.append(e)
        todo.extend(c for c in e[2] if isinstance(c, list))
    found = []
    for e in reversed(order):
        h = xxhash.xxh3_64(f"{e[0]}\x00{e[1]}")
        for c in e[2]:
            h.update(b"\x01" + c[3].to_bytes(8, "big") if isinstance(c, list) else "\x02" + SPACE.sub(" ", c).strip())
        e[3] = h.intdigest()
        if e[0] not in ROOTS and e[0] not in VOID:
            found.append(e[3])
    return found


def text_of(root: list, template) -> tuple[str, int]:
    """The text without template subtrees, and how many of those were deleted (the outermost ones count)."""
    parts, removed, todo = [], 0, [root]
    while todo:
        e = todo.pop()
        if isinstance(e, str):
            parts.append(e)
            continue
        if e[0] not in ROOTS and e[3] in template:
            removed += 1
            continue
        if e[0] in SILENT:
            continue
        if e[0] in BLOCK:
            parts.append("\x00")
            todo.append("\x00")
        todo.extend(reversed(e[2]))
    lines = (SPACE.sub(" ", entities.unescape(x)).strip() for x in "".join(parts).split("\x00"))
    return "\n".join(x for x in lines if x), removed


def host() -> Column:
    return F.lower(F.nullif(F.regexp_extract(F.col("url"), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def count_subtrees(batches):
    """(host, key, content, h) of the distinct subtrees of each page (host, html, key), content being the hash of its text."""
    for batch in batches:
        hosts, pages, keys, rows = batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), ([], [], [], [])
        for i, at in enumerate(hosts):
            root = parse((pages[i].as_py() or "").replace("\x00", " "))
            own = sorted(set(hashed(root)))
            rows[0].extend([at] * len(own))
            rows[1].extend([keys[i]] * len(own))
            rows[2].extend([xxhash.xxh3_64_intdigest(text_of(root, ())[0])] * len(own))
            rows[3].extend(own)
        signed = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in rows[2:]]
        yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.string()), pa.array(rows[1], pa.int64()), *signed], ["host", "key", "content", "h"])


def strip(template):
    """The mapInArrow function over (page_id, host, html[, template hashes])."""

    def run(batches):
        for batch in batches:
            hosts, pages, texts, removed = batch.column(1).to_pylist(), batch.column(2), [], []
            for i, at in enumerate(hosts):
                page = pages[i].as_py()
                root = parse((page or "").replace("\x00", " "))
                found = hashed(root)
                if template:
                    known, seen = template.value.get(at, NONE), np.array(sorted(set(found)), np.uint64)
                    own = set(seen[np.isin(seen, known, assume_unique=True)].tolist())
                else:
                    own = {h & 0xFFFFFFFFFFFFFFFF for h in batch.column(3)[i].as_py() or ()}
                text, n = text_of(root, own)
                texts.append(None if page is None else text)
                removed.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(removed, pa.int32())], ["page_id", "host", "text", "n_removed"])

    return run


def extract(pages: DataFrame, min_pages: int = 3, max_broadcast: int = 2_000_000) -> DataFrame:
    """One row for each row of pages: page_id, host, text, n_removed (template subtrees deleted, the outermost ones).

    pages has page_id, url and html; other columns are ignored. Up to max_broadcast template subtrees, of 8 bytes each, are
    broadcast; more are joined to the subtrees of each page, so no page is sent those of the others. Defined results: a null
    html gives a null text, an empty one an empty text. A url without a host, and a null one, has a null host, whose pages have
    no template. Repeated rows each give their row; pages of a host whose texts are equal count as one page. Unclosed and stray
    tags are taken as browsers would, roughly; an empty table gives an empty result.
    """
    own = pages.select("page_id", host().alias("host"), "html")
    known = own.where("host is not null").select("host", "html", F.xxhash64("html").alias("key"))
    subtrees = known.mapInArrow(count_subtrees, "host string, key long, content long, h long")
    seen = subtrees.select("host", "h", "content").distinct().groupBy("host", "h").count()
    template = cut(seen.where(F.col("count") >= min_pages).select("host", "h"))
    kind = dict(pages.dtypes)["page_id"]
    schema = f"page_id {kind}, host string, text string, n_removed int"
    if template.count() <= max_broadcast:
        table = template.toArrow()
        named = table.column("host").combine_chunks().dictionary_encode()
        if isinstance(named, pa.ChunkedArray):
            named = named.combine_chunks()
        codes, hashes = named.indices.to_numpy(), table.column("h").to_numpy().view(np.uint64)
        order = np.argsort(codes, kind="stable")
        edges = np.searchsorted(codes[order], np.arange(len(named.dictionary) + 1))
        by_host = {at: hashes[order[a:b]] for at, a, b in zip(named.dictionary.to_pylist(), edges[:-1], edges[1:])}
        return own.mapInArrow(strip(pages.sparkSession.sparkContext.broadcast(by_host)), schema)
    lists = subtrees.select("host", "key", "h").join(template, ["host", "h"]).groupBy(F.col("host").alias("other"), F.col("key").alias("page")).agg(F.collect_set("h").alias("template"))
    same = (F.col("host") == F.col("other")) & (F.xxhash64("html") == F.col("page"))
    return own.join(lists, same, "left").select("page_id", "host", "html", "template").mapInArrow(strip(None), schema)
