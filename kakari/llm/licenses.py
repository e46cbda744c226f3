"""Licence scans: windows of the normalised texts compared with licence templates by the Dice coefficient over word bigrams.

Words are as in kernels.py, so case, punctuation and line breaks don't count. A template of m words is compared with every
window of m words of a text, at each word (a shorter text is one window); a window and a template have the similarity
2 |A & B| / (|A| + |B|) of their sets of word bigrams. A template of b bigrams can reach the threshold t only with t / (2 - t) * b
shared ones, and with windows of t / (2 - t) * b to (2 - t) / t * b bigrams: a template of which a whole text hasn't as many is
dropped before any comparison, and only windows that hold as many of its bigrams are compared. Of windows that overlap, of
the same template or of others, the best one counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kakari.llm.kernels import Table, U, blocks, mix, owners, words
from kakari.llm.license_texts import TEMPLATES
from kakari.llm.util import pick

SCHEMA = "word int, n_words int, license string, template string, dice double"


def bigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word bigrams of all texts in order, and the texts' offsets into them."""
    w = words(texts)
    count = np.maximum(np.diff(w.offsets) - 1, 0)
    offsets = np.concatenate([[0], np.cumsum(count)])
    first = np.arange(offsets[-1]) + np.repeat(w.offsets[:-1] - offsets[:-1], count)
    with np.errstate(over="ignore"):
        return mix(w.hash[first] * U(0xD6E8FEB86659FD93) + w.hash[np.minimum(first + 1, max(len(w.hash) - 1, 0))]), offsets


class Templates:
    def __init__(self, templates: dict[str, str], threshold: float):
        self.threshold = threshold
        own = [(n, bigrams(pa.array([templates[n]]))[0]) for n in sorted(templates)]
        own = [(n, h) for n, h in own if len(h)]
        self.names = [n for n, _ in own]
        sets = [np.unique(h) for _, h in own]
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.widths = np.array([len(h) for _, h in own], np.int64)
        self.need = np.ceil(self.sizes * threshold / (2 - threshold) - 1e-9)
        distinct = np.unique(np.concatenate(sets)) if sets else np.zeros(0, U)
        self.table = Table(distinct)
        self.holds = np.array([np.isin(distinct, s) for s in sets]).reshape(len(sets), len(distinct))
        self.quick = np.zeros(1 << 16, bool)
        self.quick[(distinct >> U(48)).astype(np.int64)] = True
        # a bigram is worth looking at when some template is within reach of the texts that hold it
        self.floor = int(self.need.min()) if len(own) else 0

    def find(self, texts: pa.Array) -> list[tuple]:
        """(text, word, words, name, dice) of the windows that count."""
        h, offsets = bigrams(texts)
        out: list[tuple] = []
        if not len(self.names) or not len(h):
            return out
        near = np.flatnonzero(self.quick[(h >> U(48)).astype(np.int64)])
        row = self.table.find(h[near])
        near, row = near[row >= 0], row[row >= 0]
        text = np.searchsorted(offsets, near, "right") - 1
        cell = np.unique(text * np.int64(self.holds.shape[1]) + row)
        of, which = cell // self.holds.shape[1], cell % self.holds.shape[1]
        edge = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(0, np.int64)
        for a, b in zip(edge, np.append(edge[1:], len(of))):
            if b - a < self.floor:
                continue
            shared = self.holds[:, which[a:b]].sum(1)
            n = int(offsets[of[a] + 1] - offsets[of[a]])
            fits = np.flatnonzero((shared >= self.need) & (n >= self.need))
            if len(fits):
                mine = slice(*np.searchsorted(text, [of[a], of[a] + 1]))
                out.extend(self.best(int(of[a]), h[offsets[of[a]] : offsets[of[a] + 1]], near[mine] - offsets[of[a]], row[mine], fits))
        return out

    def best(self, text: int, h: np.ndarray, at: np.ndarray, row: np.ndarray, fits: np.ndarray) -> list[tuple]:
        n, scored = len(h), []
        for t in fits.tolist():
            width = min(int(self.widths[t]), n)
            held = np.zeros(n + 1, np.int64)
            hits = at[self.holds[t, row]]
            held[hits + 1] = 1
            upto = np.cumsum(held)
            for start in np.flatnonzero(upto[width:] - upto[: n - width + 1] >= self.need[t]).tolist():
                own = len(np.unique(h[start : start + width]))
                some = hits[np.searchsorted(hits, start) : np.searchsorted(hits, start + width)]
                both = len(np.unique(h[some]))
                dice = 2 * both / (own + int(self.sizes[t]))
                if dice >= self.threshold:
                    scored.append((-both, -dice, -width, start, self.names[t]))
        scored.sort()
        begin, end = np.array([s for *_, s, _ in scored]), np.array([s - w for *_, w, s, _ in scored])  # the window's words are start..end
        out = []
        for i, (_, dice, width, start, name) in enumerate(scored):
            if not ((begin[:i] <= end[i]) & (end[:i] >= begin[i])).any():
                out.append((text, start, 1 - width, name, -dice))
        return out


def scan(templates):
    def run(batches):
        for batch in blocks(batches):
            rows = templates.value.find(batch.column(1))
            ids = batch.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
            columns = [[r[1] for r in rows], [r[2] for r in rows], [r[3].split("/")[0] for r in rows], [r[3] for r in rows], [r[4] for r in rows]]
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(columns, kinds))], ["doc_id", "word", "n_words", "license", "template", "dice"])

    return run


def find_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """Every window that matches a template: doc_id, word (its first word's number in the text), n_words, license, template, dice.

    docs has doc_id and text; other columns are ignored. templates maps "licence/form" to a text. A window counts if none that
    overlaps it is better: one that shares more bigrams with its template, of a higher coefficient, of more words, further left,
    or of a template earlier by name, in this order; so a body counts, not the notice in its first lines.
    Defined results: null and empty texts, texts and templates of fewer than two words match nothing; repeated rows and null
    doc_ids each give their rows; an empty table gives an empty result. One scan, no shuffle; the templates are broadcast.
    """
    kind = dict(docs.dtypes)["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(Templates(templates, threshold))
    return pick(docs, doc_id="doc_id", text="text").mapInArrow(scan(shared), f"doc_id {kind}, {SCHEMA}")


ORACLE = """
WITH templates(template, body) AS (VALUES %s),
tw AS (SELECT template, regexp_extract_all(lower(body), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM templates),
own AS MATERIALIZED (SELECT template, len(w) - 1 AS width, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM tw WHERE len(w) > 1),
words AS (SELECT doc_id, regexp_extract_all(lower(text), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM documents),
grams AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS r, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS g FROM words WHERE len(w) > 1),
flat AS (SELECT r, unnest(list_distinct(g)) AS x FROM grams),
flat_own AS (SELECT template, len(b) AS size, unnest(b) AS x FROM own),
near AS MATERIALIZED (SELECT r, template FROM flat JOIN flat_own USING (x) GROUP BY r, template, size HAVING count(*) >= ceil(size * 0.8 / 1.2 - 1e-9)),
starts AS (SELECT r, template, least(width, len(g)) AS width, b, g, unnest(range(0, len(g) - least(width, len(g)) + 1)) AS word FROM near JOIN grams USING (r) JOIN own USING (template)),
cut AS (SELECT r, template, width, word, b, list_distinct(g[word + 1 : word + width]) AS a FROM starts),
scored AS MATERIALIZED (SELECT r, template, width, word, len(list_intersect(a, b)) AS both, 2 * len(list_intersect(a, b)) / (len(a) + len(b)) AS dice FROM cut WHERE 2 * len(list_intersect(a, b)) / (len(a) + len(b)) >= 0.8)
SELECT doc_id, CAST(word AS INTEGER) AS word, CAST(width + 1 AS INTEGER) AS n_words, string_split(template, '/')[1] AS license, template, CAST(dice AS DOUBLE) AS dice
FROM scored s JOIN grams USING (r) WHERE NOT EXISTS (SELECT 1 FROM scored o WHERE o.r = s.r AND o.word <= s.word + s.width AND o.word + o.width >= s.word
  AND (-o.both, -o.dice, -o.width, o.word, o.template) < (-s.both, -s.dice, -s.width, s.word, s.template))
""" % ", ".join("('{}', '{}')".format(n, b.replace("'", "''")) for n, b in TEMPLATES.items())
