"""Texts of whole batches: lattice, tree, XML and CoNLL, a text for each line of a piece, as operators.format has them for rows."""

from __future__ import annotations

import numpy as np

from kakari.functions import plain as P
from kakari.functions.patterns import PosSet
from kakari.operators.batch import Chunks, Piece
from kakari.schema import CHUNK, SELECTION


def _joined(parts: list[str], off: np.ndarray, before: str = "", after: str = "") -> list[str]:
    edges = off.tolist()
    return [before + "".join(parts[a:b]) + after for a, b in zip(edges, edges[1:])]


def chunk_lines(c: Chunks, layer: int, link: np.ndarray, head: np.ndarray | None = None, func: np.ndarray | None = None, score: np.ndarray | None = None, features: list[list[str]] | None = None) -> list[str]:
    """The line before the tokens of each chunk, at a layer from the chunks' on."""
    first = [f"* {i} {to}D " for i, to in zip(c.id.tolist(), link.tolist())]
    if layer == CHUNK:
        return [x + "\n" for x in first]
    scores = [0.0] * len(first) if score is None else score.tolist()
    whole = [f"{x}{h}/{f} {s:.6f}" for x, h, f, s in zip(first, head.tolist(), func.tolist(), scores)]
    if layer == SELECTION:
        whole = [f"{x} {P.csv_join(fs)}" if fs else x for x, fs in zip(whole, features)]
    return [x + "\n" for x in whole]


def lattice(p: Piece, heads: list[str] | None = None) -> list[str]:
    """A line for each token, before those of each chunk its line of heads, where there are any, then EOS."""
    own = p.words.column(P.token_line)
    tokens = [own[i] for i in p.ids.tolist()]
    if heads is None:
        return _joined(tokens, p.off, "", "EOS\n")
    edges = np.append(p.chunks.at, len(tokens)).tolist()
    blocks = [h + "".join(tokens[a:b]) for h, a, b in zip(heads, edges, edges[1:])]
    return _joined(blocks, p.chunks.off, "", "EOS\n")


def tree(p: Piece, link: np.ndarray) -> list[str]:
    """Chunks right-aligned on a staircase, with lines to their heads. Width counts 2 for what isn't ASCII."""
    c, names = p.chunks, p.words.names
    tokens = [names[i] for i in p.ids.tolist()]
    edges = np.append(c.at, len(tokens)).tolist()
    texts = ["".join(tokens[a:b]) for a, b in zip(edges, edges[1:])]
    widths = np.add.reduceat(p.numbers(P.width), c.at).tolist() if len(c.at) else []
    links, off, out = link.tolist(), c.off.tolist(), []
    for a, b in zip(off, off[1:]):
        n, rows = b - a, []
        top = max(widths[a:b], default=0)
        # what stands in the columns of a row before its link and after it; a column that an earlier chunk points at has a bar
        dashes, blanks, seen = bytearray(b"--" * n), bytearray(b"  " * n), set()
        for i in range(n):
            to = links[a + i]
            if to > i:
                cells = dashes[2 * i + 2 : 2 * to] + b"-D" + blanks[2 * to + 2 :]
            else:
                cells = dashes[2 * i + 2 :]
            rows.append(f"{' ' * (top - widths[a + i] + 2 * i)}{texts[a + i]}{cells.decode()}\n")
            if to >= 0 and to not in seen:
                seen.add(to)
                dashes[2 * to : 2 * to + 2] = blanks[2 * to : 2 * to + 2] = b" |"
        out.append("".join(rows) + "EOS\n")
    return out


def xml(p: Piece, link: np.ndarray, head: np.ndarray, func: np.ndarray) -> list[str]:
    """A sentence element with chunk and tok elements; head and func are places in the sentence here."""
    c = p.chunks
    after = p.words.column(_xml_token)
    tokens = [f'  <tok id="{i}" {after[w]}' for i, w in zip(p.place.tolist(), p.ids.tolist())]
    edges = np.append(c.at, len(tokens)).tolist()
    rows = zip(c.id.tolist(), link.tolist(), (head + c.pos).tolist(), (func + c.pos).tolist(), edges, edges[1:])
    blocks = [f' <chunk id="{i}" link="{to}" rel="D" score="0.000000" head="{h}" func="{f}">\n{"".join(tokens[a:b])} </chunk>\n' for i, to, h, f, a, b in rows]
    return _joined(blocks, c.off, "<sentence>\n", "</sentence>\n")


def _xml_token(w: str) -> str:
    return f'feature="{P.xml_escape(P.feature(w))}">{P.xml_escape(w)}</tok>\n'


def _conll_columns(ps: PosSet):
    def made(w):
        own = P.fields(w)
        lemma = own[ps.lemma] if len(own) >= ps.lemma_from else P.norm(w)
        return f"{w}\t{lemma}\t{own[0] if own else '_'}\t{P.concat_pos(ps.levels)(w)}\tfeature={P.feature(w)}"

    return made


def conll(p: Piece, link: np.ndarray, head: np.ndarray, func: np.ndarray, ps: PosSet) -> list[str]:
    """Ten columns for each token. Inside a chunk a token's head is the next one; the last one's is the head word of the head chunk, 0 beyond the end."""
    c, n = p.chunks, len(p.ids)
    rule = _CONLL.setdefault(ps, _conll_columns(ps))
    begins, heads, funcs, end = (np.zeros(n, bool) for _ in range(4))
    begins[c.at] = heads[c.at + head] = funcs[c.at + func] = True
    linked = link >= 0
    last = (c.at + c.size - 1)[linked]
    end[last] = True
    to = p.place.astype(np.int64) + 2
    target = c.off[c.sent[linked]] + link[linked]
    to[last] = (c.pos + head)[target] + 1
    to[to == p.counts[p.sent] + 1] = 0
    notes = np.array(["", "|begin_chunk=1", "|head=1", "|begin_chunk=1|head=1", "|func=1", "|begin_chunk=1|func=1", "|head=1|func=1", "|begin_chunk=1|head=1|func=1"], object)[begins + 2 * heads + 4 * funcs].tolist()
    own = p.words.column(rule)
    rows = [f"{i + 1}\t{own[w]}{note}\t{h}\t{'D' if e else '_'}\t_\t_\n" for i, w, note, h, e in zip(p.place.tolist(), p.ids.tolist(), notes, to.tolist(), end.tolist())]
    return _joined(rows, p.off, "", "\n")


_CONLL: dict = {}
