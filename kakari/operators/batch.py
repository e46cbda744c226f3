"""The layers over whole batches of texts: Arrow stages in which a token is a number and rules are asked once for each distinct word.

Lambdas over arrays are interpreted by Spark for every element, some 20 to 100 microseconds a token for the longer rules. Here a text's
words are numbered, what a rule says of a word is kept with its number, and chunks, heads and links are arithmetic over whole arrays.
Rows come out of the stage that reads the texts, without shuffles. The expressions in the modules beside this one say the same for
rows that have tokens already, and for streams.

Texts are handled a piece of some PIECE characters at a time, rows are given back some ROWS at a time and the words that are kept are
forgotten beyond MAX_WORDS, so a worker's memory doesn't follow the size of its partition.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from kakari.functions import plain as P
from kakari.functions.patterns import PosSet

PIECE, ROWS, MAX_WORDS = 1 << 20, 1 << 14, 1 << 17
_CUT = re.compile("[A-Za-zÀ-ɏ]+|[0-9]+|\n|[^ \t\r]")


class Words(dict):
    """Distinct words and their numbers, and by rule what it says of each; 0 is the end of a line."""

    def __init__(self):
        super().__init__()
        self.names: list[str] = []
        self._columns: dict = {}
        self._arrays: dict = {}
        self._codes: dict = {}
        self["\n"]

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self.names)
        self.names.append(word)
        return n

    def column(self, rule: Callable) -> list:
        made = self._columns.setdefault(rule, [])
        if len(made) < len(self.names):
            made.extend(map(rule, self.names[len(made) :]))
        return made

    def _array(self, key, values: list, make):
        kept = self._arrays.get(key)
        if kept is None or len(kept) != len(values):
            kept = self._arrays[key] = make(values)
        return kept

    def numbers(self, rule: Callable, dtype=bool) -> np.ndarray:
        return self._array((rule, dtype), self.column(rule), lambda x: np.array(x, dtype))

    def by_class(self, rule: Callable, dtype=bool) -> np.ndarray:
        """For a rule on what words share: what it says of each word."""
        codes, values = self.codes(P.klass)
        return np.array([rule(v) for v in values], dtype)[codes]

    def strings(self, rule: Callable) -> pa.Array:
        return self._array(rule, self.column(rule), lambda x: pa.array(x, pa.string()))

    def truth(self, rule: Callable) -> np.ndarray:
        """Whether a rule says anything of each word."""
        return self._array((rule, "truth"), self.column(rule), lambda x: np.array(list(map(bool, x)), bool))

    def codes(self, rule: Callable) -> tuple[np.ndarray, list[str]]:
        """For a rule with few distinct results: a number for each word, and what the numbers stand for."""
        found, kept = self._codes.setdefault(rule, ({}, []))
        values = self.column(rule)
        kept.extend(found.setdefault(v, len(found)) for v in values[len(kept) :])
        return self._array((rule, "codes"), kept, lambda x: np.array(x, np.int64)), list(found)


class Piece:
    """Some texts as lines and words: ids are the words' numbers, off the places in it where lines begin."""

    def __init__(self, words: Words, keys: pa.Array, texts: list[str]):
        cut = _CUT.findall("\n".join(texts))
        raw = np.fromiter(map(words.__getitem__, cut), np.int32, len(cut))
        ends = np.flatnonzero(raw == 0)
        self.words, self.keys, self.ids = words, keys, raw[raw != 0]
        self.off = np.concatenate([[0], ends - np.arange(len(ends)), [len(self.ids)]]).astype(np.int64)
        lines = np.array([t.count("\n") + 1 for t in texts])
        self.n = len(self.off) - 1
        self.doc = np.repeat(np.arange(len(texts)), lines)
        self.line = (np.arange(self.n) - np.repeat(np.cumsum(lines) - lines, lines)).astype(np.int32)
        self.counts = np.diff(self.off)

    @cached_property
    def sent(self) -> np.ndarray:
        """The line of each token, counted through the piece."""
        return np.repeat(np.arange(self.n), self.counts)

    @cached_property
    def place(self) -> np.ndarray:
        """The place of each token in its line."""
        return (np.arange(len(self.ids)) - np.repeat(self.off[:-1], self.counts)).astype(np.int32)

    @cached_property
    def chunks(self) -> Chunks:
        return Chunks(self)

    def chunks_by(self, marks: np.ndarray) -> Chunks:
        """Chunks from marks, one for each token; the first of a line begins one whatever its mark."""
        return Chunks(self, marks)

    def numbers(self, rule: Callable, dtype=np.int64) -> np.ndarray:
        """What a rule on words says of each token."""
        return self.words.numbers(rule, dtype)[self.ids]

    def flags(self, rule: Callable) -> np.ndarray:
        """What a rule on classes of words says of each token."""
        return self.words.by_class(rule)[self.ids]

    def text_of(self, rule: Callable) -> Taken:
        return Taken(self.words.strings(rule), self.ids)


class Taken:
    """A column of values by their numbers, made a slice at a time."""

    def __init__(self, values: pa.Array, at: np.ndarray):
        self.values, self.at = values, at

    def __call__(self, a: int, b: int) -> pa.Array:
        return self.values.take(pa.array(self.at[a:b]))


class Chunks:
    """Chunks of a piece: at is the first token in the piece, size, sent the line, id the number in the line, off the lines' first chunks."""

    def __init__(self, p: Piece, marks: np.ndarray | None = None):
        if marks is None:
            # a chunk begins after a particle that no particle follows
            part = p.flags(P.is_case)
            marks = ~part
            marks[1:] &= part[:-1]
        begin = np.array(marks, bool)
        begin[p.off[:-1][p.counts > 0]] = True
        self.p, self.at = p, np.flatnonzero(begin)
        self.size = np.diff(np.append(self.at, len(p.ids))).astype(np.int32)
        self.sent = p.sent[self.at]
        self.counts = np.bincount(self.sent, minlength=p.n)
        self.off = np.concatenate([[0], np.cumsum(self.counts)])
        self.id = (np.arange(len(self.at)) - self.off[self.sent]).astype(np.int32)
        self.n = self.counts[self.sent].astype(np.int32)
        self.pos = (self.at - p.off[self.sent]).astype(np.int32)

    def last(self, flags: np.ndarray) -> np.ndarray:
        """The offset of each chunk's last token with a flag, 0 where there is none."""
        if not len(self.at):
            return np.zeros(0, np.int32)
        found = np.maximum.reduceat(np.where(flags, np.arange(len(flags)), -1), self.at)
        return np.where(found < 0, 0, found - self.at).astype(np.int32)

    def heads(self, ps: PosSet) -> tuple[np.ndarray, np.ndarray]:
        """Offsets of the head words and of the function words."""
        head, func = (self.last(self.p.flags(P.has_prefix(x))) for x in (ps.head, ps.func))
        return head, np.maximum(head, func) if ps.func_after_head else func

    def features(self, ps: PosSet, punctuation, most: int) -> list[list[str]]:
        """All features of each chunk, the first `most` of them: signs, head/function/left/right token, context, place, and the one its heads see."""
        words, ids = self.p.words, self.p.ids
        head, func = self.heads(ps)
        rule = P.sign_features(punctuation)
        signs, norm = words.column(rule), words.column(P.norm)
        signed = np.flatnonzero(words.truth(rule)[ids])
        edges = np.searchsorted(signed, np.append(self.at, len(ids))).tolist()
        signed = ids[signed].tolist()
        codes, classes = words.codes(P.klass)
        fh, ff, fl, fr = ([P.token_features(x, ps)(k) for k in classes] for x in ("FH", "FF", "FL", "FR"))
        case, seen = [P.is_case(k) for k in classes], [P.seen_feature(ps)(k) for k in classes]
        at = [ids[self.at + head], ids[self.at + func], ids[self.at], ids[self.at + self.size - 1]]
        rows = zip(edges, edges[1:], *(x.tolist() for x in at), *(codes[x].tolist() for x in at), (self.id == 0).tolist(), (self.id == self.n - 1).tolist())
        out = []
        for a, b, h, f, left, right, kh, kf, kl, kr, begins, ends in rows:
            x = []
            for s in signed[a:b]:
                x += signs[s]
            h, f, left = norm[h], norm[f], norm[left]
            x.append("FHS:" + h)
            x += fh[kh]
            x.append("FFS:" + f)
            x += ff[kf]
            x.append("FLS:" + left)
            x += fl[kl]
            x.append("FRS:" + norm[right])
            x += fr[kr]
            x += ("LF:" + f, "RL:" + left, "RH:" + h, "RF:" + f)
            if begins:
                x.append("FBOS:1")
            if ends:
                x.append("FEOS:1")
            if case[kf]:
                x.append("GCASE:" + f)
            x.append(seen[kf] or "A:" + f)
            out.append(x if len(x) <= most else x[:most])
        return out

    def by_rule(self, step: int = 2) -> np.ndarray:
        """Links by arithmetic on the chunks' sizes."""
        return np.where(self.id == self.n - 1, -1, np.minimum(self.id + 1 + self.size % step, self.n - 1)).astype(np.int32)

    def depths(self, link: np.ndarray) -> np.ndarray:
        """How many links lead from each chunk to its root. Links lead to later chunks or are -1."""
        depth = [0] * len(link)
        rows = zip(range(len(link) - 1, -1, -1), link[::-1].tolist(), self.off[self.sent][::-1].tolist())
        for i, to, first in rows:
            if to >= 0:
                depth[i] = depth[first + to] + 1
        return np.array(depth, np.int32)

    def passed(self, of_src: np.ndarray, of_dst: np.ndarray, modulus: int, shift: int) -> tuple[np.ndarray, np.ndarray]:
        """Links and scores of the shift-reduce pass, where a pair's score is (of_src + of_dst) % modulus - shift; the root has -1 and 0."""
        link, score = [-1] * len(self.at), [0] * len(self.at)
        first, second = of_src.tolist(), of_dst.tolist()
        edges = self.off.tolist()
        for a, b in zip(edges, edges[1:]):
            if b - a < 2:
                continue
            stack, latest = [a], 0
            for dst in range(a + 1, b - 1):
                other = second[dst]
                while stack:
                    src = stack[-1]
                    latest = (first[src] + other) % modulus - shift
                    if latest <= 0:
                        break
                    stack.pop()
                    link[src], score[src] = dst - a, latest
                stack.append(dst)
            for src in stack:
                link[src], score[src] = b - 1 - a, latest
        return np.array(link, np.int32), np.array(score, np.int32)


def pieces(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[str]]]:
    """The keys and texts of a batch (key, text), some PIECE characters at a time; rows without a text have no lines and are left out."""
    kept = batch.filter(pc.is_valid(batch.column(1))) if batch.column(1).null_count else batch
    size = np.cumsum(pc.binary_length(kept.column(1)).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < kept.num_rows:
        b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + PIECE, "right")))
        yield kept.column(0).slice(a, b - a), kept.column(1).slice(a, b - a).to_pylist()
        a = b


_known = Words()


def known_words() -> Words:
    """The words that this process has met, in this task or in those before it; they are forgotten when they become many."""
    global _known
    if len(_known.names) > MAX_WORDS:
        _known = Words()
    return _known


def schema_of(text: str) -> list[StructField]:
    return _parse_datatype_string(text).fields


def over(df: DataFrame, fields: str, made: Callable[[Piece], Iterator[list]], keyed: bool = True) -> DataFrame:
    """Rows of the batches made(piece) from the texts of df (key, text), in the stage that reads them: the columns are the key, if keyed, and fields."""
    schema = StructType(df.schema.fields[:1] * keyed + schema_of(fields))
    names = schema.names

    def run(batches):
        for batch in batches:
            for keys, texts in pieces(batch):
                for arrays in made(Piece(known_words(), keys, texts)):
                    yield pa.RecordBatch.from_arrays(arrays, names)

    return df.mapInArrow(run, schema)


def arrow(x, a: int, b: int) -> pa.Array:
    return x(a, b) if callable(x) else pa.array(x[a:b]) if isinstance(x, np.ndarray) else x.slice(a, b - a)


def rows(p: Piece, sent: np.ndarray, *columns, step: int = ROWS) -> Iterator[list[pa.Array]]:
    """Batches of key, line and columns (arrays, or functions of a slice) of rows that lie in the lines sent."""
    for a in range(0, len(sent), step):
        b = min(a + step, len(sent))
        own = sent[a:b]
        yield [p.keys.take(pa.array(p.doc[own])), pa.array(p.line[own]), *(arrow(c, a, b) for c in columns)]


def by_line(p: Piece, *columns, step: int = 1 << 10) -> Iterator[list[pa.Array]]:
    """Batches of key, line and columns with one value for each line."""
    return rows(p, np.arange(p.n), *columns, step=step)


def lists(off: np.ndarray, values: np.ndarray, type_=None) -> Callable:
    """A column of lists: values from one place in off to the next."""

    def made(a, b):
        own = off[a : b + 1]
        flat = values.slice(own[0], own[-1] - own[0]) if isinstance(values, pa.Array) else pa.array(values[own[0] : own[-1]], type_)
        return pa.ListArray.from_arrays(pa.array((own - own[0]).astype(np.int32)), flat)

    return made


def strings(values: list[str]) -> Callable:
    """A column of texts that are in memory, made a slice at a time."""
    return lambda a, b: pa.array(values[a:b], pa.string())


# Templates of the sequence tagger


def template_texts(p_sent: np.ndarray, cells: list[tuple[np.ndarray, list[str] | pa.Array]], templates: dict) -> Callable:
    """A column of the templates filled in and joined by |, for rows in the lines p_sent; beyond a line's ends stand _B-1, _B-2, _B+1, _B+2.

    cells has, by column, a number for each row and what numbers stand for; the first column's values are many, those of others few, so
    that windows of those are put together once for each distinct one.
    """
    n_rows = len(p_sent)
    starts = np.flatnonzero(np.diff(p_sent, prepend=-1)) if n_rows else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, n_rows))
    place, size = np.arange(n_rows) - np.repeat(starts, sizes), np.repeat(sizes, sizes)
    ends = ["_B-2", "_B-1", "_B+1", "_B+2"]
    codes, values = [c for c, _ in cells], [v for _, v in cells]
    texts = [pa.concat_arrays([v if isinstance(v, pa.Array) else pa.array(v, pa.string()), pa.array(ends)]) for v in values]

    def at(column: int, d: int, a: int, b: int) -> np.ndarray:
        n = len(values[column])
        here = place[a:b] + d
        inside = (here >= 0) & (here < size[a:b])
        beyond = np.where(here < 0, here + 2, here - size[a:b] + 2)
        return np.where(inside, codes[column][np.clip(np.arange(a, b) + d, 0, max(n_rows - 1, 0))], n + beyond)

    # the templates in turn, those of the first column apart, the others in groups by the columns that they read
    groups: list[list] = []
    for name, own in templates.items():
        columns = tuple(sorted({c for _, c in own}))
        if not groups or groups[-1][0] != columns:
            groups.append([columns, []])
        groups[-1][1].append((name, own))

    def window_column(own, a, b):
        used = sorted({cell for _, c in own for cell in c})
        parts = [(at(c, d, a, b), len(values[c]) + 4) for d, c in used]
        key = np.zeros(b - a, np.int64)
        for x, base in parts:
            key = key * base + x
        _, first, back = np.unique(key, return_index=True, return_inverse=True)
        word = {cell: [texts_of[cell[1]][i] for i in x[first].tolist()] for cell, (x, _) in zip(used, parts)}
        made = ["|".join(name + ":" + "/".join(word[c][k] for c in own_cells) for name, own_cells in own) for k in range(len(first))]
        return pa.array(made, pa.string()).take(pa.array(back))

    texts_of = [None if c == 0 else t.to_pylist() for c, t in enumerate(texts)]

    def made(a, b):
        pieces_, lead = [], ""
        shown: dict = {}
        for columns, own in groups:
            if columns != (0,):
                pieces_ += [lead, window_column(own, a, b)]
                lead = "|"
                continue
            for name, own_cells in own:
                lead += f"{name}:"
                for k, (d, c) in enumerate(own_cells):
                    if d not in shown:
                        shown[d] = texts[c].take(pa.array(at(c, d, a, b)))
                    pieces_ += [lead + ("/" if k else ""), shown[d]]
                    lead = ""
                lead = "|"
        return pc.binary_join_element_wise(*(pa.scalar(x) if isinstance(x, str) else x for x in pieces_), "")

    return made


# Entities


def spans(p: Piece, tags: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first token, size) of the spans of tags, where tags has 1 for B, 2 for I and 0 for O, and kind the type: a B with the I of its type that follow."""
    mark = np.ones(len(tags), bool)
    mark[1:] = (tags[1:] != 2) | (kind[1:] != kind[:-1]) | (tags[:-1] == 0)
    mark[p.off[:-1][p.counts > 0]] = True
    begins = np.flatnonzero(mark)
    sizes = np.diff(np.append(begins, len(tags)))
    kept = tags[begins] == 1
    return begins[kept], sizes[kept].astype(np.int32)
