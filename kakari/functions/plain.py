"""The rules of kakari.functions.text, patterns, tokens and chunks for single words, as plain functions.

They serve the batch stages, which ask once for each distinct word; the column functions say the same for rows.
"""

from __future__ import annotations

import re
from functools import cache

from kakari.functions.patterns import CASE, CLOSE, DYNAMIC, NOUN, OPEN, PARTICLE, SYMBOL, VERB, Pattern, PosSet
from kakari.functions.text import ALPHA, BLANK, CAPALPHA, CLASSES, HYPHEN, ODD, OTHER, PAIRS, SINGLES
from kakari.operators.tokens import FUNCTION_WORDS, VERBAL

_ODD, _CHANGED, _LETTER = re.compile(f"[{ODD}]"), re.compile(f"[{ODD} 　]"), re.compile("[A-Za-zÀ-ɏ]")
_DIGITS, _ASCII = re.compile("[0-9]+"), re.compile("[\\x00-\\x7F]")
_FUNCTION, _SINGLES = frozenset(FUNCTION_WORDS), str.maketrans(SINGLES)


def surface(w: str) -> str:
    return w


def norm(w: str) -> str:
    if not _CHANGED.search(w):
        return w
    if _ODD.search(w):
        for key, to in PAIRS.items():
            w = w.replace(key, to)
        w = w.translate(_SINGLES)
    return w.replace("　", BLANK).replace(" ", BLANK)


def csv_escape(x: str) -> str:
    return '"' + x.replace('"', '""') + '"' if "," in x or '"' in x else x


NUMERAL, CASE_PARTICLE, OTHER_SIGN, COMMON, INFLECTED = f"{NOUN},数,*,*,*,*", f"{PARTICLE},格助詞,一般,*,*,*", f"{SYMBOL},一般,*,*,*,*", f"{NOUN},一般,*,*,*,*", f"{VERB},自立,*,*,一段,基本形"
_BRACKETS = {x: f"{SYMBOL},括弧開,*,*,*,*" for x in "([{<"} | {x: f"{SYMBOL},括弧閉,*,*,*,*" for x in ")]}>"}


def klass(w: str) -> str:
    """The fields of a word's feature that it shares with others: four levels, conjugation type and form."""
    if w.lower() in _FUNCTION:
        return CASE_PARTICLE
    if _LETTER.match(w):
        return INFLECTED if len(w) > 4 and w.endswith(VERBAL) else COMMON
    return NUMERAL if _DIGITS.fullmatch(w) else _BRACKETS.get(w, OTHER_SIGN)


def feature(w: str) -> str:
    own = klass(w)
    if own is NUMERAL:
        return f"{own},{w},{w}"
    if own.startswith(SYMBOL):
        quoted = csv_escape(w)
        return f"{own},{quoted},{quoted}"
    return f"{own},{w.lower()},{w}"


_FIELD = re.compile('[ \\t]*("[^"]*(?:""[^"]*)*"?[^,]*|[^,]*),')
_QUOTED = re.compile('"([^"]*(?:""[^"]*)*)')


def split_csv(line: str) -> list[str]:
    """Fields of a CSV line: leading blanks of a field are skipped, "" in quotes stands for ", what follows the closing quote is ignored."""
    if line == "":
        return []
    if not ('"' in line or " " in line or "\t" in line or line.endswith(",")):
        return line.split(",")
    parts = [m.group(0) for m in _FIELD.finditer(line + ",")]
    if parts[-1] == ",":
        parts.pop()
    bare = [x[:-1].lstrip(" \t") for x in parts]
    return [_QUOTED.match(x).group(1).replace('""', '"') if x.startswith('"') else x for x in bare]


def fields(w: str) -> list[str]:
    return split_csv(feature(w))


def pos_fields(features: list[str], n: int) -> list[str]:
    first = features[:n]
    return first[: first.index("*")] if "*" in first else first


def field_at(features: list[str], n: int) -> str | None:
    """The field at position n from 0; None where it is absent or *."""
    return features[n] if n < len(features) and features[n] != "*" else None


@cache
def concat_pos(n: int):
    """word -> the first n fields up to the first *, joined by hyphens; n is within what words share."""
    of = cache(lambda own: "-".join(pos_fields(own.split(","), n)))
    return lambda w: of(klass(w))


def csv_join(features: list[str]) -> str:
    joined = ",".join(features)
    # most have nothing to escape
    return ",".join(map(csv_escape, features)) if '"' in joined or joined.count(",") != len(features) - 1 else joined


def width(w: str) -> int:
    """Columns on a terminal: 1 for an ASCII character, 2 for any other."""
    return 2 * len(w) - len(_ASCII.findall(w))


class _CharClasses(dict):
    def __missing__(self, c: str) -> int:
        p = ord(c)
        k = next((k for k, ranges in CLASSES.items() if any(a <= p <= b for a, b in ranges)), OTHER)
        if len(self) < 1 << 16:
            self[c] = k
        return k


_CHAR = _CharClasses()


def char_shape(w: str) -> str:
    codes = [_CHAR[c] for c in w]
    if not codes:
        return "M-1"
    if len(codes) == 1:
        return f"S{codes[0]}"
    if codes[0] == CAPALPHA and codes.count(ALPHA) == len(codes) - 1:
        return "C"
    if codes.count(codes[0]) == len(codes):
        return f"M{codes[0]}"
    kept = codes[:1] + [k for k in codes[1:] if k != HYPHEN]
    runs = [k for i, k in enumerate(kept) if not i or k != kept[i - 1]]
    return f"M{runs[0]}" if len(runs) == 1 else f"T{runs[-2]}-{runs[-1]}"


def shape_of_norm(w: str) -> str:
    return char_shape(norm(w))


def prefixed(p: Pattern, x: str) -> bool:
    return x.startswith(p.words) != p.negated


def matched(p: Pattern, x: str) -> bool:
    return (x in p.words) != p.negated


def is_case(own: str) -> bool:
    """Of klass(): whether it is that of a particle."""
    return prefixed(CASE, own)


@cache
def has_prefix(p: Pattern):
    """klass -> whether its feature has a prefix of the pattern."""
    return lambda own: prefixed(p, own)


@cache
def is_numeral(ps: PosSet):
    return lambda own: own.startswith(ps.numeral)


@cache
def sign_features(punctuation: Pattern):
    """word -> what punctuation, brackets and particles anywhere in a chunk add."""

    def made(w):
        n, out = norm(w), []
        if matched(punctuation, n):
            out += ["GPUNC:" + n, "FPUNC:" + n]
        if matched(OPEN, n):
            out += ["GOB:" + n, "FOB:" + n, "GOB:1", "FOB:1"]
        if matched(CLOSE, n):
            out += ["GCB:" + n, "FCB:" + n, "GCB:1", "FCB:1"]
        if is_case(klass(w)):
            out.append("FCASE:" + n)
        return out

    return made


@cache
def token_features(header: str, ps: PosSet):
    """klass -> what a token's features have besides its surface: <header>P<k>: levels up to the first *, <header>F: conjugation form where there is one."""

    def made(own):
        form = field_at(own.split(","), ps.select_levels + 1)
        return [*(f"{header}P{k}:{x}" for k, x in enumerate(pos_fields(own.split(","), ps.select_levels))), *([] if form is None else [f"{header}F:{form}"])]

    return made


@cache
def seen_feature(ps: PosSet):
    """klass -> the one feature that a chunk's heads see of its function word; None where that is its surface."""

    def made(own):
        if prefixed(DYNAMIC, own):
            return None
        form = field_at(own.split(","), ps.select_levels + 1)
        return "A:" + (form if form is not None else "-".join(pos_fields(own.split(","), ps.select_levels)))

    return made


def token_line(w: str) -> str:
    return f"{w}\t{feature(w)}\n"


def xml_escape(x: str) -> str:
    for sign, name in (("&", "&amp;"), ('"', "&quot;"), ("'", "&apos;"), ("<", "&lt;"), (">", "&gt;")):
        x = x.replace(sign, name)
    return x
