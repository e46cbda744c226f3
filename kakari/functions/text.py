"""Column functions on strings. All stay in the JVM; a null argument gives null unless said otherwise."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

VOICED, SEMI = "ﾞ", "ﾟ"
#: Half-width kana with a following voice mark become one full-width letter.
PAIRS = {k + m: unicodedata.normalize("NFKC", k + m) for m, row in ((VOICED, "ｳｶｷｸｹｺｻｼｽｾｿﾀﾁﾂﾃﾄﾊﾋﾌﾍﾎ"), (SEMI, "ﾊﾋﾌﾍﾎ")) for k in row}
#: Full-width signs that are left as they are.
KEPT = frozenset("，．／［］＼＿＂＇")
#: One character for one: half-width kana and marks, full-width ASCII, and a few signs.
SINGLES = {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in range(0xFF62, 0xFF9E)}
SINGLES |= {VOICED: "゛", SEMI: "゜"}
SINGLES |= {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F) if chr(c) not in KEPT}
SINGLES |= {"”": '"', "’": "'", "￥": "\\", "―": "-"}
BLANK = "___"
#: Characters without which, and without blanks, a text is normal already.
ODD = "―’”＀-￯"


def let(value: Column, body) -> Column:
    """body(value) with value computed once, also inside lambdas, where the optimiser would compute it for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def normalize(c: Column) -> Column:
    """Half-width kana to full width, full-width ASCII to half, a blank (narrow or wide) to ___; the longest key wins."""
    wide = c
    for key, to in PAIRS.items():
        wide = F.replace(wide, F.lit(key), F.lit(to))
    wide = F.translate(wide, "".join(SINGLES), "".join(SINGLES.values()))
    plain = F.when(c.rlike(f"[{ODD}]"), wide).otherwise(c)
    return F.when(plain.rlike("[ 　]"), F.replace(F.replace(plain, F.lit("　"), F.lit(BLANK)), F.lit(" "), F.lit(BLANK))).otherwise(plain)


def code_points(c: Column) -> Column:
    """The code point of each character; 0 for those beyond the basic plane. An empty string has none."""
    return F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: let(F.ascii(x), lambda p: F.when(p > 0xFFFF, 0).otherwise(p)))


CHARSETS = {"utf8": "UTF-8", "utf-8": "UTF-8", "utf_8": "UTF-8", "euc": "EUC-JP", "euc-jp": "EUC-JP", "euc_jp": "EUC-JP", "eucjp": "EUC-JP", "ujis": "EUC-JP", "sjis": "MS932", "shift-jis": "MS932", "shift_jis": "MS932", "cp932": "MS932", "ms932": "MS932", "ascii": "US-ASCII", "us-ascii": "US-ASCII"}


def charset(name: str) -> str:
    """The Java name of a charset alias, whatever its case; an unknown name raises ValueError."""
    try:
        return CHARSETS[name.strip().lower()]
    except KeyError:
        raise ValueError(f"unknown charset: {name}") from None


def decode(c: Column, name: str) -> Column:
    """Bytes to text. EUC-JP and MS932 need spark.sql.legacy.javaCharsets=true in the session."""
    return F.decode(c, charset(name))


def recode(c: Column, source: str, target: str) -> Column:
    """Bytes of one charset to bytes of another."""
    return F.encode(decode(c, source), charset(target))


def display_width(c: Column) -> Column:
    """Columns on a terminal: 1 for an ASCII character, 2 for any other."""
    return 2 * F.char_length(c) - F.char_length(F.regexp_replace(c, "[^\\x00-\\x7F]", ""))


OTHER, DIGIT, ALPHA, CAPALPHA, HIRAGANA, KATAKANA, HAN, HYPHEN = range(8)
#: Character classes by ranges of code points; what lies in none is OTHER. The table is this engine's own.
CLASSES = {
    DIGIT: [(48, 57)],
    ALPHA: [(97, 122), (0xDF, 0xF6), (0xF8, 0x24F)],
    CAPALPHA: [(65, 90), (0xC0, 0xD6), (0xD8, 0xDE)],
    HIRAGANA: [(0x3041, 0x309F)],
    KATAKANA: [(0x30A0, 0x30FB), (0x30FD, 0x30FF), (0x31F0, 0x31FF)],
    HAN: [(0x3005, 0x3007), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF)],
    HYPHEN: [(45, 45), (0x2010, 0x2015), (0x30FC, 0x30FC)],
}
_MARK = {k: chr(0xE100 + k) for k in CLASSES}


def class_codes(c: Column) -> Column:
    """A string of digits, one for each character: its class."""
    for k, ranges in CLASSES.items():
        c = F.regexp_replace(c, "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges) + "]", _MARK[k])
    marks = "".join(_MARK.values())
    return F.translate(F.regexp_replace(c, f"[^{marks}]", str(OTHER)), marks, "".join(map(str, CLASSES)))


def char_shape(c: Column) -> Column:
    """C for a capital and small letters, S<class> for one character, M<class> for one class, T<a>-<b> for the last change of class.

    Hyphens after the first character are looked through. The empty string has M-1.
    """

    def shaped(codes):
        runs = F.regexp_replace(F.concat(F.left(codes, F.lit(1)), F.replace(F.substring(codes, 2, 1 << 30), F.lit(str(HYPHEN)), F.lit(""))), "(.)\\1+", "$1")
        return (
            F.when(codes == "", "M-1")
            .when(codes.rlike(f"^{CAPALPHA}{ALPHA}+$"), "C")
            .when(F.length(codes) == 1, F.concat(F.lit("S"), codes))
            .otherwise(let(runs, lambda r: F.when(F.length(r) == 1, F.concat(F.lit("M"), r)).otherwise(F.concat(F.lit("T"), F.substring(F.right(r, F.lit(2)), 1, 1), F.lit("-"), F.right(r, F.lit(1))))))
        )

    return let(class_codes(c), shaped)


def split_csv(c: Column) -> Column:
    """Fields of a CSV line: leading blanks of a field are skipped, "" in quotes stands for ", what follows the closing quote is ignored.

    A comma at the very end opens no field, and an empty line has none.
    """
    parts = F.regexp_extract_all(F.concat(c, F.lit(",")), F.lit('[ \\t]*(?:"[^"]*(?:""[^"]*)*"?[^,]*|[^,]*),'), F.lit(0))
    kept = F.when(F.element_at(parts, -1) == ",", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)

    def field(x):
        bare = F.regexp_replace(F.left(x, F.length(x) - 1), "^[ \\t]+", "")
        return F.when(F.startswith(bare, F.lit('"')), F.replace(F.regexp_extract(bare, '^"([^"]*(?:""[^"]*)*)', 1), F.lit('""'), F.lit('"'))).otherwise(bare)

    signs = [F.contains(c, F.lit(x)) for x in ('"', " ", "\t")]
    simple = ~(signs[0] | signs[1] | signs[2] | F.endswith(c, F.lit(",")))  # most lines; byte searches are far cheaper than patterns
    return F.when(c == "", F.array().cast("array<string>")).when(simple, F.split(c, ",")).otherwise(F.transform(kept, field))


def split_max(c: Column, delimiter: str, most: int) -> Column:
    """Pieces between single-character delimiters, the first `most` of them; the rest is dropped."""
    return F.slice(F.split(c, _quoted(delimiter)), 1, most)


def split_collapse(c: Column, delimiters: str) -> Column:
    """Pieces between runs of any of the delimiters, without empty ones."""
    return F.filter(F.split(c, _quoted(delimiters)), lambda x: x != "")


def _quoted(characters: str) -> str:
    return "[" + "".join("\\" + x if x in "\\]^-[&" else x for x in characters) + "]"


def feature_at(features: Column, n: int) -> Column:
    """The field at position n from 0; null where it is absent or *."""
    return F.nullif(F.get(features, F.lit(n)), F.lit("*"))


def pos_fields(features: Column, n: int) -> Column:
    """The first n fields up to the first *."""
    first = F.slice(features, 1, n)
    return F.when(F.array_contains(first, "*"), F.slice(first, F.lit(1), F.array_position(first, F.lit("*")).cast("int") - 1)).otherwise(first)


def concat_pos(features: Column, n: int) -> Column:
    """The first n fields up to the first *, joined by hyphens."""
    return F.array_join(pos_fields(features, n), "-")


def ascii_lower(c: Column) -> Column:
    """A to Z lowered, other letters as they are."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def replace_first(c: Column, old: str, new: str) -> Column:
    """The first occurrence of old replaced; c itself where there is none."""
    at = F.locate(old, c)
    return F.when(at > 0, F.concat(F.left(c, at - 1), F.lit(new), F.substring(c, at + len(old), F.length(c)))).otherwise(c)


def xml_escape(c: Column) -> Column:
    for sign, name in (("&", "&amp;"), ('"', "&quot;"), ("'", "&apos;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(sign), F.lit(name))
    return c


def csv_escape(c: Column) -> Column:
    """Quoted, with quotes doubled, where it holds a comma or a quote."""
    return F.when(c.rlike('[,"]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def csv_join(features: Column) -> Column:
    """The fields as one CSV line; nulls become *."""
    return F.array_join(F.transform(features, lambda x: F.coalesce(csv_escape(x), F.lit("*"))), ",")


def unescape(c: Column) -> Column:
    """Backslash escapes 0 a b t n v f r s and a doubled backslash decoded; other sequences are left as they are."""
    held = F.replace(c, F.lit("\\\\"), F.lit(""))
    for sign, to in (("0", "\0"), ("a", "\a"), ("b", "\b"), ("t", "\t"), ("n", "\n"), ("v", "\v"), ("f", "\f"), ("r", "\r"), ("s", " ")):
        held = F.replace(held, F.lit("\\" + sign), F.lit(to))
    return F.replace(held, F.lit(""), F.lit("\\"))


def score_text(c: Column) -> Column:
    """A score with six decimals."""
    return F.format_string("%.6f", c.cast("double"))


def to_number(c: Column, kind: str = "int") -> Column:
    """The number a text holds, 0 where it holds none."""
    return F.coalesce(c.try_cast(kind), F.lit(0).cast(kind))


def pair_key(a: Column, b: Column) -> Column:
    """Two non-negative ints in one long."""
    return F.shiftleft(a.cast("long"), 32).bitwiseOR(b.cast("long"))


def unpack_pair(key: Column) -> tuple[Column, Column]:
    return F.shiftright(key, 32).cast("int"), key.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")


def common(a: Column, b: Column) -> Column:
    """How many elements two sets of ids share: their dot product as sparse binary vectors."""
    return F.size(F.array_intersect(a, b))
