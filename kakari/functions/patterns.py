"""Surface and part-of-speech patterns: alternatives, matched exactly or as prefixes, negated by a leading !."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Pattern:
    words: tuple[str, ...]
    negated: bool = False

    @classmethod
    def compile(cls, text: str) -> Pattern:
        negated, text = text[:1] == "!", text.removeprefix("!")
        grouped = len(text) >= 3 and text[0] == "(" and text[-1] == ")"
        return cls(tuple(text[1:-1].split("|")) if grouped else (text,), negated)

    def match(self, c: Column) -> Column:
        found = c.isin(list(self.words))
        return ~found if self.negated else found

    def prefix(self, c: Column) -> Column:
        found = F.lit(False)
        for word in self.words:
            found = found | F.startswith(c, F.lit(word))
        return ~found if self.negated else found

    def sql(self, c: str, prefix: bool = True) -> str:
        """The same test as SQL text."""
        quoted = ["'" + w.replace("'", "''") + "'" for w in self.words]
        found = " OR ".join(f"starts_with({c}, {w})" for w in quoted) if prefix else f"{c} IN ({', '.join(quoted)})"
        return f"NOT ({found})" if self.negated else f"({found})"


def any_of(*words: str) -> Pattern:
    return Pattern(words)


def none_of(*words: str) -> Pattern:
    return Pattern(words, True)


PARTICLE, AUXILIARY, SYMBOL, NOUN, VERB, SUFFIX = "助詞", "助動詞", "記号", "名詞", "動詞", "接尾辞"
BOUND = [f"{pos},{kind}" for kind in ("非自立", "接尾") for pos in (VERB, "形容詞")]
ENDINGS = [f"{SUFFIX},{pos}的" for pos in (VERB, "形容詞", "形状詞")]

PUNCTUATION = any_of("、", "。")
#: For texts in Latin script.
ASCII_PUNCTUATION = any_of(",", ".", ";", ":", "!", "?")
OPEN = any_of(*"(（‘“《「『［〈｛")
CLOSE = any_of(*")）’”》」』］〉｝")
CASE = any_of(PARTICLE)
DYNAMIC = any_of("接続詞", "連体詞", "副詞", PARTICLE)


@dataclass(frozen=True)
class PosSet:
    """How a tag set is read: levels for chunking and tagging, levels for selection, where the lemma is, head and function words."""

    name: str
    levels: int
    select_levels: int
    lemma: int
    lemma_from: int
    head: Pattern
    func: Pattern
    func_after_head: bool
    numeral: str


IPA = PosSet("IPA", 4, 4, 6, 8, none_of(PARTICLE, AUXILIARY, *BOUND, SYMBOL), any_of(PARTICLE, AUXILIARY, *BOUND), True, "名詞,数,")
UNIDIC = PosSet("UNIDIC", 4, 2, 6, 8, none_of(PARTICLE, AUXILIARY, *ENDINGS, "補助記号", SYMBOL, "空白"), any_of(PARTICLE, AUXILIARY, *ENDINGS), True, "名詞,数詞,")
JUMAN = PosSet("JUMAN", 2, 2, 4, 6, none_of("特殊", PARTICLE, "接尾辞"), none_of("特殊"), False, "名詞,数詞,")
POSSETS = {p.name: p for p in (IPA, UNIDIC, JUMAN)}


def posset(name: str | PosSet) -> PosSet:
    if isinstance(name, PosSet):
        return name
    try:
        return POSSETS[name.upper()]
    except KeyError:
        raise ValueError(f"unknown tag set: {name}") from None
