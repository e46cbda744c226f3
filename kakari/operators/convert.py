"""Corpora in other formats to layers."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kakari.functions.text import let

ENTITY_NAMES = "ORGANIZATION PERSON LOCATION ARTIFACT DATE TIME MONEY PERCENT".split()


def legacy_to_csv(line: Column) -> Column:
    """A TAB-separated tagger line, parts of speech joined by -, to surface TAB feature CSV [TAB entity tag]; EOS and chunk lines stay.

    Levels are filled up to four with *; empty conjugation fields become *.
    """

    def moved(c):
        at = lambda i: F.coalesce(F.get(c, F.lit(i)), F.lit(""))
        star = lambda x: F.when(x == "", "*").otherwise(x)
        levels = F.filter(F.split(at(3), "-"), lambda x: x != "")
        four = F.slice(F.concat(levels, F.array_repeat(F.lit("*"), 4)), 1, 4)
        return F.concat_ws("\t", at(0), F.concat_ws(",", F.array_join(four, ","), star(at(4)), star(at(5)), at(2), at(1)), at(6))

    return F.when(F.contains(line, F.lit("EOS")), "EOS").when(F.startswith(line, F.lit("*")), line).otherwise(let(F.split(line, "\t"), moved))


def blank_separated_to_csv(line: Column) -> Column:
    """A morpheme row with blanks (surface reading lemma pos sub type form) to surface TAB feature CSV; # lines become null, a lemma * becomes the surface."""

    def moved(c):
        at = lambda i: F.coalesce(F.get(c, F.lit(i)), F.lit(""))
        lemma = F.when(at(2) == "*", at(0)).otherwise(at(2))
        return F.concat(at(0), F.lit("\t"), F.concat_ws(",", at(3), at(4), at(5), at(6), lemma, at(1), F.lit("*")))

    return F.when(F.startswith(line, F.lit("#")), F.lit(None)).when(line == "EOS", "EOS").when(F.startswith(line, F.lit("*")), line).otherwise(let(F.split(F.trim(line), "[ \\t]+"), moved))


def legacy_line(line: str) -> str:
    """legacy_to_csv() for one line."""
    if "EOS" in line:
        return "EOS"
    if line.startswith("*"):
        return line
    c = line.split("\t")
    at = lambda i: c[i] if i < len(c) else ""
    levels = [x for x in at(3).split("-") if x] + ["*"] * 4
    return "\t".join([at(0), ",".join([*levels[:4], at(4) or "*", at(5) or "*", at(2), at(1)]), at(6)])


def blank_separated_line(line: str) -> str | None:
    """blank_separated_to_csv() for one line."""
    if line.startswith("#"):
        return None
    if line == "EOS":
        return "EOS"
    if line.startswith("*"):
        return line
    c = re.split("[ \\t]+", line.strip(" "))
    at = lambda i: c[i] if i < len(c) else ""
    return at(0) + "\t" + ",".join([at(3), at(4), at(5), at(6), at(0) if at(2) == "*" else at(2), at(1), "*"])


_TAG = "<(" + "|".join([*ENTITY_NAMES, "OPTIONAL"]) + ")[^>]*>(.+?)</\\1>"


def inline_spans(text: Column) -> Column:
    """struct(sentence, spans array<struct<begin,stop,category>>) of text with inline entity tags; OPTIONAL ones are taken out and dropped.

    Positions count the characters of the text without tags and blanks; a blank is put around every tagged piece, so that it is cut there.
    """
    cuts = F.split(text, "(?=<(?:" + "|".join([*ENTITY_NAMES, "OPTIONAL"]) + ")[^>]*>)")

    def piece(p):
        tagged = p.rlike("^" + _TAG)
        inner = F.regexp_extract(p, "^" + _TAG, 2)
        after = F.regexp_replace(p, "^" + _TAG, "")
        return F.struct(F.when(tagged, F.regexp_extract(p, "^" + _TAG, 1)).alias("kind"), F.when(tagged, inner).otherwise("").alias("inner"), F.when(tagged, after).otherwise(p).alias("after"))

    def built(pieces):
        sentence = F.array_join(F.transform(pieces, lambda x: F.concat(F.when(x["kind"].isNotNull(), F.concat(F.lit(" "), x["inner"], F.lit(" "))).otherwise(""), x["after"])), "")
        bare = lambda c: F.length(F.regexp_replace(c, "[ \\t]", ""))

        def step(acc, x):
            begin = acc["at"]
            stop = begin + bare(x["inner"])
            found = F.when(x["kind"].isNotNull() & (x["kind"] != "OPTIONAL"), F.array(F.struct(begin.alias("begin"), stop.alias("stop"), x["kind"].alias("category")))).otherwise(F.array().cast("array<struct<begin:int,stop:int,category:string>>"))
            return F.struct((stop + bare(x["after"])).alias("at"), F.concat(acc["spans"], found).alias("spans"))

        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,stop:int,category:string>>").alias("spans"))
        return F.struct(sentence.alias("sentence"), F.aggregate(pieces, start, step, lambda s: s["spans"]).alias("spans"))

    return let(F.transform(cuts, piece), built)


def span_tags(surfaces: Column, spans: Column) -> Column:
    """IOB2 tags of tokens by the spans over their characters: B where a span begins with the token, I inside it, else O."""

    def placed(ends):
        def tag(s, i):
            begin = F.get(ends, i) - F.length(s)
            inside = F.element_at(F.filter(spans, lambda x: (x["begin"] <= begin) & (begin < x["stop"])), 1)
            return F.when(F.get(F.filter(spans, lambda x: (x["begin"] <= begin) & (begin < x["stop"])), F.lit(0)).isNull(), "O").when(inside["begin"] == begin, F.concat(F.lit("B-"), inside["category"])).otherwise(F.concat(F.lit("I-"), inside["category"]))

        return F.transform(surfaces, tag)

    return let(running(F.transform(surfaces, lambda s: F.length(s))), placed)


def running(sizes: Column) -> Column:
    """Running sums of an array of ints."""
    return F.aggregate(sizes, F.array().cast("array<int>"), lambda acc, x: F.concat(acc, F.array((F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + x).cast("int"))))


def realign(chunks: DataFrame, morphs: DataFrame, *keys: str) -> DataFrame:
    """Chunks of one segmentation over the tokens of another: both grow until their lengths agree.

    chunks holds (keys, chunk_id, length, link, kind), morphs (keys, tok_id, length). Rows: keys, new_id, link, kind, src (the last
    of the merged chunks), first_tok, n_tokens. A link leads to the first new chunk whose src isn't before the old head, -1 stays.
    The joins are on equal character offsets within a sentence.
    """
    from pyspark.sql import Window

    so_far = Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    c = chunks.withColumn("stop", F.sum("length").over(so_far.orderBy("chunk_id")))
    m = morphs.withColumn("stop", F.sum("length").over(so_far.orderBy("tok_id")))
    both = c.select(*keys, "stop", "chunk_id", "link", "kind").join(m.select(*keys, "stop", "tok_id"), [*keys, "stop"])
    # several chunks or tokens of length 0 may end at one place; the last counts
    last = both.groupBy(*keys, "stop").agg(F.max(F.struct("chunk_id", "link", "kind")).alias("c"), F.max("tok_id").alias("tok_id"))
    whole = last.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("stop", "c", "tok_id"))).alias("r"))

    def one(x, i, r):
        before = F.when(i > 0, F.get(r, i - 1)["tok_id"]).otherwise(-1)
        first = F.array_position(F.transform(r, lambda y: y["c"]["chunk_id"] >= x["c"]["link"]), F.lit(True)).cast("int")
        link = F.when(x["c"]["link"] == -1, -1).otherwise(first - 1)
        return F.struct(i.alias("new_id"), link.alias("link"), x["c"]["kind"].alias("kind"), x["c"]["chunk_id"].alias("src"), (before + 1).alias("first_tok"), (x["tok_id"] - before).alias("n_tokens"))

    return whole.select(*keys, F.explode(let(F.col("r"), lambda r: F.transform(r, lambda x, i: one(x, i, r)))).alias("x")).select(*keys, "x.*")


def _stops(sent: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Where each piece ends in its line, with the line in the upper half; lines follow each other."""
    total = np.cumsum(length)
    first = np.flatnonzero(np.diff(sent, prepend=-1)) if len(sent) else np.zeros(0, np.int64)
    before = np.repeat(total[first] - length[first], np.diff(np.append(first, len(sent))))
    return (sent.astype(np.int64) << 32) + total - before


def realign_lines(chunks: tuple, morphs: tuple) -> tuple[np.ndarray, ...]:
    """realign() for whole batches: chunks (line, chunk_id, length, link) and morphs (line, tok_id, length) of one batch, in order.

    Gives line, new_id, link, src, first_tok, n_tokens.
    """
    (sent, ids, length, was), (m_sent, toks, m_length) = chunks, morphs
    stops, m_stops = _stops(sent, length), _stops(m_sent, m_length)
    # several chunks or tokens of length 0 may end at one place; the last counts
    last, m_last = (np.flatnonzero(np.append(np.diff(x) != 0, True)[: len(x)]) for x in (stops, m_stops))
    _, i, j = np.intersect1d(stops[last], m_stops[m_last], assume_unique=True, return_indices=True)
    i, j = last[i], m_last[j]
    sent, src, tok, was = sent[i].astype(np.int64), ids[i], toks[j], was[i]
    first = np.flatnonzero(np.diff(sent, prepend=-1))
    begin = np.repeat(first, np.diff(np.append(first, len(sent))))
    before = np.full(len(tok), -1, np.int64)
    before[1:] = np.where(sent[1:] == sent[:-1], tok[:-1], -1)
    # the first new chunk of the line whose src isn't before the old head
    keys = (sent << 32) + src
    found = np.searchsorted(keys, (sent << 32) + was)
    inside = (found < len(sent)) & (sent[np.minimum(found, max(len(sent) - 1, 0))] == sent) if len(sent) else np.zeros(0, bool)
    link = np.where((was == -1) | ~inside, -1, found - begin)
    return sent, *(x.astype(np.int32) for x in (np.arange(len(sent)) - begin, link, src, before + 1, tok - before))
