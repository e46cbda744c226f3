"""Named entities: rows for a sequence model, repair of its tags, and spans of tags."""

from __future__ import annotations

from itertools import accumulate

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kakari.functions.patterns import PosSet, posset
from kakari.functions.text import char_shape, concat_pos, let


def numeral_tail(tokens: Column, ps: PosSet) -> Column:
    """Marks of the tokens that continue a run of numerals: the second of the run and all after it."""
    numeral = F.transform(tokens, lambda t: F.startswith(t["feature"], F.lit(ps.numeral)))
    return let(numeral, lambda n: F.transform(n, lambda x, i: (i > 0) & x & F.when(i > 0, F.get(n, i - 1)).otherwise(False)))


def entity_rows(tokens: Column, tags: str | PosSet = "IPA") -> Column:
    """array<struct<i,surface,shape,pos,ne>>: what the tagger sees, one row for a run of numerals (its first token)."""
    ps = posset(tags)

    def rows(tail):
        kept = F.transform(tokens, lambda t, i: F.when(~F.get(tail, i), F.struct(i.alias("i"), t["norm"].alias("surface"), char_shape(t["norm"]).alias("shape"), concat_pos(t["features"], ps.levels).alias("pos"), t["ne"].alias("ne"))))
        return F.filter(kept, lambda x: x.isNotNull())

    return let(let(tokens, lambda ts: numeral_tail(ts, ps)), rows)


def repair(tags: Column, tail: Column | None = None, compat: bool = False) -> Column:
    """Sound IOB2: a first I becomes B, an I after an I of another type becomes B; compares with the repaired tag before it.

    With tail (marks of numeral runs), a marked token takes I with the type before it, or O. compat compares types from their second
    letter on, as the tagger this follows did.
    """
    skip = 4 if compat else 3

    def step(acc, x):
        previous, first = F.element_at(acc, -1), F.size(acc) == 0
        raw = x["tag"] if tail is None else F.when(x["tail"] & ~first, F.when(F.startswith(previous, F.lit("O")), previous).otherwise(F.concat(F.lit("I"), F.substring(previous, 2, 1 << 30)))).otherwise(x["tag"])

        def fixed(t):
            clash = F.startswith(previous, F.lit("I")) & (F.substring(t, skip, 1 << 30) != F.substring(previous, skip, 1 << 30)) & (F.length(t) >= 3) & (F.length(previous) >= 3)
            return F.when(F.startswith(t, F.lit("I")) & (first | F.coalesce(clash, F.lit(False))), F.concat(F.lit("B"), F.substring(t, 2, 1 << 30))).otherwise(t)

        return let(acc, lambda a: F.concat(a, F.array(let(raw, fixed))))

    rows = F.transform(tags, lambda t: F.struct(t.alias("tag"), F.lit(False).alias("tail"))) if tail is None else F.transform(F.arrays_zip(tags.alias("tag"), tail.alias("tail")), lambda x: F.struct(x["tag"].alias("tag"), x["tail"].alias("tail")))
    return F.aggregate(rows, F.array().cast("array<string>"), step)


def repair_lines(tags: np.ndarray, names: tuple[str, ...], off: np.ndarray) -> np.ndarray:
    """repair() for whole batches: tags are numbers in names, lines lie from one place in off to the next. names must hold the B of every I."""

    def fixed(previous, t):
        clash = previous is not None and previous[:1] == "I" and len(t) >= 3 and len(previous) >= 3 and t[2:] != previous[2:]
        return "B" + t[1:] if t[:1] == "I" and (previous is None or clash) else t

    number = {n: i for i, n in enumerate(names)}
    at_start = [number[fixed(None, t)] for t in names]
    steps = [[number[fixed(previous, t)] for t in names] + at_start for previous in names]
    given = np.array(tags, np.int64)
    given[off[:-1][np.diff(off) > 0]] += len(names)  # the first of a line
    return np.fromiter(accumulate(given.tolist(), lambda s, t: steps[s][t], initial=0), np.int64, len(given) + 1)[1:]


def spread(decoded: Column, tail: Column) -> Column:
    """Tags for all tokens from those of the tagger's rows: a token that continues a numeral run takes its row's tag, for repair() to set."""

    def at(marks):
        return F.transform(marks, lambda m, i: F.get(decoded, i - F.size(F.filter(F.slice(marks, F.lit(1), i + 1), lambda x: x))))

    return let(tail, at)


def set_tags(df: DataFrame, tags: Column) -> DataFrame:
    """df with the entity tags of its tokens."""
    return df.withColumn("tokens", let(F.struct(F.col("tokens"), tags.alias("tags")), lambda x: F.transform(x["tokens"], lambda t, i: t.withField("ne", F.get(x["tags"], i)))))


def within_chunks(tags: Column, chunks: Column) -> Column:
    """Tags under the constraint that no entity spans chunks: an I at the first token of a chunk becomes B. An operator of this engine's own."""
    starts = F.transform(chunks, lambda c: c["token_pos"])
    return let(starts, lambda s: F.transform(tags, lambda t, i: F.when(F.startswith(t, F.lit("I")) & F.array_contains(s, i), F.concat(F.lit("B"), F.substring(t, 2, 1 << 30))).otherwise(t)))


def spans(tags: Column) -> Column:
    """array<struct<category,start,size>> of IOB2 tags: a B with the tags I of its type that follow. A stray I begins none."""
    def extended(begins):
        def one(b):
            tail = F.slice(tags, b + 2, F.size(tags))
            wanted = F.concat(F.lit("I-"), F.substring(F.get(tags, b), 3, 1 << 30))
            stop = F.array_position(F.transform(tail, lambda t: F.coalesce(t == wanted, F.lit(False))), F.lit(False))
            size = F.when(stop > 0, stop).otherwise(F.size(tail) + 1)
            return F.struct(F.substring(F.get(tags, b), 3, 1 << 30).alias("category"), b.alias("start"), size.cast("int").alias("size"))

        return F.transform(begins, one)

    return let(F.filter(F.transform(tags, lambda t, i: F.when(F.startswith(t, F.lit("B")), i)), lambda x: x.isNotNull()), extended)
