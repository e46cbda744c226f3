"""Chunks (layer 2) from marks on the tokens, and heads, function words and features of chunks (layer 3).

Everything here is an expression over the arrays of one row, so no stage shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kakari.functions.patterns import CASE, CLOSE, DYNAMIC, OPEN, PUNCTUATION, Pattern, PosSet, posset
from kakari.functions.text import concat_pos, feature_at, let, pos_fields
from kakari.schema import chunk, no_strings, tokens_of

MAX_FEATURES = 128


def after_particle(tokens: Column) -> Column:
    """Marks of a rule: a chunk begins after a particle that no particle follows."""
    return F.transform(tokens, lambda t, i: (i == 0) | (~CASE.prefix(t["feature"]) & F.when(i > 0, CASE.prefix(F.get(tokens, i - 1)["feature"])).otherwise(False)))


def spans(begins: Column) -> Column:
    """Chunks without links from marks, one for each token; the first token begins one whatever its mark."""

    def built(x):
        starts, n = x["starts"], x["n"]
        return F.transform(starts, lambda s, k: chunk(F.lit(-1), F.lit(0), F.lit(0), s, F.coalesce(F.get(starts, k + 1), n) - s, F.lit(0.0), no_strings()))

    starts = F.filter(F.transform(begins, lambda b, i: F.when((i == 0) | b, i)), lambda x: x.isNotNull())
    return let(F.struct(starts.alias("starts"), F.size(begins).alias("n")), built)


def chunk_by(df: DataFrame, begins: Column | None = None) -> DataFrame:
    """df with `chunks`: from marks (array<boolean>), or by after_particle(). A sentence without tokens has none."""
    marks = let(F.col("tokens"), after_particle) if begins is None else begins
    return df.withColumn("chunks", let(marks, spans))


def head_func(tokens: Column, ps: PosSet) -> Column:
    """struct(head, func): offsets of the last head word and the last function word of a chunk's tokens, 0 where there is none."""
    last = lambda pattern: F.coalesce(F.array_max(F.transform(tokens, lambda t, i: F.when(pattern.prefix(t["feature"]), i))), F.lit(0))
    found = F.struct(last(ps.head).alias("head"), last(ps.func).alias("func"))
    return let(found, lambda x: F.struct(x["head"].alias("head"), F.greatest(x["head"], x["func"]).alias("func"))) if ps.func_after_head else found


def token_features(header: str, t: Column, ps: PosSet) -> Column:
    """<header>S: surface, <header>P<k>: levels up to the first *, <header>F: conjugation form where there is one."""
    form = feature_at(t["features"], ps.select_levels + 1)
    return F.concat(
        F.array(F.concat(F.lit(f"{header}S:"), t["norm"])),
        F.transform(pos_fields(t["features"], ps.select_levels), lambda x, k: F.concat(F.lit(f"{header}P"), k.cast("string"), F.lit(":"), x)),
        F.when(form.isNull(), no_strings()).otherwise(F.array(F.concat(F.lit(f"{header}F:"), form))),
    )


def sign_features(t: Column, punctuation: Pattern) -> Column:
    """What punctuation, brackets and particles anywhere in a chunk add."""
    said = lambda *names: F.array(*(F.concat(F.lit(n), t["norm"]) if n.endswith(":") else F.lit(n) for n in names))
    rules = [(punctuation.match(t["norm"]), ("GPUNC:", "FPUNC:")), (OPEN.match(t["norm"]), ("GOB:", "FOB:", "GOB:1", "FOB:1")), (CLOSE.match(t["norm"]), ("GCB:", "FCB:", "GCB:1", "FCB:1")), (CASE.prefix(t["feature"]), ("FCASE:",))]
    return F.concat(*(F.when(test, said(*names)).otherwise(no_strings()) for test, names in rules))


def chunk_features(tokens: Column, head: Column, func: Column, i: Column, n: Column, ps: PosSet, punctuation: Pattern = PUNCTUATION) -> Column:
    """All features of a chunk, the i-th of n: signs, head/function/left/right token, context, position, and the one its heads see."""

    def made(h, f, left, right):
        case = CASE.prefix(f["feature"])
        seen = F.when(DYNAMIC.prefix(f["feature"]), f["norm"]).otherwise(F.coalesce(feature_at(f["features"], ps.select_levels + 1), concat_pos(f["features"], ps.select_levels)))
        only = lambda test, x: F.when(test, F.array(x)).otherwise(no_strings())
        return F.concat(
            F.flatten(F.transform(tokens, lambda t: sign_features(t, punctuation))),
            *(token_features(header, t, ps) for header, t in (("FH", h), ("FF", f), ("FL", left), ("FR", right))),
            F.array(*(F.concat(F.lit(name), t["norm"]) for name, t in (("LF:", f), ("RL:", left), ("RH:", h), ("RF:", f)))),
            only(i == 0, F.lit("FBOS:1")),
            only(i == n - 1, F.lit("FEOS:1")),
            only(case, F.concat(F.lit("GCASE:"), f["norm"])),
            F.array(F.concat(F.lit("A:"), seen)),
        )

    whole = let(F.get(tokens, head), lambda h: let(F.get(tokens, func), lambda f: made(h, f, F.element_at(tokens, 1), F.element_at(tokens, -1))))
    # fields with blanks in them come apart, as features are written with blanks between them
    return F.slice(let(whole, lambda x: F.when(F.exists(x, lambda y: F.contains(y, F.lit(" "))), F.split(F.array_join(x, " "), " ")).otherwise(x)), 1, MAX_FEATURES)


def select(df: DataFrame, tags: str | PosSet = "IPA", punctuation: Pattern = PUNCTUATION, features=None) -> DataFrame:
    """df with head_pos, func_pos and features set in each chunk (layer 3); the given links stay.

    features(tokens, chunk, i, n) -> Column (array<string>) stands in for chunk_features() where a caller has rules of its own.
    """
    ps = posset(tags)

    def every(row):
        tokens, chunks = row["tokens"], row["chunks"]

        def one(c, i):
            def known(own):
                def with_head(x):
                    made = features(own, c, i, F.size(chunks)) if features else chunk_features(own, x["head"], x["func"], i, F.size(chunks), ps, punctuation)
                    return chunk(c["link"], x["head"], x["func"], c["token_pos"], c["token_size"], c["score"], made)

                return let(head_func(own, ps), with_head)

            return let(tokens_of(c, tokens), known)

        return F.transform(chunks, one)

    return df.withColumn("chunks", let(F.struct("tokens", "chunks"), every))
