"""Features of a candidate link from chunk src to a later chunk dst."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kakari.functions.text import let
from kakari.schema import no_strings

ROLES = "FLRGA"


def role(features: Column, letter: str) -> Column:
    return F.filter(features, lambda x: F.startswith(x, F.lit(letter)))


def relabel(features: Column, letter: str) -> Column:
    return F.transform(features, lambda x: F.concat(F.lit(letter), F.substring(x, 2, 1 << 30)))


def unknown_roles(features: Column) -> Column:
    """How many features begin with a letter that has no role; they are ignored."""
    return F.size(F.filter(features, lambda x: ~F.left(x, F.lit(1)).isin(*ROLES)))


def distance(src: Column, dst: Column) -> Column:
    gap = dst - src
    return F.when(gap == 1, "DIST:1").when(gap.between(2, 5), "DIST:2-5").otherwise("DIST:6-")


def gap_features(chunks: Column, src: Column, dst: Column) -> Column:
    """Gap features of the chunks strictly between, and the one bracket state: none, open, close or both."""
    between = F.when(dst - src > 1, F.flatten(F.transform(F.slice(chunks, src + 2, F.greatest(dst - src - 1, F.lit(0))), lambda c: role(c["features"], "G")))).otherwise(no_strings())

    def made(g):
        opened, closed = F.array_contains(g, "GOB:1"), F.array_contains(g, "GCB:1")
        state = F.when(opened & closed, "GBB:1").when(opened, "GOB:1").when(closed, "GCB:1").otherwise("GNB:1")
        return F.concat(F.filter(g, lambda x: ~x.isin("GOB:1", "GCB:1")), F.array(state))

    return let(between, made)


def pair_features(chunks: Column, src: Column, dst: Column, src_children: Column | None = None, dst_children: Column | None = None) -> Column:
    """The sorted distinct features of a pair; the children are arrays of chunk numbers already linked to src and to dst."""
    own = lambda i: F.get(chunks, i)["features"]
    parts = [F.array(distance(src, dst)), relabel(role(own(src), "F"), "S"), relabel(role(own(dst), "F"), "D")]
    parts.append(F.when(src > 0, role(own(src - 1), "L")).otherwise(no_strings()))
    parts.append(F.when(dst < F.size(chunks) - 1, role(own(dst + 1), "R")).otherwise(no_strings()))
    seen = lambda children, letter: F.flatten(F.transform(children, lambda k: relabel(role(own(k), "A"), letter)))
    parts += [seen(children, letter) for children, letter in ((src_children, "a"), (dst_children, "A")) if children is not None]
    parts.append(gap_features(chunks, src, dst))
    return F.array_sort(F.array_distinct(F.concat(*parts)))


def partners(chunks: Column, i: Column) -> Column:
    """The chunks after the i-th that it is paired with: the next one, and the one it links to. A sentence of n chunks has fewer than 2n pairs."""
    linked = F.get(chunks, i)["link"]
    return F.when(linked > i + 1, F.array(i + 1, linked)).otherwise(F.array(i + 1))


def each_pair(chunks: Column, made) -> Column:
    """array of made(src, dst) for every chunk but the last and its partners."""
    n = F.size(chunks)
    first = F.when(n > 1, F.sequence(F.lit(0), n - 2)).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.transform(first, lambda i: F.transform(partners(chunks, i), lambda j: made(i, j))))


def static_pairs(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, src, dst, features) of each chunk with the next one and with the one it links to, without children."""
    one = lambda chunks: each_pair(chunks, lambda i, j: F.struct(i.alias("src"), j.alias("dst"), pair_features(chunks, i, j).alias("features")))
    # pairs are made inside the row, so that a sentence isn't copied for each of its pairs
    return df.select(*keys, F.explode_outer(let(F.col("chunks"), one)).alias("p")).where("p is not null").select(*keys, "p.src", "p.dst", "p.features")
