"""Column types of the layers: a sentence is a row with its text, its tokens and its chunks.

Layers: 0 raw text, 1 tokens with parts of speech, 2 chunks, 3 heads and features, 4 links. Each adds to the one before.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RAW, POS, CHUNK, SELECTION, DEP = range(5)

TOKEN = "struct<surface:string,norm:string,feature:string,features:array<string>,ne:string>"
CHUNKS = "struct<link:int,head_pos:int,func_pos:int,token_pos:int,token_size:int,score:float,features:array<string>>"


def token(surface: Column, norm: Column, feature: Column, features: Column, ne: Column | None = None) -> Column:
    return F.struct(surface.alias("surface"), norm.alias("norm"), feature.alias("feature"), features.alias("features"), (F.lit(None).cast("string") if ne is None else ne).alias("ne"))


def chunk(link: Column, head: Column, func: Column, pos: Column, size: Column, score: Column, features: Column) -> Column:
    parts = {"link": link.cast("int"), "head_pos": head.cast("int"), "func_pos": func.cast("int"), "token_pos": pos.cast("int"), "token_size": size.cast("int"), "score": score.cast("float"), "features": features}
    return F.struct(*(c.alias(n) for n, c in parts.items()))


def no_strings() -> Column:
    return F.array().cast("array<string>")


def upto(n: Column) -> Column:
    """0..n-1; empty for n < 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def tokens_of(c: Column, tokens: Column) -> Column:
    """The tokens of a chunk."""
    return F.slice(tokens, c["token_pos"] + 1, c["token_size"])


def joined_surface(tokens: Column) -> Column:
    return F.array_join(F.transform(tokens, lambda t: t["surface"]), "")
