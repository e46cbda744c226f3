"""From raw text to tokens (layer 1).

The tokenizer is a plug-in: any function from a DataFrame with `sentence` to one with `tokens`. The one here serves texts in
Latin script: it cuts words, digits and single signs, and a lexicon of rules gives each its part of speech. A lexicon table
can be joined in instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kakari.checkpoint import cut
from kakari.functions.patterns import NOUN, PARTICLE, SYMBOL, VERB
from kakari.functions.text import ODD, csv_escape, let, normalize, split_csv
from kakari.schema import token

WORD = "[A-Za-zÀ-ɏ]+|[0-9]+|[^ \\t\\r\\n]"
FUNCTION_WORDS = tuple("the a an of to in is was be that this with for on from by at and or he it le la les un une de du des et en que qui dans est der die das und ein eine zu den mit von ist el los las y por con su para se no".split())
VERBAL = ("ing", "ed", "ent", "er", "ir", "en", "ar", "tion")


def part_of_speech(w: Column) -> Column:
    """The feature line of a word: four levels, conjugation type and form, lemma, reading."""
    quoted = csv_escape(w)
    lemma = F.lower(w)
    return (
        F.when(w.rlike("^[0-9]+$"), F.concat(F.lit(f"{NOUN},数,*,*,*,*,"), w, F.lit(","), w))
        .when(lemma.isin(*FUNCTION_WORDS), F.concat(F.lit(f"{PARTICLE},格助詞,一般,*,*,*,"), lemma, F.lit(","), w))
        .when(w.isin("(", "[", "{", "<"), F.concat(F.lit(f"{SYMBOL},括弧開,*,*,*,*,"), quoted, F.lit(","), quoted))
        .when(w.isin(")", "]", "}", ">"), F.concat(F.lit(f"{SYMBOL},括弧閉,*,*,*,*,"), quoted, F.lit(","), quoted))
        .when(~w.rlike("^[A-Za-zÀ-ɏ]"), F.concat(F.lit(f"{SYMBOL},一般,*,*,*,*,"), quoted, F.lit(","), quoted))
        .when((F.char_length(w) > 4) & w.rlike(f"(?:{'|'.join(VERBAL)})$"), F.concat(F.lit(f"{VERB},自立,*,*,一段,基本形,"), lemma, F.lit(","), w))
        .otherwise(F.concat(F.lit(f"{NOUN},一般,*,*,*,*,"), lemma, F.lit(","), w))
    )


def make_token(surface: Column, feature: Column, ne: Column | None = None) -> Column:
    return token(surface, normalize(surface), feature, split_csv(feature), ne)


def words(sentence: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(sentence, F.lit("")), F.lit(WORD), F.lit(0))


def tokenize(df: DataFrame, sentence: str = "sentence") -> DataFrame:
    """df with `tokens`, one for each word, run of digits or other sign of the sentence; a null sentence has none. No shuffle."""
    # whether anything is to be normalised is found once for the sentence
    seen = F.struct(words(F.col(sentence)).alias("words"), F.coalesce(F.col(sentence).rlike(f"[{ODD}\u3000]"), F.lit(False)).alias("odd"))
    made = lambda w, f, odd: token(w, F.when(odd, normalize(w)).otherwise(w), f, split_csv(f))
    return df.withColumn("tokens", let(seen, lambda s: F.transform(s["words"], lambda w: let(part_of_speech(w), lambda f: made(w, f, s["odd"])))))


def tokenize_with(df: DataFrame, lexicon: DataFrame, sentence: str = "sentence", unknown: str = f"{NOUN},一般,*,*,*,*,*", max_broadcast_bytes: int = 64 << 20) -> DataFrame:
    """As tokenize(), with the parts of speech of a lexicon (surface, feature); the first by feature where it has several.

    A lexicon within max_broadcast_bytes of text is gathered into one map and broadcast as a one-row table, so sentences aren't
    shuffled; a larger one is joined by word and the sentences are put together again by a row key.
    """
    kept = lexicon.groupBy("surface").agg(F.min("feature").alias("feature")).where("surface is not null and feature is not null")
    size = kept.agg(F.sum(F.octet_length("surface") + F.octet_length("feature"))).first()[0] or 0
    if size <= max_broadcast_bytes:
        table = kept.agg(F.map_from_entries(F.collect_list(F.struct("surface", "feature"))).alias("__lexicon"))
        tagged = df.crossJoin(F.broadcast(table))
        return tagged.withColumn("tokens", F.transform(words(F.col(sentence)), lambda w: let(F.coalesce(F.col("__lexicon")[w], F.lit(unknown)), lambda f: make_token(w, f)))).drop("__lexicon")
    keyed = cut(df.withColumn("__row", F.monotonically_increasing_id()))
    pieces = keyed.select("__row", F.posexplode(words(F.col(sentence))).alias("i", "surface"))
    found = pieces.join(kept, "surface", "left").select("__row", "i", make_token(F.col("surface"), F.coalesce("feature", F.lit(unknown))).alias("t"))
    lists = found.groupBy("__row").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "t"))), lambda x: x["t"]).alias("tokens"))
    return keyed.join(lists, "__row", "left").withColumn("tokens", F.coalesce("tokens", F.array())).drop("__row")
