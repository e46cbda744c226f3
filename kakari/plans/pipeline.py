"""From the layers of input and output to stages, and the stages applied to a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kakari.functions.patterns import PUNCTUATION, Pattern, posset
from kakari.functions.text import let
from kakari.operators import sequence
from kakari.operators.chunks import chunk_by, select
from kakari.operators.entities import entity_rows, numeral_tail, repair, set_tags, spread, within_chunks
from kakari.operators.format import to_text
from kakari.operators.links import link_by, link_sentences
from kakari.operators.model import PairModel
from kakari.operators.tokens import tokenize
from kakari.schema import CHUNK, DEP, POS, RAW, SELECTION

Stage = Callable[[DataFrame], DataFrame]
ORDER = ("tokens", "entities", "chunks", "selection", "links")


def plan(input_layer: int = RAW, output_layer: int = DEP, ne: int = 0) -> list[str]:
    """The stages' names. Entities are tagged only where the input is raw or tokens; an output below the input needs no stage."""
    if not (RAW <= input_layer <= DEP and POS <= output_layer <= DEP):
        raise ValueError(f"no plan from layer {input_layer} to {output_layer}")
    gives = {"tokens": POS, "entities": POS, "chunks": CHUNK, "selection": SELECTION, "links": DEP}
    return [s for s in ORDER if (input_layer < gives[s] <= output_layer or s == "entities" and input_layer <= POS) and (s != "entities" or ne)]


class Parser:
    """The stages with their models and rules. Whatever isn't given is done by rule.

    tokenizer: DataFrame -> DataFrame; link: a PairModel, or a function (src, dst) -> Column; chunker and tagger: SequenceModel;
    features: (tokens, chunk, i, n) -> Column in place of the built-in chunk features.
    """

    def __init__(self, tags: str = "IPA", ne: int = 0, tokenizer: Stage = tokenize, chunker=None, tagger=None, link: PairModel | Callable[[Column, Column], Column] | None = None, punctuation: Pattern = PUNCTUATION, features=None, respect_links: bool = False):
        self.ps, self.ne, self.tokenizer, self.chunker, self.tagger, self.link = posset(tags), ne, tokenizer, chunker, tagger, link
        self.punctuation, self.features, self.respect_links = punctuation, features, respect_links

    def tokens(self, df: DataFrame) -> DataFrame:
        return self.tokenizer(df)

    def entities(self, df: DataFrame) -> DataFrame:
        """Tags by the model; without one tokens keep theirs. Mode 1 is finished after chunking."""
        if not self.tagger:
            return df
        rows = entity_rows(F.col("tokens"), self.ps)
        named = df.withColumn("features", let(rows, lambda r: sequence.template_features(r, ["surface", "shape", "pos"], sequence.ENTITY_TEMPLATES)))
        tagged = sequence.decode(named, self.tagger, "features", "__ne").withColumn("__tail", numeral_tail(F.col("tokens"), self.ps))
        return set_tags(tagged, repair(spread(F.col("__ne"), F.col("__tail")), F.col("__tail"))).drop("features", "__ne", "__tail")

    def chunks(self, df: DataFrame) -> DataFrame:
        if not self.chunker:
            out = chunk_by(df)
        else:
            rows = sequence.chunk_rows(F.col("tokens"), self.ps.levels)
            named = df.withColumn("__f", let(rows, lambda r: sequence.template_features(r, ["surface", "pos"], sequence.CHUNK_TEMPLATES)))
            out = chunk_by(sequence.decode(named, self.chunker, "__f", "__bi"), F.transform("__bi", lambda x: x == "B")).drop("__f", "__bi")
        if self.ne == 1:
            out = set_tags(out, within_chunks(F.transform("tokens", lambda t: t["ne"]), F.col("chunks")))
        return out

    def selection(self, df: DataFrame) -> DataFrame:
        return select(df, self.ps, self.punctuation, self.features)

    def links(self, df: DataFrame) -> DataFrame:
        if isinstance(self.link, PairModel):
            return link_sentences(df, self.link)
        return link_by(df, self.link or (lambda s, d: F.lit(1.0)), self.respect_links)

    def parse(self, df: DataFrame, input_layer: int = RAW, output_layer: int = DEP) -> DataFrame:
        """df, with the columns of its input layer, at its output layer. All stages are narrow: sentences stay where they are.

        A link rule that isn't given links each chunk to the next.
        """
        return reduce(lambda d, name: getattr(self, name)(d), plan(input_layer, output_layer, self.ne), df)

    def parse_to_text(self, df: DataFrame, style: int | str = 0, input_layer: int = RAW, output_layer: int = DEP, out: str = "text") -> DataFrame:
        return to_text(self.parse(df, input_layer, output_layer), style, output_layer, self.ps, out)
