"""The functions a user calls: parse DataFrames, lists of strings or files, train, compile and evaluate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kakari.functions import text as T
from kakari.operators import evaluate
from kakari.operators.entities import spans as entity_spans
from kakari.operators.train import train_chunker, train_entities, train_links  # noqa: F401
from kakari.plans.pipeline import Parser
from kakari.schema import CHUNK, DEP, POS, RAW
from kakari.sources.layers import read_blocks, read_layer
from kakari.sources.models import open_model, save_model  # noqa: F401
from kakari.sources.raw import read_encoded, read_sentences

VERSION = "0.1"


def parse_df(df: DataFrame, input_layer: int = RAW, output_layer: int = DEP, **options) -> DataFrame:
    """df (sentence, or the columns of the input layer) with the columns of the output layer; options are Parser's."""
    return Parser(**options).parse(df, input_layer, output_layer)


def parse_to_string_df(df: DataFrame, style: int | str = 0, input_layer: int = RAW, output_layer: int = DEP, **options) -> DataFrame:
    """df with the formatted parse in `text`."""
    return Parser(**options).parse_to_text(df, style, input_layer, output_layer)


def parse_strings(spark: SparkSession, sentences: list[str], **options) -> list:
    """The parsed rows of a few sentences, in their order."""
    rows = spark.createDataFrame(list(enumerate(sentences)), "n long, sentence string")
    return parse_df(rows, **options).orderBy("n").collect()


def parse_to_string(spark: SparkSession, sentence: str, style: int | str = 0, **options) -> str:
    return parse_to_string_df(spark.createDataFrame([(sentence,)], "sentence string"), style, **options).first().text


def read(spark: SparkSession, paths: str | list[str], layer: int = RAW, charset: str = "UTF-8", blank_ends: bool = True) -> DataFrame:
    """Rows of a layer from files, all of those given. Where every block ends with EOS (blank_ends=False), large files are split over tasks; otherwise a file of a higher layer is one row."""
    if layer == RAW:
        return read_sentences(spark, paths) if T.charset(charset) == "UTF-8" else read_encoded(spark, paths, charset)
    return read_layer(read_blocks(spark, paths, blank_ends), layer)


def tokens_table(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, tok_id, chunk_id, surface, norm, feature, features, ne): a row for each token."""
    rows = df.select(*keys, "chunks", F.posexplode("tokens").alias("tok_id", "t"))
    own = F.size(F.filter("chunks", lambda c: c["token_pos"] <= F.col("tok_id"))) - 1
    return rows.select(*keys, "tok_id", F.when(own >= 0, own).alias("chunk_id"), "t.*")


def chunks_table(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, chunk_id, n_chunks, link, head_pos, func_pos, token_pos, token_size, score, features): a row for each chunk."""
    return df.select(*keys, F.size("chunks").alias("n_chunks"), F.posexplode_outer("chunks").alias("chunk_id", "c")).where("chunk_id is not null").select(*keys, "chunk_id", "n_chunks", "c.*")


def evaluate_files(spark: SparkSession, system: str, gold: str, what: str = "dep") -> DataFrame:
    """dep, chunk or ne scores of two files of blocks; their sentences correspond by number."""
    layer = POS if what == "ne" else CHUNK
    sides = [read_layer(read_blocks(spark, p), layer).withColumn("path", F.lit("")) for p in (system, gold)]
    if what == "dep":
        return evaluate.link_accuracy(*(chunks_table(d, "block") for d in sides), "block")
    if what == "chunk":
        return evaluate.chunk_scores(*(chunks_table(d, "block") for d in sides), "block")
    if what == "ne":
        found = [d.select("block", F.explode(entity_spans(F.transform("tokens", lambda t: t["ne"]))).alias("x")).select("block", "x.*") for d in sides]
        return evaluate.entity_scores(*found, "block")
    raise ValueError(f"unknown evaluation: {what}")


def register(spark: SparkSession) -> None:
    """SQL functions k_width and k_lower, as SQL definitions, so that they stay in the JVM."""
    body = {"k_width": "2 * char_length(x) - char_length(regexp_replace(x, '[^\\\\x00-\\\\x7F]', ''))", "k_lower": f"translate(x, '{''.join(chr(c) for c in range(65, 91))}', '{''.join(chr(c) for c in range(97, 123))}')"}
    for name, sql in body.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x STRING) RETURNS {'INT' if name == 'k_width' else 'STRING'} RETURN {sql}")
