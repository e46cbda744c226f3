"""Raw text: a line is a sentence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kakari.functions.text import CHARSETS, decode


def lines(text: Column) -> Column:
    """The lines of a text; a null text has none, an empty one has one empty line."""
    return F.split(text, "\n")


def read_sentences(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, sentence): a row for each line of files in UTF-8, empty ones too, of all the files given."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("sentence"))


def read_encoded(spark: SparkSession, path: str, charset: str) -> DataFrame:
    """(path, line, sentence) of files in another charset, each decoded whole; needs spark.sql.legacy.javaCharsets for Japanese ones."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.posexplode(F.split(F.regexp_replace(decode(F.col("content"), charset), "\n$", ""), "\n")).alias("line", "sentence"))


def sentences_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line, sentence): a row for each line of each document."""
    return docs.select(key, F.posexplode(lines(F.col(text))).alias("line", "sentence"))


def charset_of(first_line: str) -> str:
    """The charset that the first line of a charset file names; UTF-8 where it names none that is known."""
    return CHARSETS.get(first_line.strip().lower(), "UTF-8")
