"""The pipeline over streams: sentences are independent, so every stage is stateless and output is appended.

Event-time windows over a stream of events are an addition of this engine's own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kakari.plans.pipeline import Parser
from kakari.schema import RAW
from kakari.sources.layers import read_layer


def read_lines(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """(sentence) of text files as they arrive."""
    reader = spark.readStream.option("maxFilesPerTrigger", max_files) if max_files else spark.readStream
    return reader.text(path).select(F.col("value").alias("sentence"))


def read_block_stream(spark: SparkSession, path: str, layer: int, max_files: int | None = None) -> DataFrame:
    """Rows of a layer from files whose blocks end with EOS lines (blocks that end with empty lines need the batch reader)."""
    reader = spark.readStream.option("maxFilesPerTrigger", max_files) if max_files else spark.readStream
    blocks = reader.option("lineSep", "\nEOS\n").text(path).select(F.regexp_replace("value", "\n?EOS\n?$", "").alias("text"))
    return read_layer(blocks, layer)


def parse_stream(lines: DataFrame, parser: Parser, style: int | str = 0, input_layer: int = RAW) -> DataFrame:
    """lines with the text of their parses."""
    return parser.parse_to_text(lines, style, input_layer)


def write_stream(df: DataFrame, path: str, checkpoint: str, column: str = "text"):
    """Appends the column to text files; with the checkpoint, each input is written once, also after a restart."""
    return df.select(F.regexp_replace(column, "\n$", "").alias("value")).writeStream.format("text").option("checkpointLocation", checkpoint).outputMode("append").start(path)


def windowed_counts(events: DataFrame, ts: str, by: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window_start, by, n) of tumbling windows in event time; events later than `late` behind the newest are dropped from a stream."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), by, "n")
