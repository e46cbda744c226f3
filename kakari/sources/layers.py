"""Layered text: blocks of token and chunk lines, read into rows and written again.

A token line is surface TAB feature [TAB entity tag]; a chunk line, * id linkD [head/func [score [features]]], stands before
the chunk's tokens; EOS or an empty line ends the block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from kakari.functions import plain
from kakari.functions.text import let, split_csv, split_max, to_number
from kakari.operators.tokens import make_token
from kakari.schema import CHUNK, POS, RAW, chunk, joined_surface, no_strings

MAX_LINES = 8192


def read_blocks(spark: SparkSession, path: str | list[str], blank_ends: bool = True, max_lines: int = MAX_LINES) -> DataFrame:
    """(path, block, text): a row for each block of the files.

    Blocks that end with EOS alone (blank_ends=False) are cut by the reader, so that large files are split; block is null then.
    Where empty lines may end blocks, a file is read whole. A block of more than max_lines lines raises an error.
    """
    if blank_ends:
        files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
        found = files.select("path", F.posexplode(split_blocks(F.col("value"))).alias("block", "text"))
    else:
        found = spark.read.text(path, lineSep="\nEOS\n").select(F.col("_metadata.file_path").alias("path"), F.lit(None).cast("int").alias("block"), F.regexp_replace("value", "\n?EOS\n?$", "").alias("text"))
    size = F.size(F.split("text", "\n"))
    return found.withColumn("text", F.when(size > max_lines, F.raise_error(F.concat(F.lit("too many lines in a block: "), size.cast("string")))).otherwise(F.col("text")))


def split_blocks(content: Column) -> Column:
    """The blocks of a whole text without their ends; what follows the last end, if it isn't empty, is a block too."""
    parts = F.split(content, "(?m)^(?:EOS)?(?:\\n|\\z)")
    return F.transform(F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts), lambda x: F.regexp_replace(x, "\\n\\z", ""))


def _line(line: Column) -> Column:
    """What a line is: kind 1 token, 2 chunk, 3 faulty chunk line, 0 the end; with its columns."""
    starred = (F.length(line) >= 3) & F.startswith(line, F.lit("* "))
    stars, tabs = split_max(line, " ", 8), split_max(line, "\t", 8)
    sound = (F.size(stars) >= 3) & F.element_at(stars, 2).rlike("^[-0-9]")
    good = (F.size(tabs) >= 2) & (F.get(tabs, F.lit(0)) != "") & (F.get(tabs, F.lit(1)) != "")
    kind = F.when(starred, F.when(sound, 2).otherwise(3)).when(good, 1).otherwise(0)
    return F.struct(kind.alias("kind"), F.when(starred, stars).otherwise(tabs).alias("c"))


def _whole(c: Column) -> Column:
    """The integer a text begins with, 0 where there is none."""
    return to_number(F.regexp_extract(c, "^[-+]?[0-9]+", 0))


def parse_block(text: Column, layer: int) -> Column:
    """struct(sentence, tokens, chunks, is_valid) of a block's text in an input layer.

    The first line that is neither ends the block. At the token layer chunk lines are passed over. A faulty chunk line, ids other
    than 0, 1, 2..., a chunk without tokens and a link out of range make a block invalid. An empty block is valid and has nothing.
    """
    if layer == RAW:
        return F.struct(text.alias("sentence"), F.array().cast("array<struct<surface:string,norm:string,feature:string,features:array<string>,ne:string>>").alias("tokens"), F.array().cast("array<struct<link:int,head_pos:int,func_pos:int,token_pos:int,token_size:int,score:float,features:array<string>>>").alias("chunks"), F.lit(True).alias("is_valid"))

    def taken(all_lines):
        first_end = F.array_position(F.transform(all_lines, lambda x: x["kind"]), F.lit(0)).cast("int")
        return F.when(first_end > 0, F.slice(all_lines, F.lit(1), first_end - 1)).otherwise(all_lines)

    def built(rows):
        tokens = F.transform(F.filter(rows, lambda r: r["kind"] == 1), lambda r: make_token(F.get(r["c"], F.lit(0)), F.get(r["c"], F.lit(1)), F.get(r["c"], F.lit(2))))
        if layer == POS:
            rows = F.filter(rows, lambda r: r["kind"] != 2)
        return let(tokens, lambda t: let(_marks(rows), lambda m: _assembled(t, m, rows)))

    def _marks(rows):
        """For each chunk line: its columns and how many tokens stand before it."""
        kinds = F.transform(rows, lambda r: r["kind"])
        at = F.filter(F.transform(rows, lambda r, i: F.when(r["kind"] == 2, F.struct(i.alias("i"), r["c"].alias("c")))), lambda x: x.isNotNull())
        return let(kinds, lambda _: F.transform(at, lambda x, n: F.struct((x["i"] - n).alias("before"), x["c"].alias("c"))))

    def _assembled(t, m, rows):
        size = F.size(t)
        n = F.size(m)

        def one(x, i):
            c = x["c"]
            pair = F.split(F.coalesce(F.get(c, F.lit(3)), F.lit("0/0")), "/")
            end = F.when(i + 1 < n, F.get(m, i + 1)["before"]).otherwise(size)
            return chunk(_whole(F.get(c, F.lit(2))), _whole(F.get(pair, F.lit(0))), _whole(F.coalesce(F.get(pair, F.lit(1)), F.lit("0"))), x["before"], end - x["before"], to_number(F.coalesce(F.get(c, F.lit(4)), F.lit("0")), "double"), F.coalesce(split_csv(F.get(c, F.lit(5))), no_strings()))

        def finished(chunks):
            ordered = F.forall(F.transform(m, lambda x, i: _whole(F.get(x["c"], F.lit(1))) == i), lambda x: x)
            whole = F.forall(chunks, lambda c: (c["token_size"] > 0) & (c["link"] >= -1) & (c["link"] < n))
            sound = F.forall(rows, lambda r: r["kind"] != 3)
            return F.struct(joined_surface(t).alias("sentence"), t.alias("tokens"), chunks.alias("chunks"), (ordered & whole & sound).alias("is_valid"))

        return let(F.transform(m, one), finished)

    split = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), _line)
    return let(let(split, taken), built)


def read_layer(blocks: DataFrame, layer: int = CHUNK, text: str = "text", mode: str = "PERMISSIVE") -> DataFrame:
    """blocks with sentence, tokens, chunks and is_valid. DROPMALFORMED leaves invalid blocks out, FAILFAST raises on them."""
    if mode not in ("PERMISSIVE", "DROPMALFORMED", "FAILFAST"):
        raise ValueError(f"unknown mode: {mode}")
    parsed = blocks.withColumn("__b", parse_block(F.col(text), layer)).select("*", *(F.col(f"__b.{c}").alias(c) for c in ("sentence", "tokens", "chunks", "is_valid"))).drop("__b")
    if mode == "DROPMALFORMED":
        return parsed.where("is_valid")
    if mode == "FAILFAST":
        return parsed.withColumn("is_valid", F.when(F.col("is_valid"), True).otherwise(F.raise_error(F.concat(F.lit("malformed block: "), F.left(F.col(text), F.lit(80))))))
    return parsed


_NUMBER, _SOUND = re.compile("[-+]?[0-9]+"), re.compile("[-0-9]")
CHUNK_ROWS = "chunk_id int, is_valid boolean, link int, head_pos int, func_pos int, token_pos int, token_size int, score float, features array<string>"


def _int_of(x: str) -> int:
    """The integer a text begins with, 0 where there is none or it is beyond an int."""
    found = _NUMBER.match(x)
    n = int(found.group(0)) if found else 0
    return n if -(1 << 31) <= n < 1 << 31 else 0


def _score_of(x: str) -> float:
    try:
        return float(x)
    except ValueError:
        return 0.0


def block_chunks(text: str | None) -> tuple[list[tuple], bool]:
    """The chunks of a block's text in a layer from that of chunks on, and whether the block is valid, by the rules of parse_block()."""
    marks, n_rows, sound = [], 0, True
    for line in (text or "").split("\n"):
        if line.startswith("* ") and len(line) >= 3:
            c = line.split(" ")[:8]
            if len(c) >= 3 and _SOUND.match(c[1]):
                marks.append((n_rows - len(marks), c))
            else:
                sound = False
        else:
            c = line.split("\t", 2)
            if len(c) < 2 or not c[0] or not c[1]:
                break
        n_rows += 1
    # faulty chunk lines are no tokens
    size = n_rows - len(marks) if sound else sum(1 for line in (text or "").split("\n")[:n_rows] if not (line.startswith("* ") and len(line) >= 3))
    chunks, valid = [], sound
    for i, (before, c) in enumerate(marks):
        end = marks[i + 1][0] if i + 1 < len(marks) else size
        pair = c[3].split("/") if len(c) > 3 else ["0", "0"]
        link = _int_of(c[2])
        chunks.append((link, _int_of(pair[0]), _int_of(pair[1]) if len(pair) > 1 else 0, before, end - before, _score_of(c[4]) if len(c) > 4 else 0.0, plain.split_csv(c[5]) if len(c) > 5 else []))
        valid = valid and end > before and -1 <= link < len(marks) and _int_of(c[1]) == i
    return chunks, valid


def read_chunks(blocks: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """(keys, chunk_id, is_valid and what is known of the chunk) of every chunk of blocks, read by read_layer()'s rules a batch at a time; invalid blocks are marked."""
    own = blocks.select(*keys, text)
    schema = StructType(own.schema.fields[: len(keys)] + _parse_datatype_string(CHUNK_ROWS).fields)
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float32(), pa.list_(pa.string()))

    def run(batches: Iterator[pa.RecordBatch]):
        for whole in batches:
            for a in range(0, whole.num_rows, 1 << 10):
                batch = whole.slice(a, 1 << 10)
                found = [block_chunks(x) for x in batch.column(len(keys)).to_pylist()]
                sizes = np.array([len(x) for x, _ in found])
                at = pa.array(np.repeat(np.arange(len(found)), sizes))
                ids = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                columns = list(zip(*(c for x, _ in found for c in x))) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(len(keys))), pa.array(ids.astype(np.int32)), pa.array([v for _, v in found], pa.bool_()).take(at), *(pa.array(c, t) for c, t in zip(columns, kinds))], schema.names)

    return own.mapInArrow(run, schema)
