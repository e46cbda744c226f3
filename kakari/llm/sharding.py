"""A reproducible shuffle into shards by a Feistel permutation of global row numbers.

Rows are numbered 0..N-1 in order of doc_id. The number's place in the shuffle is a keyed Feistel permutation of the
smallest even-bit domain that holds N; a value outside 0..N-1 is permuted again until it falls inside (cycle walking), which
keeps it a permutation of 0..N-1. Shard and slot are the quotient and remainder of the place by the slots in a shard, so both
can be computed from a row number alone, and inverse() leads back.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kakari.llm.util import fresh

ROUNDS = 6
MULTIPLIER = 1597334677


def round_keys(seed: int) -> list[int]:
    """ROUNDS keys of 31 bits."""
    return [(seed * 2654435761 + i * 40503 * 65537 + 97) % 2147483647 for i in range(1, ROUNDS + 1)]


def half_bits(n: int) -> int:
    return max(1, -(-max(n - 1, 1).bit_length() // 2))


def feistel(x: np.ndarray, n: int, seed: int, backwards: bool = False) -> np.ndarray:
    """The place of each row number below n (at most 2**62), or backwards the row number of each place."""
    bits = half_bits(n)
    low = np.int64((1 << bits) - 1)
    keys = round_keys(seed)

    def once(v):
        a, b = v >> bits, v & low
        for k in reversed(keys) if backwards else keys:
            r = a if backwards else b
            t = (r ^ np.int64(k & int(low))) * np.int64(MULTIPLIER) + np.int64(k)
            f = ((t >> 13) ^ t) & low
            a, b = (b ^ f, a) if backwards else (b, a ^ f)
        return (a << bits) | b

    out = np.array(x, np.int64)
    todo = np.arange(len(out))
    while len(todo):
        out[todo] = once(out[todo])
        todo = todo[out[todo] >= n]
    return out


def number_rows(df: DataFrame, max_ranges: int = 1 << 13, rows_per_range: int = 1 << 12) -> tuple[DataFrame, str, int]:
    """df with a column of global row numbers in order of doc_id (nulls first), its name, and the number of rows.

    doc_ids, whole numbers, are cut into at most max_ranges ranges at their quantiles, so gaps and far outliers don't matter. A doc_id
    that many rows share, or null, is a range of its own, cut once more by a hash of the columns. The ranges' sizes, at most
    4 * max_ranges of them or so, are counted and broadcast as offsets, and ranks are taken inside each range, so no task sees all rows.
    Rows with equal doc_id are ordered by the hash; only wholly equal rows can change places, and these alone share a range however many they are.
    """
    if dict(df.dtypes)["doc_id"] not in ("bigint", "int", "smallint", "tinyint"):
        raise TypeError("doc_id must be a whole number")
    n, nulls = df.agg(F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    ranges = min(max_ranges, max(1, n // rows_per_range))
    at = [i / ranges for i in range(1, ranges)]
    cuts = (df.agg(F.percentile_approx("doc_id", at, 10 * ranges)).first()[0] if at else None) or []
    bounds, repeats = np.unique(np.array(cuts, np.int64), return_counts=True)
    bits = np.ceil(np.log2(np.append(repeats, max(1, nulls * ranges // max(n, 1))))).astype(np.int64)

    @F.pandas_udf("long")
    def range_of(x: pd.Series, none: pd.Series, tie: pd.Series) -> pd.Series:
        v, hidden = x.to_numpy(np.int64), none.to_numpy(bool)
        where = np.searchsorted(bounds, v)
        known = np.append(bounds, 0)[where]
        equal = (where < len(bounds)) & (known == v) & ~hidden
        own = np.where(hidden, bits[-1], np.where(equal, bits[where], 0))
        high = (tie.to_numpy(np.int64) ^ np.int64(-(1 << 63))).view(np.uint64)
        part = np.where(own > 0, high >> (64 - np.maximum(own, 1)).astype(np.uint64), 0).astype(np.int64)
        return pd.Series((np.where(hidden, 0, 1 + 2 * where + equal) << 16) | part)

    bucket, number, offset, tie = (fresh(df, c) for c in ("__bucket", "__number", "__offset", "__tie"))
    plain = [F.col(f"`{c}`") for c, t in df.dtypes if "map<" not in t and "variant" not in t]
    ranged = df.withColumn(tie, F.xxhash64(*plain)).withColumn(bucket, range_of(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.col("doc_id").isNull(), F.col(tie)))
    sizes = sorted((r[0], r[1]) for r in ranged.groupBy(bucket).count().collect())
    starts = np.cumsum([0] + [c for _, c in sizes]).tolist()
    offsets = F.broadcast(df.sparkSession.createDataFrame([(b, at) for (b, _), at in zip(sizes, starts)], f"`{bucket}_b` long, `{offset}` long"))
    w = Window.partitionBy(bucket).orderBy("doc_id", tie)
    out = ranged.withColumn(number, F.row_number().over(w)).join(offsets, F.col(bucket) == F.col(f"{bucket}_b"))
    return out.withColumn(number, F.col(number) - 1 + F.col(offset)).select(*(F.col(f"`{c}`") for c in df.columns), number), number, n


def shard(df: DataFrame, n_shards: int = 64, seed: int = 1, rows_per_task: int = 1 << 16) -> DataFrame:
    """df's rows with row_number, position, shard and slot, in order of shard and slot inside each partition.

    A partition holds whole runs of rows_per_task slots, so the tasks that write a shard aren't bounded by the number of shards.
    Columns of df with one of these four names are replaced. Shards hold ceil(N / n_shards) rows; the last ones may hold fewer. Defined results: a null doc_id
    is numbered before all others; repeated doc_ids and rows each keep a number of their own; texts are carried, not read. An
    empty table gives an empty result with the four columns. A doc_id that isn't a whole number raises TypeError.
    """
    df = df.drop("row_number", "position", "shard", "slot")
    numbered, number, n = number_rows(df)
    slots = max(1, -(-n // n_shards))

    @F.pandas_udf("long")
    def place(x: pd.Series) -> pd.Series:
        return pd.Series(feistel(x.to_numpy(), n, seed))

    out = numbered.withColumnRenamed(number, "row_number").withColumn("position", place("row_number"))
    out = out.withColumn("shard", F.expr(f"position div {slots}")).withColumn("slot", F.expr(f"position % {slots}"))
    run = F.expr(f"slot div {rows_per_task}")
    pieces = n_shards * -(-slots // rows_per_task)
    return out.repartition(min(pieces, 1 << 15), "shard", run).sortWithinPartitions("shard", "slot")


ORACLE = f"""
WITH RECURSIVE
n AS (SELECT count(*) AS n, greatest(1, CAST(ceil(count(*) / 64.0) AS BIGINT)) AS slots FROM documents),
h AS (SELECT n, slots, (SELECT min(b) FROM range(1, 32) t(b) WHERE (1::BIGINT << (2 * b)) >= n) AS bits FROM n),
numbered AS (SELECT doc_id, lang, source, n_chars, text, row_number() OVER (ORDER BY doc_id) - 1 AS row_number FROM documents),
keys AS (SELECT k, row_number() OVER () AS i FROM (SELECT unnest({round_keys(1)}) AS k)),
steps AS (
  SELECT row_number, 0 AS i, row_number >> (SELECT bits FROM h) AS a, row_number & ((1::BIGINT << (SELECT bits FROM h)) - 1) AS b FROM numbered
  UNION ALL
  SELECT row_number, i, a, b FROM (
    SELECT s.row_number, CASE WHEN s.i = {ROUNDS} THEN 1 ELSE s.i + 1 END AS i, s.b AS a,
      xor(s.a, xor((xor(s.b, k.k & m.m) * {MULTIPLIER} + k.k) >> 13, xor(s.b, k.k & m.m) * {MULTIPLIER} + k.k) & m.m) AS b
    FROM steps s, (SELECT bits, n, (1::BIGINT << bits) - 1 AS m FROM h) m, keys k
    WHERE k.i = CASE WHEN s.i = {ROUNDS} THEN 1 ELSE s.i + 1 END
      AND (s.i < {ROUNDS} OR ((s.a << m.bits) | s.b) >= m.n))
)
SELECT d.doc_id, d.lang, d.source, d.n_chars, d.text, d.row_number, (s.a << h.bits) | s.b AS position,
  ((s.a << h.bits) | s.b) // h.slots AS shard, ((s.a << h.bits) | s.b) % h.slots AS slot
FROM numbered d JOIN steps s USING (row_number), h
WHERE s.i = {ROUNDS} AND ((s.a << h.bits) | s.b) < h.n
"""
