"""Counts of byte n-grams of a text column, gathered per task and summed in Spark."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kakari.llm.kernels import blocks, gram_keys

FLUSH = 4 << 20


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([c for _, c in parts])).astype(np.int64)


def counter(length: int):
    """The mapInArrow function over (text): distinct grams of the task and their counts, in parts when they are very many."""

    def batch(keys, counts):
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], ["gram", "n"])

    def run(batches):
        parts, held, floor = [], 0, 0
        for block in blocks(batches, 0):
            keys, counts = np.unique(gram_keys(block.column(0), length)[0], return_counts=True)
            parts.append((keys, counts))
            held += len(keys)
            if held > floor + (FLUSH >> 2):
                parts = [merged(parts)]
                held = floor = len(parts[0][0])
                if held > FLUSH:
                    yield batch(*parts[0])
                    parts, held, floor = [], 0, 0
        if parts:
            yield batch(*merged(parts))

    return run


def gram_counts(texts: DataFrame, length: int) -> DataFrame:
    """(gram, n) over all texts, length up to 7: each byte with the length-1 bytes before it, the byte itself lowest."""
    return texts.select("text").mapInArrow(counter(length), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
