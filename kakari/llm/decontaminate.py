"""Benchmark decontamination: which documents hold a benchmark item.

Items are partitioned by their number of shingles into classes (u/2, u]. For each class a document is read as windows of
1.5u shingles, one every u/2, so an item lies inside a window of a size like its own however long the document is. An item
and a window that share a MinHash value become a candidate, and a candidate is verified by the exact containment of the
item's distinct shingles in the whole document. With containment c the chance that a contained item shares none of the
num_perm values is at most (1 - c / (4 - c)) ** num_perm, 0.0001 for the defaults. Items of up to FEW shingles have too small windows
for that: every shingle of theirs is looked up itself, so none of them is missed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kakari.llm.kernels import Table, U, blocks, mix, owners, shingles, words
from kakari.llm.util import cut, pick

SCHEMA = "doc_id long, item_id long, n_shingles int, n_shared int, containment double"
FEW, SMALLEST = 4, 8


def build_index(ids: list[int], texts: list[str | None], k: int, num_perm: int) -> list[dict]:
    """For each shingle length and size class: the items, their distinct shingles and their MinHash values by permutation."""
    w = words(pa.array(texts, pa.string()))
    n_words = np.diff(w.offsets)
    out = []
    for length in sorted({min(int(n), k) for n in n_words if n}):
        hashes, offsets, _ = shingles(w, length)
        classes: dict[int, list] = {}
        small: list = []
        for i in np.flatnonzero(np.minimum(n_words, k) == length):
            own = np.unique(hashes[offsets[i] : offsets[i + 1]])
            if len(own) <= FEW:
                small.append((ids[i], own))
                continue
            upper = max(SMALLEST, 1 << (len(own) - 1).bit_length())
            classes.setdefault(upper, []).append((ids[i], own))
        if small:
            out.append(looked_up(length, small))
        for upper, items in sorted(classes.items()):
            mins = np.array([[mix(s, p + 1).min() for p in range(num_perm)] for _, s in items], U)
            distinct = [np.unique(mins[:, p]) for p in range(num_perm)]
            holders = [[np.flatnonzero(mins[:, p] == v) for v in distinct[p]] for p in range(num_perm)]
            quick = np.zeros((num_perm, 1 << 16), bool)
            for p in range(num_perm):
                quick[p, (distinct[p] >> U(48)).astype(np.int64)] = True
            out.append({"length": length, "upper": upper, "ids": [i for i, _ in items], "sets": [s for _, s in items], "tables": [Table(d) for d in distinct], "holders": holders, "quick": quick})
    return out


def looked_up(length: int, items: list) -> dict:
    """The index of items of few shingles: which items each shingle belongs to."""
    distinct, at = np.unique(np.concatenate([s for _, s in items]), return_inverse=True)
    owner = np.repeat(np.arange(len(items)), [len(s) for _, s in items])
    order = np.argsort(at, kind="stable")
    holders = np.split(owner[order], np.cumsum(np.bincount(at))[:-1])
    quick = np.zeros(1 << 16, bool)
    quick[(distinct >> U(48)).astype(np.int64)] = True
    return {"length": length, "upper": 0, "ids": [i for i, _ in items], "sets": [s for _, s in items], "table": Table(distinct), "holders": holders, "quick": quick}


def block_starts(offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First elements of the runs of size elements (the last of a text may be shorter) and the texts' offsets into the runs."""
    count = -(-np.diff(offsets) // size)
    at = np.concatenate([[0], np.cumsum(count)])
    return (np.arange(at[-1]) - np.repeat(at[:-1], count)) * size + np.repeat(offsets[:-1], count), at


def candidates(hashes: np.ndarray, offsets: np.ndarray, groups: list[dict], num_perm: int) -> set[tuple[int, int, int]]:
    """(text, group, item of the group) of which a window shares a MinHash value with the item."""
    found: set[tuple[int, int, int]] = set()
    if not len(hashes):
        return found
    for n, g in enumerate(groups):
        if not g["upper"]:
            near = np.flatnonzero(g["quick"][(hashes >> U(48)).astype(np.int64)])
            row = g["table"].find(hashes[near])
            text = np.searchsorted(offsets, near[row >= 0], "right") - 1
            for t, r in set(zip(text.tolist(), row[row >= 0].tolist())):
                found.update((t, n, int(i)) for i in g["holders"][r])
    sized = [(n, g) for n, g in enumerate(groups) if g["upper"]]
    if not sized:
        return found
    base = min(g["upper"] for _, g in sized) // 2
    starts, at = block_starts(offsets, base)
    levels = {}
    for _, g in sized:
        coarse, where = block_starts(at, g["upper"] // 2 // base)
        text = owners(where)
        levels[g["upper"]] = (coarse, text, np.append(text[1:] == text[:-1], False), np.append(text[2:] == text[:-2], [False, False][: min(2, len(text))])[: len(text)])
    for p in range(num_perm):
        least = np.minimum.reduceat(mix(hashes, p + 1), starts)
        for n, g in sized:
            coarse, text, second, third = levels[g["upper"]]
            low = np.minimum.reduceat(least, coarse)
            window = low.copy()
            window[:-1][second[:-1]] = np.minimum(low[:-1], low[1:])[second[:-1]]
            window[:-2][third[:-2]] = np.minimum(window[:-2], low[2:])[third[:-2]]
            hit = np.flatnonzero(g["quick"][p][(window >> U(48)).astype(np.int64)])
            row = g["tables"][p].find(window[hit])
            for t, r in set(zip(text[hit[row >= 0]].tolist(), row[row >= 0].tolist())):
                found.update((t, n, int(i)) for i in g["holders"][p][r])
    return found


def matches(texts: pa.Array, index: list[dict], k: int, threshold: float, num_perm: int):
    """(text, item_id, shingles of the item, shared shingles) for every verified pair of these texts."""
    w = words(texts)
    n_words = np.diff(w.offsets)
    for length in sorted({g["length"] for g in index}):
        groups = [g for g in index if g["length"] == length]
        hashes, offsets, _ = shingles(w, length)
        sets: dict[int, np.ndarray] = {}
        for t, n, i in candidates(hashes, offsets, groups, num_perm):
            if n_words[t] < length:
                continue
            if t not in sets:
                sets[t] = np.unique(hashes[offsets[t] : offsets[t + 1]])
            own = groups[n]["sets"][i]
            at = np.minimum(np.searchsorted(sets[t], own), len(sets[t]) - 1)
            shared = int((sets[t][at] == own).sum())
            if shared >= threshold * len(own):
                yield t, groups[n]["ids"][i], len(own), shared


def scan(index, *how):
    """The mapInArrow function over (doc_id, text)."""

    def run(batches):
        for batch in blocks(batches):
            ids = batch.column(0).to_pylist()
            rows = [(ids[t], i, n, shared, shared / n) for t, i, n, shared in matches(batch.column(1), index.value, *how)]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64()))], ["doc_id", "item_id", "n_shingles", "n_shared", "containment"])

    return run


def keep_clean(index, text: int, *how):
    """The mapInArrow function over whole rows that drops those whose text holds an item."""

    def run(batches):
        for batch in blocks(batches, text):
            keep = np.ones(batch.num_rows, bool)
            keep[[t for t, *_ in matches(batch.column(text), index.value, *how)]] = False
            yield batch.filter(pa.array(keep))

    return run


def indexes(benchmark: DataFrame, k: int, num_perm: int, max_index_bytes: int):
    """Broadcast item indexes that together cover the benchmark, each of about max_index_bytes of text at most."""
    items = pick(benchmark, item_id="item_id", text="text").dropDuplicates()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // max_index_bytes))
    for part in range(parts):
        own = items if parts == 1 else items.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == part)
        rows = own.orderBy("item_id", "text").collect()
        yield benchmark.sparkSession.sparkContext.broadcast(build_index([r[0] for r in rows], [r[1] for r in rows], k, num_perm)), parts


def find_contaminated(docs: DataFrame, benchmark: DataFrame, k: int = 5, threshold: float = 0.8, num_perm: int = 32, max_index_bytes: int = 32 << 20) -> DataFrame:
    """Every (document, item) pair with at least threshold of the item's distinct k-word shingles in the document.

    docs has doc_id and text, benchmark item_id and text; other columns are ignored. Rows: doc_id, item_id, n_shingles of the
    item, n_shared, containment. One scan of docs without a shuffle of texts; the item index is broadcast. Its size is
    checked: a benchmark with more than max_index_bytes of text is split by hash into parts of that size, each scanned for
    in turn, its rows kept in a checkpoint, so the result is the same at any size.

    Defined results: null and empty texts hold nothing, and items without words are found nowhere. An item of fewer than k
    words is one shingle of all its words, which must stand in the document as they are. Repeated rows, on either side, give
    a pair once. A null doc_id or item_id is carried through as null. Empty tables give an empty result.
    """
    texts = pick(docs, doc_id="doc_id", text="text")
    out = None
    for index, parts in indexes(benchmark, k, num_perm, max_index_bytes):
        found = texts.mapInArrow(scan(index, k, threshold, num_perm), SCHEMA)
        if parts > 1:
            found = cut(found)
            index.unpersist()
        out = found if out is None else out.unionByName(found)
    return out.distinct()


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, k: int = 5, threshold: float = 0.8, num_perm: int = 32, max_index_bytes: int = 32 << 20) -> DataFrame:
    """docs without the rows whose text holds a benchmark item by find_contaminated's rule; all its columns, no shuffle.

    Each row is judged by its own text, so repeated and null doc_ids need no rule; rows with a null or empty text stay.
    """
    at = docs.columns.index("text")
    for index, parts in indexes(benchmark, k, num_perm, max_index_bytes):
        docs = docs.mapInArrow(keep_clean(index, at, k, threshold, num_perm), docs.schema)
        if parts > 1:
            docs = cut(docs)
            index.unpersist()
    return docs
