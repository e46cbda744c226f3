"""Best-fit packing of documents into sequences of several permitted lengths.

Documents are measured in tokens, by default blank-separated words. A document longer than the largest length is cut into
pieces of that length, the last one shorter; nothing is dropped. Pieces are packed in decreasing order: each goes to the
open bin, of whatever size, that it fits most tightly. If none has room, a bin is opened of the size whose cost for each
token that can still go into it is least: cost(size) / min(size, tokens not yet placed). When all are placed, each bin is
downsized to the cheapest permitted length that holds its contents. A sequence of s tokens costs s + overhead by default.

Packing runs in groups of about group_rows pieces, chosen by hash, in parallel; a group loses a few part-filled bins at most.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kakari.llm.util import cut

SIZES = (512, 1024, 2048, 4096)
NAMES = ["seq_id", "seq_len", "n_used", "seq_offset", "doc_id", "piece", "doc_start", "n_tokens"]


def words_of(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0))


def pack(lengths: list[int], costs: dict[int, float]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """For lengths in decreasing order, (bin, offset) of each, and (final size, tokens) of each bin."""
    sizes = sorted(costs)
    left = sum(lengths)
    free: dict[int, list[int]] = {}
    rooms = 0  # bit r is set if some bin has r free
    used: list[int] = []
    size_of: list[int] = []
    placed = []
    for n in lengths:
        fit = rooms >> n
        if fit:
            room = n + (fit & -fit).bit_length() - 1
            own = free[room].pop()
            if not free[room]:
                rooms ^= 1 << room
        else:
            room = min((s for s in sizes if s >= n), key=lambda s: (costs[s] / min(s, left), s))
            own = len(used)
            used.append(0)
            size_of.append(room)
        placed.append((own, used[own]))
        used[own] += n
        left -= n
        if room > n:
            free.setdefault(room - n, []).append(own)
            rooms |= 1 << (room - n)
    return placed, [(min((s for s in sizes if s >= u), key=lambda s: (costs[s], s)), u) for u in used]


def packer(costs: dict[int, float]):
    """The applyInArrow function over one group."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("n_tokens", "descending"), ("doc_id", "ascending"), ("doc_start", "ascending"), ("h", "ascending")])
        placed, bins = pack(table.column("n_tokens").to_pylist(), costs)
        base = table.column("part")[0].as_py() << 32 if table.num_rows else 0
        own = [pa.array([base + b for b, _ in placed], pa.int64()), pa.array([bins[b][0] for b, _ in placed], pa.int32()), pa.array([bins[b][1] for b, _ in placed], pa.int32()), pa.array([o for _, o in placed], pa.int32())]
        return pa.table([*own, *(table.column(c) for c in NAMES[4:])], names=NAMES)

    return run


def pack_documents(docs: DataFrame, sizes: tuple[int, ...] = SIZES, overhead: float = 128, costs: dict[int, float] | None = None, length: Column | None = None, group_rows: int = 20_000) -> DataFrame:
    """One row for each piece: seq_id, seq_len (the bin's final size), n_used of it, seq_offset, doc_id, piece, doc_start, n_tokens.

    docs has doc_id and text; other columns are ignored. costs gives the permitted sizes their costs instead of s + overhead.
    Defined results: documents without tokens (null and empty texts too) fill nothing and give no row. Repeated rows and null
    doc_ids are packed like any other; ties in length go by doc_id (nulls last), start and hash of the text. The number of groups follows
    from the number of pieces, so the packing depends on the rows alone, not on how they are partitioned. An empty table
    gives an empty result.
    """
    costs = costs or {s: s + overhead for s in sizes}
    top = max(costs)
    kind = dict(docs.dtypes)["doc_id"]
    n = length if length is not None else words_of()
    measured = docs.select("doc_id", F.xxhash64("text").alias("h"), n.cast("int").alias("n")).where("n > 0")
    pieces = measured.select("doc_id", "h", "n", F.posexplode(F.sequence(F.lit(0), F.expr(f"n - 1"), F.lit(top))).alias("piece", "doc_start"))
    pieces = cut(pieces.select("doc_id", "h", "piece", "doc_start", F.least(F.col("n") - F.col("doc_start"), F.lit(top)).alias("n_tokens")))
    parts = max(1, -(-pieces.count() // group_rows))
    grouped = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "h", "piece"), F.lit(parts)))
    return grouped.groupBy("part").applyInArrow(packer(costs), f"seq_id long, seq_len int, n_used int, seq_offset int, doc_id {kind}, piece int, doc_start int, n_tokens int")
