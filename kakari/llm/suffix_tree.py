"""Language-model scores by a probabilistic suffix tree over the bytes and words of the texts.

Short contexts are the up to `depth` bytes before a byte. One is a state of the tree if it makes up at least p_min of all
positions and its next-symbol distribution diverges from that of its suffix: n * KL(P_s || P_suffix) >= strength * ln(N),
N being the number of positions; the suffixes of a state are states too, and so is the empty context. A state's
distribution is smoothed towards its suffix's, (n(s, x) + mu * P(x | suffix)) / (n(s) + mu), the root's towards the uniform
one over 256 bytes; symbols seen fewer than q_min * N times after a state are left to its suffix with their share. So there are at
most depth / p_min + 1 short states with (depth + 1) / q_min symbols, whatever the input, which bounds what is broadcast.

Long contexts are the `run` words before a word (a word with the blanks after it counts as one symbol there). Nothing bounds
their number, which grows with the texts. One is a state if it occurs min_count times or more and diverges from what the short
states say: the sum over its occurrences of ln(P_without / P_short) is gain or more, P_without being its smoothed
distribution without that occurrence. Its distribution is smoothed towards theirs in the same way. A word is scored in its long context if that is
a state, else byte by byte in the longest suffix of what precedes each byte that is a state.

Counts are taken over every position of every text. Short ones follow from one gram table, summed in Spark. The long contexts'
occurrences are shuffled once by a hash of the context, packed into arrays of some bytes each; every shard counts, tests
and scores its own contexts, and only the sums of each text go back, to be added to the short states' by block of texts. Equal texts of a
block are sent once with their number, so a group of copies costs as many rows as it has blocks. Contexts are told apart by 32 bits in a
shard, symbols by 16 in a context.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kakari.llm.grams import gram_counts
from kakari.llm.kernels import Table, U, blocks, flat, gram_keys, mix, owners, powers, segment_sum
from kakari.llm.util import cut, pick


def mask(n: int) -> int:
    return (1 << (8 * n)) - 1


def state_rows(grams: DataFrame, total: int, depth: int, p_min: float, strength: float, q_min: float) -> DataFrame:
    """(d, ctx, sym, n, total): the next-symbol counts of every state, d being its length, total its own count; of the total number of positions."""
    bar = strength * np.log(max(total, 2))
    levels = []
    for d in range(depth + 1):
        own = grams.select(F.expr(f"shiftright(gram, 8) & {mask(d)}L").alias("ctx"), F.expr("gram & 255").alias("sym"), "n")
        levels.append(own.groupBy("ctx", "sym").agg(F.sum("n").alias("n")))
    passed = None
    for d in range(depth, 0, -1):
        sums = levels[d].groupBy("ctx").agg(F.sum("n").alias("total")).where(F.col("total") >= p_min * total)
        rows = levels[d].join(sums, "ctx").withColumn("suffix", F.expr(f"ctx & {mask(d - 1)}L"))
        up = levels[d - 1].select(F.col("ctx").alias("suffix"), "sym", F.col("n").alias("up_n"))
        up_sums = levels[d - 1].groupBy(F.col("ctx").alias("suffix")).agg(F.sum("n").alias("up_total"))
        gain = F.sum(F.col("n") * F.log(F.col("n") / F.col("total") / (F.col("up_n") / F.col("up_total"))))
        good = rows.join(up, ["suffix", "sym"]).join(up_sums, "suffix").groupBy("ctx").agg(gain.alias("gain")).where(F.col("gain") >= bar).select(F.lit(d).alias("d"), "ctx")
        if passed is not None:
            good = good.unionByName(passed.where(F.col("d") == d + 1).select(F.lit(d).alias("d"), F.expr(f"ctx & {mask(d)}L").alias("ctx"))).distinct()
        passed = good if passed is None else passed.unionByName(good)
        passed = cut(passed)
    out = levels[0].withColumn("d", F.lit(0))
    for d in range(1, depth + 1):
        own = passed.where(F.col("d") == d).select("ctx")
        out = out.unionByName(levels[d].join(own, "ctx").withColumn("d", F.lit(d)))
    sums = out.groupBy("d", "ctx").agg(F.sum("n").alias("total"), F.max("n").alias("most"))
    kept = out.join(sums, ["d", "ctx"]).where((F.col("n") >= q_min * total) | (F.col("n") == F.col("most")))
    return kept.select("d", "ctx", "sym", "n", "total")


class Tree:
    """The states and their smoothed distributions, ready for whole arrays of contexts."""

    def __init__(self, d: np.ndarray, ctx: np.ndarray, sym: np.ndarray, n: np.ndarray, total: np.ndarray, depth: int, mu: float, positions: int = 0):
        self.depth, self.tables, self.floors, self.probs, self.pairs, self.up, self.positions = depth, [], [], [], [], [], positions
        for level in range(depth + 1):
            own = d == level
            c, s, k = ctx[own].astype(U), sym[own].astype(U), n[own].astype(float)
            states, first, at = np.unique(c, return_index=True, return_inverse=True)
            whole = total[own][first].astype(float)
            rest = whole - np.bincount(at, k, minlength=len(states)) + mu
            if level:
                base = self.prob(level - 1, self.tables[level - 1].find(states & U(mask(level - 1)))[at], s)
            else:
                base = np.full(len(s), 1 / 256)
            self.tables.append(Table(states))
            self.floors.append(rest / (whole + mu))
            self.pairs.append(Table((at.astype(U) << U(8)) | s))
            self.probs.append((k + rest[at] * base) / (whole[at] + mu))
            self.up.append(self.tables[level - 1].find(states & U(mask(level - 1))) if level else None)

    def prob(self, level: int, state: np.ndarray, sym: np.ndarray) -> np.ndarray:
        """P(sym | state); what a state has not seen, its suffix answers for with the state's share of mu."""
        row = self.pairs[level].find((state.astype(U) << U(8)) | sym)
        out = self.probs[level][row] if len(self.probs[level]) else np.zeros(len(row))
        miss = np.flatnonzero(row < 0)
        if len(miss):
            if len(self.floors[level]) == 0:
                out[miss] = 1 / 256
            else:
                out[miss] = self.floors[level][state[miss]] * (self.prob(level - 1, self.up[level][state[miss]], sym[miss]) if level else 1 / 256)
        return out

    def score(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ln P of each gram's lowest byte after the bytes above it, and the length of the state used."""
        logs, used = np.zeros(len(grams)), np.zeros(len(grams), np.int8)
        sym, ctx, todo = grams & U(255), grams >> U(8), np.arange(len(grams))
        for level in range(self.depth, -1, -1):
            state = self.tables[level].find(ctx[todo] & U(mask(level)))
            hit = state >= 0 if level else np.ones(len(todo), bool)
            at = todo[hit]
            logs[at] = np.log(self.prob(level, state[hit], sym[at]))
            used[at] = level
            todo = todo[~hit]
        return logs, used


def pieces(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of each text, each with the blanks after it: hash, first byte, and the texts' offsets into them."""
    data, at = flat(texts)
    inside = data > 32
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    before = np.append(False, inside[:-1]) if len(data) else inside
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    offsets = np.searchsorted(start, at)
    end = np.minimum(np.append(start[1:], len(data)), np.repeat(at[1:], np.diff(offsets)))
    up, down = powers(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, U)
        np.cumsum((data.astype(U) + U(1)) * up[: len(data)], out=sums[1:])
        return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U), 3), start, offsets


def contexts(texts: pa.Array, logs: np.ndarray, run: int) -> tuple[np.ndarray, ...]:
    """For each word with `run` words before it: text, hash of these, hash of it, and its log-probability, logs being those of the bytes."""
    h, start, offsets = pieces(texts)
    text = owners(offsets)
    sums = np.concatenate([[0], np.cumsum(logs)])
    _, at = flat(texts)
    end = np.minimum(np.append(start[1:], len(logs)), at[1:][text])
    base = sums[end] - sums[start]
    own = np.flatnonzero(np.arange(len(h)) - offsets[:-1][text] >= run)
    ctx = np.zeros(len(own), U)
    for j in range(run, 0, -1):
        ctx = mix(ctx ^ h[own - j], 13)
    return text[own], ctx, h[own], base[own]


FLUSH_POSITIONS, FLUSH_TEXTS = 2_000_000, 60_000
#: Of text scored at a time: its arrays take some hundred times as much memory.
EMIT_BYTES = 512 << 10
CELL = np.dtype([("ctx", "<u4"), ("sym", "<u2"), ("base", "<f2"), ("text", "<u2")])
COPIES = np.dtype([("text", "<u2"), ("n", "<u4")])
KEYS = ["shard", "block", "text", "doc_id", "n", "total", "deep", "cells", "copies"]


def emit(tree, depth: int, run: int, shards: int):
    """The mapInArrow function over (doc_id, h, text): for each text its short states' score (shard < 0), and for each shard the cells of a block of texts."""

    def going(held: list, docs: list, number: int):
        block = (TaskContext.get().partitionId() << 32) | number
        kind = docs[0][0].type
        n = sum(len(d[0]) for d in docs)
        columns = [pa.array(np.full(n, -1 - block % shards)), pa.array(np.full(n, block)), *(pa.concat_arrays([d[c] for d in docs]) for c in (1, 0, 2, 3, 4)), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, KEYS)
        if not held:
            return
        shard, cell, copies = (np.concatenate(x) for x in zip(*held))
        held.clear()
        order = np.argsort(shard, kind="stable")
        shard, cell = shard[order], cell[order]
        del order
        edge = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(shard) else np.zeros(0, np.int64)
        cells, several = [], []
        for part in np.split(cell, edge[1:]) if len(edge) else []:
            cells.append(part.tobytes())
            several.append(copies[np.isin(copies["text"], part["text"])].tobytes() if len(copies) else b"")
        n = len(edge)
        none = [pa.nulls(n, t) for t in (pa.int32(), kind, pa.int64(), pa.float64(), pa.float64())]
        yield pa.RecordBatch.from_arrays([pa.array(shard[edge].astype(np.int64)), pa.array(np.full(n, block)), *none, pa.array(cells, pa.binary()), pa.array(several, pa.binary())], KEYS)

    def run_(batches):
        held, docs, texts, positions, number = [], [], 0, 0, 0
        for batch in blocks(batches, 2, EMIT_BYTES):
            if docs and (positions > FLUSH_POSITIONS or texts + batch.num_rows > FLUSH_TEXTS):
                yield from going(held, docs, number)
                held, docs, texts, positions, number = [], [], 0, 0, number + 1
            for at in range(0, batch.num_rows, FLUSH_TEXTS):
                part = batch.slice(at, FLUSH_TEXTS)
                if at:
                    yield from going(held, docs, number)
                    held, docs, texts, positions, number = [], [], 0, 0, number + 1
                _, first, own, copies = np.unique(part.column(1).to_numpy(), return_index=True, return_inverse=True, return_counts=True)
                column = part.column(2).take(pa.array(first))
                grams, offsets = gram_keys(column, depth + 1)
                distinct, back = np.unique(grams, return_inverse=True)
                del grams
                logs, used = tree.value.score(distinct)
                logs, used = logs[back], used[back].astype(np.int32)
                del distinct, back
                text, ctx, sym, base = contexts(column, logs, run)
                cell = np.empty(len(text), CELL)
                cell["ctx"], cell["sym"], cell["base"], cell["text"] = ctx & U(0xFFFFFFFF), sym & U(0xFFFF), base, text + texts
                many = np.flatnonzero(copies > 1)
                extra = np.empty(len(many), COPIES)
                extra["text"], extra["n"] = many + texts, copies[many]
                held.append((((ctx >> U(32)) % U(shards)).astype(np.int32), cell, extra))
                mine = pa.array((own + texts).astype(np.int32))
                docs.append((part.column(0), mine, *(pa.array(x[own]) for x in (np.diff(offsets), segment_sum(logs, offsets), segment_sum(used, offsets).astype(float)))))
                texts += len(first)
                positions += len(text)
        if docs:
            yield from going(held, docs, number)

    return run_


def weigh(mu: float, min_count: int, gain: float):
    """The applyInArrow function over a shard: the rows of texts as they are; for each block, what the long states add to its texts."""

    def run(table: pa.Table) -> pa.Table:
        names = ["block", "text", "doc_id", "n", "total", "deep", "texts", "adds"]
        table = table.combine_chunks()
        n = table.num_rows
        empty = pa.nulls(n, pa.binary())
        if not n or table.column("shard")[0].as_py() < 0:
            return pa.table([*(table.column(c) for c in names[:6]), empty, empty], names=names)
        parts = [np.frombuffer(x, CELL) for x in table.column("cells").to_pylist()]
        cell = np.concatenate(parts)
        row = np.repeat(np.arange(n, dtype=np.int32), [len(x) for x in parts])
        weight = np.ones(len(cell))
        edges = np.cumsum([0] + [len(x) for x in parts])
        for i, x in enumerate(table.column("copies").to_pylist()):
            if x:
                some = np.frombuffer(x, COPIES)
                lookup = np.ones(1 << 16)
                lookup[some["text"]] = some["n"]
                weight[edges[i] : edges[i + 1]] = lookup[parts[i]["text"]]
        del parts
        key = (cell["ctx"].astype(U) << U(16)) | cell["sym"]
        order = np.argsort(key)
        key, base, w = key[order], cell["base"][order].astype(float), weight[order]
        new = np.append(True, key[1:] != key[:-1])
        pair = np.cumsum(new) - 1
        state_new = np.append(True, (key[1:] >> U(16)) != (key[:-1] >> U(16)))
        state = np.cumsum(state_new) - 1
        del key, new, state_new, weight
        seen, whole = np.bincount(pair, w)[pair], np.bincount(state, w)[state]
        low = np.exp(base)
        apart = np.log((seen - 1 + mu * low) / (whole - 1 + mu)) - base
        good = ((whole >= min_count) & (np.bincount(state, w * np.where(whole > 1, apart, 0))[state] >= gain))
        at = np.flatnonzero(good)
        add = np.log((seen[at] + mu * low[at]) / (whole[at] + mu)) - base[at]
        to = row[order[at]].astype(np.int64) << 16 | cell["text"][order[at]]
        where, back = np.unique(to, return_inverse=True)
        sums = np.empty(len(where), [("add", "<f8"), ("n", "<u4")])
        sums["add"], sums["n"] = np.bincount(back, add, minlength=len(where)), np.bincount(back, minlength=len(where))
        cuts = np.searchsorted(where >> 16, np.arange(n + 1))
        some = np.flatnonzero(np.diff(cuts))
        texts = [(where[cuts[i] : cuts[i + 1]] & 0xFFFF).astype("<u2").tobytes() for i in some]
        adds = [sums[cuts[i] : cuts[i + 1]].tobytes() for i in some]
        none = [pa.nulls(len(some), table.column(c).type) for c in names[1:6]]
        return pa.table([table.column("block").take(pa.array(some)), *none, pa.array(texts, pa.binary()), pa.array(adds, pa.binary())], names=names)

    return run


def add_up(table: pa.Table) -> pa.Table:
    """The applyInArrow function over a block: its texts' scores."""
    table = table.combine_chunks()
    own = table.filter(table.column("text").is_valid())
    add, long = np.zeros(1 << 16), np.zeros(1 << 16, np.int64)
    for texts, adds in zip(table.column("texts").to_pylist(), table.column("adds").to_pylist()):
        if texts:
            sums = np.frombuffer(adds, [("add", "<f8"), ("n", "<u4")])
            at = np.frombuffer(texts, "<u2")
            add[at] += sums["add"]
            long[at] += sums["n"]
    text, n = own.column("text").to_numpy(), own.column("n").to_numpy()
    total = own.column("total").to_numpy() + add[text]
    none = n == 0
    with np.errstate(invalid="ignore", divide="ignore"):
        bits, deep = -total / np.log(2) / n, own.column("deep").to_numpy() / n
    return pa.table([own.column("doc_id"), own.column("n"), pa.array(np.where(none, 0, total)), pa.array(bits, mask=none), pa.array(deep, mask=none), pa.array(long[text])], names=["doc_id", "n_symbols", "log_prob", "bits_per_symbol", "mean_depth", "n_long"])


def train(docs: DataFrame, depth: int = 5, p_min: float = 1e-5, strength: float = 2.0, mu: float = 4.0, q_min: float = 5e-7) -> Tree:
    """The short states of all texts of docs; null and empty texts add nothing, and without any text every byte has 1/256."""
    grams = cut(gram_counts(pick(docs, text="text"), depth + 1))
    total = grams.agg(F.sum("n")).first()[0] or 0
    rows = state_rows(grams, total, depth, p_min, strength, q_min).toArrow()
    return Tree(*(rows.column(c).to_numpy() for c in ("d", "ctx", "sym", "n", "total")), depth, mu, total)


def score(docs: DataFrame, tree: Tree, run: int = 3, min_count: int = 2, gain: float = 4.0, mu_long: float = 1.0, bytes_per_shard: int = 12 << 20) -> DataFrame:
    """One row for each row of docs: doc_id, n_symbols (bytes), log_prob (natural), bits_per_symbol, mean_depth of the short states, n_long (words scored in long states).

    The short states are tree's; the long ones are those of docs. A null or empty text has 0 symbols, log_prob 0 and null rates.
    Repeated rows and null doc_ids each give their row; other columns are ignored; an empty table gives an empty result. Texts
    of any length are scored whole. A word's log-probability under the short states is carried with 11 bits.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tree)
    kind = dict(docs.dtypes)["doc_id"]
    shards = max(1, -(-tree.positions // bytes_per_shard))
    texts = pick(docs, doc_id="doc_id", text="text").select("doc_id", F.xxhash64("text").alias("h"), "text")
    numbers = f"block long, text int, doc_id {kind}, n long, total double, deep double"
    cells = texts.mapInArrow(emit(shared, tree.depth, run, shards), f"shard long, {numbers}, cells binary, copies binary")
    sums = cells.groupBy("shard").applyInArrow(weigh(mu_long, min_count, gain), f"{numbers}, texts binary, adds binary")
    return sums.groupBy("block").applyInArrow(add_up, f"doc_id {kind}, n_symbols long, log_prob double, bits_per_symbol double, mean_depth double, n_long long")


def score_corpus(docs: DataFrame, **options) -> DataFrame:
    """score() of docs under the tree that train() makes of the same docs."""
    short = {k: v for k, v in options.items() if k in ("depth", "p_min", "strength", "mu", "q_min")}
    return score(docs, train(docs, **short), **{k: v for k, v in options.items() if k not in short})
