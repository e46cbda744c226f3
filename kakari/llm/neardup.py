"""Near-duplicate documents by ProbMinHash, banding and exact verification.

A document is the weighted set of its distinct k-word shingles, the weight being the count. In ProbMinHash every element
sends arrivals of a Poisson process whose rate is its weight to registers chosen at random; a register keeps the element of
its first arrival, so two documents agree in a register with the probability Jaccard similarity J_P of their weighted sets.
Arrivals are made in order of time, and an element stops once its next one lies beyond the time by which every register of
the document is filled.

Texts that are equal, by a 64-bit hash, are one node of the graph, named by the least (doc_id, hash); only nodes have signatures
and meet. Registers are cut into bands, and nodes that agree in a band share a bucket. Buckets aren't compared all against
all: each member is compared with the bucket's least node, by exact J_P. Rounds follow with LEADERS, LEADERS^2, ... members of
each bucket as leaders, each compared with all members that haven't led yet, in parts of PART members, so that no task holds a
large bucket. A member is done only when it has led: one that matched a leader still meets those that didn't. A bucket is done
when all that haven't led lie in one connected component of the pairs found so far, so a group of thousands costs its size,
and one of n unlike documents takes log n rounds. Leaders are taken from every component in turn, and pairs within one are
skipped. In the rounds a pair is verified exactly only if the share of registers in which it agrees lies at most 3.3 standard
deviations below the threshold. No bucket is cut short. The verified edges' connected components are the groups; the least
document of each is its representative.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kakari.llm.kernels import U, blocks, mix, owners, segment_sum, shingles, words
from kakari.llm.util import cut, fresh, pick

NODE = "struct(doc_id, h)"
LEADERS = 8
PART = 16_384


def weighted(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingles of each text, in order of hash, with their counts: text, hash, count."""
    hashes, offsets, _ = shingles(words(texts), k)
    text = owners(offsets)
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    return text[at], hashes[at], np.diff(np.append(at, len(hashes)))


def uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> U(11)).astype(np.float64) + 0.5) * 2.0**-53


def probminhash(text: np.ndarray, elem: np.ndarray, weight: np.ndarray, n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Registers (n, m) of n weighted sets, whose elements come sorted by set, and which sets have any element."""
    out = np.zeros((n, m), U)
    size = np.bincount(text, minlength=n)
    total = np.bincount(text, weight, minlength=n)
    lone = size[text] == 1
    out[text[lone]] = elem[lone, None]
    todo = size > 1
    horizon = m * (np.log(m) + 4) / np.maximum(total, 1)
    while todo.any():
        own = todo[text]
        t, e, w = text[own], elem[own], weight[own]
        state, clock = mix(e, 1), np.zeros(len(t))
        parts = []
        while len(t):
            clock = clock - np.log(uniform(state)) / w
            live = clock < horizon[t]
            t, e, w, clock, state = t[live], e[live], w[live], clock[live], state[live]
            if len(t):
                parts.append((t * m + (mix(state, 2) % U(m)).astype(np.int64), clock, e))
                state = mix(state, 3)
        slot, when, what = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, U))
        order = np.lexsort((what, when))[::-1]
        first = np.zeros(n * m, U)
        filled = np.zeros(n * m, bool)
        first[slot[order]] = what[order]
        filled[slot] = True
        done = todo & filled.reshape(n, m).all(1)
        out[done] = first.reshape(n, m)[done]
        todo &= ~done
        horizon = horizon * 2
    return out, size > 0


def sign(k: int, bands: int, rows: int):
    """The mapInArrow function over (h, text): h, the hash of each band and 16 bits of each register, of the texts with words, once in a block."""

    def run(batches):
        for batch in blocks(batches):
            _, first = np.unique(batch.column(0).to_numpy(), return_index=True)
            batch = batch.take(pa.array(first))
            n, m = batch.num_rows, bands * rows
            registers, some = probminhash(*weighted(batch.column(1), k), n, m)
            keys = np.zeros((n, bands), U)
            for r in range(rows):
                keys = mix(keys ^ registers.reshape(n, bands, rows)[:, :, r], 5)
            keys = mix(keys + np.arange(bands, dtype=U)[None, :], 7)[some]
            own = batch.filter(pa.array(some))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, bands), pa.int32()), pa.array(keys.ravel().view(np.int64)))
            short = np.ascontiguousarray((mix(registers[some], 11) >> U(48)).astype(np.uint16))
            sigs = pa.Array.from_buffers(pa.binary(2 * m), len(short), [None, pa.py_buffer(short.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([own.column(0), lists, sigs], ["h", "bands", "sig"])

    return run


def proposals(least: float):
    """The applyInArrow function over a part of a bucket (key, part, leads, node, label, sig): its leaders paired with all members of another label that agree in `least` of the registers."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        leads = table.column("leads").to_numpy()
        sigs = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint16).reshape(table.num_rows, -1)
        label = table.column("label").to_numpy()
        members, left, right = np.flatnonzero(~leads), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in np.flatnonzero(leads):
            other = members[label[members] != label[i]]
            hit = other[(sigs[other] == sigs[i]).mean(1) >= least]
            left.append(np.full(len(hit), i))
            right.append(hit)
        node = table.column("node")
        return pa.table([node.take(pa.array(np.concatenate(x))) for x in (left, right)], names=["a", "b"])

    return run


def similarity(left: pa.Array, right: pa.Array, k: int) -> np.ndarray:
    """Exact J_P of each pair of texts: over common elements d, the sum of 1 / sum_e max(x_e / x_d, y_e / y_d)."""
    n = len(left)
    a, b = weighted(left, k), weighted(right, k)
    pair, elem = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
    x = np.concatenate([a[2], np.zeros(len(b[2]))])
    y = np.concatenate([np.zeros(len(a[2])), b[2]])
    order = np.lexsort((elem, pair))
    pair, elem, x, y = pair[order], elem[order], x[order], y[order]
    both = np.zeros(len(pair), bool)
    if len(pair) > 1:
        both[:-1] = (pair[1:] == pair[:-1]) & (elem[1:] == elem[:-1])
    y[:-1][both[:-1]] += y[1:][both[:-1]]
    keep = np.ones(len(pair), bool)
    keep[1:] = ~both[:-1]
    pair, x, y = pair[keep], x[keep], y[keep]
    both = both[keep]
    with np.errstate(divide="ignore"):
        order = np.lexsort((x / y, pair))
    pair, x, y, both = pair[order], x[order], y[order], both[order]
    edge = np.searchsorted(pair, np.arange(n + 1))
    upto_x, upto_y = np.concatenate([[0], np.cumsum(x)]), np.concatenate([[0], np.cumsum(y)])
    i = np.flatnonzero(both)
    p = pair[i]
    inner = 1 / ((upto_x[edge[p + 1]] - upto_x[i]) / x[i] + (upto_y[i] - upto_y[edge[p]]) / y[i])
    return np.bincount(p, inner, minlength=n)


def verify(k: int, threshold: float):
    """The mapInArrow function over (a, b, text of a, text of b): a, b and the exact similarity of the pairs that reach threshold."""

    def run(batches):
        for batch in blocks(blocks(batches, 2), 3):
            score = similarity(batch.column(2), batch.column(3), k)
            ok = pa.array(score >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok), pa.array(score).filter(ok)], ["a", "b", "similarity"])

    return run


def few_components(edges: DataFrame) -> DataFrame:
    """components() of so few edges that the driver holds them."""
    up: dict = {}

    def top(x):
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    # null sorts first, as in Spark
    for e in edges.toArrow().to_pylist():
        a, b = (top((e[c]["doc_id"] is not None, e[c]["doc_id"], e[c]["h"])) for c in "ab")
        up[max(a, b)] = min(a, b)
    kind = edges.schema["a"].dataType.simpleString()
    return edges.sparkSession.createDataFrame([(x[1:], top(x)[1:]) for x in list(up)], f"node {kind}, root {kind}")


def components(edges: DataFrame, max_driver: int = 100_000) -> DataFrame:
    """(node, root): the least node of the connected component of every node of edges (a, b), by minimum labels and pointer jumps beyond max_driver edges."""
    edges = cut(edges.select("a", "b"))
    if edges.count() <= max_driver:
        return few_components(edges)
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("root")))
    while True:
        near = both.join(label.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = label.join(near, "node").select("node", F.least("root", "near").alias("next"), "root")
        jump = step.join(label.select(F.col("node").alias("next"), F.col("root").alias("far")), "next")
        new = cut(jump.select("node", F.least("next", "far").alias("root"), (F.least("next", "far") < F.col("root")).alias("moved")))
        label = new.select("node", "root")
        if new.where("moved").isEmpty():
            return label


def merged(labels: DataFrame, new: DataFrame) -> DataFrame:
    """labels (node, root) after the edges new (a, b), which are looked at between components only."""
    a, b = labels.select(F.col("node").alias("a"), F.col("root").alias("ra")), labels.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    between = new.select("a", "b").join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).where("a != b").distinct()
    up = components(between)
    moved = labels.join(up.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return cut(moved.unionByName(up.join(labels.select("node"), "node", "left_anti").select("node", "root")))


def hashed(docs: DataFrame) -> DataFrame:
    return pick(docs, doc_id="doc_id", text="text").select("doc_id", F.xxhash64("text").alias("h"), "text")


def groups(docs: DataFrame, k: int, bands: int, rows: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(node, root) of the nodes that are in a verified pair, and (h, node, n): the node of each text with words and its number of rows."""
    kinds = dict(docs.dtypes)
    kind = f"struct<doc_id:{kinds['doc_id']},h:bigint>"
    texts = hashed(docs)
    signed = texts.select("h", "text").mapInArrow(sign(k, bands, rows), "h long, bands array<long>, sig binary").dropDuplicates(["h"])
    least = texts.select("h", F.expr(NODE).cast(kind).alias("node")).groupBy("h").agg(F.min("node").alias("node"), F.count("*").alias("n"))
    nodes = cut(signed.join(least, "h"))
    band = nodes.select(F.explode("bands").alias("key"), "node")
    lead = band.groupBy("key").agg(F.min("node").alias("lead"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = cut(band.join(lead, "key").where("node != lead"))
    held = first.select(F.explode(F.array("node.h", "lead.h")).alias("h")).distinct()
    held = cut(texts.select("h", "text").join(held, "h", "left_semi").dropDuplicates(["h"]))

    def verified(pairs: DataFrame) -> DataFrame:
        a, b = held.select(F.col("h").alias("ha"), F.col("text").alias("text_a")), held.select(F.col("h").alias("hb"), F.col("text").alias("text_b"))
        full = pairs.join(a, F.col("a.h") == F.col("ha")).join(b, F.col("b.h") == F.col("hb"))
        return cut(full.select("a", "b", "text_a", "text_b").mapInArrow(verify(k, threshold), f"a {kind}, b {kind}, similarity double"))

    def unsettled(members: DataFrame, labels: DataFrame) -> DataFrame:
        """Those of members (key, node) in buckets in which they lie in several components: with label, the component's, and n, their number in the bucket."""
        named = members.join(labels, "node", "left").select("key", "node", F.coalesce("root.h", "node.h").alias("label"))
        mixed = named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n")).where("low != high").select("key", "n")
        return cut(named.join(mixed, "key"))

    tried = cut(first.select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct())
    labels = components(verified(tried))
    rest = unsettled(first.select("key", "node"), labels)
    sigs = nodes.select("node", "sig")
    bar = threshold - 3.3 * (threshold * (1 - threshold) / (bands * rows)) ** 0.5
    leaders = LEADERS
    while not rest.isEmpty():
        # with ranks limited to few, Spark drops the others of a group before it is shuffled
        turns = rest.withColumn("turn", F.row_number().over(Window.partitionBy("key", "label").orderBy("node"))).where(F.col("turn") <= leaders)
        leading = cut(turns.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy("turn", "node"))).where(F.col("place") <= leaders).select("key", "node", "label", "n"))
        last = F.expr(f"int((n - 1) div {PART})")
        every = leading.select("key", F.explode(F.sequence(F.lit(0), last)).alias("part"), F.lit(True).alias("leads"), "node", "label")
        every = every.unionByName(rest.select("key", F.pmod(F.xxhash64("node"), last + 1).cast("int").alias("part"), F.lit(False).alias("leads"), "node", "label"))
        proposed = every.join(sigs, "node").groupBy("key", "part").applyInArrow(proposals(bar), f"a {kind}, b {kind}")
        pair = proposed.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        new = cut(pair.join(tried, ["a", "b"], "left_anti"))
        tried, labels = tried.unionByName(new), merged(labels, verified(new))
        rest = unsettled(rest.select("key", "node").join(leading.select("key", "node"), ["key", "node"], "left_anti"), labels)
        leaders *= LEADERS
    return labels, nodes.select("h", "node", "n")


def survivors(labels: DataFrame, nodes: DataFrame) -> DataFrame:
    """(h, root) of every text that has several rows or a verified pair: the representative of its group."""
    return nodes.join(labels, "node", "left").where("n > 1 or root is not null").select("h", F.coalesce("root", "node").alias("root"))


def find_duplicates(docs: DataFrame, k: int = 5, bands: int = 20, rows: int = 4, threshold: float = 0.6) -> DataFrame:
    """One row for every document that repeats another: doc_id, duplicate_of (the representative of its group).

    docs has doc_id and text; other columns are ignored. A group is a connected component of pairs whose exact probability
    Jaccard similarity reaches threshold. A pair at the threshold shares a band with chance 0.94, one at 0.7 with 0.996. A pair
    that shares one is in one group, unless its registers understate it: after the first round, pairs whose registers
    agree 3.3 standard deviations less than the threshold (one in 2,000 at the threshold, fewer above) aren't verified.

    Defined results: texts without words (null and empty ones too) repeat nothing. Rows that agree in text are
    copies of each other: each but one gives a row that names the representative of the group, which may be its own doc_id.
    Rows that share a doc_id but not their text are different documents. A null doc_id is a value like any other and sorts
    first. Ties: the representative is the least by (doc_id, hash of the text). Empty tables give an empty result.
    """
    own = survivors(*groups(docs, k, bands, rows, threshold))
    rows_ = hashed(docs).groupBy("doc_id", "h").agg(F.count("*").alias("n")).join(own, "h")
    itself = F.col("doc_id").eqNullSafe(F.col("root.doc_id")) & (F.col("h") == F.col("root.h"))
    times = (F.col("n") - F.when(itself, 1).otherwise(0)).alias("times")
    return rows_.select("doc_id", F.col("root.doc_id").alias("duplicate_of"), times).where("times > 0").select("doc_id", "duplicate_of", F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("copy")).drop("copy")


def drop_duplicates(docs: DataFrame, k: int = 5, bands: int = 20, rows: int = 4, threshold: float = 0.6) -> DataFrame:
    """docs with one row of each group of find_duplicates, and with every row that has no words; all its columns.

    Of several rows with the representative's doc_id and text the least by a hash of all columns stays (maps don't count).
    """
    own = survivors(*groups(docs, k, bands, rows, threshold))
    h, other, top = (fresh(docs, c) for c in ("__h", "__other", "__top"))
    named = docs.withColumn(h, F.xxhash64("text")).join(own.select(F.col("h").alias(other), F.col("root").alias(top)), F.col(h) == F.col(other), "left")
    chosen = named.where(F.col(top).isNotNull() & named["doc_id"].eqNullSafe(F.col(f"{top}.doc_id")) & (F.col(h) == F.col(f"{top}.h")))
    plain = [c for c, t in docs.dtypes if "map<" not in t and "variant" not in t]
    w = Window.partitionBy(h).orderBy(F.xxhash64(*(F.col(f"`{c}`") for c in plain)))
    n = fresh(named, "__n")
    one = chosen.withColumn(n, F.row_number().over(w)).where(F.col(n) == 1)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return named.where(F.col(top).isNull()).select(*columns).unionByName(one.select(*columns))
