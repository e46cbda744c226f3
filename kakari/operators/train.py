"""Training of the link model and of the chunk and entity taggers."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kakari.functions.patterns import PosSet, posset
from kakari.functions.text import let
from kakari.operators import model as m
from kakari.operators.chunks import select
from kakari.operators.entities import entity_rows
from kakari.operators.links import shift_reduce
from kakari.operators.pairs import pair_features
from kakari.operators.sequence import CHUNK_TEMPLATES, ENTITY_TEMPLATES, SequenceModel, chunk_labels, chunk_rows, template_features, train_sequence

EPS, MAX_ITERATIONS = 0.1, 5000
#: Places of ids and pairs that solve() keeps, of 4 bytes each.
MOST_CELLS = 1 << 28


def link_examples(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, src, dst, label, features) of every pair that the pass visits with the gold links: +1 where src links to dst, else -1.

    Rows are sentences at the feature layer with gold links in their chunks. As gold decides every step, the pairs visited follow
    from the links alone: for src, the chunks after it that no unfinished chunk in between keeps from it, up to its head.
    A chunk without a gold link (-1) takes the next one and gives no example, nor counts among children; the last chunk takes all.
    """
    gold = F.transform("chunks", lambda c: c["link"])
    n = F.size("chunks")
    linked = df.where(n >= 2).withColumn("__gold", gold).withColumn("__links", let(F.col("__gold"), lambda g: shift_reduce(F.size(g), lambda s, d: F.lit(-1.0), gold=g)))

    def visited(dst, links):
        # those on the stack when dst comes: linked to nothing before it; from the nearest on, up to the first refusal
        open_ = F.filter(F.reverse(F.sequence(F.lit(0), dst - 1)), lambda s: F.get(links, s)["dst"] >= dst)

        def upto_refusal(o):
            stop = F.array_position(F.transform(o, lambda s: (F.get(links, s)["dst"] != dst)), F.lit(True)).cast("int")
            return F.when(stop > 0, F.slice(o, F.lit(1), stop)).otherwise(o)

        free = F.get(links, dst - 1)["fake"]
        tried = let(open_, upto_refusal)
        return F.when(free & (F.get(links, dst - 1)["dst"] == dst), F.array().cast("array<struct<src:int,dst:int>>")).otherwise(F.transform(tried, lambda s: F.struct(s.cast("int").alias("src"), dst.cast("int").alias("dst"))))

    order = F.when(n > 2, F.sequence(F.lit(1), n - 2)).otherwise(F.array().cast("array<int>"))
    pairs = let(F.col("__links"), lambda links: F.flatten(F.transform(order, lambda dst: visited(dst, links))))

    def example(row, p):
        links, src, dst = row["links"], p["src"], p["dst"]
        # children found before this pair is tried, in order of chunk
        kids = lambda of, before: F.transform(F.filter(links, lambda x: (x["dst"] == of) & ~x["fake"] & before(x)), lambda x: x["src"])
        made = pair_features(row["chunks"], src, dst, kids(src, lambda x: F.lit(True)), kids(dst, lambda x: x["src"] > src))
        return F.struct(src.alias("src"), dst.alias("dst"), F.when(F.get(row["gold"], src) == dst, 1).otherwise(-1).alias("label"), made.alias("features"))

    # examples are made inside the row, so that a sentence isn't copied for each of them
    row = F.struct(F.col("chunks"), F.col("__gold").alias("gold"), F.col("__links").alias("links"))
    rows = linked.select(*keys, let(row, lambda r: F.transform(pairs, lambda p: example(r, p))).alias("__p"))
    return rows.select(*keys, F.explode_outer("__p").alias("__p")).where("__p is not null").select(*keys, "__p.src", "__p.dst", "__p.label", "__p.features")


@dataclass
class Stats:
    errors: int
    loss: float
    bounded: int
    support: int
    objective: float
    iterations: int


def _keys(x: np.ndarray) -> np.ndarray:
    """The ids of an instance and of its pairs, as one sorted array of longs; 0 is the constant."""
    i, j = np.triu_indices(len(x), 1)
    return np.concatenate([[0], x + 1, ((x[i] + 1) << 32) | (x[j] + 1)])


class _LookedUp:
    def __init__(self, x, look_up):
        self.x, self.look_up = x, look_up

    def __getitem__(self, i: int) -> np.ndarray:
        return self.look_up(self.x[i])


def solve(y: np.ndarray, x: list[np.ndarray], cost: float, alpha: np.ndarray | None = None, seed: int = 0, eps: float = EPS, max_iterations: int = MAX_ITERATIONS, most_cells: int = MOST_CELLS) -> tuple[np.ndarray, Stats]:
    """Coefficients of the L1-loss dual with the kernel (common + 1)^2, by coordinate descent over explicit primal weights.

    Bound examples that can't move are set aside until the rest has converged; then all are gone through again. Examples are
    visited in a random order that follows from seed. alpha gives a warm start.

    All examples count. The places of their ids and pairs in w are kept up to most_cells of them, and looked up at each visit beyond, so
    memory follows the distinct pairs and the ids of the examples, not the square of these.
    """
    x = [np.sort(np.asarray(v, np.int64)) for v in x]
    n = len(x)
    names = np.zeros(0, np.int64)
    for k in range(0, n, 1 << 12):
        names = np.union1d(names, np.concatenate([_keys(v) for v in x[k : k + (1 << 12)]]))
    look_up = lambda v: np.searchsorted(names, _keys(v)).astype(np.int32)
    cells = [look_up(v) for v in x] if sum(1 + len(v) * (len(v) + 1) // 2 for v in x) <= most_cells else _LookedUp(x, look_up)
    scale = np.where(names == 0, 1.0, np.where(names >> 32 == 0, 3.0, 2.0))
    w = np.zeros(len(names))
    alpha = np.zeros(n) if alpha is None else np.array(alpha, float)
    for i in np.flatnonzero(alpha):
        w[cells[i]] += y[i] * alpha[i] * scale[cells[i]]
    norm = np.array([(1 + len(v)) ** 2 for v in x], float)
    rng = np.random.default_rng(seed)
    active = np.arange(n)
    margins = np.zeros(n)
    high, low, done = np.inf, -np.inf, 0
    for done in range(1, max_iterations + 1):
        rng.shuffle(active)
        stay = np.ones(len(active), bool)
        top, bottom = -np.inf, np.inf
        for k, i in enumerate(active):
            g = y[i] * w[cells[i]].sum() - 1
            margins[i] = g + 1
            if alpha[i] == 0:
                stay[k] = g <= high
                p = min(g, 0.0)
            elif alpha[i] == cost:
                stay[k] = g >= low
                p = max(g, 0.0)
            else:
                p = g
            if not stay[k]:
                continue
            top, bottom = max(top, p), min(bottom, p)
            if abs(p) > 1e-12:
                new = min(max(alpha[i] - g / norm[i], 0.0), cost)
                w[cells[i]] += (new - alpha[i]) * y[i] * scale[cells[i]]
                alpha[i] = new
        active = active[stay]
        if top - bottom <= eps or not len(active):
            if len(active) == n or not n:
                break
            active, high, low = np.arange(n), np.inf, -np.inf
            continue
        high, low = top if top > 0 else np.inf, bottom if bottom < 0 else -np.inf
    margins = np.array([y[i] * w[cells[i]].sum() for i in range(n)])
    stats = Stats(int((margins < 0).sum()), float(np.maximum(1 - margins, 0).sum()), int((alpha == cost).sum()), int((alpha > 0).sum()), float((alpha * (margins - 2)).sum() / 2), done)
    return alpha, stats


def train_links(df: DataFrame, *keys: str, cost: float = 0.0015, freq: int = 1, tags: str | PosSet = "IPA", seed: int = 0, previous: tuple[DataFrame, DataFrame] | None = None):
    """(params, dic, sv, Stats) of the link model from sentences at the chunk layer with gold links.

    Examples, dictionary and ids are made in Spark over all sentences; coordinate descent is sequential and runs on the driver, over all
    examples, in the order of a hash of their key.
    previous gives a model whose support vectors start as examples with their coefficients.
    """
    ps = posset(tags)
    spark = df.sparkSession
    examples = link_examples(select(df, ps), *keys)
    names = [*keys, "src", "dst"]
    counts = examples.select(F.explode("features").alias("feature")).groupBy("feature").agg(F.count("*").alias("n")).where(F.col("n") >= freq)
    dic = m.ranked(counts, "id", F.col("n").desc(), F.col("feature")).select("feature", "id")
    ids = m.to_ids(examples, dic, *names).join(examples.select(*names, "label"), names)
    rows = ids.where("size(x) > 0").select("label", "x", F.xxhash64(*names).alias("h"), *names).orderBy("h", *names).select("label", "x").toArrow()
    lists = rows.column("x").combine_chunks()
    y, x = rows.column("label").to_numpy().astype(float), np.split(lists.flatten().to_numpy().astype(np.int64), lists.offsets.to_numpy()[1:-1] - lists.offsets[0].as_py()) if len(rows) else []
    start = np.zeros(len(x))
    if previous is not None:
        old_dic, old_sv = previous
        new_sv = spark.createDataFrame([(i, float(label), own.tolist()) for i, (label, own) in enumerate(zip(y, x))], "sv_id int, alpha double, x array<int>")
        dic, every = m.merge((old_dic, old_sv), (dic, new_sv))
        n_old = old_sv.count()
        merged = every.orderBy("sv_id").collect()
        y = np.array([np.sign(r.alpha) or 1.0 for r in merged])
        x = [np.array(r.x, np.int64) for r in merged]
        start = np.array([min(abs(r.alpha), cost) if k < n_old else 0.0 for k, r in enumerate(merged)])
    alpha, stats = solve(y, x, cost, start, seed)
    keep = np.flatnonzero(alpha)
    sv = spark.createDataFrame([(k, float(alpha[i] * y[i]), [int(v) for v in x[i]]) for k, i in enumerate(keep)], "sv_id int, alpha double, x array<int>")
    dic, sv = m.rerank(*m.compress(dic, sv))
    return {"model_type": "svm", "degree": "2", "posset": ps.name, "cost": str(cost)}, dic, m.sort_instances(sv), stats


def train_chunker(df: DataFrame, tags: str | PosSet = "IPA", epochs: int = 5) -> SequenceModel:
    """The chunk tagger from sentences with tokens and chunks."""
    ps = posset(tags)
    rows = df.where(F.size("tokens") > 0).select(let(chunk_rows(F.col("tokens"), ps.levels), lambda r: template_features(r, ["surface", "pos"], CHUNK_TEMPLATES)).alias("features"), chunk_labels(F.col("chunks")).alias("tags"))
    return train_sequence(rows, ["B", "I"], epochs)


def train_entities(df: DataFrame, tags: str | PosSet = "IPA", epochs: int = 5) -> SequenceModel:
    """The entity tagger from sentences whose tokens all have tags; runs of numerals are one row, with the tag of their first token."""
    made = df.where((F.size("tokens") > 0) & F.forall("tokens", lambda t: t["ne"].isNotNull())).withColumn("__rows", entity_rows(F.col("tokens"), tags))
    rows = made.select(template_features(F.col("__rows"), ["surface", "shape", "pos"], ENTITY_TEMPLATES).alias("features"), F.transform("__rows", lambda r: r["ne"]).alias("tags"))
    labels = sorted(r[0] for r in rows.select(F.explode("tags")).distinct().collect())  # a few tags
    return train_sequence(rows, labels, epochs)
