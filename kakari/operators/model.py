"""The quadratic-kernel model as tables, and its expanded, quantised form.

Tables: dic(feature, id), sv(sv_id, alpha, x) with x the sorted distinct ids of an instance. The score of ids y is
sum(alpha * (|x & y| + 1)^2) over sv. Expanded, it is a constant plus weights of ids and of pairs of ids, whose number
doesn't depend on that of the instances: w0 = sum(alpha), w1 = 3 alpha by id, w2 = 2 alpha by pair. Quantised, weights are
integers, and only display multiplies by the factor.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from kakari.checkpoint import cut

SCALE = 1048575


def ranked(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """df with 0, 1, 2... in a total order, without gathering all rows in one task: a range sort, then offsets by partition."""
    placed = cut(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()))
    sizes = sorted(placed.groupBy(F.shiftright("__at", 33).alias("p")).count().collect())
    offsets, total = [], 0
    for p, n in sizes:
        offsets.append((p, total))
        total += n
    at = F.broadcast(df.sparkSession.createDataFrame(offsets, "__p long, __o long"))  # one row for each partition
    return placed.join(at, F.shiftright("__at", 33) == F.col("__p")).withColumn(name, (F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("__o")).cast("int")).drop("__at", "__p", "__o")


def dictionary(features: DataFrame, column: str = "feature") -> DataFrame:
    """(feature, id, n): ids by frequency, the most frequent first; ties by name."""
    counts = features.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("feature")).agg(F.count("*").alias("n"))
    return ranked(counts, "id", F.col("n").desc(), F.col("feature"))


def dictionary_of(counts: DataFrame) -> DataFrame:
    """dictionary() from partial counts (feature, n), whose features may come several times."""
    return ranked(counts.groupBy("feature").agg(F.sum("n").alias("n")), "id", F.col("n").desc(), F.col("feature"))


#: Tables up to this many bytes are broadcast to the stages that score; larger ones are joined.
MAX_BROADCAST = 128 << 20


def shared_ids(dic: DataFrame, max_broadcast: int = MAX_BROADCAST):
    """A dictionary within max_broadcast bytes as a broadcast dict from feature to id; None for a larger one."""
    if (dic.agg(F.sum(F.octet_length("feature") + 12)).first()[0] or 0) > max_broadcast:
        return None
    table = dic.select("feature", F.col("id").cast("int")).toArrow()
    return dic.sparkSession.sparkContext.broadcast(dict(zip(table.column("feature").to_pylist(), table.column("id").to_pylist())))


def to_ids(rows: DataFrame, dic: DataFrame, *keys: str, features: str = "features", max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """(keys, x): the sorted distinct ids of each row's features; unknown ones are dropped, a row without known ones has an empty x.

    A dictionary within max_broadcast bytes is broadcast and looked up by whole batches, so rows stay where they are. A larger one is
    joined by feature; then keys must tell rows apart.
    """
    size, most = dic.agg(F.sum(F.octet_length("feature") + 12), F.max("id")).first()
    if (size or 0) <= max_broadcast:
        table = dic.select("feature", F.col("id").cast("int")).toArrow()
        shared = dic.sparkSession.sparkContext.broadcast((table.column("feature").combine_chunks(), table.column("id").to_numpy(), (most or 0) + 1))
        names = [*keys, "x"]

        def run(batches):
            known, ids, width = shared.value
            for batch in batches:
                cells, n = batch.column(len(keys)), batch.num_rows
                lengths = pc.fill_null(pc.list_value_length(cells), 0).to_numpy(zero_copy_only=False)
                at = pc.index_in(cells.flatten(), value_set=known)
                found = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
                cell = np.unique(np.repeat(np.arange(n), lengths)[found] * np.int64(width) + ids[at.to_numpy(zero_copy_only=False)[found].astype(np.int64)])
                offsets = np.searchsorted(cell, np.arange(n + 1) * np.int64(width))
                x = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(cell % width, pa.int32()))
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keys))), x], names)

        own = rows.select(*keys, F.col(features).alias("__f"))
        return own.mapInArrow(run, StructType([*own.schema.fields[: len(keys)], StructField("x", ArrayType(IntegerType()))]))
    pieces = rows.select(*keys, F.explode(F.array_distinct(features)).alias("__f"))
    found = pieces.join(dic.select(F.col("feature").alias("__f"), F.col("id").alias("__n")), "__f").groupBy(*keys).agg(F.sort_array(F.collect_set("__n")).alias("x"))
    return rows.select(*keys).join(found, list(keys), "left").withColumn("x", F.coalesce("x", F.array().cast("array<int>")))


def scored(instances: DataFrame, key: str, fields: list[StructField], score) -> DataFrame:
    """(key, fields) of instances (key, x) by score(ids) -> tuple, in the rows' own partitions."""
    names = [key, *(f.name for f in fields)]

    def run(batches):
        for batch in batches:
            x = batch.column(1)
            flat, lengths = x.flatten().to_numpy(zero_copy_only=False), pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(lengths)
            made = [score(flat[e - n : e]) for e, n in zip(ends.tolist(), lengths.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[c] for r in made], to_arrow_type(f.dataType)) for c, f in enumerate(fields))], names)

    own = instances.select(key, "x")
    return own.mapInArrow(run, StructType([own.schema.fields[0], *fields]))


def rerank(dic: DataFrame, sv: DataFrame) -> tuple[DataFrame, DataFrame]:
    """dic and sv with ids by frequency in sv, the most frequent first, ties by descending old id."""
    counts = sv.select(F.explode("x").alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    full = dic.select("id").distinct().join(counts, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))
    new = ranked(full, "new", F.col("n").desc(), F.col("id").desc()).select("id", "new")
    moved = sv.select("sv_id", "alpha", F.explode("x").alias("id")).join(new, "id").groupBy("sv_id", "alpha").agg(F.sort_array(F.collect_list("new")).alias("x"))
    return dic.join(new, "id").select("feature", F.col("new").alias("id")), moved


def compress(dic: DataFrame, sv: DataFrame, least: int = 1) -> tuple[DataFrame, DataFrame]:
    """Only features in at least `least` instances (1 at least), renumbered in the order of their old ids."""
    active = sv.select(F.explode("x").alias("id")).groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") >= max(1, least))
    new = ranked(dic.join(active.select("id"), "id", "left_semi").select("id").distinct(), "new", F.col("id"))
    moved = sv.select("sv_id", "alpha", F.explode_outer("x").alias("id")).join(new, "id").groupBy("sv_id", "alpha").agg(F.sort_array(F.collect_list("new")).alias("x"))
    return dic.join(new, "id").select("feature", F.col("new").alias("id")), moved


def sort_instances(sv: DataFrame) -> DataFrame:
    """sv numbered anew in the order of its id lists, equal ones in their old order."""
    return ranked(sv.withColumnRenamed("sv_id", "__old"), "sv_id", F.col("x"), F.col("__old")).drop("__old").select("sv_id", "alpha", "x")


def merge(old: tuple[DataFrame, DataFrame], new: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Two models over one dictionary: the old one's ids stay, new features follow by name; ids are sorted again."""
    top = old[0].agg(F.max("id")).first()[0]
    fresh = ranked(new[0].join(old[0].select("feature"), "feature", "left_anti"), "__n", F.col("feature")).select("feature", (F.col("__n") + (0 if top is None else top + 1)).alias("id"))
    dic = old[0].select("feature", "id").unionByName(fresh)
    names = new[0].select(F.col("id").alias("was"), "feature").join(dic, "feature").select("was", "id")
    last = old[1].agg(F.max("sv_id")).first()[0]
    moved = new[1].select((F.col("sv_id") + (0 if last is None else last + 1)).alias("sv_id"), "alpha", F.explode("x").alias("was")).join(names, "was").groupBy("sv_id", "alpha").agg(F.sort_array(F.collect_list("id")).alias("x"))
    return dic, old[1].select("sv_id", "alpha", F.sort_array("x").alias("x")).unionByName(moved.select(F.col("sv_id"), "alpha", "x"))


def kernel_scores(instances: DataFrame, sv: DataFrame, key: str = "id", max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """(key, score) of instances (key, x): the sum over sv of alpha * (common + 1)^2.

    Where a square of ids and support vectors has at most max_broadcast cells, it is broadcast, and an instance's common ids with all
    of them are one sum over its rows: no shuffle. Beyond, instances meet only the support vectors that share an id with them, by an equi-join on ids; the rest add alpha each, which
    is a constant. So there is no cross product.
    """
    n, top = sv.agg(F.count("*"), F.coalesce(F.max(F.array_max("x")), F.lit(-1))).first()
    if n * (top + 2) <= max_broadcast:
        table = sv.select("alpha", "x").toArrow()
        square = np.zeros((top + 2, n), np.uint8)
        x = table.column("x").combine_chunks()
        square[x.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(n), pc.list_value_length(x).to_numpy(zero_copy_only=False))] = 1
        shared = sv.sparkSession.sparkContext.broadcast((square, table.column("alpha").to_numpy()))

        def score(ids):
            square, alpha = shared.value
            at = np.minimum(ids, len(square) - 1)
            # sums of up to 255 rows fit a byte, and bytes are added many at a time
            common = np.zeros(square.shape[1], np.int64)
            for a in range(0, len(at), 255):
                common += square[at[a : a + 255]].sum(0, dtype=np.uint8)
            return (float((alpha * (common + 1) ** 2).sum()),)

        return scored(instances, key, [StructField("score", DoubleType())], score)
    base = sv.agg(F.coalesce(F.sum("alpha"), F.lit(0.0)).alias("w0"))
    left = instances.select(key, F.explode("x").alias("f"))
    right = sv.select("sv_id", "alpha", F.explode("x").alias("f"))
    shared = left.join(right, "f").groupBy(key, "sv_id").agg(F.count("*").alias("s"), F.first("alpha").alias("alpha"))
    sums = shared.groupBy(key).agg(F.sum(F.col("alpha") * F.col("s") * (F.col("s") + 2)).alias("more"))
    return instances.select(key).join(sums, key, "left").crossJoin(F.broadcast(base)).select(key, (F.col("w0") + F.coalesce("more", F.lit(0.0))).alias("score"))  # base is one row


def id_pairs(x: Column) -> Column:
    """array<struct<i,j>> of all pairs i < j of a sorted id list."""
    return F.flatten(F.transform(x, lambda a, k: F.transform(F.slice(x, k + 2, F.size(x)), lambda b: F.struct(a.alias("i"), b.alias("j")))))


def expand_bias(sv: DataFrame) -> DataFrame:
    return sv.agg(F.coalesce(F.sum("alpha"), F.lit(0.0)).alias("w0"))


def expand_singles(sv: DataFrame) -> DataFrame:
    """(id, w): three times the sum of alpha over the instances with the id."""
    return sv.select("alpha", F.explode("x").alias("id")).groupBy("id").agg(F.sum(3 * F.col("alpha")).alias("w"))


def expand_pairs(sv: DataFrame) -> DataFrame:
    """(i, j, n, w): twice the sum of alpha over the n instances with both ids; partial sums are taken before the shuffle."""
    return sv.select("alpha", F.explode(id_pairs(F.col("x"))).alias("p")).groupBy("p.i", "p.j").agg(F.count("*").alias("n"), F.sum(2 * F.col("alpha")).alias("w"))


def prune_pairs(pairs: DataFrame, sv: DataFrame, sigma: float, minsup: int, frequent: int) -> DataFrame:
    """Pairs of two ids below `frequent` stay; others need minsup instances and a weight beyond sigma, scaled by each side's share."""
    share = sv.agg(F.count_if(F.col("alpha") > 0).alias("p"), F.count("*").alias("all")).select((F.lit(sigma) * F.col("p") / F.col("all")).alias("up"), (-F.lit(sigma) * (F.col("all") - F.col("p")) / F.col("all")).alias("down"))
    known = (F.col("i") < frequent) & (F.col("j") < frequent)
    return pairs.crossJoin(F.broadcast(share)).where(known | ((F.col("n") >= minsup) & ((F.col("w") <= F.col("down")) | (F.col("w") >= F.col("up"))))).drop("up", "down")  # share is one row


def quantise(w0: DataFrame, w1: DataFrame, w2: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Integer weights, truncated toward zero, and factor: (w0, factor), (id, w), (i, j, w). Weights of 0 are left out."""
    top = w1.select(F.abs("w").alias("a")).unionByName(w2.select(F.abs("w").alias("a"))).agg((F.max("a") / SCALE).alias("factor"))
    factor = F.broadcast(top.select(F.when(F.col("factor") > 0, F.col("factor")).otherwise(1.0).alias("factor")))  # one row
    whole = lambda c: (F.col(c) / F.col("factor")).cast("int")
    return (
        w0.crossJoin(factor).select(whole("w0").alias("w0"), "factor"),
        w1.crossJoin(factor).select("id", whole("w").alias("w")).where("w <> 0"),
        w2.crossJoin(factor).select("i", "j", whole("w").alias("w")).where("w <> 0"),
    )


class Weights:
    """Quantised weights for whole id arrays: those of ids, of pairs of the first `square` ids in a square, of other pairs by their first id."""

    def __init__(self, w0: int, factor: float, ids: np.ndarray, w: np.ndarray, i: np.ndarray, j: np.ndarray, v: np.ndarray, square: int = 2048):
        n = int(max(ids.max(initial=-1), j.max(initial=-1))) + 2
        self.w0, self.factor, self.one, self.side = w0, factor, np.zeros(n, np.int64), min(square, n)
        self.one[ids] = w
        self.square = np.zeros((self.side, self.side), np.int32)
        hot = j < self.side
        self.square[i[hot], j[hot]] = v[hot]
        order = np.argsort(i[~hot], kind="stable")
        self.j, self.v = j[~hot][order], v[~hot][order].astype(np.int64)
        self.edge = np.searchsorted(i[~hot][order], np.arange(n + 1))

    def score(self, x: np.ndarray) -> tuple[int, float]:
        x = x[x < len(self.one)]
        low = x[: np.searchsorted(x, self.side)]
        total = self.w0 + int(self.one[x].sum()) + int(self.square[np.ix_(low, low)].sum(dtype=np.int64))
        if len(self.j) and len(x):
            first, size = self.edge[x], self.edge[x + 1] - self.edge[x]
            at = np.arange(size.sum()) + np.repeat(first - np.cumsum(size) + size, size)
            own = np.zeros(len(self.one), bool)
            own[x] = True
            total += int(self.v[at][own[self.j[at]]].sum())
        return total, total * self.factor


def expanded_scores(instances: DataFrame, q0: DataFrame, q1: DataFrame, q2: DataFrame, key: str = "id", max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """(key, score, scaled) of instances (key, x): integer sums of the quantised weights, and the sum times the factor.

    Weights of at most max_broadcast bytes, 16 for a pair, are broadcast, and rows are scored where they are; larger ones are joined.
    """
    if 16 * (q1.count() + q2.count()) <= max_broadcast:
        first = q0.first()
        one, two = q1.toArrow(), q2.toArrow()
        column = lambda t, c: t.column(c).to_numpy().astype(np.int64)
        shared = q0.sparkSession.sparkContext.broadcast(Weights(first["w0"], first["factor"], column(one, "id"), column(one, "w"), column(two, "i"), column(two, "j"), column(two, "w")))
        return scored(instances, key, [StructField("score", LongType()), StructField("scaled", DoubleType())], lambda x: shared.value.score(x))
    ids = instances.select(key, F.explode("x").alias("__f"))
    one = ids.join(q1, ids["__f"] == q1["id"]).select(ids[key], F.col("w").cast("long").alias("w"))
    two = instances.select(key, F.explode(id_pairs(F.col("x"))).alias("p")).select(key, "p.i", "p.j").join(q2, ["i", "j"]).select(key, F.col("w").cast("long").alias("w"))
    sums = one.unionByName(two).groupBy(key).agg(F.sum("w").alias("more"))
    return instances.select(key).join(sums, key, "left").crossJoin(F.broadcast(q0)).select(key, (F.col("w0") + F.coalesce("more", F.lit(0))).alias("score"), ((F.col("w0") + F.coalesce("more", F.lit(0))) * F.col("factor")).alias("scaled"))


@dataclass
class PairModel:
    """A compiled model in memory, for the link stage: ids of features, integer weights, and how to display a score.

    Pairs of the `frequent` first ids are in a square array, the others in a map.
    """

    ids: dict[str, int]
    w0: int
    w1: np.ndarray
    square: np.ndarray
    rare: dict[tuple[int, int], int]
    factor: float
    params: dict[str, str] = field(default_factory=dict)

    @classmethod
    def compile(cls, dic: DataFrame, sv: DataFrame, sigma: float = 0.0001, minsup: int = 2, frequent: int = 3000, params: dict[str, str] | None = None) -> PairModel:
        """From the tables: expansion, pruning and quantising run in Spark; what is kept is fetched. Its size follows the model, not the corpus."""
        pairs = prune_pairs(expand_pairs(sv), sv, sigma, minsup, frequent)
        q0, q1, q2 = quantise(expand_bias(sv), expand_singles(sv), pairs)
        ids = {r.feature: r.id for r in dic.select("feature", "id").toLocalIterator()}
        return cls.of(ids, q0.first(), q1.toLocalIterator(), q2.toLocalIterator(), min(frequent, len(ids)), params)

    @classmethod
    def of(cls, ids, q0, q1, q2, frequent: int, params: dict[str, str] | None = None) -> PairModel:
        w1, square, rare = np.zeros(max(ids.values(), default=-1) + 1, np.int64), np.zeros((frequent, frequent), np.int32), {}
        for r in q1:
            w1[r.id] = r.w
        for r in q2:
            if r.j < frequent:
                square[r.i, r.j] = r.w
            else:
                rare[r.i, r.j] = r.w
        return cls(ids, q0.w0, w1, square, rare, q0.factor, params or {})

    def score(self, features) -> float:
        """The score of a set of features; unknown ones are ignored."""
        own = np.array(sorted({self.ids[f] for f in features if f in self.ids}), np.int64)
        low = own[own < len(self.square)]
        total = self.w0 + int(self.w1[own].sum()) + int(self.square[np.ix_(low, low)].sum(dtype=np.int64))
        if self.rare:
            high = own[len(low) :].tolist()
            every = own.tolist()
            total += sum(self.rare.get((i, j), 0) for at, j in enumerate(high) for i in every[: len(low) + at])
        return total * self.factor

    def check(self, **wanted: str) -> PairModel:
        """Itself, if it was made for the wanted parameters (tag set and the like); else ValueError."""
        for key, value in wanted.items():
            if self.params.get(key, value) != value:
                raise ValueError(f"the model was made for {key} {self.params[key]}, not {value}")
        return self
