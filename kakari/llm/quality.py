"""Quality classifier: interpolated modified Kneser-Ney over bytes, trained on trusted text.

Trusted documents are those labelled quality 1 and toxic 0. All of them are used, and split in each language by hash of doc_id:
half trains the model, half is held out, as bounds must come from documents that the model hasn't seen. Counts, continuation
counts, context sums and the interpolated probabilities are joins and sums in Spark, sharded by gram; the resulting table, which
grows with the distinct grams of the texts, is broadcast up to max_model_rows rows, beyond which documents' distinct grams are
joined with it by shuffle instead. Likewise the labelled doc_ids, up to max_broadcast_docs, are sent to where the texts are;
beyond that a bitmap leaves few other texts to be shuffled.
A document's perplexity is per byte. Its language's bounds come from the held-out documents: the quantiles low and high of
their log-perplexity, widened by slack times the distance between the quantiles and the median, and, as the mean over a short
text scatters more, by z * sigma / sqrt(bytes), sigma being the held-out spread of one byte. Outside, it is rejected.

A mean over a document dilutes a few insults away, so each word is looked at as well. A second model of the same kind is trained
on the documents labelled toxic, split alike; a word's contrast is its log-probability under that model less
that under the trusted one, and a document's is that of its worst word. It is rejected above its language's bar: the quantile
high of the held-out trusted documents' contrasts, widened by slack as above, and, where the quantile low of held-out toxic
documents lies higher still, halfway to it.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kakari.llm.grams import gram_counts
from kakari.llm.kernels import Table, U, blocks, flat, gram_keys, segment_sum
from kakari.llm.util import cut, fresh, pick

ORDER = 5


def mask(n: int) -> int:
    return (1 << (8 * n)) - 1


TRUSTED, TOXIC = "quality = 1 and toxic = 0", "toxic = 1"
#: Toxic documents are few, so one in four of them is held out, against one in two of the trusted ones.
HELD_TOXIC = 4


def labelled_sample(docs: DataFrame, labels: DataFrame, which: str, max_docs_per_lang: int | None = None, one_in: int = 2) -> DataFrame:
    """(doc_id, lang, held): all documents with such a label, or the first max_docs_per_lang of each language by hash of doc_id; one in one_in of each language is held out.

    Ranks are taken inside ranges of hashes, to which the sizes of the ranges before are added, so no task sees a whole language.
    """
    good = labels.where(which).select("doc_id").distinct()
    known = pick(docs, doc_id="doc_id", lang="lang").where("doc_id is not null").groupBy("doc_id").agg(F.min("lang").alias("lang")).join(good, "doc_id")
    known = known.select("doc_id", "lang", F.expr("shiftright(xxhash64(doc_id), 54)").alias("range"))
    before = Window.partitionBy("lang").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = known.groupBy("lang", "range").count().select(F.col("lang").alias("of"), F.col("range").alias("at"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("lang", "range").orderBy(F.xxhash64("doc_id"), "doc_id")
    placed = known.withColumn("place", F.row_number().over(inside)).join(sizes, F.col("lang").eqNullSafe(F.col("of")) & (F.col("range") == F.col("at")))
    ranked = placed.select("doc_id", "lang", (F.col("before") + F.col("place")).alias("rank"))
    if max_docs_per_lang is not None:
        ranked = ranked.where(F.col("rank") <= max_docs_per_lang)
    return ranked.select("doc_id", "lang", (F.col("rank") % one_in == 0).alias("held"))


def perhaps_among(rows: DataFrame, known: DataFrame, bits: int = 26) -> DataFrame:
    """The rows whose doc_id is in known, and few others: those with equal hashes of so many bits. The bitmap of hashes has 2**bits bits, 8 MB, whatever known has."""
    h = f"pmod(xxhash64(doc_id), {1 << bits}L)"
    have = known.groupBy(F.expr(f"bitmap_bucket_number({h})").alias("bucket")).agg(F.expr(f"bitmap_construct_agg(bitmap_bit_position({h}))").alias("bits"))
    at = rows.withColumn("bucket", F.expr(f"bitmap_bucket_number({h})")).withColumn("bit", F.expr(f"bitmap_bit_position({h})"))
    byte = "cast(conv(hex(substring(bits, cast(bit div 8 as int) + 1, 1)), 16, 10) as int)"
    return at.join(F.broadcast(have), "bucket").where(F.expr(f"shiftright({byte}, cast(bit % 8 as int)) % 2 = 1")).select(*rows.columns)


def quantiles(rows: DataFrame, column: str, at: tuple[float, ...]) -> dict[str, list[float]]:
    """The exact quantiles of a column, interpolated, by lang and, as "*", of all rows; nulls are left out.

    Values are numbered by a range sort and offsets by partition, so no task holds all of them.
    """
    own = rows.where(F.col(column).isNotNull()).select(F.explode(F.array_distinct(F.array("lang", F.lit("*")))).alias("lang"), F.col(column).alias("v"))
    placed = cut(own.where("lang is not null").orderBy("lang", "v").withColumn("id", F.monotonically_increasing_id()))
    runs = defaultdict(list)
    for first, lang, n in sorted(map(tuple, placed.groupBy("lang", F.shiftright("id", 33).alias("p")).agg(F.min("id").alias("first"), F.count("*").alias("n")).select("first", "lang", "n").collect())):
        runs[lang].append((first, n))

    def place(lang: str, rank: int) -> int:
        for first, n in runs[lang]:
            if rank < n:
                return first + rank
            rank -= n

    ranks = {lang: [q * (sum(n for _, n in own) - 1) for q in at] for lang, own in runs.items()}
    ends = {(lang, r): (place(lang, math.floor(r)), place(lang, math.ceil(r))) for lang, own in ranks.items() for r in own}
    found = {r.id: r.v for r in placed.where(F.col("id").isin(sorted({i for e in ends.values() for i in e}))).collect()} if ends else {}
    between = lambda r, lo, hi: found[lo] if lo == hi else (math.ceil(r) - r) * found[lo] + (r - math.floor(r)) * found[hi]
    return {lang: [between(r, *ends[lang, r]) for r in own] for lang, own in ranks.items()}


def kneser_ney(counts: DataFrame, order: int = ORDER) -> tuple[DataFrame, DataFrame]:
    """From (gram, n) of the highest order: grams (o, gram, p) with their interpolated probability, contexts (o, ctx, g) with the weight of the next lower order.

    Discounts D1, D2, D3+ come from each order's counts of counts (Chen and Goodman); where one isn't defined, it is 0.5, 1, 1.5.
    """
    level = {order: cut(counts.select("gram", F.col("n").alias("c")))}
    for o in range(order - 1, 0, -1):
        level[o] = cut(level[o + 1].groupBy(F.expr(f"gram & {mask(o)}L").alias("gram")).agg(F.count("*").alias("c")))
    probs, grams, contexts = None, None, None
    for o in range(1, order + 1):
        n = dict(level[o].where("c <= 4").groupBy("c").count().collect())
        y = n.get(1, 0) / max(1, n.get(1, 0) + 2 * n.get(2, 0))
        cuts = []
        for k in (1, 2, 3):
            d = k - (k + 1) * y * n.get(k + 1, 0) / n[k] if n.get(k) else 0
            cuts.append(d if 0 < d < k else k / 2)
        discount = F.when(F.col("c") == 1, cuts[0]).when(F.col("c") == 2, cuts[1]).otherwise(cuts[2])
        rows = level[o].withColumn("ctx", F.expr("shiftright(gram, 8)")).withColumn("d", discount)
        sums = rows.groupBy("ctx").agg(F.sum("c").alias("total"), (F.sum("d") / F.sum("c")).alias("g"))
        own = rows.join(sums, "ctx")
        first = (F.col("c") - F.col("d")) / F.col("total")
        if o == 1:
            made = own.select("gram", (first + F.col("g") / 256).alias("p"))
        else:
            low = probs.select(F.col("gram").alias("low"), F.col("p").alias("low_p"))
            made = own.withColumn("low", F.expr(f"gram & {mask(o - 1)}L")).join(low, "low").select("gram", (first + F.col("g") * F.col("low_p")).alias("p"))
        probs = cut(made)
        g, c = probs.select(F.lit(o).alias("o"), "gram", "p"), sums.select(F.lit(o).alias("o"), "ctx", "g")
        grams, contexts = (g, c) if grams is None else (grams.unionByName(g), contexts.unionByName(c))
    return grams, contexts


class Model:
    """The table of kneser_ney() for whole arrays of grams."""

    def __init__(self, grams: pa.Table, contexts: pa.Table, order: int = ORDER):
        self.order, self.grams, self.contexts = order, {}, {}
        for o in range(1, order + 1):
            for table, key, value, to in ((grams, "gram", "p", self.grams), (contexts, "ctx", "g", self.contexts)):
                own = table.column("o").to_numpy() == o
                to[o] = (Table(table.column(key).to_numpy()[own].astype(U)), np.log(table.column(value).to_numpy()[own]))

    def logs(self, grams: np.ndarray) -> np.ndarray:
        """ln P of each gram's lowest byte after the bytes above it."""
        out, todo = np.zeros(len(grams)), np.arange(len(grams))
        for o in range(self.order, 0, -1):
            table, values = self.grams[o]
            row = table.find(grams[todo] & U(mask(o)))
            hit = row >= 0
            out[todo[hit]] += values[row[hit]] if len(values) else 0
            todo = todo[~hit]
            if not len(todo):
                return out
            table, values = self.contexts[o]
            row = table.find((grams[todo] & U(mask(o))) >> U(8))
            out[todo[row >= 0]] += values[row[row >= 0]] if len(values) else 0
        out[todo] += np.log(1 / 256)
        return out


def worst_words(texts: pa.Array, contrast: np.ndarray) -> np.ndarray:
    """The greatest sum of contrast over a word's bytes and the one after it, for each text; -inf without words. Words are what blanks separate."""
    data, at = flat(texts)
    inside = np.append(data > 32, False)
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    before = np.append(False, inside[:-1]) & ~edge
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside[:-1] & (~inside[1:] | edge[1:])) + 1
    offsets = np.searchsorted(start, at)
    sums = np.concatenate([[0], np.cumsum(contrast)])
    out = np.full(len(at) - 1, -np.inf)
    some = np.diff(offsets) > 0
    if some.any():
        last = np.repeat(at[1:], np.diff(offsets))
        out[some] = np.maximum.reduceat(sums[np.minimum(end + 1, last)] - sums[start], offsets[:-1][some])
    return out


def judged(texts: pa.Array, model: Model, contrast: Model | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, log-perplexity (nan without bytes) and worst contrast (-inf without words or model) of each text."""
    grams, offsets = gram_keys(texts, ORDER)
    distinct, at = np.unique(grams, return_inverse=True)
    own, n = model.logs(distinct), np.diff(offsets)
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = -segment_sum(own[at], offsets) / n
    worst = worst_words(texts, (contrast.logs(distinct) - own)[at]) if contrast else np.full(len(n), -np.inf)
    return n, mean, worst


def scorer(models):
    def run(batches):
        for batch in blocks(batches, 2):
            n, mean, worst = judged(batch.column(2), *models.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), pa.array(mean, mask=n == 0), pa.array(worst, mask=np.isinf(worst))], ["id", "lang", "n_bytes", "log_ppl", "contrast"])

    return run


def document_grams(batches):
    """(id, lang, gram, n) of the distinct grams of each row."""
    for batch in blocks(batches, 2):
        for i in range(batch.num_rows):
            keys, n = np.unique(gram_keys(batch.column(2).slice(i, 1), ORDER)[0], return_counts=True)
            row = [pa.repeat(batch.column(c)[i], len(keys)) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([*row, pa.array(keys.view(np.int64)), pa.array(n)], ["id", "lang", "gram", "n"])


def word_pieces(batches):
    """(id, lang, piece) of the distinct words of each row, a piece being a word's bytes with the ORDER-1 before and the one after it."""
    for batch in batches:
        rows = ([], [])
        for i in range(batch.num_rows):
            raw = b"\xff" * (ORDER - 1) + (batch.column(2)[i].as_py() or "").encode()
            own, start = set(), None
            for at in range(ORDER - 1, len(raw) + 1):
                if at < len(raw) and raw[at] > 32:
                    start = at if start is None else start
                elif start is not None:
                    own.add(raw[start - ORDER + 1 : at + 1])
                    start = None
            rows[0].extend([i] * len(own))
            rows[1].extend(sorted(own))
        at = pa.array(rows[0], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(rows[1], pa.binary())], ["id", "lang", "piece"])


def piece_grams(batches):
    for batch in batches:
        pieces = batch.column(0).to_pylist()
        grams = [int.from_bytes(p[i - ORDER + 1 : i + 1], "big") for p in pieces for i in range(ORDER - 1, len(p))]
        own = np.repeat(np.arange(len(pieces)), [len(p) - ORDER + 1 for p in pieces])
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own)), pa.array(grams, pa.int64())], ["piece", "gram"])


def joined_logs(grams: DataFrame, model: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(gram, logs) of distinct grams, by joins with the count shards of each order in turn."""
    known, contexts = model
    table = grams.select("gram").distinct().withColumn("logs", F.lit(0.0)).withColumn("open", F.lit(True))
    for o in range(ORDER, 0, -1):
        g = known.where(F.col("o") == o).select(F.col("gram").alias("g"), "p")
        c = contexts.where(F.col("o") == o).select(F.col("ctx").alias("c"), F.col("g").alias("w"))
        table = table.withColumn("g", F.expr(f"gram & {mask(o)}L")).withColumn("c", F.expr("shiftright(g, 8)")).join(g, "g", "left").join(c, "c", "left")
        step = F.when(~F.col("open"), 0.0).when(F.col("p").isNotNull(), F.log("p")).otherwise(F.coalesce(F.log("w"), F.lit(0.0)))
        table = table.select("gram", (F.col("logs") + step).alias("logs"), (F.col("open") & F.col("p").isNull()).alias("open"))
    return table.select("gram", F.when(F.col("open"), F.col("logs") - np.log(256)).otherwise(F.col("logs")).alias("logs"))


def joined_scores(texts: DataFrame, model: tuple[DataFrame, DataFrame], contrast: tuple[DataFrame, DataFrame] | None) -> DataFrame:
    """What scorer() gives, by joins of the texts' distinct grams and words with the count shards; rows are told apart by id and lang."""
    kinds = dict(texts.dtypes)
    own = texts.mapInArrow(document_grams, f"id {kinds['id']}, lang string, gram long, n long")
    out = own.join(joined_logs(own, model), "gram").groupBy("id", "lang").agg(F.sum("n").alias("n_bytes"), (-F.sum(F.col("n") * F.col("logs")) / F.sum("n")).alias("log_ppl"))
    if contrast is None:
        return out.withColumn("contrast", F.lit(None).cast("double"))
    words = cut(texts.mapInArrow(word_pieces, f"id {kinds['id']}, lang string, piece binary"))
    grams = words.select("piece").distinct().mapInArrow(piece_grams, "piece binary, gram long")
    good, bad = joined_logs(grams, model), joined_logs(grams, contrast).withColumnRenamed("logs", "bad")
    scored = grams.join(good, "gram").join(bad, "gram").groupBy("piece").agg(F.sum(F.col("bad") - F.col("logs")).alias("contrast"))
    worst = words.join(scored, "piece").groupBy(F.col("id").alias("wid"), F.col("lang").alias("wlang")).agg(F.max("contrast").alias("contrast"))
    return out.join(worst, F.col("id").eqNullSafe(F.col("wid")) & F.col("lang").eqNullSafe(F.col("wlang")), "left").select("id", "lang", "n_bytes", "log_ppl", "contrast")


class Judge:
    """The models trained from docs and labels: score() gives perplexities and contrasts, bounds and bars those of each language."""

    def __init__(self, docs: DataFrame, labels: DataFrame, max_docs_per_lang: int | None = None, max_model_rows: int = 16_000_000, max_broadcast_docs: int = 500_000, low: float = 0.01, high: float = 0.99, slack: float = 0.5, z: float = 3.0):
        own = [cut(labelled_sample(docs, labels, w, max_docs_per_lang, n)) for w, n in ((TRUSTED, 2), (TOXIC, HELD_TOXIC))]
        known = own[0].withColumn("toxic", F.lit(False)).unionByName(own[1].withColumn("toxic", F.lit(True)))
        small = known.count() <= max_broadcast_docs
        texts = pick(docs, doc_id="doc_id", text="text")
        # another scan is cheaper than a copy of the texts, another shuffle of them isn't
        texts = texts.join(F.broadcast(known), "doc_id") if small else cut(perhaps_among(texts, known).join(known, "doc_id"))
        trained = lambda texts: tuple(cut(x) for x in kneser_ney(gram_counts(texts.where("not held"), ORDER)))
        self.tables, self.contrast = trained(texts.where("not toxic")), None if own[1].isEmpty() else trained(texts.where("toxic"))
        tables = [t for t in (self.tables, self.contrast) if t]
        self.models = None
        if sum(x.count() for t in tables for x in t) <= max_model_rows:
            made = [Model(*(x.toArrow() for x in t)) for t in tables]
            self.models = docs.sparkSession.sparkContext.broadcast((made[0], made[1] if self.contrast else None))
        held = [cut(self.score(x.select(F.col("doc_id").alias("id"), "lang", "text"))).where("log_ppl is not null") for x in (texts.where("held and not toxic"), texts.where("held and toxic"))]

        at = (low, 0.5, high)
        own = quantiles(held[0], "log_ppl", at)
        self.bounds = {k: (q[0] - slack * (q[1] - q[0]), q[2] + slack * (q[2] - q[1])) for k, q in own.items()}
        middle = own["*"][1] if "*" in own else 0.0
        spread = held[0].agg(F.stddev_pop((F.col("log_ppl") - middle) * F.sqrt("n_bytes"))).first()[0]
        self.margin = z * (spread or 0.0)
        self.bars = {k: q[2] + slack * (q[2] - q[1]) for k, q in quantiles(held[0], "contrast", at).items()} if self.contrast else {}
        worst = quantiles(held[1], "contrast", at) if self.bars else {}
        for k, bar in self.bars.items():
            least = (worst.get(k) or worst.get("*") or [bar])[0]
            self.bars[k] = max(bar, (bar + least) / 2)

    def score(self, rows: DataFrame) -> DataFrame:
        """(id, lang, n_bytes, log_ppl, contrast) of rows (id, lang, text); by joins, beyond max_model_rows, equal (id, lang) count as one text."""
        kind = dict(rows.dtypes)["id"]
        if self.models:
            return rows.select("id", "lang", "text").mapInArrow(scorer(self.models), f"id {kind}, lang string, n_bytes long, log_ppl double, contrast double")
        return joined_scores(rows.select("id", "lang", "text"), self.tables, self.contrast)

    def keeps(self) -> Column:
        """Whether a row (lang, n_bytes, log_ppl, contrast) lies within its language's bounds; those of all languages stand in for an unknown one."""
        lo, hi = self.bounds.get("*", (float("-inf"), float("inf")))
        low, high, bar = F.lit(lo), F.lit(hi), F.lit(self.bars.get("*", float("inf")))
        for lang, (lo, hi) in sorted((k, v) for k, v in self.bounds.items() if k != "*"):
            low, high = F.when(F.col("lang") == lang, lo).otherwise(low), F.when(F.col("lang") == lang, hi).otherwise(high)
        for lang, at in sorted((k, v) for k, v in self.bars.items() if k != "*"):
            bar = F.when(F.col("lang") == lang, at).otherwise(bar)
        wide = self.margin / F.sqrt(F.nullif(F.col("n_bytes"), F.lit(0)))
        return F.coalesce(F.col("log_ppl").between(low - wide, high + wide), F.lit(False)) & F.coalesce(F.col("contrast") <= bar, F.lit(True))


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """One row for each row of docs: doc_id, lang, n_bytes, log_ppl, perplexity, contrast, keep.

    docs has doc_id, text and lang, labels doc_id, quality and toxic; other columns are ignored.
    Defined results: a null or empty text has no perplexity and is rejected. A null lang, or one without held-out documents, is
    judged by the bounds of all held-out documents together. Without any trusted document nothing bounds the
    perplexity, and every document with text is kept; without any toxic one there is no contrast. Labels of unknown documents,
    repeated or null labels count for nothing beyond the first; repeated documents and null doc_ids each give their row. Empty
    tables give an empty result.
    """
    judge = Judge(docs, labels, **options)
    rows = pick(docs, doc_id="doc_id", lang="lang", text="text")
    if judge.models:
        scored = judge.score(rows.withColumnRenamed("doc_id", "id")).withColumnRenamed("id", "doc_id")
    else:
        by_text = judge.score(rows.select(F.xxhash64("text").alias("id"), F.lit("").alias("lang"), "text").dropDuplicates(["id"])).select(F.col("id").alias("h"), "n_bytes", "log_ppl", "contrast")
        scored = rows.withColumn("h", F.xxhash64("text")).join(by_text, "h", "left").select("doc_id", "lang", F.coalesce("n_bytes", F.lit(0).cast("long")).alias("n_bytes"), "log_ppl", "contrast")
    return scored.select("doc_id", "lang", "n_bytes", "log_ppl", F.exp("log_ppl").alias("perplexity"), "contrast", judge.keeps().alias("keep"))


def filter_batches(models, text: int, lang: int, bounds: dict, margin: float, bars: dict):
    """The mapInArrow function over whole rows that drops the rejected ones."""

    def run(batches):
        for batch in blocks(batches, text):
            n, mean, worst = judged(batch.column(text), *models.value)
            langs = batch.column(lang).to_pylist()
            every = bounds.get("*", (-np.inf, np.inf))
            own = np.array([bounds.get(x, every) for x in langs])
            bar = np.array([bars.get(x, bars.get("*", np.inf)) for x in langs])
            with np.errstate(divide="ignore"):
                wide = margin / np.sqrt(n)
            yield batch.filter(pa.array((n > 0) & (mean >= own[:, 0] - wide) & (mean <= own[:, 1] + wide) & (worst <= bar)))

    return run


def drop_rejected(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs that classify() keeps, with all their columns; while the models are broadcast, in one scan without a shuffle."""
    judge = Judge(docs, labels, **options)
    if judge.models:
        at = {c: i for i, c in enumerate(docs.columns)}
        return docs.mapInArrow(filter_batches(judge.models, at["text"], at["lang"], judge.bounds, judge.margin, judge.bars), docs.schema)
    h, other, ok = (fresh(docs, c) for c in ("__h", "__other", "__ok"))
    named = docs.withColumn(h, F.xxhash64("text"))
    scored = judge.score(named.select(F.col(h).alias("id"), "lang", "text").dropDuplicates(["id", "lang"])).select(F.col("id").alias(other), F.col("lang").alias(ok), judge.keeps().alias("keeps")).where("keeps").drop("keeps")
    return named.join(scored, (F.col(h) == F.col(other)) & F.col("lang").eqNullSafe(F.col(ok)), "left_semi").select(*docs.columns)
