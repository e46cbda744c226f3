"""Every labelled document counts for the classifier, in its models or in its bounds."""

import random

import pytest
from pyspark.sql import functions as F

from kakari.llm import quality

N = 4200


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame([(i, f"{i:05d}", "en") for i in range(N)] + [(N + i, f"t{i:04d}", "en") for i in range(N)], "doc_id long, text string, lang string")
    labels = docs.select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") >= N).cast("int").alias("toxic"))
    return docs.repartition(4).cache(), labels.cache()


def whole_texts(model):
    """How many of the texts a model has counted: all are different and of the highest order's length."""
    return {g.to_bytes(quality.ORDER, "big").decode() for (g,) in model[0].where(F.col("o") == quality.ORDER).select("gram").collect() if g < 1 << 39}


def test_all_labelled_documents_are_used(tables):
    docs, labels = tables
    judge = quality.Judge(docs, labels)
    for model, which, one_in in ((judge.tables, quality.TRUSTED, 2), (judge.contrast, quality.TOXIC, quality.HELD_TOXIC)):
        own = docs.join(quality.labelled_sample(docs, labels, which, None, one_in), "doc_id").select("text", "held").collect()
        assert len(own) == N and sum(r.held for r in own) == N // one_in
        assert whole_texts(model) == {r.text for r in own if not r.held}
    held = docs.join(quality.labelled_sample(docs, labels, quality.TRUSTED).where("held").select("doc_id"), "doc_id")
    q = judge.score(held.withColumnRenamed("doc_id", "id")).agg(F.percentile("log_ppl", F.array(F.lit(0.01), F.lit(0.5), F.lit(0.99)))).first()[0]
    assert judge.bounds["en"] == pytest.approx((q[0] - 0.5 * (q[1] - q[0]), q[2] + 0.5 * (q[2] - q[1])))


def test_labels_beyond_what_is_broadcast(tables):
    docs, labels = tables
    a, b = quality.Judge(docs, labels), quality.Judge(docs, labels, max_broadcast_docs=0)
    assert whole_texts(a.tables) == whole_texts(b.tables) and whole_texts(a.contrast) == whole_texts(b.contrast)
    for x, y in ((a.bounds, b.bounds), (a.bars, b.bars)):
        assert x.keys() == y.keys() and all(x[k] == pytest.approx(y[k]) for k in x)


def test_doc_ids_are_told_apart_by_a_bitmap(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    known = docs.where("doc_id % 3 = 0").select("doc_id")
    got = {r.doc_id for r in quality.perhaps_among(docs, known).collect()}
    assert got >= set(range(0, 3000, 3)) and len(got) < 1010
    assert quality.perhaps_among(docs, known.limit(0)).count() == 0


def test_ranks_are_those_of_one_sort(spark):
    docs = spark.createDataFrame([(i, ("en", "de", None)[i % 7 % 3]) for i in range(900)], "doc_id long, lang string")
    labels = docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    hashed = docs.select("doc_id", "lang", F.xxhash64("doc_id").alias("h")).collect()
    for lang in ("en", "de", None):
        ids = [r.doc_id for r in sorted(hashed, key=lambda r: (r.h, r.doc_id)) if r.lang == lang]
        for most in (None, 50):
            got = quality.labelled_sample(docs, labels, quality.TRUSTED, most, 3).where(F.col("lang").eqNullSafe(F.lit(lang))).collect()
            assert {(r.doc_id, r.held) for r in got} == {(d, i % 3 == 2) for i, d in enumerate(ids[:most])}


def test_quantiles_against_percentile(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None, "*"]), rng.choice([rng.gauss(0, 1), 0.5, None])) for _ in range(3000)] + [("one", 3.0), ("none", None)]
    df, at = spark.createDataFrame(rows, "lang string, x double").repartition(7), (0.01, 0.5, 0.99)
    p = F.percentile("x", F.array(*map(F.lit, at))).alias("q")
    want = {r.lang: r.q for r in [*df.groupBy("lang").agg(p).collect(), *df.agg(F.lit("*").alias("lang"), p).collect()] if r.q and r.lang is not None}
    assert quality.quantiles(df, "x", at) == want
    assert quality.quantiles(df.limit(0), "x", at) == {}
