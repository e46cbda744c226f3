"""Row numbers under far outliers, shared doc_ids and nulls."""

import random

import pytest

from kakari.llm import sharding


@pytest.mark.parametrize("case", ["outlier", "shared", "nulls"])
def test_ranges_stay_small(spark, case):
    rng = random.Random(1)
    ids = {"outlier": [*range(20_000), 1 << 60], "shared": [7] * 8000 + rng.sample(range(1 << 40), 12_000), "nulls": [None] * 9000 + list(range(-6000, 5000))}[case]
    rng.shuffle(ids)
    df = spark.createDataFrame([(x, f"text {i}") for i, x in enumerate(ids)], "doc_id long, text string").repartition(3)
    numbered, name, n = sharding.number_rows(df, rows_per_range=500)
    rows = sorted((r[name], r.doc_id) for r in numbered.collect())
    assert n == len(ids) and [i for i, _ in rows] == list(range(n))
    assert [x for _, x in rows] == sorted(ids, key=lambda x: (x is not None, x or 0))
    assert sharding.shard(df, 4, rows_per_task=1000).select("position").distinct().count() == n


def test_text_ids_are_refused(spark):
    with pytest.raises(TypeError):
        sharding.shard(spark.createDataFrame([("a",)], "doc_id string"))
