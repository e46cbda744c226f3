"""The corpus pipeline's stages."""

import pytest

import corpus_pipeline
from kakari.llm import queries


@pytest.fixture(scope="module")
def outputs(spark, sf, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("stages"))
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out.append((docs, stage(spark, docs, sf)))
        out[-1][1].write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
        out[-1] = (out[-1][0], docs)
    return out


def test_stages(outputs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "identifiers", "packing"]
    for before, after in outputs[:-1]:
        assert after.columns == ["doc_id", "text", "lang", "source", "n_chars"] and 0 < after.count() <= before.count()
    assert outputs[3][0].count() == outputs[3][1].count()


def test_decisions_take_effect(spark, sf, outputs):
    from kakari.llm import decontaminate, neardup, pii

    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    before, after = outputs[1]
    assert ids(before) - ids(after) == {r.doc_id for r in neardup.find_duplicates(before).collect()}
    before, after = outputs[2]
    found = {r.doc_id for r in decontaminate.find_contaminated(before, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert found and ids(before) - ids(after) == found
    before, after = outputs[3]
    hit = {r.doc_id for r in pii.find_identifiers(before).collect()}
    texts = {r.doc_id: r.text for r in before.collect()}
    assert hit and {r.doc_id for r in after.collect() if r.text != texts[r.doc_id]} == hit
    kept = {r.doc_id for r in outputs[4][0].collect() if (r.text or "").split()}
    assert ids(outputs[4][1]) == kept


def test_run_is_the_stages(spark, sf, outputs):
    got = sorted(map(tuple, queries.queries()["pipeline"](spark, sf).collect()))
    assert got == sorted(map(tuple, outputs[-1][1].collect()))


def test_empty_tables(spark, sf, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
