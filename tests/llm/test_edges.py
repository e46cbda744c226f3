"""Every operator and stage on nulls, empty and very long texts, repeats, clashing columns and empty tables."""

import pytest
from pyspark.sql import functions as F

from kakari.llm import decontaminate, html, licenses, media, neardup, packing, pii, quality, sharding, suffix_tree

LONG = "alpha beta gamma delta " * 30_000
ITEM = "one two three four five six seven eight nine ten eleven twelve"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, key string, node string, __h int, bands int, gram long, part int, position int, kinds string"
ROWS = [
    (1, f"start {ITEM} end. Mail anna.smith@mail.example.com now. Licensed under the MIT License", "en", "a", 5),
    (1, f"start {ITEM} end. Mail anna.smith@mail.example.com now. Licensed under the MIT License", "en", "a", 5),
    (2, f"start {ITEM} end. Mail anna.smith@mail.example.com now. Licensed under the MIT License", None, None, None),
    (3, None, "en", "b", None), (4, "", "de", None, 0), (None, "some text without a number", "xx", "c", 3), (None, None, None, None, None),
    (5, LONG, "en", "a", len(LONG)), (6, "  \n\t ", "fr", "a", 4), (7, "é ü ß 漢字 \U0001f600", "en", "a", 9), (1, "the same number with another text altogether", "en", "a", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 1, "k", "n", 2, 3, 4, 5, 6, "z") for r in ROWS], SCHEMA).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0, 9), (5, 1, 0, 9), (2, 0, 1, 9), (None, 1, 0, 9), (1, 1, 0, 9), (99, None, None, 9)], "doc_id long, quality int, toxic int, h int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(10, ITEM, 1), (11, None, 1), (12, "", 1), (None, ITEM, 1), (10, ITEM, 1), (13, "漢字", 1)], "item_id long, text string, doc_id int")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_decontamination(docs, benchmark):
    found = rows(decontaminate.find_contaminated(docs, benchmark).select("doc_id", "item_id", "containment"))
    assert found == sorted([(d, i, 1.0) for d in (1, 2) for i in (10, None)] + [(7, 13, 1.0)], key=repr)
    kept = decontaminate.drop_contaminated(docs, benchmark)
    assert kept.columns == docs.columns and kept.count() == len(ROWS) - 4
    assert decontaminate.find_contaminated(docs.limit(0), benchmark).count() == 0
    assert decontaminate.drop_contaminated(docs, benchmark.limit(0)).count() == len(ROWS)


def test_near_duplicates(docs):
    assert rows(neardup.find_duplicates(docs)) == [(1, 1), (2, 1)]
    kept = neardup.drop_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == len(ROWS) - 2
    assert neardup.find_duplicates(docs.limit(0)).count() == 0 and neardup.drop_duplicates(docs.limit(0)).count() == 0


def test_suffix_tree(docs):
    got = suffix_tree.score_corpus(docs)
    assert got.count() == len(ROWS)
    empty = got.where("n_symbols = 0").collect()
    assert len(empty) == 3 and all(r.log_prob == 0 and r.bits_per_symbol is None for r in empty)
    assert suffix_tree.score_corpus(docs.limit(0)).count() == 0
    assert got.where("n_symbols > 0 and not (bits_per_symbol >= 0)").count() == 0


def test_quality(docs, labels):
    got = quality.classify(docs, labels)
    assert got.count() == len(ROWS) and got.where("n_bytes = 0 and (keep or perplexity is not null)").count() == 0
    assert quality.drop_rejected(docs, labels).columns == docs.columns
    unlabelled = quality.classify(docs, labels.limit(0))
    assert unlabelled.where("keep").count() == len(ROWS) - 3
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_packing(docs):
    got = packing.pack_documents(docs)
    pieces = got.where("doc_id = 5").orderBy("piece").collect()
    assert sum(p.n_tokens for p in pieces) == 120_000 and [p.doc_start for p in pieces] == list(range(0, 120_000, 4096))
    assert got.where("doc_id in (3, 4, 6)").count() == 0 and got.where("doc_id is null").count() == 1 and got.where("doc_id = 1").count() == 3
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_sharding(docs):
    got = sharding.shard(docs, 3)
    assert sorted(r.position for r in got.collect()) == list(range(len(ROWS))) and got.count() == len(ROWS)
    assert {r.row_number for r in got.where("doc_id is null").collect()} == {0, 1}
    assert got.columns == [c for c in docs.columns if c != "position"] + ["row_number", "position", "shard", "slot"]
    assert sharding.shard(docs.limit(0)).count() == 0


def test_licenses(docs):
    assert rows(licenses.find_licenses(docs).select("doc_id", "license", "dice")) == [(1, "MIT", 1.0), (1, "MIT", 1.0), (2, "MIT", 1.0)]
    assert licenses.find_licenses(docs.limit(0)).count() == 0
    assert licenses.find_licenses(docs, {"none": "", "one": "word"}).count() == 0


def test_media(spark):
    blob = bytearray(media.write_container(b"x" * 1000, 3))
    df = spark.createDataFrame([(1, blob, "c"), (1, blob, "c"), (2, None, "c"), (3, bytearray(), "c"), (4, bytearray(b"nonsense of no box at all"), "c"), (None, bytearray(blob[:-40]), None)], "media_id long, media binary, codec string")
    got = media.read_media(df)
    assert sorted(r.status[:6] for r in got.collect()) == ["broken", "broken", "empty", "empty", "ok", "ok", "ok", "ok"]
    assert media.read_media(df.limit(0)).count() == 0


def test_html(spark):
    page = "<html><body><nav><a href='/'>Home</a></nav><p>text {}</p></body></html>"
    df = spark.createDataFrame([(i, "https://site.example/a", page.format(i), "x") for i in range(5)] + [(5, None, page.format(1), "x"), (6, "nonsense", "<p>unclosed <b>bold", "x"), (None, "https://site.example/b", None, None), (8, "https://other.example/", "", None)], "page_id long, url string, html string, h string")
    got = {r.page_id: r for r in html.extract(df).collect()}
    assert got[2].text == "text 2" and got[2].n_removed == 1 and got[5].text == "Home\ntext 1" and got[6].text == "unclosed bold" and got[None].text is None and got[8].text == ""
    assert html.extract(df.limit(0)).count() == 0


def test_identifiers(docs):
    got = pii.find_identifiers(docs)
    assert rows(got.select("doc_id", "value", "kind")) == [(1, "anna.smith@mail.example.com", "email")] * 2 + [(2, "anna.smith@mail.example.com", "email")]
    clean = pii.redact(docs)
    assert clean.columns == docs.columns and clean.count() == len(ROWS) and clean.where(F.contains("text", F.lit("<EMAIL>"))).count() == 3
    assert clean.where("text is null").count() == 2
    assert pii.find_identifiers(docs.limit(0)).count() == 0 and pii.redact(docs.limit(0)).count() == 0


def test_other_paths_agree(docs, labels, benchmark):
    """Beyond the size that is broadcast, the joined ways give the same rows."""
    a, b = quality.classify(docs, labels), quality.classify(docs, labels, max_model_rows=0)
    same = lambda x: [(r[0], r[1], r[2], r[3] and round(r[3], 9), r[5] and round(r[5], 9), r[6]) for r in sorted(map(tuple, x.collect()), key=repr)]
    assert same(a) == same(b)
    assert rows(quality.drop_rejected(docs, labels).select("doc_id", "text")) == rows(quality.drop_rejected(docs, labels, max_model_rows=0).select("doc_id", "text"))
    assert rows(pii.redact(docs).select("doc_id", "text")) == rows(pii.redact(docs, max_values=0).select("doc_id", "text"))
    assert rows(decontaminate.find_contaminated(docs, benchmark)) == rows(decontaminate.find_contaminated(docs, benchmark, max_index_bytes=8))
    assert decontaminate.drop_contaminated(docs, benchmark, max_index_bytes=8).count() == len(ROWS) - 4
