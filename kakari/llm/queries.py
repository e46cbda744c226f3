"""The queries of this subpackage, opN_<name> by the operator's number, with the SQL of those that SQL can express."""

from __future__ import annotations

from kakari.llm import decontaminate, html, licenses, media, neardup, packing, pii, quality, sharding, suffix_tree


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark, sf_dir):
    return decontaminate.find_contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_near_duplicates(spark, sf_dir):
    return neardup.find_duplicates(table(spark, sf_dir, "documents"))


def op3_suffix_tree(spark, sf_dir):
    return suffix_tree.score_corpus(table(spark, sf_dir, "documents"))


def op4_quality(spark, sf_dir):
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op6_sharding(spark, sf_dir):
    return sharding.shard(table(spark, sf_dir, "documents"))


def op7_licenses(spark, sf_dir):
    return licenses.find_licenses(table(spark, sf_dir, "documents"))


def op8_media(spark, sf_dir):
    return media.read_media(media.containers(table(spark, sf_dir, "pages"), "page_id", "html"))


def op9_html(spark, sf_dir):
    return html.extract(table(spark, sf_dir, "pages"))


def op10_identifiers(spark, sf_dir):
    return pii.find_identifiers(table(spark, sf_dir, "documents"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {f.__name__: f for f in (op1_decontaminate, op2_near_duplicates, op3_suffix_tree, op4_quality, op5_packing, op6_sharding, op7_licenses, op8_media, op9_html, op10_identifiers, pipeline)}


DECONTAMINATE = """
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM documents),
b AS (SELECT DISTINCT item_id, regexp_extract_all(lower(text), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM benchmark),
items AS (SELECT item_id, w, least(len(w), 5) AS k FROM b WHERE len(w) > 0),
own AS (SELECT DISTINCT item_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS g FROM items),
sizes AS (SELECT item_id, count(*) AS n FROM own GROUP BY item_id),
ks AS (SELECT DISTINCT k FROM items),
docs AS (SELECT DISTINCT doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS g FROM d, ks WHERE len(w) >= k),
shared AS (SELECT doc_id, item_id, count(*) AS m FROM docs JOIN own USING (k, g) GROUP BY ALL)
SELECT doc_id, item_id, CAST(n AS INTEGER) AS n_shingles, CAST(m AS INTEGER) AS n_shared, CAST(m AS DOUBLE) / n AS containment
FROM shared JOIN sizes USING (item_id) WHERE m >= 0.8 * n
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": DECONTAMINATE, "op6_sharding": sharding.ORACLE, "op7_licenses": licenses.ORACLE}
