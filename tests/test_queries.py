"""Every registered core query against its SQL, over a small fixture full of edge cases."""

import pytest

from kakari.plans.oracle import oracle_sql
from kakari.plans.queries import queries
from tests.compare import differences, oracle

TEXTS = [
    'The cat of the house (no. 12) is "seen", by 3 4 5 dogs.\nSecond line: <b>bold</b> & more; it ended.',
    "", None, "\n\n", "one", "the the the of of and", "1 2 3 4", '"', ",", "* starred # hashed EOS", "a,b \"c\" 'd' [e] {f} (g) <h>",
    "El perro está con la niña en una casa. Ünlü straße Große Ärger façade œuvre", "tabs\tand\rreturns  and   blanks ", "漢字 かな ｶﾞ full-width ＡＢＣ １２ \U0001f600", "x" * 300 + " " + "y, " * 400,
    "Word Another Third, Fourth. fifth Sixth", "ending running jumped nation under",
]


@pytest.fixture(scope="module")
def at(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("small"))
    docs = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{folder}/docs")
    items = [(i, f"The item number {i} of the benchmark is here, with {i} words.\nAnd a second (line) {'of it ' * (i % 3)}") for i in range(8)]
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{folder}/bench")
    from pathlib import Path

    talks = [(i // 3, i % 3, "user", f"Turn {i} of (the talk), with other words; and numbers {i} 12.\n" * (i % 3)) for i in range(9)] + [(9, 0, "user", None)]
    spark.createDataFrame(talks, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{folder}/talk")
    for name, to in (("docs", "documents"), ("bench", "benchmark"), ("talk", "conversations")):
        next(Path(folder, name).glob("*.parquet")).rename(f"{folder}/{to}.parquet")
    Path(f"{folder}/events.parquet").symlink_to("/root/testdata/sf0.001/events.parquet")
    return folder


@pytest.fixture(scope="module")
def con(at):
    return oracle(at)


def test_every_query_has_sql():
    assert oracle_sql().keys() == queries().keys() - {"trained_links"}


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_as_sql(spark, at, con, name):
    assert differences(spark, con, name, queries()[name], oracle_sql()[name], at) == []


def test_plans_stay_narrow(spark, at):
    """A parse is one stage without shuffles or Python, and reads only what it needs."""
    from pyspark.sql import functions as F

    from kakari.plans.pipeline import Parser
    from kakari.sources.raw import sentences_of

    df = Parser().parse(sentences_of(spark.read.parquet(f"{at}/documents.parquet"))).select("doc_id", F.size("chunks"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_links_of_a_trained_model(spark, at):
    """Every chunk but the last links to a later one, projectively, whatever the model says; and the model follows the rule it learnt."""
    got = queries()["trained_links"](spark, at).collect()
    rows = {}
    for r in got:
        rows.setdefault((r.doc_id, r.line), {})[r.chunk_id] = r.link
    for links in rows.values():
        n = len(links)
        assert all(i < links[i] < n for i in range(n - 1)) and links[n - 1] == -1
        assert not any(i < j < links[i] < links[j] for i in range(n - 1) for j in range(i))


def test_a_trained_model_follows_what_it_learnt(spark, at):
    from kakari.functions.patterns import ASCII_PUNCTUATION, IPA
    from kakari.operators import model, train
    from kakari.operators.chunks import chunk_by, select
    from kakari.operators.links import link_sentences
    from kakari.operators.tokens import tokenize
    from kakari.plans.queries import by_function_word
    from kakari.sources.raw import sentences_of

    lines = by_function_word(select(chunk_by(tokenize(sentences_of(spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet"), "item_id"))), IPA, ASCII_PUNCTUATION))
    params, dic, sv, stats = train.train_links(lines, "item_id", "line", cost=0.05)
    made = link_sentences(lines, model.PairModel.compile(dic, sv, params=params)).collect()
    given = {(r.item_id, r.line): [c.link for c in r.chunks] for r in lines.collect()}
    pairs = [(c.link, given[r.item_id, r.line][i]) for r in made for i, c in enumerate(r.chunks[:-2])]
    print(len(pairs), sum(a == b for a, b in pairs), stats)
    assert len(pairs) > 100 and sum(a == b for a, b in pairs) > 0.95 * len(pairs)
