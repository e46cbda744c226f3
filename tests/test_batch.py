"""Batch stages: no lambdas that Spark interprets for every token, and the same results as the expressions and joins that they stand in for."""

import inspect

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kakari.operators import evaluate, train
from kakari.operators import model as m
from kakari.plans.queries import queries

ODD_TEXTS = ['The cat of the house (no. 12) is "seen", by 3 4 5 dogs; of (it [and) the] of.', "", "one", "of the of", "漢字 ｶﾞ ＡＢＣ　x \U0001f600 of the (end)", " ".join(f"word{i} of (the) thing, and" for i in range(90))]


def by_batch(made, texts=ODD_TEXTS):
    from kakari.operators import batch as b

    return made(b.Piece(b.Words(), pa.array(range(len(texts))), texts))


BATCHED = ["crf_features", "entity_features", "format_layers", "iob_spans", "pair_features", "link_examples", "distance_bucket", "shift_reduce_links", "kernel_score", "feature_ids", "read_layer_blocks", "eval_dep", "csv_features", "legacy_to_csv", "blank_to_csv", "head_func", "char_shape", "eval_chunk", "chunk_features", "numeral_runs", "viterbi_bi", "head_func_tagsets", "tree_depth", "tokens_pos", "realign_chunks", "chunk_features_juman"]


@pytest.mark.parametrize("name", BATCHED)
def test_no_lambdas_in_the_plan(spark, sf, name):
    assert "lambda" not in queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()


def test_entity_lists_score_as_spans_do(spark):
    """Lines that one side lacks, spans that differ in type or size, and none at all."""
    sides = [{0: [("X", 0, 2), ("Y", 3, 1)], 1: [("X", 0, 1)], 2: [("Y", 5, 2)]}, {0: [("X", 0, 2), ("X", 3, 1)], 2: [("Y", 5, 3)], 3: [("X", 1, 1)]}]
    flat = [spark.createDataFrame([(k, *x) for k, xs in s.items() for x in xs], "s int, category string, start int, size int") for s in sides]
    lists = [spark.createDataFrame([(k, *map(list, zip(*xs))) for k, xs in s.items()], "s int, categories array<string>, starts array<int>, sizes array<int>") for s in sides]
    rows = [sorted(map(tuple, d.collect())) for d in (evaluate.entity_scores_lists(*lists, "s"), evaluate.entity_scores(*flat, "s"))]
    assert rows[0] == rows[1] and len(rows[0]) == 4


def test_examples_of_a_long_line_are_those_of_the_expressions(spark):
    """With children, gaps, brackets in them, and chunks cut at 128 features."""
    from kakari.functions.patterns import ASCII_PUNCTUATION, IPA
    from kakari.operators import batch_pairs as pairs
    from kakari.operators.chunks import chunk_by, select
    from kakari.operators.links import link_by
    from kakari.operators.tokens import tokenize
    from kakari.plans.queries import passed

    texts = [" ".join(ODD_TEXTS), ", ".join(["of"] + ["("] * 90)]
    rule = lambda z: lambda s, d: (7 * F.get(z, s) + 13 * (F.get(z, s) % 4) + 5 * (d - s) + 3 * F.get(z, d)) % 11 - 5
    df = select(chunk_by(tokenize(spark.createDataFrame(list(enumerate(texts)), "id int, sentence string"))), IPA, ASCII_PUNCTUATION)
    df = link_by(df, rule(F.transform("chunks", lambda c: c["token_size"])))
    want = {(r.id, r.src, r.dst, r.label, "|".join(r.features)) for r in train.link_examples(df, "id").collect()}
    got = by_batch(lambda p: set(pairs.examples(p.chunks, p.chunks.features(IPA, ASCII_PUNCTUATION, 128), passed(p.chunks)[0])), texts)
    assert got == want and len(want) > 50


def test_model_links_are_those_of_link_sentences(spark):
    """Under weights of frequent ids, of rare ones and of their pairs."""
    from kakari.functions.patterns import ASCII_PUNCTUATION, IPA
    from kakari.operators import batch_pairs as pairs
    from kakari.operators.chunks import chunk_by, select
    from kakari.operators.links import link_sentences
    from kakari.operators.tokens import tokenize
    from kakari.plans.queries import passed

    known = by_batch(lambda p: sorted({f for x in pairs.examples(p.chunks, p.chunks.features(IPA, ASCII_PUNCTUATION, 128), passed(p.chunks)[0]) for f in x[4].split("|")}))
    rng = np.random.default_rng(3)
    n, low = len(known), len(known) // 2
    rare = {(int(i), int(j)): int(w) for i, j, w in zip(rng.integers(0, low, 400), rng.integers(low, n, 400), rng.integers(-9, 10, 400))}
    model = m.PairModel({f: i for i, f in enumerate(known)}, 3, rng.integers(-20, 21, n), np.triu(rng.integers(-3, 4, (low, low)), 1).astype(np.int32), rare, 0.5)
    df = select(chunk_by(tokenize(spark.createDataFrame(list(enumerate(ODD_TEXTS)), "id int, sentence string"))), IPA, ASCII_PUNCTUATION)
    want = [c.link for r in link_sentences(df, model).orderBy("id").collect() for c in r.chunks]
    assert by_batch(lambda p: pairs.model_links(p.chunks, p.chunks.features(IPA, ASCII_PUNCTUATION, 128), model).tolist()) == want
    assert len(set(want)) > 20


def test_training_uses_every_example():
    assert "max_examples" not in inspect.signature(train.train_links).parameters and ".limit(" not in inspect.getsource(train.train_links)


def test_places_looked_up_give_the_same_model():
    rng = np.random.default_rng(5)
    x = [np.sort(rng.choice(40, 6, replace=False)) for _ in range(60)]
    y = np.where(np.array([v.sum() for v in x]) % 2 == 0, 1.0, -1.0)
    kept, looked_up = (train.solve(y, x, 0.05, most_cells=k)[0] for k in (1 << 28, 0))
    assert (kept == looked_up).all() and kept.any()


def test_partial_counts_make_the_same_dictionary(spark):
    df = spark.createDataFrame([(x,) for x in "b a a c b d a".split()], "feature string")
    parts = spark.createDataFrame([("a", 2), ("b", 1), ("c", 1), ("b", 1), ("a", 1), ("d", 1)], "feature string, n long")
    assert sorted(map(tuple, m.dictionary_of(parts).select("feature", "id", "n").collect())) == sorted(map(tuple, m.dictionary(df).select("feature", "id", "n").collect()))


def test_kernel_of_more_ids_than_a_byte_counts(spark):
    sv = spark.createDataFrame([(0, 0.5, list(range(600))), (1, -1.0, [3])], "sv_id int, alpha double, x array<int>")
    got = m.kernel_scores(spark.createDataFrame([(7, list(range(100, 700)))], "id int, x array<int>"), sv).first().score
    assert got == 0.5 * 501**2 - 1.0


def test_blocks_are_read_as_by_the_expressions(spark):
    """Sound blocks, and ids out of order, chunks without tokens, links out of range, faulty chunk lines, broken lines and numbers."""
    from kakari.sources.layers import read_chunks, read_layer

    token = "a\tx,y\n"
    blocks = ["* 0 1D 0/0 1.500000\n" + token + "* 1 -1D 1/1 -0.5 f,\"g,h\"\n" + token * 2, token, "", None, "* 1 -1D\n" + token, "* 0 5D\n" + token, "* 0 -1D\n* 1 -1D\n" + token, "* x yD\n" + token + "* 0 -1D 2\n" + token, "* 0 99999999999D /3 z\n" + token + "broken\n* 1 0D\n" + token, "* 0\n" + token, "* \n" + token]
    df = spark.createDataFrame(list(enumerate(blocks)), "id int, text string")
    columns = "link head_pos func_pos token_pos token_size score features".split()
    flat = read_layer(df, 4).select("id", F.posexplode("chunks").alias("chunk_id", "c"), "is_valid").select("id", "chunk_id", "is_valid", *(f"c.{x}" for x in columns))
    rows = [sorted(map(str, d.select("id", "chunk_id", "is_valid", *columns).collect())) for d in (read_chunks(df, "id"), flat)]
    assert rows[0] == rows[1] and len(rows[0]) >= 8


def test_link_lists_score_as_links_do(spark):
    links = [{0: [1, 2, -1], 1: [-1], 2: [2, 3, 3, -1]}, {0: [2, 2, -1], 1: [-1], 2: [2, 3, 3, -1]}]
    flat = [spark.createDataFrame([(k, i, len(v), x) for k, v in s.items() for i, x in enumerate(v)], "s int, chunk_id int, n_chunks int, link int") for s in links]
    lists = [spark.createDataFrame(list(s.items()), "s int, links array<int>") for s in links]
    assert evaluate.link_accuracy_lists(*lists, "s").first().asDict() == evaluate.link_accuracy(*flat, "s").first().asDict()
    with pytest.raises(Exception, match="differ in chunks"):
        evaluate.link_accuracy_lists(lists[0], lists[1].where("s < 2"), "s").collect()


def test_chunk_lists_score_as_chunks_do(spark):
    sides = [{0: [(0, 2), (2, 1)], 1: [(0, 1)]}, {0: [(0, 2), (2, 2), (4, 1)], 2: [(0, 3)]}]
    flat = [spark.createDataFrame([(k, *x) for k, xs in s.items() for x in xs], "s int, token_pos int, token_size int") for s in sides]
    lists = [spark.createDataFrame([(k, *map(list, zip(*xs))) for k, xs in s.items()], "s int, places array<int>, sizes array<int>") for s in sides]
    assert evaluate.chunk_scores_lists(*lists, "s").first() == evaluate.chunk_scores(*flat, "s").first()


def test_lines_are_realigned_as_by_the_joins(spark):
    """Pieces of length 0, ends that never meet, and a head that is in no new chunk."""
    from kakari.operators import convert

    chunks = [(0, 0, 2, 1), (0, 1, 3, 3), (0, 2, 0, 3), (0, 3, 4, -1), (1, 0, 5, 9), (1, 1, 1, -1), (2, 0, 1, -1)]
    morphs = [(0, 0, 5), (0, 1, 0), (0, 2, 4), (1, 0, 5), (1, 1, 2), (2, 0, 2)]
    joined = convert.realign(spark.createDataFrame([(*c, "D") for c in chunks], "s int, chunk_id int, length int, link int, kind string"), spark.createDataFrame(morphs, "s int, tok_id int, length int"), "s")
    want = sorted(map(tuple, joined.select("s", "new_id", "link", "src", "first_tok", "n_tokens").collect()))
    got = convert.realign_lines(tuple(map(np.array, zip(*chunks))), tuple(map(np.array, zip(*morphs))))
    assert sorted(zip(*(x.tolist() for x in got))) == want and want
