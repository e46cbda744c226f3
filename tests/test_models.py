"""Kernel models, entities, converters, training, streams and command lines."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kakari import api, cli
from kakari.functions.text import let
from kakari.operators import convert, entities, evaluate, sequence, train
from kakari.operators import model as m
from kakari.operators.chunks import chunk_by, select
from kakari.operators.links import fold, gathered, link_by, link_sentences, roles, shift_reduce
from kakari.operators.tokens import tokenize, tokenize_with
from kakari.plans.pipeline import Parser
from kakari.sources import config, models
from kakari.sources.layers import read_blocks, read_layer
from kakari.streaming import stream


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(1)
    sv = [(i, rng.randint(-8, 8) / 16 or 0.5, sorted(rng.sample(range(12), rng.randint(1, 6)))) for i in range(40)]
    dic = [(f"f{i}", i) for i in range(14)]
    return spark.createDataFrame(dic, "feature string, id int").cache(), spark.createDataFrame(sv, "sv_id int, alpha double, x array<int>").cache()


def test_expansion_is_the_kernel(spark, tables):
    dic, sv = tables
    inst = spark.createDataFrame([(1, [0, 3, 5]), (2, []), (3, list(range(12)))], "id int, x array<int>")
    rows = sv.collect()
    want = {r.id: sum(v.alpha * (len(set(v.x) & set(r.x)) + 1) ** 2 for v in rows) for r in inst.collect()}
    assert {r.id: r.score for r in m.kernel_scores(inst, sv).collect()} == pytest.approx(want)
    q = m.quantise(m.expand_bias(sv), m.expand_singles(sv), m.expand_pairs(sv))
    got = {r.id: r.scaled for r in m.expanded_scores(inst, *q).collect()}
    assert got == pytest.approx(want, abs=1e-3)
    for frequent in (3000, 4):
        model = m.PairModel.compile(dic, sv, sigma=0.0, minsup=1, frequent=frequent)
        assert {r.id: model.score([f"f{i}" for i in r.x] + ["unknown"]) for r in inst.collect()} == pytest.approx(got)


def test_rank_compress_merge(spark, tables):
    dic, sv = tables
    rows = sv.collect()
    count = {i: sum(i in r.x for r in rows) for i in range(14)}
    order = sorted(range(14), key=lambda i: (-count[i], -i))
    assert {r.feature: r.id for r in m.rerank(dic, sv)[0].collect()} == {f"f{i}": k for k, i in enumerate(order)}
    small, moved = m.compress(dic, sv)
    assert [r.feature for r in small.orderBy("id").collect()] == [f"f{i}" for i in range(14) if count[i]] and moved.count() == 40
    both, every = m.merge((dic, sv), (spark.createDataFrame([("f3", 0), ("new", 1)], dic.schema), spark.createDataFrame([(0, 1.0, [0, 1])], sv.schema)))
    assert every.count() == 41 and every.where("sv_id = 40").first().x == [3, 14] and both.where("feature = 'new'").first().id == 14
    assert [r.x for r in m.sort_instances(sv).orderBy("sv_id").collect()] == sorted(r.x for r in rows)


def test_model_files(spark, tables, tmp_path):
    dic, sv = tables
    models.save_model(f"{tmp_path}/m", {"posset": "IPA"}, dic, sv)
    models.write_text_model(f"{tmp_path}/t", {"posset": "IPA"}, dic, sv)
    for params, d, s in (models.load_model(spark, f"{tmp_path}/m"), models.read_text_model(spark, f"{tmp_path}/t")):
        assert params == {"posset": "IPA"} and sorted(d.collect()) == sorted(dic.collect())
        assert [tuple(r) for r in s.orderBy("sv_id").collect()] == [tuple(r) for r in sv.orderBy("sv_id").collect()]
    assert models.open_model(spark, f"{tmp_path}/t").score(["f1"]) == pytest.approx(models.open_model(spark, f"{tmp_path}/m").score(["f1"]))
    with pytest.raises(ValueError, match="posset"):
        models.open_model(spark, f"{tmp_path}/m", "JUMAN")


def test_fold_two_ways(spark):
    rng = random.Random(2)
    for n in (2, 3, 9, 14):
        table = [[rng.choice([-2.0, -1.0, 1.0, 2.0]) for _ in range(n)] for _ in range(n)]
        cells = F.array(*(F.array(*map(F.lit, r)) for r in table))
        got = spark.range(1).select(F.lit(n).alias("n"), cells.alias("t")).select(let(F.struct("n", "t"), lambda r: shift_reduce(r["n"], lambda s, d: F.get(F.get(r["t"], s), d))).alias("x")).first().x
        link, score = fold(n, lambda s, d, _: (table[s][d] > 0, table[s][d]))
        assert [x.dst for x in got] == link and [x.score for x in got] == score
        assert all(l > i for i, l in enumerate(link)) and not any(i < k < link[i] < link[k] for i in range(n - 1) for k in range(n - 1))


def test_training_pass_and_examples(spark):
    df = select(chunk_by(tokenize(spark.createDataFrame([(1, "cat of dog by house with tree on hill at sea and sky for end")], "id int, sentence string"))))
    n = len(df.first().chunks)
    rng = random.Random(3)
    for trial in range(6):
        gold, _ = fold(n, lambda s, d, _: (rng.random() < 0.5, 1.0))
        gold = [g if trial < 3 or rng.random() < 0.7 else -1 for g in gold] + [-1]
        marked = df.withColumn("chunks", F.transform("chunks", lambda c, i: c.withField("link", F.get(F.array(*map(F.lit, gold)), i))))
        parts, want = [roles(c.features) for c in df.first().chunks], {}

        def accepts(s, d, kids):
            want[s, d] = (1 if gold[s] == d else -1, gathered(parts, s, d, kids))
            return gold[s] == d, 1.0

        fold(n, accepts, lambda s: gold[s] == -1)
        got = {(r.src, r.dst): (r.label, set(r.features)) for r in train.link_examples(marked, "id").collect()}
        assert got == want


def test_solver_separates():
    rng = np.random.default_rng(0)
    x = [np.unique(rng.integers(0, 10, 4)) for _ in range(120)]
    y = np.array([1.0 if (1 in v) != (2 in v) else -1.0 for v in x])
    alpha, stats = train.solve(y, x, 1.0, eps=0.01)
    scores = np.array([sum(a * t * (len(np.intersect1d(u, v)) + 1) ** 2 for a, t, u in zip(alpha, y, x)) for v in x])
    assert (np.sign(scores) == y).mean() > 0.97 and stats.support == (alpha > 0).sum() and (alpha <= 1.0).all()
    assert np.array_equal(train.solve(y, x, 1.0, seed=1)[0], train.solve(y, x, 1.0, seed=1)[0])


def test_train_and_parse(spark, tmp_path):
    """Links learnt from a rule are found again, by a model saved and loaded, and from the command line."""
    rng = random.Random(4)
    words = "cat dog house tree hill sea sky".split()
    rows = [(i, " ".join(f"{rng.choice(words)} {rng.choice(['of', 'by'])}" for _ in range(rng.randint(2, 6)))) for i in range(60)]
    base = select(chunk_by(tokenize(spark.createDataFrame(rows, "id int, sentence string"))))
    gold = link_by(base, lambda s, d: F.lit(1.0))
    params, dic, sv, stats = train.train_links(gold, "id", cost=1.0)
    assert stats.errors == 0 and params["posset"] == "IPA"
    model = m.PairModel.compile(dic, sv)
    got = link_sentences(base, model)
    acc = evaluate.link_accuracy(api.chunks_table(got, "id"), api.chunks_table(gold, "id"), "id").first()
    assert acc.rate0 == 100 and acc.sentence_rate == 100
    again = train.train_links(gold, "id", cost=1.0, previous=(dic, sv))
    assert again[3].errors == 0
    text = "".join(r.text for r in Parser().parse_to_text(gold, "lattice", 4).orderBy("id").collect())
    (tmp_path / "gold.txt").write_text(text)
    assert cli.main(["learn", f"{tmp_path}/gold.txt", f"{tmp_path}/model", "-c", "1.0", "--text"]) == 0
    assert cli.main(["index", f"{tmp_path}/model", f"{tmp_path}/compiled"]) == 0 and len(models.load_compiled(spark, f"{tmp_path}/compiled")) == 3
    assert cli.main(["parse", "-I2", "-f1", "-m", f"{tmp_path}/model", "-o", f"{tmp_path}/out", f"{tmp_path}/gold.txt"]) == 0
    assert cli.main(["eval", f"{tmp_path}/out", f"{tmp_path}/gold.txt"]) == 0
    assert cli.main([]) == 2 and cli.main(["--version"]) == 0


def tags_of(spark, values, f):
    return [r.o for r in spark.createDataFrame(list(enumerate(values)), "i int, t array<string>").select("i", f(F.col("t")).alias("o")).orderBy("i").collect()]


def test_entities(spark):
    cases = [["I-X", "I-X", "O"], ["B-X", "I-Y", "I-Y"], ["O", "I-XA", "I-YA"], []]
    assert tags_of(spark, cases, lambda t: entities.repair(t)) == [["B-X", "I-X", "O"], ["B-X", "I-Y", "I-Y"], ["O", "I-XA", "B-YA"], []]
    assert tags_of(spark, cases[2:3], lambda t: entities.repair(t, compat=True)) == [["O", "I-XA", "I-YA"]]
    found = tags_of(spark, [["B-X", "I-X", "O", "B-Y", "B-Y", "I-X", "I-Y"], ["I-X"], []], lambda t: let(t, entities.spans))
    assert [[(x.category, x.start, x.size) for x in r] for r in found] == [[("X", 0, 2), ("Y", 3, 1), ("Y", 4, 1)], [], []]


def test_numeral_runs(spark):
    df = tokenize(spark.createDataFrame([("in 1 2 3 and 4",)], "sentence string"))
    rows = df.select(entities.entity_rows(F.col("tokens")).alias("r")).first().r
    assert [(x.i, x.surface) for x in rows] == [(0, "in"), (1, "1"), (4, "and"), (5, "4")]
    tail = df.select(entities.numeral_tail(F.col("tokens"), entities.posset("IPA")).alias("t"), F.array(*map(F.lit, ["O", "B-N", "O", "B-N"])).alias("y"))
    assert tail.select(entities.repair(entities.spread(F.col("y"), F.col("t")), F.col("t")).alias("o")).first().o == ["O", "B-N", "I-N", "I-N", "O", "B-N"]


def test_entity_scores(spark):
    schema = "s int, category string, start int, size int"
    system = spark.createDataFrame([(1, "X", 0, 1), (1, "Y", 2, 2), (1, "X", 5, 1)], schema)
    gold = spark.createDataFrame([(1, "X", 0, 1), (1, "X", 2, 2), (2, "Z", 0, 1)], schema)
    got = {r.category: (r.correct, r.n_system, r.n_gold) for r in evaluate.entity_scores(system, gold, "s").collect()}
    assert got == {"X": (1, 2, 2), "Y": (0, 1, 0), "Z": (0, 0, 1), "(all)": (1, 3, 3), "(any)": (2, 3, 3)}
    with pytest.raises(Exception, match="differ in chunks"):
        a = spark.createDataFrame([(1, 0, 2, 1)], "s int, chunk_id int, n_chunks int, link int")
        evaluate.link_accuracy(a, a.withColumn("n_chunks", F.lit(3)), "s").collect()


def test_sequence_tagger(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("cat of dog by the house 12".split()) for _ in range(rng.randint(1, 9)))) for i in range(50)]
    df = chunk_by(tokenize(spark.createDataFrame(rows, "id int, sentence string")))
    model = train.train_chunker(df, epochs=8)
    got = Parser(chunker=model).parse(df.drop("chunks"), 1, 2)
    same = evaluate.chunk_scores(api.chunks_table(got, "id"), api.chunks_table(df, "id"), "id").first()
    assert same.f1 > 95
    tagged = entities.set_tags(df, F.transform("tokens", lambda t: F.when(t["surface"] == "12", "B-NUM").otherwise("O")))
    tagger = train.train_entities(tagged, epochs=8)
    out = Parser(tagger=tagger, ne=1).parse(df.drop("chunks"), 1, 2)
    wrong = out.select(F.explode("tokens").alias("t")).where("(t.surface = '12') != (t.ne like '%NUM')").count()
    assert wrong <= 3


def test_viterbi_two_ways(spark):
    rng = random.Random(6)
    steps = [[1, 0, 2], [0, 3, 1], [2, 0, 0]]
    labels = ["a", "b", "c"]
    rows = [[[float(rng.randint(0, 6)) for _ in labels] for _ in range(rng.randint(0, 6))] for _ in range(20)]
    got = [r.y for r in spark.createDataFrame(list(enumerate(rows)), "i int, e array<array<double>>").select("i", sequence.viterbi(F.col("e"), steps, labels).alias("y")).orderBy("i").collect()]

    def value(e, y):
        k = [labels.index(v) for v in y]
        return sum(e[i][v] for i, v in enumerate(k)) + sum(steps[p][q] for p, q in zip(k, k[1:]))

    import itertools

    for e, y in zip(rows, got):
        assert len(y) == len(e) and value(e, y) == max(value(e, z) for z in itertools.product(labels, repeat=len(e)))


def test_converters(spark):
    one = lambda f, v: spark.createDataFrame([(v,)], "c string").select(f(F.col("c")).alias("o")).first().o
    assert one(convert.legacy_to_csv, "と\tト\tと\t助詞-格助詞-引用\t\t\tO") == "と\t助詞,格助詞,引用,*,*,*,と,ト\tO"
    assert one(convert.blank_separated_to_csv, "日 にち * 接尾辞 名詞性名詞助数辞 * *") == "日\t接尾辞,名詞性名詞助数辞,*,*,日,にち,*"
    assert one(convert.blank_separated_to_csv, "# S-ID") is None and one(convert.legacy_to_csv, "* 0 1D") == "* 0 1D"
    x = one(convert.inline_spans, "昨日<PERSON>太郎</PERSON>は<OPTIONAL>x</OPTIONAL><DATE TYPE=a>五月</DATE>。")
    assert x.sentence == "昨日 太郎 は x  五月 。" and [(s.begin, s.stop, s.category) for s in x.spans] == [(2, 4, "PERSON"), (6, 8, "DATE")]
    tags = spark.createDataFrame([(["昨日", "太", "郎", "は", "x", "五月", "。"],)], "w array<string>").select(convert.span_tags(F.col("w"), F.array(*(F.struct(F.lit(a).alias("begin"), F.lit(b).alias("stop"), F.lit(c).alias("category")) for a, b, c in ((2, 4, "PERSON"), (6, 8, "DATE"))))).alias("o")).first().o
    assert tags == ["O", "B-PERSON", "I-PERSON", "O", "O", "B-DATE", "O"]


def test_realign(spark):
    chunks = spark.createDataFrame([(1, 0, 2, 2, "D"), (1, 1, 1, 2, "D"), (1, 2, 3, 3, "P"), (1, 3, 2, -1, "D")], "s int, chunk_id int, length int, link int, kind string")
    morphs = spark.createDataFrame([(1, i, n) for i, n in enumerate([1, 2, 2, 1, 2])], "s int, tok_id int, length int")
    got = [(r.new_id, r.link, r.kind, r.src, r.first_tok, r.n_tokens) for r in convert.realign(chunks, morphs, "s").orderBy("new_id").collect()]
    assert got == [(0, 1, "D", 1, 0, 2), (1, 2, "P", 2, 2, 2), (2, -1, "D", 3, 4, 1)]


def test_lexicon_two_ways(spark):
    lexicon = spark.createDataFrame([("cat", "名詞,動物,*,*"), ("cat", "名詞,a"), ("of", "助詞,x"), (None, "z")], "surface string, feature string")
    df = spark.createDataFrame([(1, "cat of dog"), (2, ""), (3, None)], "id int, sentence string")
    a, b = (sorted((r.id, [t.feature for t in r.tokens]) for r in tokenize_with(df, lexicon, max_broadcast_bytes=n).collect()) for n in (1 << 20, 0))
    assert a == b == [(1, ["名詞,a", "助詞,x", "名詞,一般,*,*,*,*,*"]), (2, []), (3, [])]


def test_options(tmp_path):
    (tmp_path / "rc").write_text("; c\n# c\noutput-format = 1\nposset = juman\nbad\nne = x\n")
    options, inputs = config.options_from(["-r", str(tmp_path / "rc"), "-f", "3", "a", "b"])
    assert (options.output_format, options.posset, options.ne, inputs) == (3, "JUMAN", 0, ["a", "b"])
    assert config.options_from(f"-r {tmp_path}/rc")[0].output_format == 1


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.txt").write_text("The cat of the house.\nAnother line\n")
    q = stream.write_stream(stream.parse_stream(stream.read_lines(spark, str(src)), Parser(), "lattice"), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.processAllAvailable()
    (src / "b.txt").write_text("third\n")
    q.processAllAvailable()
    q.stop()
    back = read_layer(read_blocks(spark, str(tmp_path / "out")), 4)
    assert sorted(back.toPandas().sentence) == ["Anotherline", "Thecatofthehouse.", "third"] and back.where("not is_valid").count() == 0


def test_api(spark):
    assert api.parse_to_string(spark, "cat of dog", "lattice").startswith("* 0 1D 0/1 0.000000\ncat\t")
    assert len(api.parse_strings(spark, ["a", "b c"])) == 2
    own = api.parse_df(spark.createDataFrame([("cat of dog",)], "sentence string"), features=lambda t, c, i, n: F.array(F.lit("A:x"))).first()
    assert [c.features for c in own.chunks] == [["A:x"]] * 2
    api.register(spark)
    assert spark.sql("select k_width('a漢') w, k_lower('ABÉ') l").first()[:] == (3, "abÉ")
