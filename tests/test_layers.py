"""Worked examples: reading, heads, links and every output format."""

import pytest
from pyspark.sql import functions as F

from kakari.api import chunks_table
from kakari.functions.patterns import IPA
from kakari.operators.chunks import head_func, select
from kakari.operators.format import to_text
from kakari.operators.links import shift_reduce
from kakari.plans.pipeline import Parser, plan
from kakari.schema import tokens_of
from kakari.sources.layers import read_layer, split_blocks


def built(chunks):
    """A block from (link, head, func, score, tokens); a token is surface/level.level.../type.form/lemma.readings[/tag], all but the surface filled up."""
    out = []
    for i, (link, head, func, score, tokens) in enumerate(chunks):
        out.append(f"* {i} {link}D {head}/{func} {score:.6f}")
        for t in tokens.split():
            surface, levels, form, lemma, *tag = t.split("/")
            fields = (levels.split(".") + ["*"] * 4)[:4] + (form.split(".") if form else ["*", "*"] if lemma else []) + (lemma.split(".") if lemma else [])
            out.append("\t".join([surface, ",".join(fields), *tag]))
    return "\n".join(out) + "\n"


G1 = built(
    [
        (5, 0, 1, 1.062087, "太郎/名詞.固有名詞.人名.名//太郎.タロウ.タロー は/助詞.係助詞//は.ハ.ワ"),
        (2, 0, 1, 1.82121, "花子/名詞.固有名詞.人名.名//花子.ハナコ.ハナコ が/助詞.格助詞.一般//が.ガ.ガ"),
        (3, 0, 2, 0, "読ん/動詞.自立/五段・マ行.連用タ接続/読む.ヨン.ヨン で/助詞.接続助詞//で.デ.デ いる/動詞.非自立/一段.基本形/いる.イル.イル"),
        (5, 0, 1, 0, "本/名詞.一般//本.ホン.ホン を/助詞.格助詞.一般//を.ヲ.ヲ"),
        (5, 1, 2, 0, "次/名詞.一般//次.ツギ.ツギ 郎/名詞.一般//郎.ロウ.ロー に/助詞.格助詞.一般//に.ニ.ニ"),
        (-1, 0, 1, 0, "渡し/動詞.自立/五段・サ行.連用形/渡す.ワタシ.ワタシ た/助動詞/特殊・タ.基本形/た.タ.タ"),
    ]
)
#: Indent, chunk, dashes and what follows them.
TREE = "".join(" " * pad + text + "-" * n + rest + "\n" for pad, text, n, rest in ((4, "太郎は", 9, "D"), (6, "花子が", 1, "D     |"), (4, "読んでいる", 1, "D   |"), (12, "本を", 3, "D"), (12, "次郎に", 1, "D"), (14, "渡した", 0, ""), (0, "EOS", 0, "")))
G2 = built(
    [
        (1, 0, 1, 1.230433, "太郎/名詞.固有名詞.人名.名///B-PERSON と/助詞.並立助詞///O"),
        (4, 0, 1, 0.83009, "花子/名詞.固有名詞.人名.名///B-PERSON は/助詞.係助詞///O"),
        (3, 1, 1, 0.381847, "2003/名詞.数///B-DATE 年/名詞.接尾.助数詞///I-DATE"),
        (4, 0, 1, 0, "奈良先端大/名詞.固有名詞.組織///B-ORGANIZATION を/助詞.格助詞.一般///O"),
        (-1, 1, 2, 0, "卒業/名詞.サ変接続///O し/動詞.自立///O た/助動詞///O"),
    ]
)


def blocks(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "block int, text string")


@pytest.fixture(scope="module")
def g1(spark):
    return read_layer(blocks(spark, G1), 4).cache()


def test_reads_the_six_chunk_sentence(g1):
    r = g1.first()
    assert r.is_valid and r.sentence == "太郎は花子が読んでいる本を次郎に渡した"
    assert len(r.tokens) == 14 and [c.link for c in r.chunks] == [5, 2, 3, 5, 5, -1]
    assert [(c.token_pos, c.token_size) for c in r.chunks] == [(0, 2), (2, 2), (4, 3), (7, 2), (9, 3), (12, 2)]


def test_head_and_function_words(g1):
    made = g1.select(F.transform("chunks", lambda c: head_func(tokens_of(c, F.col("tokens")), IPA)).alias("h")).first().h
    assert [(x["head"], x["func"]) for x in made] == [(0, 1), (0, 1), (0, 2), (0, 1), (1, 2), (0, 1)]


def test_tree(g1):
    assert to_text(g1, "tree", out="o").first().o == TREE


def test_lattice_round_trip(g1):
    assert to_text(g1, "lattice", out="o").first().o == G1 + "EOS\n"
    assert to_text(g1, "tree_lattice", out="o").first().o == TREE + G1 + "EOS\n"


def test_features(g1):
    c = select(g1, "IPA").first().chunks
    assert c[0].features == ["FCASE:は", "FHS:太郎", "FHP0:名詞", "FHP1:固有名詞", "FHP2:人名", "FHP3:名", "FFS:は", "FFP0:助詞", "FFP1:係助詞", "FLS:太郎", "FLP0:名詞", "FLP1:固有名詞", "FLP2:人名", "FLP3:名", "FRS:は", "FRP0:助詞", "FRP1:係助詞", "LF:は", "RL:太郎", "RH:太郎", "RF:は", "FBOS:1", "GCASE:は", "A:は"]
    assert c[2].features[-1] == "A:基本形" and "FFF:基本形" in c[2].features and c[5].features[-2] == "FEOS:1"


def test_conll(g1):
    rows = [x.split("\t") for x in to_text(g1, "conll", out="o").first().o.split("\n")[:-2]]
    assert [int(r[6]) for r in rows] == [2, 13, 4, 5, 6, 7, 8, 9, 13, 11, 12, 13, 14, 0]
    assert [r[7] for r in rows] == list("_D_D__D_D__D__") and rows[4][2] == "読む" and rows[0][4] == "名詞-固有名詞-人名-名"
    assert rows[0][5].endswith("|begin_chunk=1|head=1") and rows[1][5].endswith("|func=1")


def test_entities_in_tree_and_xml(spark):
    r = read_layer(blocks(spark, G2), 4)
    out = to_text(r, "tree", out="o").first().o
    assert "<PERSON>太郎</PERSON>と" in out and "<DATE>2003年</DATE>-D" in out and "<ORGANIZATION>奈良先端大</ORGANIZATION>を" in out
    x = to_text(r, "xml", out="o").first().o
    assert x.startswith('<sentence>\n <chunk id="0" link="1" rel="D" score="1.230433" head="0" func="1">\n  <tok id="0" feature="名詞,固有名詞,人名,名" ne="B-PERSON">太郎</tok>\n') and x.count("</chunk>") == 5


@pytest.mark.parametrize(
    "text, ok",
    [("", True), ("* 0 -1D\na\tb\n* 2 -1D\na\tb\n", False), ("* 0 -1D\n* 1 -1D\na\tb\n", False), ("* 0 7D\na\tb\n", False), ("* 0 -1D\na\tb\n* 1 -1D\n", False), ("* x\na\tb\n", False), ("* 0 -1D\n*\tb\n", True), ("a\tb", True)],
)
def test_validity(spark, text, ok):
    assert read_layer(blocks(spark, text), 2).first().is_valid is ok


def test_token_layer_passes_over_chunk_lines(spark):
    r = read_layer(blocks(spark, G1), 1).first()
    assert len(r.tokens) == 14 and r.chunks == []


def test_first_other_line_ends_a_block(spark):
    assert len(read_layer(blocks(spark, "a\tb\nstray\nc\td\n"), 1).first().tokens) == 1


def test_modes(spark):
    both = blocks(spark, "* 1 -1D\na\tb\n", G1)
    assert read_layer(both, 2, mode="DROPMALFORMED").count() == 1
    with pytest.raises(Exception, match="malformed block"):
        read_layer(both, 2, mode="FAILFAST").select("is_valid").collect()


def test_split_blocks(spark):
    df = spark.createDataFrame([("a\tb\nEOS\nc\td\n\ne\tf\n",), ("EOS\n",), ("a\tb",)], "t string")
    assert [r[0] for r in df.select(split_blocks(F.col("t"))).collect()] == [["a\tb", "c\td", "e\tf"], [""], ["a\tb"]]


def test_scores_of_the_pass(spark):
    df = spark.range(1).select(F.lit(4).alias("n"))
    links = df.select(shift_reduce(F.col("n"), lambda s, d: F.lit(-2.5)).alias("x")).first().x
    assert [(x.dst, x.score) for x in links] == [(3, -2.5), (3, -2.5), (3, -2.5)]
    assert df.select(shift_reduce(F.lit(2), lambda s, d: F.lit(9.0)).alias("x")).first().x[0].score == 0.0
    assert df.select(shift_reduce(F.lit(1), lambda s, d: F.lit(9.0)).alias("x")).first().x == []


def test_plans():
    assert plan(0, 4, 1) == ["tokens", "entities", "chunks", "selection", "links"]
    assert plan(1, 1, 0) == [] and plan(1, 2, 1) == ["entities", "chunks"] and plan(2, 3, 1) == ["selection"]
    assert plan(3, 4) == ["links"] and plan(4, 4) == [] and plan(2, 1, 1) == []
    with pytest.raises(ValueError):
        plan(0, 5)


def test_parse_raw(spark):
    df = spark.createDataFrame([("The cat of the house (3) is seen.",), ("",), (None,)], "sentence string")
    rows = Parser().parse(df).collect()
    assert [c.link for c in rows[0].chunks] == [*range(1, len(rows[0].chunks)), -1]
    assert [(len(r.tokens), len(r.chunks)) for r in rows[1:]] == [(0, 0), (0, 0)]
    one = chunks_table(Parser().parse(df.limit(1)), "sentence")
    assert one.count() == len(rows[0].chunks)
