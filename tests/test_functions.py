"""Column functions against plain versions."""

import string

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kakari.functions import patterns as P
from kakari.functions import text as T


def apply(spark, values, f, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, c {kind}")
    return [r.o for r in rows.select("i", f(F.col("c")).alias("o")).orderBy("i").collect()]


def plain_csv(s):
    out, i = [], 0
    while i < len(s):
        while i < len(s) and s[i] in " \t":
            i += 1
        if i < len(s) and s[i] == '"':
            i, field = i + 1, ""
            while i < len(s):
                if s[i] == '"':
                    i += 1
                    if i >= len(s) or s[i] != '"':
                        break
                field += s[i]
                i += 1
        else:
            j = s.find(",", i)
            field = s[i : len(s) if j < 0 else j]
        j = s.find(",", i)
        i = (len(s) if j < 0 else j) + 1
        out.append(field)
    return out


def test_csv(spark):
    import random

    rng = random.Random(1)
    lines = ["", "a", "a,", ",", ",,", 'a,"b,c",d', '"x""y",z', '"open', "  a, b", "a, ", '"q" rest,t', "名詞,一般,*,*,*,*,\",\",\",\""] + ["".join(rng.choice('ab", ') for _ in range(rng.randint(0, 12))) for _ in range(300)]
    got = apply(spark, lines, T.split_csv)
    assert [(x, y) for x, y in zip(lines, got) if plain_csv(x) != y] == []


def test_csv_round_trip(spark):
    fields = [["a", "b,c", 'd"e', "*"], ["名詞"], ["x", ""]]
    assert apply(spark, fields, lambda c: T.split_csv(T.csv_join(c)), "array<string>") == [["a", "b,c", 'd"e', "*"], ["名詞"], ["x"]]
    assert apply(spark, [[None, "a"]], T.csv_join, "array<string>") == ["*,a"]


def plain_shape(s):
    def cls(ch):
        return next((k for k, r in T.CLASSES.items() if any(a <= ord(ch) <= b for a, b in r)), T.OTHER)

    cap, one, two = False, -1, -1
    for n, c in enumerate(map(cls, s)):
        if cap and c != T.ALPHA:
            cap = False
        if n == 0:
            one = c
        elif n == 1 and one == T.CAPALPHA and c == T.ALPHA:
            one, two, cap = c, one, True
        elif c != T.HYPHEN and c != one:
            one, two = c, one
    return "C" if cap else f"S{one}" if len(s) == 1 else f"M{one}" if two == -1 else f"T{two}-{one}"


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet=string.ascii_letters[20:32] + "12-ーあア漢é\U0001f600", max_size=8), min_size=30, max_size=60))
def test_shape(spark, words):
    assert apply(spark, words, T.char_shape) == [plain_shape(w) for w in words]


def test_normalize(spark):
    words = ["ｶﾞｷﾞﾊﾟﾊ", "ｳﾞ", "ｦﾞﾜﾞ", "ＡＢｃ１２", "a b　c", "，．／", "￥”’―－", "漢字 ", "", None, "ﾞﾟ", "！～"]
    want = ["ガギパハ", "ヴ", "ヲ゛ワ゛", "ABc12", "a___b___c", "，．／", "\\\"'--", "漢字___", "", None, "゛゜", "!~"]
    got = apply(spark, words, T.normalize)
    assert got == want and apply(spark, got, T.normalize) == want


def test_small_functions(spark):
    one = lambda f, v, kind="string": apply(spark, [v], f, kind)[0]
    assert one(T.display_width, "aé漢") == 5
    assert one(T.code_points, "aあ\U0001f600") == [97, 0x3042, 0]
    assert one(lambda c: T.concat_pos(c, 4), ["a", "b", "*", "d"], "array<string>") == "a-b" and one(lambda c: T.concat_pos(c, 4), ["*"], "array<string>") == ""
    assert one(lambda c: T.feature_at(c, 1), ["a", "*"], "array<string>") is None and one(lambda c: T.feature_at(c, 9), ["a"], "array<string>") is None
    assert one(lambda c: T.split_max(c, "\t", 2), "a\tb\tc") == ["a", "b"] and one(lambda c: T.split_collapse(c, " ,"), "a, b,,c ") == ["a", "b", "c"]
    assert one(lambda c: T.replace_first(c, "a", "X"), "bab a") == "bXb a" and one(lambda c: T.replace_first(c, "z", "X"), "bab") == "bab"
    assert one(T.xml_escape, "<a b=\"c\">'&") == "&lt;a b=&quot;c&quot;&gt;&apos;&amp;"
    assert one(T.ascii_lower, "ABÉ") == "abÉ" and one(T.score_text, 1.5, "double") == "1.500000" and one(T.to_number, "x") == 0 and one(T.to_number, "12") == 12
    assert one(T.unescape, "a\\tb\\\\n\\s") == "a\tb\\n "
    assert one(lambda c: T.unpack_pair(T.pair_key(c, F.lit(7)))[0], 12, "int") == 12 and one(lambda c: T.unpack_pair(T.pair_key(c, F.lit(7)))[1], 12, "int") == 7
    assert one(lambda c: T.common(c, F.array(F.lit(2), F.lit(3))), [1, 2, 3], "array<int>") == 2


def test_charsets(spark):
    text = "漢字かな"
    for name, codec in (("EUC-JP", "euc_jp"), ("sjis", "cp932"), ("utf8", "utf8")):
        assert apply(spark, [bytearray(text.encode(codec))], lambda c, name=name: T.decode(c, name), "binary") == [text]
    assert bytes(apply(spark, [bytearray(text.encode("euc_jp"))], lambda c: T.recode(c, "euc-jp", "utf-8"), "binary")[0]) == text.encode()
    with pytest.raises(ValueError):
        T.charset("nonsense")


def test_patterns(spark):
    values = ["助詞,格助詞", "名詞,一般", "助動詞"]
    assert apply(spark, values, P.Pattern.compile("(助詞|助動詞)").prefix) == [True, False, True]
    assert apply(spark, values, P.Pattern.compile("!(助詞|助動詞)").prefix) == [False, True, False]
    assert apply(spark, ["(", "（", "x"], P.OPEN.match) == [True, True, False]
    assert apply(spark, ["a", "b"], P.Pattern.compile("!a").match) == [False, True]
    with pytest.raises(ValueError):
        P.posset("nonsense")
