import hashlib

import pytest
from pyspark.sql import functions as F

from millrace.functions import text as X


def one(spark, f, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r.out for r in df.select("i", f(F.col("t")).alias("out")).orderBy("i").collect()]


@pytest.mark.parametrize(
    ("f", "given", "wanted"),
    [
        (X.remove_html, "a<b class='x'>c</b>&amp;&#39;&#x2F;d", "a c    d"),
        (X.remove_html, "1 < 2\nand <br\n/>3", "1  3"),
        (X.replace_emojis, "go🎉🎉now☀", "go now "),
        (X.drop_unknown, "a\x01b​c!!!!d!!!e", "a bc d!!!e"),
        (X.replace_unknown_chars, "é", "é"),
        (X.normalize_symbols, "“a”—b…€ c→д好", "\"a\"-b... cд好"),
        (X.normalize_whitespace, "\t a \x1f　b\n", "a b"),
        (X.clean_text, "<p>It’s  fine🎉</p>", "It's fine"),
        (X.remove_stopwords, "The cat, and a dog -- (the) end.", "cat, dog -- end."),
        (X.word_count, "", 0),
        (X.word_count, " one  two\n", 2),
        (X.sentence_count, "A. B! . C", 3),
        (X.sentence_pieces, "A. B.", 3),
        (X.paragraph_count, "a\n\n\nb\n\n \n", 2),
        (X.verdict, " pass - good", True),
        (X.verdict, "Failing", False),
        (X.verdict, "it may pass", None),
        (X.normalise_category, " strat_with ", "Start_With"),
        (X.normalise_category, "My Kind", "My_Kind"),
    ],
)
def test_functions(spark, f, given, wanted):
    assert one(spark, f, given, None) == [wanted, None]


def test_printable_share(spark):
    assert one(spark, X.printable_share, "", "ab\x00\n", None, "a b") == [0.0, 0.5, 0.0, 1.0]


def test_clean_text_may_expose_new_markup(spark):
    once = one(spark, X.clean_text, "<<b>i>x")[0]
    assert once is not None and one(spark, X.clean_text, once)[0] is not None


def test_fingerprint_ignores_case_and_spaces(spark):
    a, b = one(spark, X.fingerprint, " A\tb ", "a B")
    assert a == b == hashlib.sha256(b"a b").hexdigest()


def test_shingles_of_short_and_repeated_texts(spark):
    assert one(spark, X.shingles, "abc", "", "aaaaaaa", "abcdefg") == [["abc"], [""], ["aaaaa"], ["abcde", "bcdef", "cdefg"]]


def test_tokens(spark):
    assert one(spark, X.entities, "The Cat saw Ann. Bob met (Eve) and USA 45")[0] == ["cat", "ann", "eve"]
    assert one(spark, X.numbers, "12 a3 4.5 有60个 x_7")[0] == ["12", "4", "5"]
    assert one(spark, X.quoted_words, "say 'Hi There' or \"Yo\"")[0] == ["hi", "there", "yo"]


def test_occurrences_do_not_overlap(spark):
    df = spark.createDataFrame([("aaaa", "aa"), ("abc", ""), ("x", "y")], "t string, k string")
    assert [r[0] for r in df.select(X.occurrences(F.col("t"), F.col("k"))).collect()] == [2, 4, 0]


def test_judge_output(spark):
    raw = ['ok {"style": 1, "topic": 0}', '{"style": true, "topic": "1"}', '{"style": 1}', "none", None, '{"style": {"a": 1}, "topic": 1}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(raw)], "i int, t string")
    got = [r.v and tuple(r.v) for r in df.select("i", X.judge_verdicts(F.col("t"), ["style", "topic"]).alias("v")).orderBy("i").collect()]
    assert got == [(1, 0), (1, 1), None, None, None, None]


@pytest.mark.parametrize(("rel", "n", "target", "wanted"), [("At Least", 3, 3, True), ("<=", 4, 3, False), ("equals", 3, 3, True), ("greater than", 3, 3, False), ("lt", 2, 3, True), ("whatever", 2, 3, False), (None, 5, 3, True), ("eq", 1, None, None)])
def test_relations(spark, rel, n, target, wanted):
    df = spark.createDataFrame([(n, target, rel)], "n int, t int, r string")
    assert df.select(X.compare(F.col("n"), F.col("t"), F.col("r"))).first()[0] is wanted


def test_strict_json(spark):
    good = ["1", "[1]", ' {"a": [1, {"b": null}]} ', '"x"', "true"]
    bad = ["", "5 things", "[1] [2]", "1, 2", "1], [2", "1}", '1,"w":2', '{"a": 1} x', "true story", None, "{"]
    assert [r is not None for r in one(spark, lambda c: F.to_json(X.strict_json(c)), *good)] == [True] * len(good)
    assert one(spark, lambda c: X.strict_json(c).isNotNull(), *bad) == [False] * len(bad)
