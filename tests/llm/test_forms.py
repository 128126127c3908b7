import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import codepoints as cp
from millrace.llm import visual_form as v
from millrace.llm.sentences import sentence_offsets

texts = st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=12), max_size=6)


@settings(max_examples=150, deadline=None)
@given(texts)
def test_round_trip(xs):
    assert cp.texts_of(*cp.from_texts(xs)) == xs
    assert cp.texts_of(*cp.from_texts([*xs, None])) == [*xs, ""]


@settings(max_examples=200, deadline=None)
@given(texts)
def test_canonical_equivalents_and_repetition(xs):
    once = v.form_of(xs)
    assert v.form_of(once) == once
    for form in ("NFC", "NFD"):
        assert v.form_of([unicodedata.normalize(form, x) for x in xs]) == once
    assert [v.form_of([x])[0] for x in xs] == once  # rows do not touch each other


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("aéộ̧̀̈1.ṩñ한", max_size=10), max_size=5))
def test_against_nfc(xs):
    assert v.form_of(xs) == [unicodedata.normalize("NFC", x) for x in xs]


@pytest.mark.parametrize(("a", "b"), [("ｆｕｌｌ　ｗｉｄｔｈ", "full width"), ("éa", "éa"), ("ё", "ë"), ("ﬁn", "fin"), ("a​b­c", "abc"), ("раpа", "papa"), ("𝗄𝖺𝗒", "kay"), ("x\xa0y z", "x y z"), ("한", "한"), ("！", "!")])
def test_same(a, b):
    assert v.form_of([a]) == v.form_of([b])


@pytest.mark.parametrize(("a", "b"), [("é", "e"), ("0", "O"), ("l", "1"), ("A", "a"), ("“x”", '"x"'), ("x.", "x!"), ("½", "1/2"), ("x²", "x2"), ("a\nb", "a b"), ("a  b", "a b"), ("и", "u")])
def test_apart(a, b):
    assert v.form_of([a]) != v.form_of([b])


def test_plain():
    assert cp.texts_of(*v.plain(*cp.from_texts([" Ａ-b,,C! ", "...", "", "É 9"]))) == ["a b c", "", "", "é 9"]


def test_slices_cover_all_rows():
    col = pa.array(["x" * n for n in (5, 0, 3_000, 1, 2)] + [None])
    got = list(cp.slices(col, 10))
    assert got[0][0] == 0 and got[-1][1] == 6 and all(a[1] == b[0] for a, b in zip(got, got[1:]))
    assert list(cp.slices(pa.array([], pa.string()))) == []


def test_gram_and_word_hashes():
    a, offs = cp.gram_hashes(*cp.from_texts(["abcdef", "abc", "xabcdef"]), 5)
    assert offs.tolist() == [0, 2, 2, 5] and set(a[:2]) <= set(a[2:])
    words, woffs, at = cp.word_hashes(*cp.from_texts(["ab cd ab", "", "好 ab好"]))
    assert woffs.tolist() == [0, 3, 3, 6] and words[0] == words[2] and words[3] == words[5]
    seq, soffs = cp.sequence_hashes(words, woffs, 3)
    assert soffs.tolist() == [0, 1, 1, 2] and len(np.unique(seq)) == 2


def test_sentences():
    cps, offs = cp.from_texts(["One. Two! “Three.” 3.5 x\nFour", "", "好。好？a。”b"])
    starts, first = sentence_offsets(cps, offs)
    parts = cp.texts_of(cps, starts)
    assert parts[first[0] : first[1]] == ["One.", " Two!", " “Three.”", " 3.5 x\n", "Four"]
    assert first[1] == first[2] and parts[first[2] :] == ["好。", "好？", "a。”", "b"]


def test_pairs(spark):
    rows = [(1, "café", None), (2, "café", " "), (3, "café​", "​"), (4, "cafe", "x"), (5, "ｃafé", "х"), (6, None, "x"), (7, "", "")]
    df = spark.createDataFrame([(*r, "c", "c") for r in rows], "n long, p string, q string, form string, raw string")
    got = sorted(tuple(r) for r in v.look_alike_pairs(df, "n", ["p", "q"]).collect())
    assert got == [("p", 1, 2), ("p", 1, 3), ("p", 1, 5), ("p", 2, 3), ("p", 2, 5), ("p", 3, 5), ("q", 4, 5), ("q", 5, 6)]
    assert v.look_alike_pairs(df.limit(0), "n", ["p"]).count() == 0
    assert [r[0] for r in df.orderBy("n").select(v.visual_form(F.col("p"))).collect()][5:] == [None, ""]
    big = spark.createDataFrame([(1, "ａ" * 200_000), (2, "a" * 200_000)], "n long, p string")
    assert v.look_alike_pairs(big, "n", ["p"]).count() == 1


def test_hot_values_make_only_their_pairs(spark):
    rows = spark.range(3000).select(F.col("id").alias("n"), F.when(F.col("id") % 3 == 0, F.lit("same text")).otherwise(F.concat(F.lit("text "), F.col("id").cast("string"))).alias("p"))
    assert v.look_alike_pairs(rows, "n", ["p"]).count() == 0
    one = rows.withColumn("p", F.when(F.col("n") == 1, F.lit("ｓame text")).otherwise(F.col("p")))
    assert v.look_alike_pairs(one, "n", ["p"]).count() == 1000
