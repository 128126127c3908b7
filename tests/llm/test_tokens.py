import os
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import bpe, mixing, splitting

tiktoken = pytest.importorskip("tiktoken")
pytestmark = pytest.mark.skipif(not os.path.exists(bpe.DEFAULT_PATH), reason="no vocabulary")


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.encoder().machine.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text("ab cd'\n\t  .!!é漢字🎉ёЖ01s<|>", max_size=80))
def test_encoding_and_stream_decoding(text):
    ref = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.encoder().machine.ranks, special_tokens={})
    ids = bpe.encoder().encode(text)
    assert list(ids) == ref.encode_ordinary(text)
    assert "".join(bpe.decode_stream(ids)) == text


def test_long_parts_and_special_strings(reference):
    enc = bpe.encoder()
    for text in ("a" * 5000, "ab" * 3000, "漢" * 2000, "<|endoftext|>", " " * 3000, "\n" * 777, "=" * 1500):
        assert list(enc.encode(text)) == reference.encode_ordinary(text)


def test_states_may_be_dropped(reference, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_STATES", 50)
    machine = bpe.Transducer(bpe.encoder().machine.ranks)
    for word in ("internationalisation", "Zorbelkaquo", "ünïcödé", "".join(random.Random(5).choice("abcdefgh") for _ in range(3000))):
        assert list(machine.encode(word.encode())) == reference.encode_ordinary(word)
    assert len(machine.members) <= 52


def test_neighbours_by_their_halves():
    machine, rng = bpe.encoder().machine, random.Random(1)
    tokens = [t for t, piece in machine.bytes_of.items() if len(piece) < 9]
    for _ in range(3000):
        a, b = rng.choice(tokens), rng.choice(tokens)
        if machine.fits(-1, a):
            whole = machine.merged(machine.bytes_of[b]) == [b] and machine.merged(machine.bytes_of[a] + machine.bytes_of[b]) == [a, b]
            assert machine.fits(a, b) == whole, (a, b)


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=20))
def test_utf8_state_machine(data):
    s = bpe.Utf8Stream()
    got = "".join(s.feed(data[i : i + 1]) for i in range(len(data))) + s.close()
    assert got.replace("�", "") == data.decode("utf-8", "replace").replace("�", "")


def test_columns(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, ""), (3, None), (4, "Hello world")], "n int, ids string")
    got = {r.n: (r.out, r.k, r.back) for r in df.select("n", bpe.token_ids(F.col("ids")).alias("out"), bpe.token_count(F.col("ids")).alias("k"), bpe.decoded(bpe.token_ids(F.col("ids"))).alias("back")).collect()}
    assert got == {1: ([15496, 995], 2, "Hello world"), 2: ([], 0, ""), 3: ([], 0, ""), 4: ([15496, 995], 2, "Hello world")}


def brute(counts, goal):
    sums = {0}
    for length, n in counts.items():
        sums = {s + length * k for s in sums for k in range(n + 1)}
    return min(sums, key=lambda s: (abs(s - goal), s))


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 4), min_size=1, max_size=6), st.integers(0, 400))
def test_nearest_sum(counts, goal):
    got = mixing.nearest_sum(counts, goal)
    assert all(0 < k <= counts[length] for length, k in got.items())
    assert abs(sum(length * k for length, k in got.items()) - goal) == abs(brute(counts, goal) - goal)


def test_fit_source_in_rounds():
    counts = {7: 3, 5: 2, 12: 1}  # 43 tokens
    whole, extra = mixing.fit_source(counts, 100, 3)
    assert whole == 2 and sum(x * k for x, k in extra.items()) == 14
    assert mixing.fit_source(counts, 1000, 3) == (3, {}) and mixing.fit_source({}, 10, 2) == (0, {})


def test_mixture(spark):
    rng = random.Random(3)
    docs = [(i, "word " * rng.randint(1, 40), s) for i, s in enumerate(["a"] * 300 + ["b"] * 60 + ["c"] * 5)] + [(900, None, "a"), (901, "", "b"), (902, "x", None), (903, "y", "zz")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, source string, n_tokens int")
    goals = spark.createDataFrame([("a", 0.6, 1), ("b", 0.3, 2), ("c", 0.08, 6), ("none", 0.02, 2)], "source string, target_share double, max_repeats int")
    mix, shares = mixing.mixture(df, goals)
    rows, report = mix.collect(), {r.source: r for r in shares.collect()}
    for s, share, cap in (("a", 0.6, 1), ("b", 0.3, 2), ("c", 0.08, 6)):
        assert abs(report[s].actual_share - share / 0.98) < 0.01 and report[s].most_uses <= cap
        assert sum(r.n_tokens * r.copies for r in rows if r.source == s) == report[s].mixed_tokens
        assert max(r.copies for r in rows if r.source == s) <= cap
    assert report["none"].mixed_tokens == 0 and len({r.doc_id for r in rows}) == len(rows)
    again = mixing.mixture(df.repartition(7), goals)[0].collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))
    full = {r.source: r for r in mixing.mixture(df, goals, total=10_000_000)[1].collect()}
    assert all(full[s].most_uses == cap for s, cap in (("a", 1), ("b", 2), ("c", 6)))
    none, empty = mixing.mixture(df.limit(0), goals)
    assert none.count() == 0 and {r.mixed_tokens for r in empty.collect()} == {0}


def check_pieces(text, pieces, most, overlap, reference):
    at = 0
    for k, (a, b, kind) in enumerate(pieces):
        off = splitting.Offsets(text)
        x, y = int(off.char[a]), int(off.char[b])
        assert b - a <= most and len(reference.encode_ordinary(text[x:y])) == b - a
        if k:
            shared = pieces[k - 1][1] - a
            assert overlap <= shared and (shared <= overlap + 8 or "'" in text) and (overlap or shared == 0) and b > pieces[k - 1][1]
        assert x <= at
        at = y
    assert at == len(text)


@settings(max_examples=60, deadline=None)
@given(st.text("ab .\n#漢é🎉!'1", min_size=60, max_size=400), st.sampled_from([(16, 0), (16, 4), (24, 12)]))
def test_pieces(text, limits):
    ref = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.encoder().machine.ranks, special_tokens={})
    off = splitting.Offsets(text)
    if off.n > limits[0]:
        check_pieces(text, splitting.cuts(off, *limits), *limits, ref)


def test_boundaries(reference):
    para = "One two three four. Five six seven eight nine ten. "
    text = "# Head\n\n" + para * 3 + "\n\n# Next\n\n" + para * 3
    pieces = splitting.cuts(splitting.Offsets(text), 60, 0)
    assert pieces[0][2] == "heading" and pieces[-1][2] == "end"
    long = "x" * 3000
    assert {k for _, _, k in splitting.cuts(splitting.Offsets(long), 64, 8)} == {"hard", "end"}
    check_pieces(long, splitting.cuts(splitting.Offsets(long), 64, 8), 64, 8, reference)


def test_split_texts(spark):
    df = spark.createDataFrame([(1, "word " * 300), (2, None), (3, ""), (4, "short")], "doc_id long, text string").withColumn("profile", F.lit("clash"))
    out = splitting.split_texts(df, "doc_id", "text", [("s", 64, 8), ("l", 2000, 0)]).collect()
    assert {(r.doc_id, r.profile) for r in out} == {(1, "s")} and max(r.n_tokens for r in out) <= 64
    assert splitting.split_texts(df.limit(0), "doc_id", "text", [("s", 64, 8)]).count() == 0
    limits = spark.createDataFrame([("s", 64, None), (None, 5, 1)], "profile string, max_tokens int, overlap_tokens int")
    assert splitting.profiles_of(limits) == [("s", 64, 0)]


def test_hot_length_in_a_mixture(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("five words of one length")).otherwise(F.concat(F.lit("word "), F.col("id").cast("string"))).alias("text"), F.when(F.col("id") % 10 == 0, F.lit("b")).otherwise(F.lit("a")).alias("source"))
    goals = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], "source string, target_share double, max_repeats int")
    mix, shares = mixing.mixture(docs, goals)
    report = {r.source: r for r in shares.collect()}
    assert abs(report["a"].actual_share - 0.5) < 0.001
    assert {s: n for s, n in mix.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies"))).collect()} == {s: r.mixed_tokens for s, r in report.items()}


def test_lengths_keep_their_shares():
    counts = {length: 3 for length in range(1, 6001)}
    total = sum(length * n for length, n in counts.items())
    for budget in (total // 2, total // 3 + 17, total * 5 // 2):
        whole, extra = mixing.fit_source(counts, budget, 4)
        assert whole * total + sum(length * k for length, k in extra.items()) == budget
        assert all(0 < k <= counts[length] for length, k in extra.items())
        thirds = [sum(extra.get(length, 0) for length in range(a, a + 2000)) / 6000 for a in (1, 2001, 4001)]
        assert max(thirds) - min(thirds) < 0.02


def test_a_source_of_one_long_document_and_short_ones():
    whole, extra = mixing.fit_source({1_000_000: 1, 3: 5}, 600_000, 1)
    assert whole == 0 and abs(sum(length * k for length, k in extra.items()) - 600_000) <= 400_015


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 4), min_size=1, max_size=6), st.integers(1, 400))
def test_small_budgets_are_fitted_as_near_as_can_be(counts, goal):
    total = sum(length * n for length, n in counts.items())
    if goal < total:
        whole, extra = mixing.fit_source(counts, goal, 1)
        assert whole == 0 and abs(sum(length * k for length, k in extra.items()) - goal) == abs(brute(counts, goal) - goal)


#: The boundaries by definition, one text at a time.
BOUNDS = (
    re.compile(r"(?<!\s)\s*\n(?=#{1,6}[ \t]|[=\-*_]{3,}[^\S\n]*(?:\n|$))"), re.compile(r"(?<!\s)\s*\n[^\S\n]*\n\s*"), re.compile(r"(?<![^\S\n])[^\S\n]*\n"),
    re.compile(r"(?<=[.!?؟。！？…])[\"'”’»)\]]*(?=\s)|(?<=[。！？])[”’」』]*"), re.compile(r"(?<=\S)(?=\s)|(?<=[぀-ヿ㐀-鿿，；、])(?=[぀-ヿ㐀-鿿])"),
)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("ab .!?\n\n#-=\t\"'”)」。，漢字…\x85\x1c", min_size=1, max_size=60), min_size=1, max_size=4))
def test_boundaries_by_definition(texts):
    made = splitting.offsets_of(texts)
    assert [o.text for o in made] == texts
    for off in made:
        for kind, bounds, found in zip(splitting.KINDS, off.bounds, BOUNDS):
            places = {m.end() if kind == "sentence" else m.start() for m in found.finditer(off.text)}
            ends = {int(c): i for i, c in enumerate(off.char) if i and c > 0}
            assert bounds.tolist() == sorted(ends[p] for p in places if p in ends), (kind, off.text)
