import itertools
import re

import pytest
from pyspark.sql import functions as F

from millrace.functions import constants as K
from millrace.functions import text as X
from millrace.operators import audit, augment, checker, dedup, gates, inference, metrics, sampling, tagging, validators
from millrace.operators.ranking import hash_rank, ntile
from millrace.plans import preprocess

C = "struct<type:string,target:int,relation:string,keywords:array<string>,keyword:string,value:string>"


def verdict(spark, response, **c):
    row = (response, (c.get("type"), c.get("target"), c.get("relation"), c.get("keywords"), c.get("keyword"), c.get("value")))
    df = spark.createDataFrame([row], f"r string, c {C}").select(checker.facts(F.col("r")).alias("f"), "c")
    return df.select(checker.check(F.col("f"), F.col("c"))).first()[0]


@pytest.mark.parametrize(
    ("response", "c", "wanted"),
    [
        ("one two three", {"type": "length_constraint:word_count", "target": 3, "relation": "exactly"}, True),
        ("one", {"type": "length_constraint:word_count", "value": "2"}, False),
        ("one", {"type": "length_constraint:word_count", "value": "x"}, None),
        ("A. B.", {"type": "length_constraint:sentence_count", "target": 2, "relation": "eq"}, True),
        ("a\n\nb", {"type": "length_constraint:paragraph_count", "target": 3}, False),
        ("The Cat", {"type": "keywords:existence", "keywords": ["cat", "the"]}, True),
        ("The Cat", {"type": "keywords:existence"}, True),
        ("cat cat", {"type": "keywords:frequency", "keyword": "CAT", "target": 2}, True),
        ("cat", {"type": "keywords:frequency", "keywords": [], "target": 2}, None),
        ("cat", {"type": "keywords:forbidden", "keyword": "dog"}, True),
        ("  Yes sir", {"type": "start_with", "value": "yes"}, True),
        ("end.", {"type": "end_with", "value": "END. "}, False),
        ("A BIG day", {"type": "capitalization:all_caps_count", "target": 1}, False),
        ("low", {"type": "capitalization:all_lowercase"}, True),
        ("- a\n* b\n•c", {"type": "format:bullet_points", "target": 2, "relation": "eq"}, True),
        ("1. ", {"type": "format:numbered_list"}, False),
        ("2) x", {"type": "format:numbered_list"}, True),
        ("####", {"type": "format:sections", "target": 2, "relation": "eq"}, True),
        (' {"a": 1} ', {"type": "format:json"}, True),
        ("NaN", {"type": "format:json"}, True),
        ("", {"type": "format:json"}, False),
        ("", {"type": "language:english"}, True),
        ("привет мир hello", {"type": "language:english"}, False),
        ("a, b", {"type": "punctuation:no_comma"}, False),
        ("tips: x", {"type": "detectable_content:postscript"}, True),
        ("**b** and *i*", {"type": "detectable_format:highlight", "target": 2, "relation": "eq"}, True),
        ("plain", {"type": "detectable_format:highlight"}, False),
        ("x", {"type": "unknown:custom"}, None),
        (None, {"type": "punctuation:no_comma"}, None),
    ],
)
def test_checkers(spark, response, c, wanted):
    assert verdict(spark, response, **c) is wanted


def test_report(spark):
    rows = [(1, [("a", True), ("b", None)]), (2, [("a", True), ("b", False)]), (3, []), (4, [("a", None)])]
    df = spark.createDataFrame(rows, "i int, rs array<struct<type:string,passed:boolean>>")
    got = {r.i: (r.x.num_constraints, r.x.num_checked, r.x.num_passed, r.x.per_constraint_csr, r.x.hard_csr) for r in df.select("i", checker.report(F.col("rs")).alias("x")).collect()}
    assert got == {1: (2, 1, 1, 1.0, True), 2: (2, 2, 1, 0.5, False), 3: (0, 0, 0, 0.0, False), 4: (1, 0, 0, 0.0, False)}


def test_integrity(spark):
    rows = [(1, {"a": ["x"]}, 1), (2, None, 1), (3, {}, None), (4, {"a": []}, None), (5, {"a": ["x", " "]}, 2), (6, {"a": ["x"]}, 2), (7, {"a": ["x"]}, None), (8, {"a": None}, None), (9, {"a": [None]}, None)]
    df = spark.createDataFrame(rows, "i int, m map<string,array<string>>, n int")
    got = {r.i: r.x for r in df.select("i", gates.integrity(F.col("m"), F.col("n")).alias("x")).collect()}
    assert got == {1: None, 2: "missing", 3: "missing", 4: "empty_category", 5: "blank_item", 6: "count_mismatch", 7: None, 8: "empty_category", 9: "blank_item"}


def test_integrity_of_json(spark):
    cells = ['{"a": ["x"]}', None, "", "{bad", "null", "{}", "[1]", '"t"', '{"a": "x"}', '{"a": []}', '{"a": [" "]}', '{"a": [1]}', '{"a": ["x", "y"]}']
    df = spark.createDataFrame([(i, c, "1" if i < 12 else "z") for i, c in enumerate(cells)], "i int, c string, n string")
    got = [r.x for r in df.select("i", gates.integrity_json(F.col("c"), F.col("n")).alias("x")).orderBy("i").collect()]
    assert got == [None, "missing", "missing", "missing", "missing", "missing", "not_object", "not_object", "bad_category", "bad_category", "blank_item", "blank_item", "bad_count"]


def _records(spark):
    long = "Please write a short and friendly note about the old harbour wall near our little town"
    rows = [(1, "s", long, "Fine.", {"a": ["x"]}, 1, "en"), (2, "s", "Too short", "Fine.", {"a": ["x"]}, 1, "en"), (3, "s", long + ".", " ", {"a": ["x"]}, 1, "en"), (4, "t", long, "Ok", {}, 0, None), (5, None, long, "Ok", {"a": ["x"]}, 1, "fr"), (6, "t", long.upper(), "Ok", {"a": ["x"]}, 1, None)]
    return spark.createDataFrame(rows, "line_no long, source string, winner_prompt string, response_of_winner_prompt string, added_constraint map<string,array<string>>, added_constraint_num int, detected string")


def test_gates_funnel_and_first_seen(spark):
    g = preprocess.gated(_records(spark))
    assert {r.line_no: r.skip_reason for r in g.collect()} == {1: None, 2: "too_short", 3: "empty_response", 4: "bad_constraint", 5: "language", 6: None}
    assert gates.funnel(g).first().asDict() == {"total": 6, "kept": 2, "language": 1, "too_short": 1, "unprintable": 0, "empty_response": 1, "bad_constraint": 1}
    assert [r.line_no for r in preprocess.kept(g).collect()] == [1]
    assert {r.source: (r.n_rows, r.n_passed, r.n_kept) for r in preprocess.by_source(g).collect()} == {"s": (3, 1, 1), "t": (2, 1, 0), None: (1, 0, 0)}
    assert {r.line_no: r.skip_reason for r in preprocess.run(_records(spark))[0].collect()}[6] == "exact"


def _greedy(sets, threshold):
    kept = []
    for i, s in sets:
        if not any(len(s & t) / len(s | t) >= threshold for _, t in kept):
            kept.append((i, s))
    return {i for i, _ in kept}


def test_near_dedup_against_a_sequential_loop(spark, sf):
    df = spark.read.parquet(f"{sf}/cv_records.parquet")
    texts = {r.row_no: r.winner_prompt or "" for r in df.select("row_no", "winner_prompt").collect()}
    shingle = lambda t: {t[i : i + 5] for i in range(max(1, len(t) - 4))}
    got = {r.row_no: r.reason for r in dedup.near_dedup(df, "row_no", F.col("winner_prompt"), 0.6).collect()}
    norm = lambda t: " ".join(t.lower().split())
    firsts, seen = [], set()
    for i in sorted(texts):
        if norm(texts[i]) not in seen:
            seen.add(norm(texts[i]))
            firsts.append((i, shingle(texts[i])))
    assert {i for i, r in got.items() if r != "exact"} == {i for i, _ in firsts}
    assert {i for i, r in got.items() if r is None} == _greedy(firsts, 0.6)
    assert set(got) == set(texts)


def test_chains_are_not_merged(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "a long, b long")
    ids = spark.createDataFrame([(i,) for i in range(1, 6)], "id long")
    assert {r.id: r.kept for r in dedup.greedy(ids, pairs).collect()} == {1: True, 2: False, 3: True, 4: False, 5: True}


def test_hash_rank_and_ntile(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 3).alias("g"), F.sha2(F.col("id").cast("string"), 256).alias("h"))
    want = {k: i for i, k in enumerate(sorted(range(1000), key=lambda k: __import__("hashlib").sha256(str(k).encode()).hexdigest()), 1)}
    assert {r.k: r["rank"] for r in hash_rank(df, "h", "k").collect()} == want
    per = hash_rank(df, "h", "k", ["g"]).collect()
    for g in range(3):
        assert sorted(r["rank"] for r in per if r.g == g) == list(range(1, 1 + sum(1 for k in range(1000) if k % 3 == g)))
    sizes = spark.range(1, 13).select(ntile(F.col("id"), F.lit(12), 5).alias("t")).groupBy("t").count().orderBy("t").collect()
    assert [r["count"] for r in sizes] == [3, 3, 2, 2, 2]


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(500).withColumn("g", F.when(F.col("id") < 170, F.lit(None)).otherwise(F.col("id") % 2))
    for f in (lambda d: sampling.folds(d, "id", 4), lambda d: sampling.per_group(d, "g", "id", 10), lambda d: sampling.stratified(d, "g", "id", 30), lambda d: sampling.holdout(d, "id"), lambda d: sampling.shuffled(d, "id")):
        a, b = (sorted(map(tuple, f(d).collect()), key=str) for d in (df, df.repartition(7)))
        assert a == b
    assert sampling.holdout(df, "id").where("split = 'val'").count() == 50
    assert {r.g: r["count"] for r in sampling.per_group(df, "g", "id", 10).groupBy("g").count().collect()} == {None: 10, 0: 10, 1: 10}


def test_tags(spark):
    rows = [(1, {"strat_with": ["a"], "Start_With": ["b", "c"], "Tone": ["d"]}), (2, {"Tone": ["a"], "Style": ["b"]}), (3, {}), (4, None), (5, {"Tone": None})]
    df = spark.createDataFrame(rows, "k int, m map<string,array<string>>")
    got = {r.k: (r.primary_cluster, r.cluster_label, r.num_constraint_types) for r in tagging.assign(df, "k", F.col("m")).collect()}
    assert got == {1: ("Start_With", "Start_With+Tone", 2), 2: ("mixed", "Style+Tone", 2), 3: ("unconstrained", "unconstrained", 1), 4: ("unconstrained", "unconstrained", 1), 5: ("Tone", "Tone", 1)}


def test_categories(spark):
    m = {"Length": ["Use between 2 and 4 words.", "Stay under 1 sentences."], "Keyword": ['Use "red" 2 times'], "Start_With": ['Start with "one"'], "End_With": ['End with "two"'], "Format": ["wrap in <<x>>"]}
    df = spark.createDataFrame([(1, "One red two", m), (2, "lollipop one two three four five", m), (3, "", None)], "i int, r string, m map<string,array<string>>")
    f = df.select("i", "m", validators.category_facts(F.col("r")).alias("f"))
    got = {r.i: r.x.asDict() for r in f.select("i", validators.category_verdicts(F.col("f"), F.col("m")).alias("x")).collect()}
    assert got[1] == {"length_ok": True, "keyword_ok": False, "start_ok": True, "end_ok": True, "format_ok": False, "tone_ok": True, "style_ok": True, "role_ok": True, "numerical_ok": True, "csr": 7 / 9}
    assert not got[2]["tone_ok"] and not got[2]["length_ok"]
    assert got[3]["csr"] == 1.0


def test_rules(spark):
    cells = ['{"word_length": {"func_input": ["t", ["2", 4], null]}, "keyword": {"func_input": ["t", {"a": 1}]}}', '{"word_length": {"func_input": ["t", null, 10]}, "start_with": {"func_input": ["t", 5]}}', "{bad", None, "[]"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string").select("i", validators.parsed_rules(F.col("c")).alias("p"))
    got = [tuple(r.p) for r in df.orderBy("i").collect()]
    assert got == [(2, 4, {"a": 1}, None, None), (8, 12, None, None, None), *[(None,) * 5] * 3]
    scored = df.select("i", validators.rule_verdicts(F.lit("a b c"), F.col("p")).alias("v")).select("i", validators.rule_score(F.col("v")).alias("e"), validators.rule_score(F.col("v"), 1.0).alias("t"))
    assert [(r.e, r.t) for r in scored.orderBy("i").collect()] == [(1.0, 1.0), (0.0, 0.0), (0.0, 1.0), (0.0, 1.0), (0.0, 1.0)]


def test_metrics(spark):
    rows = [("L1", 2, 1, 0.5, False), ("L1", 1, 1, 1.0, True), ("L3", 0, 0, 0.0, False), (None, 1, 1, 1.0, True)]
    df = spark.createDataFrame(rows, "difficulty_level string, num_checked int, num_passed int, per_constraint_csr double, hard_csr boolean")
    got = {r.level: (r.n, r.mean_csr, r.hard_csr) for r in metrics.csr_by_level(df).collect()}
    assert got == {"L1": (2, 0.75, 0.5), "L2": (0, 0.0, 0.0), "L3": (0, 0.0, 0.0), "L4": (0, 0.0, 0.0), "Overall": (3, 2.5 / 3, 2 / 3)}
    folds = spark.createDataFrame([("a", 1, True), ("a", 2, False), ("b", 1, True)], "model string, fold int, ok boolean")
    got = {r.model: (r["mean"], r["std"], r.n_folds) for r in metrics.fold_summary(folds, ["ok"]).collect()}
    assert got["a"][0] == 0.5 and abs(got["a"][1] - 0.5**0.5) < 1e-12 and got["b"][2] == 1
    assert metrics.compare_models(folds, ["ok"], "a", "b").first().winner == "b"


def test_audits_of_empty_tables(spark):
    df = spark.createDataFrame([], "m map<string,array<string>>, t string")
    assert audit.category_counts(df, F.col("m")).count() == 0
    assert audit.imbalance(audit.category_counts(df, F.col("m"))).count() == 0
    assert audit.length_stats(df, ["t"]).count() == 0
    assert [tuple(r) for r in audit.field_coverage(df, ["t"]).collect()] == [("t", 0)]


def test_edits_keep_protected_words(spark):
    text = 'Write 3 lines for Anna about the old harbour and "quiet stones" please'
    df = spark.createDataFrame([(i, text, {"Tone": ["Stay calm."]}) for i in range(20)], "i int, t string, m map<string,array<string>>")
    guard = augment.protected_tokens(F.col("t"), F.col("m"))
    syn = {"old": ["aged"], "lines": ["rows"], "about": ["on"]}
    a = df.select("i", guard.alias("g"), augment.lexical(F.col("t"), guard, F.col("i"), syn, (0.2, 0.2, 0.2, 0.3)).alias("x")).collect()
    b = df.repartition(3).select("i", augment.lexical(F.col("t"), guard, F.col("i"), syn, (0.2, 0.2, 0.2, 0.3)).alias("x")).collect()
    assert {r.i: r.x for r in a} == {r.i: r.x for r in b} and len({r.x for r in a}) > 5
    for r in a:
        assert {"3", "Anna", '"quiet', 'stones"'} <= set(r.x.split())
    same = df.limit(1).select(augment.lexical(F.col("t"), guard, F.col("i"), syn, (0, 0, 0, 0))).first()[0]
    assert same == " ".join(text.split())
    cut = df.select(guard.alias("g"), "t", "i").select(augment.random_deletion(F.col("t"), F.col("g"), F.col("i"), 0.9, 1).alias("x")).collect()
    assert all({"3", "Anna"} <= set(r.x.split()) and len(r.x.split()) < 13 for r in cut)


def test_translation_falls_back(spark):
    rows = [("a", "Name 3 things", {"Tone": ["calm"]}), ("b", "Say calm tone 7", {"Tone": ["calm"]}), ("c", None, None)]
    df = spark.createDataFrame(rows, "id string, p string, m map<string,array<string>>")
    stub = augment.translated(F.col("p"), lambda xs: [x.upper() for x in xs], lambda xs: xs)
    got = {r.id: (r.p, r.fell_back) for r in augment.verified_translation(df, "p", "m", stub, "xx").collect()}
    assert got == {"a_bt": ("Name 3 things", True), "b_bt": ("SAY CALM TONE 7", False), "c_bt": (None, True)}
    three = augment.threefold(df, augment.lexical_rows(df, "p", "m", {}), augment.verified_translation(df, "p", "m", stub, "xx"))
    assert sorted(r.id for r in three.collect()) == ["a", "a_bt", "a_lex", "b", "b_bt", "b_lex", "c", "c_bt", "c_lex"]


def test_inference(spark):
    df = spark.createDataFrame([(1, "x"), (2, None), (3, "yy")], "i int, p string")
    assert [r[0] for r in df.select("i", inference.generated(F.col("p"), lambda: lambda xs: [x * 2 for x in xs]).alias("o")).orderBy("i").select("o").collect()] == ["xx", None, "yyyy"]
    rows = [(1, "even", [("a", None), ("b", True)]), (2, "odd", [("a", None)])]
    s = spark.createDataFrame(rows, "k int, response string, results array<struct<type:string,passed:boolean>>")
    out = inference.judge_open_results(s, "k", lambda r, t: F.when(r == "even", "PASS").otherwise("hm"))
    assert {r.k: (r.num_checked, r.num_passed, r.hard_csr, [x.judged_by for x in r.results]) for r in out.collect()} == {1: (2, 2, True, ["llm", None]), 2: (0, 0, False, [None])}
    assert [r.i for r in inference.not_done(df, spark.createDataFrame([(1,), (1,)], "i int"), "i").orderBy("i").collect()] == [2, 3]


def test_only_first_keeps_whole_rows(spark):
    rows = list(itertools.chain([(5, "A b", "five"), (2, "a  B", "two"), (9, None, "null")], [(i, "c", str(i)) for i in range(10, 60)]))
    df = spark.createDataFrame(rows, "n int, t string, x string")
    got = sorted((r.n, r.x) for r in dedup.only_first(df, "n", X.fingerprint(F.col("t"))).collect())
    assert got == [(2, "two"), (9, "null"), (10, "10")]


def test_training_rows(spark):
    from millrace.operators import training

    df = spark.createDataFrame([(1, "ab", "cde"), (2, "abcdef", "x"), (3, None, "yz"), (4, "ab", None), (5, "é", "x")], "k int, p string, r string").withColumn("labels", F.lit("clash"))
    got = {r.k: (r.input_ids, r.labels) for r in training.training_table(df, "k", F.col("p"), F.col("r"), training.utf8_bytes, 4).collect()}
    assert got == {1: ([97, 98, 99, 100], [-100, -100, 99, 100]), 3: ([121, 122], [121, 122]), 5: ([195, 169, 120], [-100, -100, 120])}


def test_counts_of_json_cells(spark):
    cells = ['{"strat_with": ["a", "b"], "Start_With": "c", "Tone": []}', '[{"type": "Tone"}, {"constraint_type": "Tone"}, {"x": 1}, "Style", null]', "{bad", None, "5"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "k int, c string")
    got = sorted((r.k, r.category, r.n) for r in tagging.constraint_counts_json(df, "k", F.col("c")).collect())
    assert got == [(0, "Start_With", 3), (0, "Tone", 0), (1, "Style", 1), (1, "Tone", 2), (1, "other", 1)]


def test_names_of_characters(spark):
    df = spark.createDataFrame([("é", 3), ("\x80", 1)], "ch string, n int")
    assert {r.ch: (r.name, r.category) for r in audit.named_chars(df).collect()} == {"é": ("LATIN SMALL LETTER E WITH ACUTE", "Ll"), "\x80": ("UNNAMED", "Cc")}


RULES = '{"word_length": {"func_input": ["r", null, 10]}, "keyword": {"func_input": ["r", {"b": 2, "a": 1}]}, "start_with": {"func_input": ["r", "So"]}, "end_with": {"func_input": ["r", ""]}}'


def _examples(spark):
    rows = [
        (1, "So a b b", RULES, '{"Style": ["calm", "brief"], "topic": "boats"}'), (2, "x", "{}", '{"Style": [], "style": ["unused"]}'), (3, "y", "{broken", None),
        (4, "So it is", '{"start_with": {"func_input": ["r", "so "]}}', '{"Topic": [1, "tea"]}'),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "k int, r string, rules string, llm string, judged string").drop("judged")
    items = lambda n: validators.described_items(F.col("llm"), n)
    return df.select("k", "r", validators.parsed_rules(F.col("rules")).alias("p"), items("Style").alias("styles"), items("Topic").alias("topics"))


def test_judge_questions(spark):
    df = _examples(spark)
    cols = F.col("p"), F.col("styles"), F.col("topics")
    got = {r.k: (r.keys, r.q) for r in df.select("k", inference.applicable_keys(*cols).alias("keys"), inference.judge_prompt(F.col("r"), *cols).alias("q")).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: ["length", "keyword", "start_with", "style", "topic"], 2: [], 3: [], 4: ["start_with", "topic"]}
    assert got[2][1] is None and got[3][1] is None
    assert '- length: from 8 to 12 words\n- keyword: contains "a" 1 times or more and "b" 2 times or more\n- start_with: begins with "So"\n- style: its style is all of "calm", "brief"\n- topic: its topic is all of "boats"' in got[1][1]
    assert got[4][1].endswith('{"start_with": 0 or 1, "topic": 0 or 1}')


def test_batch_judge(spark):
    def answers(verdict):
        return lambda: lambda qs: [verdict] * len(qs)

    df = _examples(spark)
    args = F.col("r"), F.col("p"), F.col("styles"), F.col("topics")
    out = {r.k: r.judged for r in inference.batch_judge(df, *args, answers('Sure: {"start_with": 1, "topic": "0", "length": 7}')).collect()}
    assert out[4].asDict() == {"length": None, "keyword": None, "start_with": 1, "end_with": None, "style": None, "topic": 0}
    assert out[1] is None and out[2] is None and out[3] is None  # a key that was asked is missing; nothing was asked
    # a second loader of the same function is another model
    again = {r.k: r.judged for r in inference.batch_judge(df, *args, answers('{"start_with": 0, "topic": true}')).collect()}
    assert (again[4].start_with, again[4].topic) == (0, 1)


def test_scores_of_examples(spark):
    df = _examples(spark).withColumn("v", validators.rule_verdicts(F.col("r"), F.col("p")))
    six = lambda **given: F.struct(*(F.lit(given.get(k)).cast("int").alias(k) for k in validators.KEYS))
    judged = F.when(F.col("k") == 4, six(start_with=1, topic=0))
    out = {r.k: r.x for r in df.select("k", validators.scored(judged, F.col("v"), True).alias("x")).collect()}
    assert (out[4].scorer, out[4].passed, out[4].total, out[4].score, out[4].loss, out[4].topic) == ("judge", 1, 2, 0.5, 0.5, 0)
    assert (out[1].scorer, out[1].length, out[1].keyword, out[1].start_with, out[1].style) == ("rule(fallback)", 0, 1, 1, None)
    assert (out[3].scorer, out[3].total, out[3].score, out[3].loss) == ("rule(fallback)", 0, 0.0, 1.0)
    assert df.select(validators.scored(judged, F.col("v"), False).alias("x")).select("x.scorer").distinct().first()[0] == "rule"


def test_records_without_results_stay(spark):
    rows = [(1, "even", [("a", None)]), (2, "even", []), (3, "even", None)]
    s = spark.createDataFrame(rows, "k int, response string, results array<struct<type:string,passed:boolean>>")
    for out in (inference.judge_open_results(s, "k", lambda r, t: F.lit("PASS")), inference.judge_open_rows(s, "k", lambda r, t: r, lambda: lambda qs: ["PASS"] * len(qs))):
        assert {r.k: (r.num_constraints, r.num_passed, r.hard_csr) for r in out.collect()} == {1: (1, 1, True), 2: (0, 0, False), 3: (0, 0, False)}


def test_mined_constraints_capture_groups(spark):
    text = "Use at least 10 words. Please must start with \"It's\", respond in all caps and avoid using the word: a'b. Do not include commas. Add a P.S."
    df = spark.createDataFrame([(text,)], "t string")
    got = [(m.type, m.raw_match) for m in df.select(X.mined_constraints(F.col("t")).alias("m")).first().m]
    want = [str(m) for p in K.MINED for m in re.findall("(?i)" + p, text)]
    assert want and got == [("parsed_from_prompt", m) for m in want]


def test_targets_by_other_names(spark):
    c = {"type": "length_constraint:word_count", "relation": "exactly"}
    kind = "type string, relation string, count int, num int, value string, forbidden array<string>"
    rows = [("one two", {**c, "count": 2, "value": "9"}, True), ("one two", {**c, "num": 2}, True), ("one two", {**c, "value": "x", "num": 2}, None), ("a Kayak", {"type": "keywords:forbidden", "forbidden": ["kayak"]}, False)]
    df = spark.createDataFrame([(i, r, x) for i, (r, x, _) in enumerate(rows)], f"i int, r string, c struct<{', '.join(x.replace(' ', ':') for x in kind.split(', '))}>")
    names = [x.split()[0] for x in kind.split(", ")]
    got = [r.x for r in df.select("i", checker.facts(F.col("r")).alias("f"), "c").select("i", checker.check(F.col("f"), F.col("c"), names).alias("x")).orderBy("i").collect()]
    assert got == [x for _, _, x in rows]


def test_copies_do_not_meet_in_bands(spark):
    base = "please write a short and friendly note about the old harbour wall near our little town"
    df = spark.range(400).select("id", F.when(F.col("id") < 300, F.lit(base)).when(F.col("id") == 300, F.lit(base + " now")).otherwise(F.sha2(F.col("id").cast("string"), 256)).alias("t"))
    got = dedup.near_pairs(df, "id", F.col("t"))
    assert got.count() == 300 * 299 // 2 + 300
    firsts = df.where("id = 0 OR id >= 300").withColumnRenamed("t", "t")
    assert dedup.first_pairs(firsts).count() == 1


def test_long_chains_settle(spark):
    n = 14
    pairs = spark.createDataFrame([(i, i + 1) for i in range(n)], "a long, b long")
    ids = spark.createDataFrame([(i,) for i in range(n + 1)], "id long")
    assert {r.id: r.kept for r in dedup.greedy(ids, pairs).collect()} == {i: i % 2 == 0 for i in range(n + 1)}


def test_cluster_summary(spark):
    rows = [(1, {"Tone": ["a", "b"], "Length": ["c"]}), (2, {"Tone": ["a"]}), (3, None), (4, {"Tone": ["x"], "Style": ["y"]})]
    df = spark.createDataFrame(rows, "k int, m map<string,array<string>>")
    assigned = tagging.assign(df, "k", F.col("m"))
    got = {(r.section, r.value): (r.n, r.pct) for r in tagging.summary(assigned, "k").collect()}
    assert got["by_primary_cluster", "Tone"] == (2, 50.0) and got["by_primary_cluster", "mixed"] == (1, 25.0)
    assert got["category_presence", "Tone"] == (3, 75.0) and got["category_presence", "unconstrained"] == (1, 25.0)
    assert got["num_constraint_types", "2"] == (2, 50.0) and got["top_cluster_labels", "Style+Tone"] == (1, 25.0)


def test_hot_fingerprint_and_group(spark):
    df = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, F.lit("same text")).otherwise(F.col("id").cast("string")).alias("t"))
    assert dedup.first_seen(df, "id", X.fingerprint(F.col("t"))).where("kept").count() == 4001
    hot = df.select("id", F.when(F.col("id") % 3 == 0, F.lit("h")).otherwise(F.lit("c")).alias("g"))
    assert sampling.per_group(hot, "g", "id", 500).groupBy("g").count().where("count = 500").count() == 2


def test_whole_preprocessing_against_the_sequential_rule(spark, sf, tmp_path):
    from millrace.queries import queries

    given = spark.read.parquet(f"{sf}/instruction_records.parquet")
    near = given.withColumns({"line_no": F.col("line_no") + 100_000, "winner_prompt": F.concat("winner_prompt", F.lit(" Thanks"))})
    nearer = given.where("line_no % 2 = 0").withColumns({"line_no": F.col("line_no") - 100_000, "winner_prompt": F.concat(F.lit("Hello: "), "winner_prompt")})
    given.unionByName(near).unionByName(nearer).write.parquet(f"{tmp_path}/instruction_records.parquet")
    q = queries()
    gated = {r.line_no: r.skip_reason for r in q["skip_reasons"](spark, str(tmp_path)).collect()}
    df = spark.read.parquet(f"{tmp_path}/instruction_records.parquet").select("line_no", "source", X.remove_stopwords(X.clean_text(F.col("winner_prompt"))).alias("t"))
    rows = sorted((r.line_no, r.source, r.t) for r in df.withColumn("fp", X.fingerprint(F.col("t"))).select("line_no", "source", F.struct("t", "fp").alias("t")).collect())
    seen, kept, want = set(), [], dict(gated)
    for line, _, t in rows:
        if gated[line] is None:
            grams = {t.t[i : i + dedup.K] for i in range(max(1, len(t.t) - dedup.K + 1))}
            if t.fp in seen:
                want[line] = "exact"
            elif any(len(grams & k) / len(grams | k) >= 0.85 for k in kept):
                want[line] = "near"
            else:
                kept.append(grams)
            seen.add(t.fp)
    assert list(want.values()).count("near") > 10
    assert {r.line_no: r.skip_reason for r in q["preprocess_full"](spark, str(tmp_path)).collect()} == want
    assert {r.line_no for r in q["preprocess_full_kept"](spark, str(tmp_path)).collect()} == {k for k, v in want.items() if v is None}
    counts = {r.source: (r.n_rows, r.n_passed, r.n_kept) for r in q["preprocess_full_by_source"](spark, str(tmp_path)).collect()}
    for source in {s for _, s, _ in rows}:
        lines = [line for line, s, _ in rows if s == source]
        assert counts[source] == (len(lines), sum(gated[x] is None for x in lines), sum(want[x] is None for x in lines))


def test_broadcasts_are_proven_by_bytes(spark):
    from millrace.session import broadcast_if_small, spread

    df = spark.createDataFrame([(1, "x" * 5000, None), (2, None, {"a": ["b"]})], "k int, `a b` string, m map<string,array<string>>")
    hinted = lambda d: "ResolvedHint" in d._jdf.queryExecution().analyzed().toString()
    assert hinted(broadcast_if_small(df)) and not hinted(broadcast_if_small(df, 1000)) and hinted(broadcast_if_small(df.limit(0), 0))
    one = df.coalesce(1)
    assert spread(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and spread(one.repartition(64)).rdd.getNumPartitions() == 64
    assert sorted(r.k for r in spread(one).collect()) == [1, 2]


def test_samples_keep_few_rows_in_each_task(spark):
    df = spark.range(1000).select("id", (F.col("id") % 2).alias("g"))
    plan = sampling.per_group(df, "g", "id", 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # before and after the shuffle
