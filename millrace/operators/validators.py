"""The other families of validators: rule dictionaries, categories with descriptions, and described constraints.

They differ on purpose in their edge rules (stripping, word lists, defaults without a rule) and are kept apart.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions import constants as K
from millrace.functions import text as X


# Rule dictionaries: {"word_length": {"func_input": [text, [lo, hi] | null, target | null]}, "keyword": {...}, ...}


def parsed_rules(rules: Column) -> Column:
    """Struct (lo, hi, keywords, start, end) of a rule dictionary (JSON text); what is missing or malformed is null."""
    v = X.strict_json(rules)
    get = lambda path, kind: F.try_variant_get(v, path, kind)
    text_only = lambda path: F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", get(path, "string"))
    pair = get("$.word_length.func_input[1]", "array<int>")
    target = get("$.word_length.func_input[2]", "int")
    is_pair = F.size(pair) == 2
    lo = F.when(is_pair, pair[0]).when(target.isNotNull(), F.greatest(F.lit(1), F.floor(target * F.lit(0.8)).cast("int")))
    hi = F.when(is_pair, pair[1]).when(target.isNotNull(), F.floor(target * F.lit(1.2)).cast("int"))
    return F.struct(lo.alias("lo"), hi.alias("hi"), get("$.keyword.func_input[1]", "map<string,int>").alias("keywords"), text_only("$.start_with.func_input[1]").alias("start"), text_only("$.end_with.func_input[1]").alias("end"))


def rule_verdicts(response: Column, p: Column) -> Column:
    """Struct (length, keyword, start, end): true, false or null (no such rule)."""
    low, wc = F.lower(response), X.word_count(response)
    enough = F.forall(F.map_entries(p["keywords"]), lambda e: X.occurrences(low, F.lower(e["key"])) >= e["value"])
    body = F.lower(X.trim_ws(response))
    return F.struct(
        F.when(p["lo"].isNotNull() & p["hi"].isNotNull(), wc.between(p["lo"], p["hi"])).alias("length"),
        F.when(F.size(p["keywords"]) > 0, enough).alias("keyword"),
        F.when(p["start"].isNotNull(), F.startswith(body, F.lower(X.trim_ws(p["start"])))).alias("start"),
        F.when(p["end"].isNotNull(), F.endswith(body, F.lower(X.trim_ws(p["end"])))).alias("end"),
    )


def _tally(verdicts: Column, kinds: tuple[str, ...]) -> tuple[Column, Column]:
    passed = sum((F.coalesce(verdicts[k].cast("int"), F.lit(0)) for k in kinds), F.lit(0))
    total = sum((verdicts[k].isNotNull().cast("int") for k in kinds), F.lit(0))
    return passed, total


RULES = ("length", "keyword", "start", "end")


def rule_score(verdicts: Column, without: float = 0.0) -> Column:
    """Share of applicable rules met; ``without`` where none applies (0 in evaluation, 1 in training)."""
    passed, total = _tally(verdicts, RULES)
    return F.when(total > 0, passed / total).otherwise(F.lit(without))


KEYS = ("length", "keyword", "start_with", "end_with", "style", "topic")


def described_items(cell: Column, name: str) -> Column:
    """Style or topic descriptions of a cell of constraints for a model (JSON text): the texts under the name, or under its
    lower-case form where the name is no key; null where there are none. A single text counts as a list of one."""
    v = X.strict_json(cell)
    has = F.array_contains(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>")), name)
    x = F.when(has, F.try_variant_get(v, f"$.{name}", "variant")).otherwise(F.try_variant_get(v, f"$.{name.lower()}", "variant"))
    is_text = lambda i: F.schema_of_variant(i) == "STRING"
    texts = lambda xs: F.transform(F.filter(xs, lambda i: F.coalesce(is_text(i), F.lit(False))), lambda i: F.try_variant_get(i, "$", "string"))
    items = texts(F.when(is_text(x), F.array(x)).otherwise(F.try_variant_get(x, "$", "array<variant>")))
    return F.when(F.size(items) > 0, items)


def scored(judged: Column, ruled: Column, by_judge: bool) -> Column:
    """Struct of the six verdicts (0, 1 or null), passed, total, score, loss and scorer of one example.

    The judge's verdicts where its output could be read, the keys it was not asked for null; else the rules' (which say nothing on
    style and topic), as rule(fallback), or as rule where there is no judge.
    """
    use = judged.isNotNull() if by_judge else F.lit(False)
    of_rules = {"length": ruled["length"], "keyword": ruled["keyword"], "start_with": ruled["start"], "end_with": ruled["end"]}
    null = F.lit(None).cast("int")
    one = {k: F.when(use, judged[k]).otherwise(of_rules[k].cast("int") if k in of_rules else null) for k in KEYS}
    passed = sum((F.coalesce(v, F.lit(0)) for v in one.values()), F.lit(0))
    total = sum((v.isNotNull().cast("int") for v in one.values()), F.lit(0))
    score = F.when(total > 0, passed / total).otherwise(F.lit(0.0))
    scorer = F.when(use, "judge").otherwise("rule(fallback)" if by_judge else "rule")
    return F.struct(*(v.alias(k) for k, v in one.items()), passed.alias("passed"), total.alias("total"), score.alias("score"), F.round(1 - score, 6).alias("loss"), scorer.alias("scorer"))


# Category validators: constraints are a map from category to descriptions; all nine categories count, always.


def _texts(m: Column, *names: str) -> Column:
    found = F.coalesce(*(F.try_element_at(m, F.lit(n)) for n in names), F.array().cast("array<string>"))
    return F.filter(found, lambda c: c.isNotNull())


_QUOTED = "[\"“”]([^\"]+)[\"“”]"


def _phrases(texts: Column) -> Column:
    quoted = F.filter(texts, lambda c: c.rlike(_QUOTED))
    return F.transform(quoted, lambda c: F.lower(X.trim_ws(F.regexp_extract(c, _QUOTED, 1))))


def category_facts(response: Column) -> Column:
    """What the category validators need of a response; project it first, so that it is computed once a row."""
    return F.struct(response.alias("text"), F.lower(response).alias("low"), X.word_count(response).alias("n_words"), X.sentence_pieces(response).alias("n_pieces"))


def category_verdicts(facts: Column, m: Column) -> Column:
    """Struct of the nine category verdicts and csr, their mean. Categories a record lacks pass."""
    response, low, wc, sc = facts["text"], facts["low"], facts["n_words"], facts["n_pieces"]
    nums = lambda c: F.transform(F.regexp_extract_all(c, F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("bigint"))
    length = _texts(m, "Length")
    ranged = F.filter(length, lambda c: (F.size(nums(c)) >= 2) & F.contains(F.lower(c), F.lit("word")))
    limited = F.filter(length, lambda c: (F.size(nums(c)) >= 1) & F.contains(F.lower(c), F.lit("sentence")))
    times = _QUOTED + r".*?(\d+)\s*[tT][iI][mM][eE][sS]"
    counted = F.filter(_texts(m, "Keyword"), lambda c: c.rlike(times))
    enough = F.forall(counted, lambda c: X.occurrences(low, F.lower(F.regexp_extract(c, times, 1))) >= F.regexp_extract(c, times, 2).cast("bigint"))
    first = F.try_element_at(X.words(low), F.lit(1))
    last = F.try_element_at(F.regexp_extract_all(low, F.lit(K.WORD + "+"), F.lit(0)), F.lit(-1))
    framed = F.exists(_texts(m, "Format"), lambda c: F.contains(c, F.lit("<<")))
    informal = F.lit(False)
    for w in K.INFORMAL:
        informal = informal | F.contains(low, F.lit(w))
    nine = {
        "length_ok": F.forall(ranged, lambda c: wc.between(nums(c)[0], nums(c)[1])) & F.forall(limited, lambda c: sc <= nums(c)[0]),
        "keyword_ok": enough,
        "start_ok": F.forall(_phrases(_texts(m, "Strat_With", "Start_With")), lambda p: F.coalesce(first == p, F.lit(False))),
        "end_ok": F.forall(_phrases(_texts(m, "End_With")), lambda p: F.coalesce(last == p, F.lit(False))),
        "format_ok": ~framed | response.rlike("<<.+?>>"),
        "tone_ok": ~informal,
        "style_ok": F.lit(True),
        "role_ok": F.lit(True),
        "numerical_ok": F.lit(True),
    }
    csr = sum((v.cast("int") for v in nine.values()), F.lit(0)) / len(nine)
    return F.struct(*(v.alias(k) for k, v in nine.items()), csr.alias("csr"))


# Described constraints: (type, description) pairs whose parameters stand in the description.


def described_score(response: Column, kind: Column, description: Column) -> Column:
    """1.0 or 0.0 for one described constraint; kinds that cannot be checked, and descriptions without parameters, give 1.0."""
    d, k, low = F.lower(description), F.lower(kind), F.lower(response)
    nums = F.transform(F.regexp_extract_all(d, F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("bigint"))
    wc, sc = X.word_count(response), X.sentence_pieces(response)
    n0, n1 = F.try_element_at(nums, F.lit(1)), F.try_element_at(nums, F.lit(2))
    has = lambda *xs: _any(F.contains(d, F.lit(x)) for x in xs)
    by_words = F.when(n1.isNotNull(), wc.between(n0, n1)).when(has("at least", "minimum", "more than"), wc >= n0).otherwise(wc <= n0)
    length = F.coalesce(F.when(has("word") & n0.isNotNull(), by_words), F.lit(True)) & F.coalesce(F.when(has("sentence") & n0.isNotNull(), sc <= n0), F.lit(True))
    quoted = "[\"“”]([^\"“”]+)[\"“”]"
    times = quoted + r".*?(\d+)\s*[tT][iI][mM][eE][sS]"
    word = F.lower(X.trim_ws(F.coalesce(F.nullif(F.regexp_extract(description, times, 1), F.lit("")), F.regexp_extract(description, quoted, 1))))
    least = F.coalesce(F.regexp_extract(description, times, 2).try_cast("bigint"), F.lit(1))
    keyword = F.when(description.rlike(quoted), X.occurrences(low, word) >= least).otherwise(True)
    phrase = F.lower(X.trim_ws(F.regexp_extract(description, quoted, 1)))
    ws, tokens = X.words(low), lambda c: F.regexp_extract_all(c, F.lit(K.WORD + "+"), F.lit(0))
    begin = X.words(phrase)
    start = F.when(phrase != "", F.slice(ws, F.lit(1), F.size(begin)) == begin).otherwise(True)
    tail = tokens(phrase)
    end = F.when(F.size(tail) > 0, F.slice(tokens(low), -F.least(F.size(tail), F.greatest(F.size(tokens(low)), F.lit(1))), F.size(tail)) == tail).otherwise(True)
    shape = ~has("<<") | response.rlike("<<.+?>>")
    of = lambda x: F.contains(k, F.lit(x))
    ok = F.when(of("length"), length).when(of("keyword"), keyword).when(of("start"), start).when(of("end"), end).when(of("format"), shape).otherwise(True)
    return F.when(ok, 1.0).otherwise(0.0)


TAGS = ("length", "keyword", "start", "end", "format", "tone", "style", "role", "numerical")


def described_tag(kind: Column) -> Column:
    """The first of the tags that the kind contains, else other."""
    out = F.lit("other")
    for t in reversed(TAGS):
        out = F.when(F.contains(F.lower(kind), F.lit(t)), t).otherwise(out)
    return out


def _any(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out
