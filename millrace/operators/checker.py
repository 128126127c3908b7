"""Constraint checkers: the 18 kinds of machine-checkable constraint and the report over a list of them.

A constraint is a struct (type, target, relation, keywords, keyword, value, count, num, forbidden), which unified() makes of
one that lacks some of them; a response is given by its facts(). Each verdict is true, false or null (unknown
kind, missing or unusable parameter). All are built-in expressions; nothing leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as X

Check = Callable[[Column, Column], Column]


def facts(response: Column) -> Column:
    """What several checkers need of a response. Project it before results(), so that it is computed once a row."""
    body = X.trim_ws(response)
    return F.struct(response.alias("text"), F.lower(response).alias("low"), F.lower(body).alias("body"), X.word_count(response).alias("n_words"), X.sentence_count(response).alias("n_sentences"), X.paragraph_count(response).alias("n_paragraphs"))


#: The fields a constraint may have; of the numbers the first that is there counts.
USUAL = ("type", "target", "relation", "keywords", "keyword", "value")
FIELDS = {"type": "string", "target": "int", "relation": "string", "keywords": "array<string>", "keyword": "string", "value": "string", "count": "int", "num": "int", "forbidden": "array<string>"}


def unified(constraint: Column, have: Sequence[str] = USUAL) -> Column:
    """A constraint struct that has the fields ``have`` with all of FIELDS, the others null."""
    return F.struct(*((constraint[f] if f in have else F.lit(None)).cast(kind).alias(f) for f, kind in FIELDS.items()))


def _target(c: Column) -> Column:
    """The count asked for: target, count, value as a number or num, the first that is given."""
    return F.when(c["target"].isNotNull(), c["target"]).when(c["count"].isNotNull(), c["count"]).when(c["value"].isNotNull(), c["value"].try_cast("int")).otherwise(c["num"])


def _keywords(c: Column) -> Column:
    """``keywords``, else ``keyword`` as a list of one, else an empty list."""
    one = F.when(c["keyword"].isNotNull(), F.array(c["keyword"])).otherwise(F.array().cast("array<string>"))
    return F.coalesce(c["keywords"], one)


def _phrase(c: Column) -> Column:
    return F.lower(F.coalesce(c["target"].cast("string"), c["value"], F.lit("")))


def _lines(r: Column) -> Column:
    return F.transform(F.split(r, "\n"), X.trim_ws)


def _has_null(xs: Column) -> Column:
    return F.exists(xs, lambda k: k.isNull())


def _counted(count: Callable[[Column], Column], default: str = "at_least") -> Check:
    return lambda r, c: X.compare(count(r), _target(c), F.coalesce(c["relation"], F.lit(default)))


def _existence(r: Column, c: Column) -> Column:
    return F.when(~_has_null(_keywords(c)), F.forall(_keywords(c), lambda k: F.contains(r["low"], F.lower(k))))


def _frequency(r: Column, c: Column) -> Column:
    first = F.coalesce(c["keyword"], F.try_element_at(c["keywords"], F.lit(1)))
    return X.compare(X.occurrences(r["low"], F.lower(first)), _target(c), c["relation"])


def _forbidden(r: Column, c: Column) -> Column:
    words = F.coalesce(c["keywords"], c["forbidden"], _keywords(c))
    return F.when(~_has_null(words), ~F.exists(words, lambda k: F.contains(r["low"], F.lower(k))))


def capital_words(r: Column) -> Column:
    return F.size(F.filter(X.words(r), lambda w: (w == F.upper(w)) & w.rlike(r"^\p{L}+$")))


def bullets(r: Column) -> Column:
    return F.size(F.filter(_lines(r), lambda x: x.rlike(r"^[•\-*]\s")))


def emphases(r: Column) -> Column:
    """Bold and italic spans."""
    bold = F.size(F.regexp_extract_all(r, F.lit(r"\*\*[^*]+\*\*"), F.lit(0)))
    return bold + F.size(F.regexp_extract_all(r, F.lit(r"(?<!\*)\*(?!\*)[^*]+\*(?!\*)"), F.lit(0)))


def _english(r: Column, c: Column) -> Column:
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("ascii"))
    step = lambda s, w: F.struct((s["n"] + 1).alias("n"), (s["ascii"] + w.rlike(r"^[\x{0}-\x{7F}]*$").cast("int")).alias("ascii"))
    return F.aggregate(X.words(r["text"]), start, step, lambda s: F.when(s["n"] == 0, True).otherwise(s["ascii"] / s["n"] > 0.8))


def _json(r: Column, c: Column) -> Column:
    body = X.trim_ws(r["text"])
    return F.when(body == "", False).otherwise(X.strict_json(body).isNotNull() | body.isin("NaN", "Infinity", "-Infinity"))


def _highlight(r: Column, c: Column) -> Column:
    return F.when(_target(c).isNotNull(), X.compare(emphases(r["text"]), _target(c), c["relation"])).otherwise(emphases(r["text"]) > 0)


CHECKS: dict[str, Check] = {
    "length_constraint:word_count": _counted(lambda r: r["n_words"]),
    "length_constraint:sentence_count": _counted(lambda r: r["n_sentences"]),
    "length_constraint:paragraph_count": _counted(lambda r: r["n_paragraphs"]),
    "keywords:existence": _existence,
    "keywords:frequency": _frequency,
    "keywords:forbidden": _forbidden,
    "start_with": lambda r, c: F.startswith(r["body"], _phrase(c)),
    "end_with": lambda r, c: F.endswith(r["body"], _phrase(c)),
    "capitalization:all_caps_count": _counted(lambda r: capital_words(r["text"]), "at_most"),
    "capitalization:all_lowercase": lambda r, c: r["text"] == r["low"],
    "format:bullet_points": _counted(lambda r: bullets(r["text"])),
    "format:numbered_list": lambda r, c: F.exists(_lines(r["text"]), lambda x: x.rlike(r"^\d+[.)]\s")),
    "format:sections": _counted(lambda r: X.occurrences(r["text"], F.lit("##"))),
    "format:json": _json,
    "language:english": _english,
    "punctuation:no_comma": lambda r, c: ~F.contains(r["text"], F.lit(",")),
    "detectable_content:postscript": lambda r, c: F.contains(r["low"], F.lit("p.s.")) | F.contains(r["low"], F.lit("ps:")),
    "detectable_format:highlight": _highlight,
}


def check(response: Column, constraint: Column, have: Sequence[str] = USUAL) -> Column:
    """The verdict on one constraint with the fields ``have``, by its type; null for unknown types and null responses."""
    constraint = unified(constraint, have)
    out = F.lit(None).cast("boolean")
    for kind, rule in CHECKS.items():
        out = F.when(constraint["type"] == kind, rule(response, constraint)).otherwise(out)
    return out


def results(response: Column, constraints: Column, have: Sequence[str] = USUAL) -> Column:
    """Verdicts (type, passed) on a list of constraints that have the fields ``have``. Project them before report(), which
    uses them several times."""
    one = lambda c: F.struct(c["type"].alias("type"), check(response, c, have).alias("passed"))
    return F.transform(F.coalesce(constraints, F.array()), one)


def fields_of(df: DataFrame, constraints: str) -> list[str]:
    """The fields that the constraints of a table have."""
    return df.schema[constraints].dataType.elementType.names


def report(results: Column) -> Column:
    """Struct of the results, their counts, per_constraint_csr and hard_csr; null results count as an empty list."""
    results = F.coalesce(results, F.array())
    checked = F.size(F.filter(results, lambda x: x["passed"].isNotNull()))
    passed = F.size(F.filter(results, lambda x: F.coalesce(x["passed"], F.lit(False))))
    csr = F.when(checked > 0, passed / checked).otherwise(F.lit(0.0))
    return F.struct(results.alias("results"), F.size(results).alias("num_constraints"), checked.alias("num_checked"), passed.alias("num_passed"), csr.alias("per_constraint_csr"), ((checked > 0) & (checked == passed)).alias("hard_csr"))
