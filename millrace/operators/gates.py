"""Quality gates, constraint integrity and the chain of skip reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as X

MIN_WORDS, MIN_PRINTABLE = 15, 0.85
#: The gates in their order; the first that fails is a record's skip reason.
REASONS = ("language", "too_short", "unprintable", "empty_response", "bad_constraint")


def language_fails(detected: Column, wanted: str = "en") -> Column:
    """Only a language that was detected and differs fails; undetected passes."""
    return F.coalesce(detected != wanted, F.lit(False))


def integrity(m: Column, stated: Column) -> Column:
    """Why a constraint map (category -> items) is broken, or null: missing, empty_category, blank_item, count_mismatch.

    A missing stated count is fine.
    """
    lists = F.map_values(m)
    total = F.aggregate(lists, F.lit(0), lambda n, x: n + F.size(x))
    out = F.when(m.isNull() | (F.size(m) <= 0), "missing").when(F.exists(lists, lambda x: x.isNull() | (F.size(x) <= 0)), "empty_category")
    out = out.when(F.exists(F.flatten(lists), lambda d: d.isNull() | (X.trim_ws(d) == "")), "blank_item")
    return out.when(stated.isNotNull() & (stated != total), "count_mismatch")


def integrity_json(cell: Column, stated: Column | None = None) -> Column:
    """The same for a cell of JSON text, where the shape itself may be wrong as well: missing (null, blank, not JSON, a
    JSON null or an empty object), not_object, bad_category (no list, or an empty one), blank_item (blank or no text),
    bad_count (the stated count is no integer), count_mismatch."""
    v = X.strict_json(cell)
    kind = F.schema_of_variant(v)
    is_object = F.startswith(kind, F.lit("OBJECT"))
    lists = F.try_variant_get(v, "$", "map<string,array<variant>>")
    items = F.flatten(F.map_values(lists))
    total = F.aggregate(F.map_values(lists), F.lit(0), lambda n, x: n + F.size(x))
    text_only = lambda x: F.schema_of_variant(x) == "STRING"
    out = F.when(v.isNull() | (kind == "VOID") | (kind == "OBJECT<>"), "missing").when(~is_object, "not_object")
    out = out.when(lists.isNull() | F.exists(F.map_values(lists), lambda x: x.isNull() | (F.size(x) <= 0)), "bad_category")
    out = out.when(F.exists(items, lambda x: x.isNull() | ~text_only(x) | (X.trim_ws(F.try_variant_get(x, "$", "string")) == "")), "blank_item")
    if stated is not None:
        out = out.when(stated.isNotNull() & stated.try_cast("int").isNull(), "bad_count").when(stated.try_cast("int") != total, "count_mismatch")
    return out


def skip_reason(prompt: Column, response: Column, detected: Column, m: Column, stated: Column, min_words: int = MIN_WORDS) -> Column:
    """The first gate that a record with cleaned prompt and response fails, or null."""
    out = F.when(language_fails(detected), "language").when(X.word_count(prompt) < min_words, "too_short")
    out = out.when(X.printable_share(prompt) < MIN_PRINTABLE, "unprintable").when(X.trim_ws(response) == "", "empty_response")
    return out.when(integrity(m, stated).isNotNull(), "bad_constraint")


def funnel(gated: DataFrame, reason: str = "skip_reason") -> DataFrame:
    """One row: total, kept and the count of each reason, in one pass."""
    counts = [F.count_if(F.col(reason) == r).alias(r) for r in REASONS]
    return gated.agg(F.count("*").alias("total"), F.count_if(F.col(reason).isNull()).alias("kept"), *counts)
