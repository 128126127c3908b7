"""Text functions: Column in, Column out, all in the JVM but for Unicode composition, which Spark lacks (in Arrow batches)."""

from __future__ import annotations

import re

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import constants as K


@F.arrow_udf(T.StringType())
def _nfc(col: pa.Array) -> pa.Array:
    return pa.array([t if t is None or unicodedata.is_normalized("NFC", t) else unicodedata.normalize("NFC", t) for t in col.to_pylist()], pa.string())


def nfc(c: Column) -> Column:
    """Canonical composition (NFC); texts that have it already pass through untouched.

    Declared nondeterministic, so that filters above do not pull a second evaluation below the projection.
    """
    return _nfc.asNondeterministic()(c)


def trim_ws(c: Column) -> Column:
    """Strip white space of any kind at both ends."""
    return F.regexp_replace(c, f"^{K.WS}+|{K.WS}+$", "")


def remove_html(c: Column) -> Column:
    """Tags, then entities, become spaces; entities are not decoded."""
    return F.regexp_replace(F.regexp_replace(c, K.HTML_TAG, " "), K.HTML_ENTITY, " ")


def replace_emojis(c: Column) -> Column:
    """Each run of emoji becomes one space."""
    return F.regexp_replace(c, K.EMOJI, " ")


def drop_unknown(c: Column) -> Column:
    """Control characters and runs of four or more symbols become spaces; invisible characters go."""
    c = F.regexp_replace(c, K.CONTROL, " ")
    c = F.regexp_replace(c, K.INVISIBLE, "")
    return F.regexp_replace(c, f"[^{K.NOT_SYMBOL}]{{4,}}", " ")


def replace_unknown_chars(c: Column) -> Column:
    return drop_unknown(nfc(c))


def normalize_symbols(c: Column) -> Column:
    """Typographic symbols in ASCII; letters, marks and numbers stay; all other non-ASCII characters go."""
    src = "".join(K.SYMBOL_FORMS.values())
    dst = "".join(form * len(symbols) for form, symbols in K.SYMBOL_FORMS.items())
    c = F.translate(F.replace(c, F.lit("…"), F.lit("...")), src, dst)
    return F.regexp_replace(F.regexp_replace(c, r"\p{Zs}", " "), r"[^\x{0}-\x{7F}\p{L}\p{M}\p{N}]", "")


def normalize_whitespace(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, f"{K.WS}+", " "))


def clean_text(c: Column) -> Column:
    """Markup, emoji, unknown characters, symbols and white space, in this order. Null stays null."""
    return normalize_whitespace(normalize_symbols(replace_unknown_chars(replace_emojis(remove_html(c)))))


def words(c: Column) -> Column:
    """Parts between white space; an empty text has none."""
    return F.filter(F.split(c, f"{K.WS}+"), lambda w: w != "")


def strip_chars(c: Column, chars: str) -> Column:
    return F.trim(c, F.lit(chars))


def remove_stopwords(c: Column) -> Column:
    """Words that are stop words without their punctuation go; the rest is joined by single spaces."""
    stop = F.array(*map(F.lit, K.STOPWORDS))
    return F.array_join(F.filter(words(c), lambda w: ~F.array_contains(stop, F.lower(strip_chars(w, K.PUNCTUATION)))), " ")


def fingerprint(c: Column) -> Column:
    """SHA-256 of the text in lower case with white space collapsed."""
    return F.sha2(normalize_whitespace(F.lower(c)), 256)


def shingles(c: Column, k: int = 5) -> Column:
    """Distinct k-character substrings; a shorter text is its own."""
    last = F.greatest(F.lit(1), F.length(c) - (k - 1))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(c, i, F.lit(k))))


def word_count(c: Column) -> Column:
    return F.size(words(c))


def sentence_count(c: Column) -> Column:
    """Parts between stops that are not blank."""
    return F.size(F.filter(F.split(c, r"[.!?]+"), lambda s: trim_ws(s) != ""))


def sentence_pieces(c: Column) -> Column:
    """Parts between stops, the empty one after a closing stop included."""
    return F.size(F.split(trim_ws(c), r"[.!?]+", -1))


def paragraph_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"\n\n+"), lambda s: trim_ws(s) != ""))


def occurrences(c: Column, needle: Column) -> Column:
    """Non-overlapping occurrences; of an empty needle, the length plus one."""
    return F.when(needle == "", F.length(c) + 1).otherwise(((F.length(c) - F.length(F.replace(c, needle, F.lit("")))) / F.greatest(F.length(needle), F.lit(1))).cast("int"))


def entities(c: Column) -> Column:
    """Likely proper nouns: capitalised words that do not begin a sentence, in lower case, distinct."""
    sentences = F.split(c, f"[.!?]{K.WS}+")
    tails = F.transform(sentences, lambda s: F.slice(words(s), 2, 1_000_000))
    bare = F.transform(F.flatten(tails), lambda w: strip_chars(w, K.EDGE + "*"))
    first = lambda w: F.substring(w, 1, 1)
    ok = lambda w: (F.length(w) >= 2) & first(w).rlike(r"^\p{Lu}") & ~(w == F.upper(w))
    return F.array_distinct(F.transform(F.filter(bare, ok), F.lower))


def numbers(c: Column) -> Column:
    """Runs of digits that are words of their own."""
    return F.regexp_extract_all(c, F.lit(rf"(?<!{K.WORD})\d+(?!{K.WORD})"), F.lit(0))


def quoted_words(c: Column) -> Column:
    """Words inside quotes that close as they open, in lower case."""
    inner = F.regexp_extract_all(c, F.lit(r"(['\"])(.*?)\1"), F.lit(2))
    return F.transform(F.flatten(F.transform(inner, words)), F.lower)


def quoted_phrases(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(r"['\"]([^'\"]+)['\"]"), F.lit(1)), F.lower)


def non_ascii(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"[^\x{0}-\x{7F}]"), F.lit(0))


def printable_share(c: Column) -> Column:
    """Share of printable characters; 0 for an empty or null text."""
    return F.when(F.length(c) > 0, F.length(F.regexp_replace(c, r"[\p{C}\p{Z}&&[^ ]]", "")) / F.length(c)).otherwise(F.lit(0.0))


def normalise_category(c: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in K.CATEGORY_NAMES.items() for x in pair))
    return F.coalesce(F.try_element_at(known, F.lower(trim_ws(c))), F.replace(trim_ws(c), F.lit(" "), F.lit("_")))


def python_text(c: Column) -> Column:
    """A text as Python shows it inside a tuple: quoted, with escapes."""
    esc = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for raw, shown in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        esc = F.replace(esc, F.lit(raw), F.lit(shown))
    double = F.contains(c, F.lit("'")) & ~F.contains(c, F.lit('"'))
    return F.when(double, F.concat(F.lit('"'), esc, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(esc, F.lit("'"), F.lit("\\'")), F.lit("'")))


def _captured(c: Column, pattern: str) -> Column:
    """What each match of a pattern captures: the whole match without groups, the text of one group, a tuple of several."""
    n = re.compile(pattern).groups
    take = lambda i: F.regexp_extract_all(c, F.lit("(?i)" + pattern), F.lit(i))
    if n < 2:
        return take(n)
    zipped = F.arrays_zip(*(take(i + 1).alias(f"g{i}") for i in range(n)))
    return F.transform(zipped, lambda m: F.concat(F.lit("("), F.concat_ws(", ", *(python_text(m[f"g{i}"]) for i in range(n))), F.lit(")")))


def mined_constraints(c: Column) -> Column:
    """Constraints stated in a prompt, pattern by pattern: structs (type, raw_match)."""
    every = F.concat(*(_captured(c, p) for p in K.MINED))
    return F.transform(every, lambda m: F.struct(F.lit("parsed_from_prompt").alias("type"), m.alias("raw_match")))


def strict_json(c: Column) -> Column:
    """The Variant of a text that is one JSON value and nothing else, or null.

    Spark's parser ignores what follows the first value; inside an array and inside an object nothing can follow unseen.
    """
    listed, named = F.try_parse_json(F.concat(F.lit("["), c, F.lit("]"))), F.try_parse_json(F.concat(F.lit('{"v":'), c, F.lit("}")))
    return F.when(named.isNotNull(), F.try_variant_get(listed, "$[0]", "variant"))


def judge_verdicts(c: Column, keys: list[str], asked: Column | None = None) -> Column:
    """Struct of 0/1 by key from the first {...} block of a judge's output; null unless it has all keys as numbers.

    ``asked`` (array<string>) are the keys that were asked for, if not all; the others are null and need not be there.
    """
    block = F.regexp_extract(c, r"(\{[^{}]+\})", 1)
    v = strict_json(F.nullif(block, F.lit("")))
    of = {k: F.coalesce(F.try_variant_get(v, f"$.{k}", "int"), F.try_variant_get(v, f"$.{k}", "boolean").cast("int")) for k in keys}
    wanted = {k: F.lit(True) if asked is None else F.array_contains(asked, k) for k in keys}
    have = F.lit(True)
    for k in keys:
        have = have & (of[k].isNotNull() | ~wanted[k])
    return F.when(have & v.isNotNull(), F.struct(*(F.when(wanted[k], (of[k] != 0).cast("int")).alias(k) for k in keys)))


def verdict(c: Column) -> Column:
    """True for PASS..., false for FAIL..., else null."""
    up = F.upper(trim_ws(c))
    return F.when(up.startswith("PASS"), True).when(up.startswith("FAIL"), False)


def safe_name(c: Column) -> Column:
    return F.translate(c, "/-", "__")


def first_truthy(*cols: Column) -> Column:
    """The first of the columns that is neither null nor empty, else an empty text."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in cols), F.lit(""))


def chat_llama(system: Column | None, user: Column) -> Column:
    """Prompt in header tokens, ready for the assistant's turn."""
    turn = lambda role, text: F.concat(F.lit(f"<|start_header_id|>{role}<|end_header_id|>\n\n"), text, F.lit("<|eot_id|>"))
    parts = [F.lit("<|begin_of_text|>"), *([turn("system", system)] if system is not None else []), turn("user", user), F.lit("<|start_header_id|>assistant<|end_header_id|>\n\n")]
    return F.concat(*parts)


def chat_plain(user: Column) -> Column:
    return F.concat(F.lit("User: "), user, F.lit("\nAssistant:"))


def difficulty(n: Column) -> Column:
    return F.when(n <= 2, "L1").when(n <= 4, "L2").when(n <= 7, "L3").otherwise("L4")


def compare(actual: Column, target: Column, relation: Column) -> Column:
    """Whether the count meets the target; unknown relations mean at least; null for a null target."""
    rel = F.replace(F.lower(trim_ws(F.coalesce(relation, F.lit("at_least")))), F.lit(" "), F.lit("_"))
    out = F.when(rel.isin(*K.RELATIONS["le"]), actual <= target).when(rel.isin(*K.RELATIONS["eq"]), actual == target)
    return out.when(rel.isin(*K.RELATIONS["gt"]), actual > target).when(rel.isin(*K.RELATIONS["lt"]), actual < target).otherwise(actual >= target)
