"""Prompt augmentation: protected tokens, word edits, back-translation and the threefold union.

Deterministic parts are built-in expressions; the edits run in Arrow batches with a generator seeded by (seed, id) per
row, so they do not depend on partitioning or row order. Synonyms and translators are injected.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import constants as K
from millrace.functions import text as X

Translate = Callable[[list[str]], list[str]]


def _descriptions(m: Column) -> Column:
    lists = F.filter(F.map_values(m), lambda x: x.isNotNull())
    return F.coalesce(F.filter(F.flatten(lists), lambda d: d.isNotNull()), F.array().cast("array<string>"))


def _categories(m: Column) -> Column:
    return F.coalesce(F.transform(F.map_keys(m), F.lower), F.array().cast("array<string>"))


def protected_tokens(prompt: Column, m: Column) -> Column:
    """Tokens that edits must leave alone: numbers, quoted words, categories, words of descriptions, format words and
    likely names; distinct."""
    described = F.transform(F.flatten(F.transform(_descriptions(m), X.words)), lambda w: F.lower(X.strip_chars(w, K.EDGE)))
    fixed = F.array(*map(F.lit, K.FORMAT_WORDS))
    return F.array_distinct(F.concat(X.numbers(prompt), X.quoted_words(prompt), _categories(m), described, fixed, X.entities(prompt)))


def constraint_tokens(prompt: Column, m: Column) -> Column:
    """Tokens that a translation must keep: numbers, quoted phrases, format words of the prompt, categories, words of
    descriptions and likely names; distinct."""
    described = F.transform(F.flatten(F.transform(_descriptions(m), X.words)), F.lower)
    present = F.filter(F.array(*map(F.lit, K.FORMAT_WORDS_BT)), lambda w: F.contains(F.lower(prompt), w))
    return F.array_distinct(F.concat(X.numbers(prompt), X.quoted_phrases(prompt), present, _categories(m), described, X.entities(prompt)))


def preserved(augmented: Column, tokens: Column) -> Column:
    """Whether every token stands in the augmented text."""
    return F.forall(tokens, lambda t: F.contains(F.lower(augmented), F.lower(t)))


def random_deletion(prompt: Column, protected: Column, key: Column, p: float, seed: int) -> Column:
    """Drop words that are not protected with probability ``p`` by a hash of seed, key and position; the first word
    stays if all would go."""
    draw = lambda i: F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string"), F.lit(":"), i.cast("string")), 256), 1, 8), 16, 10).cast("bigint") / F.lit(2.0**32)
    guarded = lambda w: F.array_contains(protected, F.lower(w)) | F.array_contains(protected, F.lower(X.strip_chars(w, K.EDGE)))
    ws = X.words(prompt)
    left = F.filter(ws, lambda w, i: guarded(w) | (draw(i) >= p))
    return F.array_join(F.when(F.size(left) > 0, left).otherwise(F.slice(ws, 1, 1)), " ")


def _rng(seed: int, key: str) -> np.random.Generator:
    return np.random.default_rng(int.from_bytes(hashlib.sha256(f"{seed}:{key}".encode()).digest()[:8], "little"))


def edit(words: list[str], guard: set[str], synonyms: dict[str, list[str]], rates: tuple[float, float, float, float], rng: np.random.Generator) -> list[str]:
    """Replacement, insertion, swap and deletion, each at its rate; protected words stay, one word at least is left."""
    free = lambda ws: [i for i, w in enumerate(ws) if w.lower() not in guard and w.strip(K.EDGE).lower() not in guard]
    other = lambda w: [s for s in synonyms.get(w.lower(), ()) if s != w.lower()]
    n = lambda rate: max(1, int(rate * len(words))) if rate > 0 else 0
    out = list(words)
    left = n(rates[0])
    for i in rng.permutation(free(out)) if left else ():
        if left and (found := other(out[i])):
            out[i] = found[rng.integers(len(found))]
            left -= 1
    for _ in range(n(rates[1])):
        spots = [i for i in free(out) if other(out[i])]
        if not spots:
            break
        found = other(out[spots[rng.integers(len(spots))]])
        out.insert(int(rng.integers(len(out) + 1)), found[rng.integers(len(found))])
    for _ in range(n(rates[2])):
        spots = free(out)
        if len(spots) < 2:
            break
        i, j = rng.choice(spots, 2, replace=False)
        out[i], out[j] = out[j], out[i]
    if rates[3] > 0:
        can = set(free(out))
        kept = [w for i, w in enumerate(out) if i not in can or rng.random() >= rates[3]]
        out = kept or [out[int(rng.integers(len(out)))]] if out else out
    return out


def lexical(prompt: Column, protected: Column, key: Column, synonyms: dict[str, list[str]], rates: tuple[float, float, float, float] = (0.1, 0.1, 0.1, 0.1), seed: int = 42) -> Column:
    """Prompt with word edits; null prompts stay null."""

    @F.arrow_udf(T.StringType())
    def edited(p: pa.Array, guard: pa.Array, keys: pa.Array) -> pa.Array:
        rows = zip(p.to_pylist(), guard.to_pylist(), keys.to_pylist())
        return pa.array([None if t is None else " ".join(edit(t.split(), set(g or ()), synonyms, rates, _rng(seed, k))) for t, g, k in rows], pa.string())

    return edited(prompt, protected, key.cast("string"))


def translated(col: Column, there: Translate, back: Translate, batch: int = 32) -> Column:
    """Texts through both translators in batches; blank texts stay as they are."""

    @F.arrow_udf(T.StringType())
    def trip(texts: pa.Array) -> pa.Array:
        out = texts.to_pylist()
        at = [i for i, t in enumerate(out) if t and t.strip()]
        for s in range(0, len(at), batch):
            for i, t in zip(at[s : s + batch], back(there([out[j] for j in at[s : s + batch]]))):
                out[i] = t
        return pa.array(out, pa.string())

    return trip(col)


def verified_translation(df: DataFrame, prompt: str, m: str, translation: Column, lang: str) -> DataFrame:
    """The translation where it is not blank and keeps all constraint tokens, else the prompt; id and tags always set."""
    candidate = F.col("_candidate")
    ok = (X.trim_ws(candidate) != "") & preserved(candidate, constraint_tokens(F.col(prompt), F.col(m)))
    fell = ~F.coalesce(ok, F.lit(False))
    # a column of its own: a translator in Python cannot stand inside the lambdas
    return df.withColumn("_candidate", translation).select(*(c for c in df.columns if c not in ("id", prompt, "augmentation_method")), F.concat(F.col("id").cast("string"), F.lit("_bt")).alias("id"), F.when(fell, F.col(prompt)).otherwise(candidate).alias(prompt), F.lit("back_translation").alias("augmentation_method"), F.lit(lang).alias("augmentation_intermediate_lang"), fell.alias("fell_back"))


def lexical_rows(df: DataFrame, prompt: str, m: str, synonyms: dict[str, list[str]], **options) -> DataFrame:
    """Rows with edited prompts, ``_lex`` ids and the method tag."""
    new = lexical(F.col(prompt), protected_tokens(F.coalesce(F.col(prompt), F.lit("")), F.col(m)), F.col("id"), synonyms, **options)
    return df.select(*(c for c in df.columns if c not in ("id", prompt, "augmentation_method")), F.concat(F.col("id").cast("string"), F.lit("_lex")).alias("id"), new.alias(prompt), F.lit("lexical").alias("augmentation_method"))


def threefold(original: DataFrame, *others: DataFrame) -> DataFrame:
    """Union of the original rows and their augmentations with ``aug_rank`` (0, 1, ...) as order."""
    out = original.withColumn("aug_rank", F.lit(0))
    for i, d in enumerate(others, 1):
        out = out.unionByName(d.withColumn("aug_rank", F.lit(i)), allowMissingColumns=True)
    return out


def stats(augmented: DataFrame) -> DataFrame:
    """Per augmentation of threefold(): rows, rows augmented, rows that fell back to the original, and errors (no prompt)."""
    fell = F.coalesce("fell_back", F.lit(False))
    failed = F.col("winner_prompt").isNull()
    rows = augmented.where("aug_rank > 0").groupBy("augmentation_method")
    return rows.agg(F.count("*").alias("total"), F.count_if(~fell & ~failed).alias("augmented"), F.count_if(fell).alias("fell_back"), F.count_if(failed).alias("errors"))
