"""Model operators behind injected callables, run in Arrow batches; resume and override by key."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import text as X
from millrace.operators.checker import report
from millrace.operators.validators import KEYS

Generate = Callable[[list[str]], list[str]]


def generated(prompt: Column, load: Callable[[], Generate], batch: int = 32) -> Column:
    """A model's output for each prompt. ``load`` runs once per Python worker, whatever it has bound; null prompts give
    null."""
    key = hashlib.sha256(cloudpickle.dumps(load)).hexdigest()

    @F.arrow_udf(T.StringType())
    def outputs(prompts: pa.Array) -> pa.Array:
        model = _loaded(key, load)
        texts = prompts.to_pylist()
        at = [i for i, t in enumerate(texts) if t is not None]
        out: list[str | None] = [None] * len(texts)
        for s in range(0, len(at), batch):
            for i, t in zip(at[s : s + batch], model([texts[j] for j in at[s : s + batch]])):
                out[i] = t
        return pa.array(out, pa.string())

    return outputs(prompt)


_MODELS: dict[str, Generate] = {}


def _loaded(key: str, load: Callable[[], Generate]) -> Generate:
    if key not in _MODELS:
        _MODELS[key] = load()
    return _MODELS[key]


def applicable_keys(rules: Column, styles: Column, topics: Column) -> Column:
    """The constraints a judge is asked about: those of the parsed rules that are given, and style and topic."""
    has = {
        "length": rules["lo"].isNotNull() & rules["hi"].isNotNull(), "keyword": F.coalesce(F.size(rules["keywords"]), F.lit(0)) > 0,
        "start_with": F.coalesce(rules["start"] != "", F.lit(False)), "end_with": F.coalesce(rules["end"] != "", F.lit(False)),
        "style": styles.isNotNull(), "topic": topics.isNotNull(),
    }
    return F.filter(F.array(*(F.when(c, k) for k, c in has.items())), lambda k: k.isNotNull())


def judge_prompt(response: Column, rules: Column, styles: Column, topics: Column) -> Column:
    """Question to a judge: one line per applicable constraint and the JSON to fill in; null where none applies."""
    quoted = lambda xs, between: F.array_join(F.transform(xs, lambda x: F.concat(F.lit('"'), x, F.lit('"'))), between)
    words = F.transform(F.array_sort(F.map_entries(rules["keywords"])), lambda e: F.concat(F.lit('"'), e["key"], F.lit('" '), e["value"].cast("string"), F.lit(" times or more")))
    line = {
        "length": F.concat(F.lit("from "), rules["lo"].cast("string"), F.lit(" to "), rules["hi"].cast("string"), F.lit(" words")),
        "keyword": F.concat(F.lit("contains "), F.array_join(words, " and ")),
        "start_with": F.concat(F.lit('begins with "'), rules["start"], F.lit('"')), "end_with": F.concat(F.lit('ends with "'), rules["end"], F.lit('"')),
        "style": F.concat(F.lit("its style is all of "), quoted(styles, ", ")), "topic": F.concat(F.lit("its topic is all of "), quoted(topics, ", ")),
    }
    keys = applicable_keys(rules, styles, topics)
    asked = F.array(*(F.when(F.array_contains(keys, k), F.concat(F.lit(f"- {k}: "), text)) for k, text in line.items()))
    blanks = F.transform(keys, lambda k: F.concat(F.lit('"'), k, F.lit('": 0 or 1')))
    body = F.concat(F.lit("Answer:\n"), response, F.lit("\n\nDoes the answer meet each of these?\n"), F.array_join(asked, "\n"), F.lit("\n\nReply with JSON only: {"), F.array_join(blanks, ", "), F.lit("}"))
    return F.when(F.size(keys) > 0, body)


def batch_judge(df: DataFrame, response: Column, rules: Column, styles: Column, topics: Column, load: Callable[[], Generate]) -> DataFrame:
    """Add ``judged``: a struct of the six verdicts of a judge model, null where nothing was asked or its output lacks a key
    that was. Rows stay where they are; only questions are sent to the model."""
    asked = df.withColumns({"_question": judge_prompt(response, rules, styles, topics), "_keys": applicable_keys(rules, styles, topics)})
    sent = asked.withColumn("_raw", generated(F.col("_question"), load))
    return sent.withColumn("judged", X.judge_verdicts(F.col("_raw"), list(KEYS), F.col("_keys"))).drop("_question", "_keys", "_raw")


def judge_open_results(scores: DataFrame, key: str, ask: Callable[[Column, Column], Column]) -> DataFrame:
    """Verdicts for results without one, in place, and the report made anew; every record is returned.

    ``ask(response, type)`` is an expression of the judge's raw output (PASS... or FAIL...); results that had a verdict are
    not sent. A judge in Python cannot stand inside an array: judge_open_rows() sends its questions as rows.
    """

    def one(r: Column) -> Column:
        said = F.when(r["passed"].isNull(), X.verdict(ask(F.col("response"), r["type"])))
        return F.struct(r["type"].alias("type"), F.coalesce(r["passed"], said).alias("passed"), F.when(said.isNotNull(), "llm").alias("judged_by"))

    done = scores.select(key, F.transform(F.coalesce("results", F.array()), one).alias("_results"))
    return done.select(key, report(F.col("_results")).alias("report")).select(key, "report.*")


def judge_open_rows(scores: DataFrame, key: str, question: Callable[[Column, Column], Column], load: Callable[[], Generate]) -> DataFrame:
    """The same with a judge model: results exploded by position, judged in batches, put back in order. The key is unique;
    records without results stay."""
    rows = scores.select(key, "response", F.posexplode_outer("results").alias("pos", "r")).select(key, "response", "pos", "r.type", "r.passed")
    open_ = F.col("pos").isNotNull() & F.col("passed").isNull()
    asked = rows.withColumn("_raw", generated(F.when(open_, question(F.col("response"), F.col("type"))), load))
    judged = asked.select(key, "pos", "type", F.coalesce("passed", X.verdict(F.col("_raw"))).alias("passed"), F.when(open_ & X.verdict(F.col("_raw")).isNotNull(), "llm").alias("judged_by"))
    packed = judged.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "type", "passed", "judged_by")))).alias("rs"))
    results = F.transform("rs", lambda x: F.struct(x["type"].alias("type"), x["passed"].alias("passed"), x["judged_by"].alias("judged_by")))
    return packed.select(key, report(results).alias("report")).select(key, "report.*")


def not_done(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in the checkpoint."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def sft_rows(prompt: Column, response: Column, count_tokens: Callable[[Column], Column], max_length: int) -> Column:
    """Whether a training row has response tokens left once the prompt has its part of ``max_length``."""
    return (count_tokens(prompt) < max_length) & (count_tokens(response) > 0)


def needs_judging(results: Column) -> Column:
    return F.exists(results, lambda r: r["passed"].isNull())
