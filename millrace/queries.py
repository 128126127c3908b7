"""Queries of the engine's own operators over the driver's tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.operators import audit, augment, checker, dedup, gates, inference, metrics, sampling, shred, tagging, training, validators
from millrace.operators.ranking import seeded
from millrace.oracles import CHECK_ARGS, oracle_sql
from millrace.plans import preprocess
from millrace.sources.queries import io_queries
from millrace.session import broadcast_if_small, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CATEGORIES = ["length_ok", "sentence_ok", "keyword_ok", "start_ok", "end_ok", "format_ok", "tone_ok", "style_ok", "role_ok"]


#: Queries whose work by row is worth dealing small tables out to all cores.
COSTLY = set("remove_html replace_emojis replace_unknown_chars normalize_symbols normalize_whitespace clean_text remove_stopwords printable_ratio entities mine_constraints shingles word_counts protected_tokens constraint_tokens quality_gates exact_dedup length_stats non_ascii_audit cv_validators random_deletion lexical_edit bt_verify augment_union aug_stats near_dup near_dup_pairs minhash_signature batch_judge judge_fallback".split())
COSTLY_KINDS = ("preprocess_", "skip_", "cc_", "p2_")


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _over(name: str, tab: str, build: Callable[[DataFrame], DataFrame]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(table(spark, sf_dir, tab, name in COSTLY or name.startswith(COSTLY_KINDS)))

    run.__name__ = name
    QUERIES[name] = run


def _text_query(name: str, tab: str, key: str, col: str, f: Callable[[Column], Column]) -> None:
    _over(name, tab, lambda df: df.select(key, f(F.col(col)).alias("out")))


def _listed(c: Column) -> Column:
    return F.array_join(F.array_sort(c), "|")


def detected(label: Column) -> Column:
    """Stands for a language detector: the declared label where it is a plain code."""
    return F.when(label.rlike("^[a-z]{2}$") & (label != "xx"), label)


# Nested records


_NESTED = {c: c for c in ("added_constraint", "rule_evaluate_dict", "added_constraint_from_llm")}
_over("p2_found", "constraint_records", lambda df: shred.scalar_paths(shred.shredded(df, "rec_no", _NESTED)))


def _entities(df: DataFrame, name: str) -> DataFrame:
    """A table of constraint records; its list of scalars as one text."""
    out = shred.constraint_tables(df)[name]
    if "scalars" not in out.columns:
        return out
    one = lambda x: F.concat_ws(":", x["ordinal"].cast("string"), F.coalesce(x["label"], F.lit("")), x["kind"], x["scalar"])
    return out.withColumn("scalars", F.array_join(F.transform("scalars", one), "|"))


for _name in ("cells", "categories", "constraints", "rules", "parts", "values"):
    _over(f"p2_{_name}", "constraint_records", lambda df, n=_name: _entities(df, n))

# Text functions

_text_query("remove_html", "documents", "doc_id", "text", X.remove_html)
_text_query("replace_emojis", "documents", "doc_id", "text", X.replace_emojis)
_text_query("replace_unknown_chars", "instruction_records", "line_no", "winner_prompt", X.replace_unknown_chars)
_text_query("normalize_symbols", "instruction_records", "line_no", "winner_prompt", X.normalize_symbols)
_text_query("normalize_whitespace", "documents", "doc_id", "text", X.normalize_whitespace)
_text_query("clean_text", "documents", "doc_id", "text", X.clean_text)
_text_query("remove_stopwords", "documents", "doc_id", "text", X.remove_stopwords)
_text_query("fingerprint", "documents", "doc_id", "text", X.fingerprint)
_text_query("printable_ratio", "documents", "doc_id", "text", X.printable_share)
_text_query("entities", "instruction_records", "line_no", "winner_prompt", lambda c: _listed(X.entities(c)))
_text_query("mine_constraints", "instruction_records", "line_no", "winner_prompt", lambda c: F.array_join(F.transform(X.mined_constraints(c), lambda m: F.concat(m["type"], F.lit("="), m["raw_match"])), "|"))
_text_query("safe_names", "instruction_records", "line_no", "source", X.safe_name)
_text_query("chat_template", "instruction_records", "line_no", "winner_prompt", lambda c: F.concat(X.chat_llama(F.lit("Be brief."), c), X.chat_plain(c)))
_over("shingles", "instruction_records", lambda df: df.select("line_no", X.shingles(F.col("winner_prompt")).alias("s")).select("line_no", F.size("s").cast("bigint").alias("n_shingles"), F.array_min("s").alias("first_shingle")))
_over("word_counts", "documents", lambda df: df.where("text IS NOT NULL").select("doc_id", X.word_count(F.col("text")).cast("bigint").alias("n_words"), X.sentence_count(F.col("text")).cast("bigint").alias("n_sentences"), X.sentence_pieces(F.col("text")).cast("bigint").alias("n_pieces"), X.paragraph_count(F.col("text")).cast("bigint").alias("n_paragraphs")))
_over("normalise_category", "instruction_records", lambda df: df.select(F.explode(F.map_keys(F.col("added_constraint"))).alias("raw")).distinct().select("raw", X.normalise_category(F.col("raw")).alias("category")))
_over("protected_tokens", "instruction_records", lambda df: df.where("winner_prompt IS NOT NULL").select("line_no", _listed(augment.protected_tokens(F.col("winner_prompt"), F.col("added_constraint"))).alias("tokens")))
_over("constraint_tokens", "instruction_records", lambda df: df.where("winner_prompt IS NOT NULL").select("line_no", _listed(augment.constraint_tokens(F.col("winner_prompt"), F.col("added_constraint"))).alias("tokens")))


@query
def parse_judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = lambda c: F.col(c).cast("int").cast("string")
    whole = F.concat(F.lit('Verdict: {"style": '), ok("style_ok"), F.lit(', "topic": '), ok("tone_ok"), F.lit("} done"))
    raw = F.when(F.col("score_id") % 4 == 0, F.concat(F.lit('{"style": '), ok("style_ok"), F.lit("}"))).when(F.col("score_id") % 4 == 1, F.lit("no verdict")).otherwise(whole)
    out = table(spark, sf_dir, "cv_scores").select("score_id", X.judge_verdicts(raw, ["style", "topic"]).alias("v"))
    return out.select("score_id", "v.style", "v.topic")


@query
def parse_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("score_id") % 4
    raw = F.when(k == 0, " pass, all met").when(k == 1, "FAIL: tone").when(k == 2, "Perhaps")
    return table(spark, sf_dir, "cv_scores").select("score_id", X.verdict(raw).alias("passed"))


# Gates


_over("alias_projection", "instruction_records", lambda df: df.select("line_no", X.first_truthy(F.col("winner_prompt"), F.col("prompt_winner")).alias("prompt"), X.first_truthy(F.col("response_of_winner_prompt"), F.col("response_winner")).alias("response"), X.difficulty(F.coalesce(F.col("added_constraint_num"), F.lit(0))).alias("difficulty"), F.coalesce("id", F.col("line_no").cast("string")).alias("key")))
_over("quality_gates", "instruction_records", lambda df: df.select("line_no", F.coalesce(X.clean_text(F.col("winner_prompt")), F.lit("")).alias("p"), F.coalesce(X.clean_text(F.col("response_of_winner_prompt")), F.lit("")).alias("r")).select("line_no", (X.word_count(F.col("p")) >= gates.MIN_WORDS).alias("long_enough"), (X.printable_share(F.col("p")) >= gates.MIN_PRINTABLE).alias("printable"), (X.trim_ws(F.col("r")) != "").alias("answered")))
_over("language_gate", "instruction_records", lambda df: df.select("line_no", (~gates.language_fails(detected(F.col("prompt_lang")))).alias("kept")))
_over("constraint_integrity", "instruction_records", lambda df: df.select("line_no", gates.integrity(F.col("added_constraint"), F.col("added_constraint_num")).alias("reason")))
_over("constraint_integrity_json", "constraint_records", lambda df: df.select("rec_no", gates.integrity_json(F.col("added_constraint")).alias("reason")))
_over("difficulty_levels", "instruction_records", lambda df: df.select("line_no", X.difficulty(F.col("added_constraint_num")).alias("level")))
_over("relation_compare", "eval_prompts", lambda df: df.select("id", X.word_count(F.col("winner_prompt")).alias("n"), F.posexplode("constraints").alias("pos", "c")).select("id", F.col("pos").cast("bigint").alias("pos"), X.compare(F.col("n"), F.col("c.target"), F.col("c.relation")).alias("met")))
_over("sft_filter", "instruction_records", lambda df: df.where(inference.sft_rows(F.coalesce(F.col("winner_prompt"), F.lit("")), F.coalesce(F.col("response_of_winner_prompt"), F.lit("")), X.word_count, 60)).select("line_no"))
_over("needs_judging", "model_responses", lambda df: df.where(inference.needs_judging(F.col("results"))).select("resp_id"))


def _gated(df: DataFrame) -> DataFrame:
    return preprocess.gated(df.withColumn("detected", detected(F.col("prompt_lang"))))


_over("skip_reasons", "instruction_records", lambda df: _gated(df).select("line_no", "skip_reason"))
_over("skip_funnel", "instruction_records", lambda df: gates.funnel(_gated(df)))
_over("preprocess_kept", "instruction_records", lambda df: preprocess.kept(_gated(df)).select("line_no", "prompt", "response"))
_over("preprocess_audit", "instruction_records", lambda df: preprocess.audit(_gated(df), preprocess.kept(_gated(df))))
_over("preprocess_by_source", "instruction_records", lambda df: preprocess.by_source(_gated(df)))
# the two above are exact removal only, as their SQL says; these are the whole plan
_over("preprocess_full", "instruction_records", lambda df: preprocess.decisions(_gated(df)).select("line_no", "skip_reason"))
_over("preprocess_full_kept", "instruction_records", lambda df: preprocess.decided(_gated(df)).where("skip_reason IS NULL").select("line_no", "prompt", "response"))
_over("preprocess_full_by_source", "instruction_records", lambda df: preprocess.decided_by_source(preprocess.decisions(_gated(df))))

# Duplicates

_over("exact_dedup", "documents", lambda df: dedup.first_seen(df.where("text IS NOT NULL").select("doc_id", "text"), "doc_id", X.fingerprint(F.col("text"))).select("doc_id", "kept"))
_over("near_dup_pairs", "cv_records", lambda df: dedup.near_pairs(df.where("length(winner_prompt) > 0"), "row_no", F.col("winner_prompt")).select("a", "b", "similarity"))
_over("minhash_signature", "cv_records", lambda df: df.select("row_no", F.col("winner_prompt").alias("t")).select("row_no", dedup.minhash(F.col("t"), 128, 1).alias("signature")))
_over("near_dup", "cv_records", lambda df: dedup.near_dedup(df, "row_no", X.remove_stopwords(F.col("winner_prompt"))))

# Audits

_over("category_counts", "instruction_records", lambda df: audit.category_counts(df, F.col("added_constraint")))
_over("imbalance_audit", "instruction_records", lambda df: audit.imbalance(audit.category_counts(df, F.col("added_constraint"))))
_over("category_coverage", "instruction_records", lambda df: audit.category_coverage(df, F.col("added_constraint")))
_over("constraint_totals", "instruction_records", lambda df: audit.constraint_totals(df, F.col("added_constraint")))
_over("field_presence", "constraint_records", lambda df: audit.field_presence(df, F.col("rule_evaluate_dict")))
_over("field_coverage", "instruction_records", lambda df: audit.field_coverage(df, ["id", "source", "winner_prompt", "prompt_lang", "response_winner", "response_of_winner_prompt", "response_lang", "augmentation_method"]))
_over("length_stats", "instruction_records", lambda df: audit.length_stats(df, ["winner_prompt", "response_of_winner_prompt"]))
_over("non_ascii_audit", "instruction_records", lambda df: audit.non_ascii_audit(df, ["winner_prompt", "response_of_winner_prompt"]))
_over("top_chars", "instruction_records", lambda df: audit.top_chars(df, ["winner_prompt", "response_of_winner_prompt"]))

_over("top_char_names", "instruction_records", lambda df: audit.named_chars(audit.top_chars(df, ["winner_prompt", "response_of_winner_prompt"])))

# Tagging

_over("constraint_counts_json", "constraint_records", lambda df: tagging.constraint_counts_json(df, "rec_no", F.col("added_constraint")))

_over("constraint_counts", "instruction_records", lambda df: tagging.constraint_counts(df, "line_no", F.col("added_constraint")))
_over("assign_clusters", "instruction_records", lambda df: tagging.assign(df, "line_no", F.col("added_constraint")).withColumn("categories", F.array_join("categories", "|")))
_over("cluster_summary", "instruction_records", lambda df: tagging.distribution(tagging.assign(df, "line_no", F.col("added_constraint")), "primary_cluster"))
_over("type_count_dist", "instruction_records", lambda df: tagging.distribution(tagging.assign(df, "line_no", F.col("added_constraint")), "num_constraint_types"))
_over("top_labels", "instruction_records", lambda df: tagging.top_labels(tagging.assign(df, "line_no", F.col("added_constraint")), "cluster_label", "line_no"))
_over("category_presence", "instruction_records", lambda df: tagging.category_presence(tagging.assign(df, "line_no", F.col("added_constraint"))))
_over("cluster_report", "instruction_records", lambda df: tagging.summary(tagging.assign(df, "line_no", F.col("added_constraint")), "line_no"))
_over("level_by_cluster", "instruction_records", lambda df: tagging.assign(df, "line_no", F.col("added_constraint")).join(df.select("line_no", X.difficulty(F.col("added_constraint_num")).alias("level")), "line_no").groupBy("primary_cluster", "level").agg(F.count("*").alias("n")))


# Checkers


def _literal(kind: str) -> Column:
    args = CHECK_ARGS[kind]
    kw = args.get("keywords")
    known = F.struct(
        F.lit(kind).alias("type"), F.lit(args.get("target")).cast("int").alias("target"), F.lit(args.get("relation")).cast("string").alias("relation"),
        (F.array(*map(F.lit, kw)) if kw else F.lit(None)).cast("array<string>").alias("keywords"), F.lit(args.get("keyword")).cast("string").alias("keyword"), F.lit(args.get("value")).cast("string").alias("value"),
    )
    return checker.unified(known, ["type", "target", "relation", "keywords", "keyword", "value"])


def _aliased(**given: Column) -> Column:
    """A constraint given by other keys than the usual ones."""
    return checker.unified(F.struct(*(c.alias(k) for k, c in given.items())), list(given))


@query
def cc_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "model_responses", True).where("response IS NOT NULL").select("resp_id", checker.facts(F.col("response")).alias("facts"))
    words, forbidden = checker.CHECKS["length_constraint:word_count"], checker.CHECKS["keywords:forbidden"]
    on = lambda check, **given: check(F.col("facts"), _aliased(**given))
    return rows.select(
        "resp_id", on(words, count=F.lit(50), value=F.lit("7")).alias("by_count"), on(words, value=F.lit("50"), num=F.lit(7)).alias("by_value"), on(words, num=F.lit(50)).alias("by_num"),
        on(words, value=F.lit("many"), num=F.lit(50)).alias("by_words"), on(forbidden, forbidden=F.array(F.lit("kayak"), F.lit("Quilt"))).alias("forbidden"),
    )


for _kind in CHECK_ARGS:
    _over("cc_" + _kind.split(":")[-1], "model_responses", lambda df, k=_kind: df.where("response IS NOT NULL").select("resp_id", checker.CHECKS[k](checker.facts(F.col("response")), _literal(k)).alias("passed")))


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompts = broadcast_if_small(table(spark, sf_dir, "eval_prompts").select("id", "constraints"))
    rows = table(spark, sf_dir, "model_responses", True).where("response IS NOT NULL").join(prompts, "id")
    known = rows.select("resp_id", "difficulty_level", "constraints", checker.facts(F.col("response")).alias("facts"))
    judged = known.select("resp_id", "difficulty_level", checker.results(F.col("facts"), F.col("constraints"), checker.fields_of(prompts, "constraints")).alias("results"))
    return judged.select("resp_id", "difficulty_level", checker.report(F.col("results")).alias("x")).select("resp_id", "difficulty_level", "x.*")


@query
def cc_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked(spark, sf_dir).select("resp_id", F.posexplode("results").alias("pos", "r")).select("resp_id", F.col("pos").cast("bigint").alias("pos"), "r.type", "r.passed")


@query
def cc_check_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _checked(spark, sf_dir)
    return out.select("resp_id", *(F.col(c).cast("bigint").alias(c) for c in ("num_constraints", "num_checked", "num_passed")), "per_constraint_csr", "hard_csr")


# Validators


def _ruled(df: DataFrame) -> DataFrame:
    v = F.try_parse_json("rule_evaluate_dict")
    response = F.coalesce(*(F.try_variant_get(v, f"$.{k}.func_input[0]", "string") for k in ("word_length", "keyword", "start_with", "end_with")), F.lit(""))
    parsed = df.select("rec_no", "added_constraint_from_llm", validators.parsed_rules(F.col("rule_evaluate_dict")).alias("p"), response.alias("response"))
    return parsed.withColumn("v", validators.rule_verdicts(F.col("response"), F.col("p")))


_over("rule_parse", "constraint_records", lambda df: _ruled(df).select("rec_no", F.col("p.lo").cast("bigint").alias("lo"), F.col("p.hi").cast("bigint").alias("hi"), F.array_join(F.array_sort(F.transform(F.map_entries("p.keywords"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))), "|").alias("keywords"), "p.start", "p.end"))
_over("rule_scores", "constraint_records", lambda df: _ruled(df).select("rec_no", "v.*", validators.rule_score(F.col("v")).alias("score"), (1 - validators.rule_score(F.col("v"))).alias("loss")))
_over("train_scores", "constraint_records", lambda df: _ruled(df).select("rec_no", *(F.col(f"v.{k}").cast("int").cast("double").alias(f"{k}_score") for k in validators.RULES), validators.rule_score(F.col("v"), 1.0).alias("score")))


def _asked(df: DataFrame) -> DataFrame:
    """Constraint records with parsed rules, styles and topics, their response, and the rules' verdicts."""
    rules = _ruled(df)
    of = lambda name: validators.described_items(F.col("added_constraint_from_llm"), name)
    return rules.select("rec_no", "p", "v", "response", of("Style").alias("styles"), of("Topic").alias("topics"))


def _judge_model() -> inference.Generate:
    """Stands for a judge: verdicts that follow from the lengths of question and key; one question in five is not understood."""

    def answer(question: str) -> str:
        keys = re.findall(r'"(\w+)": 0 or 1', question)
        return "I cannot tell." if len(question) % 5 == 0 else "{" + ", ".join(f'"{k}": {(len(question) + len(k)) % 2}' for k in keys) + "}"

    return lambda questions: [answer(q) for q in questions]


def _judged_examples(df: DataFrame) -> DataFrame:
    return inference.batch_judge(_asked(df), F.col("response"), F.col("p"), F.col("styles"), F.col("topics"), _judge_model)


def _scored(df: DataFrame, judged: Column, by_judge: bool) -> DataFrame:
    rows = df.select("rec_no", validators.scored(judged, F.col("v"), by_judge).alias("x")).select("rec_no", "x.*")
    return rows.withColumns({c: F.col(c).cast("bigint") for c in (*validators.KEYS, "passed", "total")})


_over("parse_style_topic", "constraint_records", lambda df: _asked(df).select("rec_no", F.array_join("styles", "|").alias("styles"), F.array_join("topics", "|").alias("topics")))
_over("judge_prompt", "constraint_records", lambda df: _asked(df).select("rec_no", inference.judge_prompt(F.col("response"), F.col("p"), F.col("styles"), F.col("topics")).alias("question")))
_over("batch_judge", "constraint_records", lambda df: _judged_examples(df).select("rec_no", *(F.col(f"judged.{k}").cast("bigint").alias(k) for k in validators.KEYS)))
_over("judge_fallback", "constraint_records", lambda df: _scored(_judged_examples(df), F.col("judged"), True))
_over("rule_scorer", "constraint_records", lambda df: _scored(_asked(df), F.struct(*(F.lit(None).cast("int").alias(k) for k in validators.KEYS)), False))
_over("cv_validators", "instruction_records", lambda df: df.where("response_of_winner_prompt IS NOT NULL").select("line_no", "added_constraint", validators.category_facts(F.col("response_of_winner_prompt")).alias("f")).select("line_no", validators.category_verdicts(F.col("f"), F.col("added_constraint")).alias("x")).select("line_no", "x.*"))


def _described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rec_no, response, cs): lists of described constraints, also those held as JSON text inside JSON, with the answer of
    the first delivery of their id."""
    v = X.strict_json(F.col("added_constraint"))
    inner = X.strict_json(F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")))
    listed = F.try_variant_get(F.coalesce(inner, v), "$", "array<variant>")
    cells = table(spark, sf_dir, "constraint_records").select("rec_no", "id", listed.alias("cs")).where("cs IS NOT NULL")
    firsts = table(spark, sf_dir, "instruction_records").groupBy("id").agg(F.min("line_no").alias("line_no"))
    answers = table(spark, sf_dir, "instruction_records").join(firsts.select("line_no"), "line_no", "left_semi").select("id", F.coalesce(F.col("response_of_winner_prompt"), F.lit("")).alias("response"))
    return cells.join(answers, "id").select("rec_no", "response", "cs")


@query
def desc_validators(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _described(spark, sf_dir).select("rec_no", "response", F.posexplode("cs").alias("pos", "c"))
    get = lambda name: F.try_variant_get("c", f"$.{name}", "string")
    kind = F.coalesce(F.nullif(get("type"), F.lit("")), get("constraint_type"), F.lit(""))
    text = F.coalesce(get("description"), F.lit(""))
    return rows.select("rec_no", F.col("pos").cast("bigint").alias("pos"), validators.described_tag(kind).alias("tag"), validators.described_score(F.col("response"), kind, text).alias("score"))


@query
def desc_record_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = desc_validators(spark, sf_dir).groupBy("rec_no").agg((F.sum(F.col("score").cast("int")) / F.count("*")).alias("mean"), F.count("*").alias("n"))
    every = _described(spark, sf_dir).select("rec_no")
    return every.join(means, "rec_no", "left").select("rec_no", F.coalesce("n", F.lit(0)).alias("n_rules"), F.coalesce("mean", F.lit(1.0)).alias("mean_score"))


@query
def desc_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return desc_record_means(spark, sf_dir).agg(F.count("*").alias("n_records"), F.round(F.avg("mean_score"), 9).alias("csr"))


@query
def desc_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return desc_validators(spark, sf_dir).groupBy("tag").agg(F.count("*").alias("n"), (F.sum(F.col("score").cast("int")) / F.count("*")).alias("mean_score"))


# Metrics

_over("csr_by_level", "model_responses", lambda df: metrics.csr_by_level(df.withColumn("per_constraint_csr", F.col("per_constraint_csr").cast("decimal(18,9)"))).select("level", "n", F.col("mean_csr").cast("double").alias("mean_csr"), "hard_csr"))
_over("pass_by_type", "model_responses", metrics.pass_by_type)
_over("overall_loss", "model_responses", metrics.overall)
_over("model_wins", "cv_scores", lambda df: metrics.wins(metrics.compare_models(df, ["csr", *CATEGORIES], "lora", "full_ft")))
_over("per_key_rates", "cv_scores", lambda df: metrics.per_key(df, CATEGORIES))
_over("fold_means", "cv_scores", lambda df: metrics.fold_means(df, CATEGORIES))
_over("fold_summary", "cv_scores", lambda df: metrics.fold_summary(df, CATEGORIES).withColumns({c: F.round(c, 9) for c in ("mean", "std")}))
_over("fold_summary_pop", "cv_scores", lambda df: metrics.fold_summary(df, CATEGORIES, True).withColumns({c: F.round(c, 9) for c in ("mean", "std")}))
_over("model_compare", "cv_scores", lambda df: metrics.compare_models(df, ["csr", *CATEGORIES], "lora", "full_ft").withColumns({c: F.round(c, 9) for c in ("mean_a", "mean_b")}))
_over("model_runs", "model_responses", metrics.model_runs)
_over("constraint_hist", "model_responses", lambda df: df.groupBy("difficulty_level", "num_constraints").agg(F.count("*").alias("n")))


def _yes_or_no() -> inference.Generate:
    return lambda questions: ["PASS" if len(q.split(": ", 1)[1]) % 2 == 0 else "FAIL" for q in questions]


def _judged(df: DataFrame) -> DataFrame:
    return df.where(F.col("num_checked") > F.col("num_passed")).select("resp_id", F.col("num_checked").alias("num_passed"), F.lit(1.0).alias("per_constraint_csr"), F.lit(True).alias("hard_csr"))


_over("override_merge", "model_responses", lambda df: metrics.override(df.select("resp_id", "model", "num_passed", "per_constraint_csr", "hard_csr"), _judged(df), "resp_id", ["num_passed", "per_constraint_csr", "hard_csr"]))
_over("resume_anti_join", "model_responses", lambda df: inference.not_done(df.select("resp_id", "id"), df.where("hard_csr").select("id"), "id"))


@query
def judge_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "model_responses")
    merged = metrics.override(df, _judged(df), "resp_id", ["num_passed", "per_constraint_csr", "hard_csr"])
    a, b = metrics.csr_by_level(df), metrics.csr_by_level(merged)
    return a.select("level", F.col("hard_csr").alias("rule_hard_csr")).join(b.select("level", F.col("hard_csr").alias("judged_hard_csr")), "level")


_over("judge_open_rows", "model_responses", lambda df: inference.judge_open_rows(df.where("response IS NOT NULL"), "resp_id", lambda r, t: F.concat(t, F.lit(": "), r), _yes_or_no).select("resp_id", *(F.col(c).cast("bigint").alias(c) for c in ("num_constraints", "num_checked", "num_passed")), "hard_csr"))
_over("judge_open_results", "model_responses", lambda df: inference.judge_open_results(df.where("response IS NOT NULL"), "resp_id", lambda r, t: F.when(F.length(r) % 2 == 0, "PASS").otherwise("FAIL")).select("resp_id", *(F.col(c).cast("bigint").alias(c) for c in ("num_constraints", "num_checked", "num_passed")), "hard_csr"))

def _tokens(df: DataFrame) -> DataFrame:
    return training.training_table(df, "line_no", F.col("winner_prompt"), F.col("response_of_winner_prompt"), training.utf8_bytes, 400)


_over("training_table", "instruction_records", lambda df: _tokens(df).select("line_no", F.size("input_ids").cast("bigint").alias("n_input"), F.size(F.filter("labels", lambda x: x == training.MASK)).cast("bigint").alias("n_masked"), "constraint_score"))


_over("generate", "model_responses", lambda df: df.select("resp_id", inference.generated(F.col("response"), _echo_model).alias("out")))


def _echo_model() -> inference.Generate:
    return lambda prompts: [f"{len(p)}: {p[:20]}" for p in prompts]


# Samples and folds

_over("stable_shuffle", "cv_records", lambda df: sampling.shuffled(df.select("row_no"), "row_no").withColumn("position", F.col("position").cast("bigint")))
_over("kfold_assign", "cv_records", lambda df: sampling.folds(df.select("row_no"), "row_no").withColumn("fold", F.col("fold").cast("bigint")))
_over("fold_sample", "cv_records", lambda df: sampling.per_group(df.select("row_no", "fold"), "fold", "row_no", 20))
_over("stratified_sample", "eval_prompts", lambda df: sampling.stratified(df.select("id", "difficulty_level"), "difficulty_level", "id", 100))
_over("holdout_split", "cv_records", lambda df: sampling.holdout(df.select("row_no"), "row_no"))
_over("head_sample", "instruction_records", lambda df: df.select("line_no", "id").orderBy("line_no").limit(100))

# Augmentation

_SYNONYMS = {"large": ["big", "great"], "quiet": ["calm", "still"], "old": ["ancient", "aged"], "letter": ["note"], "write": ["compose", "draft"], "report": ["account"], "keeps": ["holds"]}
_over("random_deletion", "instruction_records", lambda df: df.where("winner_prompt IS NOT NULL").select("line_no", "winner_prompt", augment.protected_tokens(F.col("winner_prompt"), F.col("added_constraint")).alias("guard")).select("line_no", augment.random_deletion(F.col("winner_prompt"), F.col("guard"), F.col("line_no"), 0.1, 42).alias("prompt")))
_over("lexical_edit", "instruction_records", lambda df: df.where("winner_prompt IS NOT NULL").select("line_no", augment.lexical(F.col("winner_prompt"), augment.protected_tokens(F.col("winner_prompt"), F.col("added_constraint")), F.col("line_no"), _SYNONYMS).alias("prompt")))
_over("bt_verify", "instruction_records", lambda df: df.where("winner_prompt IS NOT NULL").select("line_no", augment.preserved(F.replace(F.col("winner_prompt"), F.lit("the"), F.lit("THIS")), augment.constraint_tokens(F.col("winner_prompt"), F.col("added_constraint"))).alias("preserved")))


def _three(df: DataFrame) -> DataFrame:
    rows = df.where("winner_prompt IS NOT NULL").select("id", "line_no", "winner_prompt", "added_constraint", "augmentation_method")
    lex = augment.lexical_rows(rows, "winner_prompt", "added_constraint", _SYNONYMS)
    bt = augment.verified_translation(rows, "winner_prompt", "added_constraint", F.upper(F.col("winner_prompt")), "xx")
    return augment.threefold(rows, lex, bt)


_over("augment_union", "instruction_records", lambda df: _three(df).select("line_no", F.col("aug_rank").cast("bigint").alias("aug_rank"), "id", "augmentation_method", "augmentation_intermediate_lang"))
_over("back_translate", "instruction_records", lambda df: df.where("winner_prompt IS NOT NULL").select("line_no", augment.translated(F.col("winner_prompt"), _there, _back).alias("out")))


def _there(texts: list[str]) -> list[str]:
    return [f"<{t}>" for t in texts]


def _back(texts: list[str]) -> list[str]:
    return [f"{t}!" for t in texts]


_over("aug_stats", "instruction_records", lambda df: augment.stats(_three(df)))


def queries() -> dict[str, Query]:
    return QUERIES | io_queries()


__all__ = ["oracle_sql", "queries", "seeded"]
