"""Queries of the language-model operators, by the names of the problems."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, language, mixing, near_dup, pair_defects, split_overlap, splitting, truncation, visual_form
from millrace.session import broadcast_if_small, table

FIELDS = ["winner_prompt", "response_of_winner_prompt"]


def joined_text():
    return F.concat(F.coalesce("winner_prompt", F.lit("")), F.lit(" "), F.coalesce("response_of_winner_prompt", F.lit("")))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "instruction_records", True).select(F.lit("instruction_records").alias("tab"), F.col("line_no").alias("row_key"), F.col("winner_prompt").alias("prompt"), F.col("response_of_winner_prompt").alias("response"))
    prompts = broadcast_if_small(table(spark, sf_dir, "eval_prompts").select("id", F.col("winner_prompt").alias("prompt")))
    asked = table(spark, sf_dir, "model_responses", True).join(prompts, "id", "left").select(F.lit("model_responses").alias("tab"), F.col("resp_id").alias("row_key"), "prompt", "response")
    return pair_defects.pair_defects(own.unionByName(asked), table(spark, sf_dir, "language_samples"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncated(table(spark, sf_dir, "model_responses", True), "resp_id", "response", "source")


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncation_report(table(spark, sf_dir, "model_responses", True), "resp_id", "response", "source")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_overlap.overlap_pairs(table(spark, sf_dir, "cv_records", True), "row_no", "fold", "winner_prompt").select("row_no_a", "row_no_b")


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_overlap.overlap_report(table(spark, sf_dir, "cv_records", True), "row_no", "fold", "winner_prompt", "source")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicate_pairs(table(spark, sf_dir, "instruction_records", True), "line_no", joined_text()).select("line_no_a", "line_no_b")


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicate_groups(table(spark, sf_dir, "instruction_records", True), "line_no", joined_text())


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visual_form.look_alike_pairs(table(spark, sf_dir, "instruction_records", True), "line_no", FIELDS)


def p6_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "instruction_records", True)
    return df.select("line_no", *(visual_form.visual_form(F.col(f)).alias(f) for f in FIELDS))


def _languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = [("winner_prompt", "prompt_lang"), ("response_of_winner_prompt", "response_lang")]
    return language.detect_languages(table(spark, sf_dir, "instruction_records", True), "line_no", fields, "source", table(spark, sf_dir, "language_samples"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.wrong_or_mixed(_languages(spark, sf_dir), "line_no").select("line_no", "field", "seg_no", "lang")


def p7_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _languages(spark, sf_dir).select(F.col("id").alias("line_no"), "field", "declared", F.inline("segments"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", True).select("doc_id", bpe.token_ids(F.col("text")).alias("ids"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents", True), table(spark, sf_dir, "source_targets"))[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents", True), table(spark, sf_dir, "source_targets"))[1]


def p10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = splitting.profiles_of(table(spark, sf_dir, "split_limits"))
    return splitting.split_texts(table(spark, sf_dir, "documents", True), "doc_id", "text", limits)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (p1_found, p3_found, p3_report, p4_found, p4_report, p5_found, p5_groups, p6_found, p6_forms, p7_found, p7_segments, p8_ids, p9_mix, p9_shares, p10_pieces)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {}
