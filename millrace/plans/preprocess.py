"""The preprocessing plan: clean, gate, remove exact and near-duplicates, audit and count by source.

``decisions`` and what rests on it (``decided``, ``decided_by_source``, ``run``) are the whole plan. ``kept`` and ``by_source`` stop after exact
removal: near-duplicates count as kept there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.operators import dedup, gates
from millrace.operators.audit import category_counts, imbalance
from millrace.session import cut


def gated(df: DataFrame) -> DataFrame:
    """Records with cleaned prompt and response and the first gate they fail; ``detected`` is the detector's language."""
    clean = F.struct(F.coalesce(X.clean_text(F.col("winner_prompt")), F.lit("")).alias("prompt"), F.coalesce(X.clean_text(F.col("response_of_winner_prompt")), F.lit("")).alias("response"))
    # a generator keeps filters above from pulling copies of the cleaning below it
    rows = df.select(*(c for c in df.columns if c not in ("prompt", "response")), F.inline(F.array(clean)))
    return rows.withColumn("skip_reason", gates.skip_reason(F.col("prompt"), F.col("response"), F.col("detected"), F.col("added_constraint"), F.col("added_constraint_num")))


def kept(gated_rows: DataFrame, order: str = "line_no") -> DataFrame:
    """Rows that pass all gates and are the first of their prompt without stop words: exact removal only."""
    live = gated_rows.where("skip_reason IS NULL").select(order, "source", "prompt", "response")
    return dedup.only_first(live, order, X.fingerprint(X.remove_stopwords(F.col("prompt"))))


def by_source(gated_rows: DataFrame, order: str = "line_no") -> DataFrame:
    """Per source: rows, rows that pass the gates, and rows kept after exact removal only."""
    ok = F.col("skip_reason").isNull()
    fp = F.when(ok, X.fingerprint(X.remove_stopwords(F.col("prompt"))))
    per = gated_rows.groupBy("source", fp.alias("fp")).agg(F.count("*").alias("n"), F.count_if(ok).alias("p"), F.min(F.when(ok, F.col(order))).alias("o"))
    firsts = per.where("fp IS NOT NULL").groupBy("fp").agg(F.min_by("source", "o").alias("source")).groupBy("source").agg(F.count("*").alias("n_kept"))
    whole = per.groupBy("source").agg(F.sum("n").alias("n_rows"), F.sum("p").alias("n_passed"))
    match = whole["source"].eqNullSafe(firsts["source"])
    return whole.join(firsts, match, "left").select(whole["source"], "n_rows", "n_passed", F.coalesce("n_kept", F.lit(0)).alias("n_kept"))


def decisions(gated_rows: DataFrame, threshold: float = 0.85, order: str = "line_no") -> DataFrame:
    """(order, source, skip_reason) of all rows, with 'exact' and 'near' added to the reasons; what has no reason is kept.

    Records are cleaned once: what duplicates are told by is written with the reasons, and nothing else.
    """
    text = F.when(F.col("skip_reason").isNull(), X.remove_stopwords(F.col("prompt")))
    slim = cut(gated_rows.select(order, "source", "skip_reason", text.alias("_text")))
    reasons = dedup.near_dedup(slim.where("skip_reason IS NULL"), order, F.col("_text"), threshold, written=True)
    return slim.join(reasons, order, "left").select(order, "source", F.coalesce("skip_reason", "reason").alias("skip_reason"))


def decided(gated_rows: DataFrame, threshold: float = 0.85, order: str = "line_no") -> DataFrame:
    """The gated rows with the reasons of decisions()."""
    known = decisions(gated_rows, threshold, order).select(order, "skip_reason")
    return gated_rows.drop("skip_reason").join(known, order)


def decided_by_source(decided_rows: DataFrame) -> DataFrame:
    """Per source: rows, rows that pass the gates, and rows kept after exact and near-duplicate removal."""
    kept_rows = F.col("skip_reason").isNull()
    passed = kept_rows | F.col("skip_reason").isin("exact", "near")
    return decided_rows.groupBy("source").agg(F.count("*").alias("n_rows"), F.count_if(passed).alias("n_passed"), F.count_if(kept_rows).alias("n_kept"))


def audit(records: DataFrame, kept_rows: DataFrame, order: str = "line_no") -> DataFrame:
    """Category counts, shares and imbalance flags of the rows kept."""
    rows = records.select(order, "added_constraint").join(kept_rows.select(order), order, "left_semi")
    return imbalance(category_counts(rows, F.col("added_constraint")))


def run(df: DataFrame, threshold: float = 0.85, order: str = "line_no", detector: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """All stages: gates, exact and near-duplicate removal, audit of what is kept: (decided rows: order, skip_reason with
    'exact' and 'near' added; audit). ``detector`` adds the column ``detected`` (a language code or null) to the records;
    without one nothing is detected, and the language gate lets all pass."""
    known = detector(df) if detector else df.withColumn("detected", F.lit(None).cast("string"))
    rows = cut(decisions(gated(known), threshold, order).select(order, "skip_reason"))
    return rows, audit(df, rows.where("skip_reason IS NULL"), order)
