"""The evaluation plan: responses against their prompts' constraints, and the metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import checker, metrics
from millrace.session import broadcast_if_small


def scored(responses: DataFrame, prompts: DataFrame, key: str = "id") -> DataFrame:
    """Responses with their report; those without a prompt are left out. Prompts are broadcast only if they are few."""
    asked = broadcast_if_small(prompts.select(key, "constraints"))
    known = responses.where("response IS NOT NULL").join(asked, key)
    known = known.withColumn("facts", checker.facts(F.col("response")))
    kept = [c for c in responses.columns if c not in ("results", "num_constraints", "num_checked", "num_passed", "per_constraint_csr", "hard_csr")]
    judged = known.select(*kept, checker.results(F.col("facts"), F.col("constraints"), checker.fields_of(prompts, "constraints")).alias("results"))
    return judged.select(*kept, checker.report(F.col("results")).alias("x")).select(*kept, "x.*")


def summary(scores: DataFrame) -> dict[str, DataFrame]:
    """The report's tables."""
    return {"by_level": metrics.csr_by_level(scores), "by_type": metrics.pass_by_type(scores), "overall": metrics.overall(scores), "histogram": scores.groupBy("difficulty_level", "num_constraints").agg(F.count("*").alias("n"))}
