"""Evaluation metrics over score rows, verdicts and folds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVELS = ("L1", "L2", "L3", "L4")


def csr_by_level(scores: DataFrame) -> DataFrame:
    """Mean CSR and hard CSR per level, L1-L4 always, and Overall; only rows with a checked constraint count."""
    used = scores.where("num_checked > 0")
    agg = used.rollup("difficulty_level").agg(F.grouping_id().alias("g"), F.count("*").alias("n"), F.sum("per_constraint_csr").alias("s"), F.count_if("hard_csr").alias("h"))
    levels = scores.sparkSession.createDataFrame([(x,) for x in (*LEVELS, "Overall")], "level string")
    named = agg.select(F.when(F.col("g") == 1, "Overall").otherwise(F.col("difficulty_level")).alias("level"), "n", "s", "h").where("level IS NOT NULL")
    n = F.coalesce("n", F.lit(0))
    mean = lambda c: F.when(n > 0, F.col(c) / n).otherwise(F.lit(0.0))
    return levels.join(named, "level", "left").select("level", n.alias("n"), mean("s").alias("mean_csr"), mean("h").alias("hard_csr"))


def pass_by_type(scores: DataFrame) -> DataFrame:
    """Checked and passed verdicts per constraint type."""
    rows = scores.select(F.inline("results")).where("passed IS NOT NULL")
    return rows.groupBy("type").agg(F.count("*").alias("n_checked"), F.count_if("passed").alias("n_passed"), (F.count_if("passed") / F.count("*")).alias("pass_rate"))


def overall(scores: DataFrame) -> DataFrame:
    """Micro-average: all passed over all checked, and the loss."""
    return scores.agg(F.sum("num_passed").cast("bigint").alias("n_passed"), F.sum("num_checked").cast("bigint").alias("n_checked")).select("*", (F.col("n_passed") / F.col("n_checked")).alias("score"), (1 - F.col("n_passed") / F.col("n_checked")).alias("loss"))


def per_key(verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """Pass rate and loss per verdict column, nulls left out, in one pass; keys without a verdict do not appear."""
    cells = F.explode(F.array(*(F.struct(F.lit(k).alias("key"), F.col(k).alias("v")) for k in keys))).alias("x")
    rows = verdicts.select(cells).select("x.*").where("v IS NOT NULL")
    rate = F.count_if(F.col("v").cast("boolean")) / F.count("*")
    return rows.groupBy("key").agg(F.count("*").alias("n"), rate.alias("pass_rate"), (1 - rate).alias("loss"))


def fold_means(scores: DataFrame, metrics: list[str]) -> DataFrame:
    """(model, fold, metric, value): mean of each metric in each fold."""
    mean = scores.groupBy("model", "fold").agg(*(F.avg(F.col(m).cast("double")).alias(m) for m in metrics))
    return mean.select("model", "fold", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics))).alias("x")).select("model", "fold", "x.*")


def fold_summary(scores: DataFrame, metrics: list[str], population: bool = False) -> DataFrame:
    """Mean and standard deviation over folds of the folds' means; sample deviation unless ``population``."""
    std = F.stddev_pop if population else F.stddev_samp
    return fold_means(scores, metrics).groupBy("model", "metric").agg(F.avg("value").alias("mean"), std("value").alias("std"), F.count("value").alias("n_folds"))


def compare_models(scores: DataFrame, metrics: list[str], a: str, b: str) -> DataFrame:
    """Per metric the larger mean wins, equal means tie."""
    wide = fold_summary(scores, metrics).where(F.col("model").isin(a, b)).groupBy("metric").agg(F.max(F.when(F.col("model") == a, F.col("mean"))).alias("mean_a"), F.max(F.when(F.col("model") == b, F.col("mean"))).alias("mean_b"))
    return wide.withColumn("winner", F.when(F.col("mean_a") > F.col("mean_b"), a).when(F.col("mean_b") > F.col("mean_a"), b).otherwise("Tie"))


def wins(compared: DataFrame) -> DataFrame:
    """How many metrics each model wins, and how many are ties."""
    return compared.groupBy("winner").agg(F.count("*").alias("n_metrics"))


def override(base: DataFrame, judged: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Rows of ``base`` with the columns of the judged row of their key where there is one."""
    j = judged.select(F.col(key), F.struct(*cols).alias("_j"))
    rows = base.join(j, key, "left")
    return rows.select(*(F.when(F.col("_j").isNotNull(), F.col(f"_j.{c}")).otherwise(F.col(c)).alias(c) if c in cols else F.col(c) for c in base.columns))


def model_runs(scores: DataFrame) -> DataFrame:
    """Mean CSR and hard CSR per model and run, models ascending, runs descending."""
    mean = scores.groupBy("model", "run_no").agg(F.count("*").alias("n"), (F.sum(F.col("per_constraint_csr").cast("decimal(18,9)")).cast("double") / F.count("per_constraint_csr")).alias("mean_csr"), (F.count_if("hard_csr") / F.count("*")).alias("hard_csr"))
    return mean.orderBy(F.asc("model"), F.desc("run_no"))
