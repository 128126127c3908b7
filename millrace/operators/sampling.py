"""Seeded samples, folds and splits. Every choice follows a hash of seed and key, so it survives any partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.ranking import hash_rank, ntile, seeded


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Add ``position``, the row's place in a seeded shuffle."""
    return hash_rank(df.withColumn("_h", seeded(F.col(key), seed)), "_h", key).withColumnRenamed("rank", "position").drop("_h", "n")


def folds(df: DataFrame, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Add ``fold`` (1..k): contiguous parts of a seeded shuffle, sizes differing by one at most."""
    ranked = hash_rank(df.withColumn("_h", seeded(F.col(key), seed)), "_h", key)
    return ranked.withColumn("fold", ntile(F.col("rank"), F.col("n"), k)).drop("_h", "rank", "n")


def _first_of_groups(df: DataFrame, group: str, key: str, most: int, seed: int) -> DataFrame:
    """The first ``most`` rows of each group by their seeded key, with their rank as ``_rank``.

    A literal limit on a row number lets each task keep ``most`` rows of a group before the shuffle, so that no task gets a
    whole group.
    """
    w = Window.partitionBy(group).orderBy("_h", key)
    ranked = df.withColumn("_h", seeded(F.col(key), seed)).withColumn("_rank", F.row_number().over(w))
    return ranked.where(F.col("_rank") <= most).drop("_h")


def per_group(df: DataFrame, group: str, key: str, m: int, seed: int = 42) -> DataFrame:
    """At most ``m`` rows of each group."""
    return _first_of_groups(df, group, key, m, seed).drop("_rank")


def stratified(df: DataFrame, level: str, key: str, total: int, seed: int = 42) -> DataFrame:
    """max(1, total // levels) rows of each level, or all it has."""
    levels = df.agg(F.count_distinct(F.coalesce(F.col(level).cast("string"), F.lit("")))).scalar()
    quota = F.greatest(F.lit(1), F.floor(F.lit(total) / F.greatest(levels, F.lit(1))))
    return _first_of_groups(df, level, key, max(1, total), seed).where(F.col("_rank") <= quota).drop("_rank")


def holdout(df: DataFrame, key: str, share: float = 0.1, seed: int = 42) -> DataFrame:
    """Add ``split``: the last ``share`` of a seeded shuffle is val, the rest train."""
    ranked = hash_rank(df.withColumn("_h", seeded(F.col(key), seed)), "_h", key)
    train = F.col("n") - F.floor(F.col("n") * share)
    return ranked.withColumn("split", F.when(F.col("rank") <= train, "train").otherwise("val")).drop("_h", "rank", "n")
