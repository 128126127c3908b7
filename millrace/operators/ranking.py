"""Global ranks without a global sort in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seeded(key: Column, seed: int) -> Column:
    """A reproducible random key: SHA-256 of seed and key, in hex."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)


def hash_rank(df: DataFrame, order: str, tie: str, by: list[str] | None = None) -> DataFrame:
    """Add ``rank`` (1..n by the hex key ``order``, then ``tie``) and ``n``, per group ``by`` or over all rows.

    Rows are ranked within the 4,096 buckets of the key's first three digits, after the sizes of the buckets before; no
    group, however large, is sorted by one task. The bucket table has at most 4,096 rows a group.
    """
    by = by or []
    keyed = df.withColumn("_b", F.substring(order, 1, 3))
    sizes = keyed.groupBy(*by, "_b").agg(F.count("*").alias("_k"))
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*by, "_b", F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_before"), F.sum("_k").over(whole).alias("n"))
    joined = keyed.join(offsets.select(*(F.col(c).alias(f"_{c}") for c in by), F.col("_b").alias("_ob"), "_before", "n"), _match(by), "left")
    within = F.row_number().over(Window.partitionBy(*by, "_b").orderBy(order, tie))
    return joined.withColumn("rank", F.col("_before") + within).drop("_b", "_ob", "_before", *(f"_{c}" for c in by))


def _match(by: list[str]) -> Column:
    out = F.col("_b") == F.col("_ob")
    for c in by:
        out = out & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return out


def ntile(rank: Column, n: Column, k: int) -> Column:
    """The k contiguous parts of n ranked rows; the first n mod k have one row more."""
    small, extra = F.floor(n / k), n % k
    big = extra * (small + 1)
    return F.when(rank <= big, F.floor((rank - 1) / (small + 1)) + 1).otherwise(extra + F.floor((rank - 1 - big) / F.greatest(small, F.lit(1))) + 1).cast("int")
