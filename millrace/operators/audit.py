"""Distribution audits: frequencies, shares, coverage, lengths and unusual characters."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import text as X


def category_counts(df: DataFrame, m: Column) -> DataFrame:
    """Records per category key; records without any count as unknown."""
    keys = F.when(F.size(m) > 0, F.map_keys(m)).otherwise(F.array(F.lit("unknown")))
    return df.select(F.explode(keys).alias("category")).groupBy("category").agg(F.count("*").alias("n_records"))


def imbalance(counts: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Share of each category and whether it is below threshold / number of categories."""
    share = F.col("n_records") / counts.agg(F.sum("n_records")).scalar()
    return counts.select("category", "n_records", share.alias("share"), (share < threshold / counts.agg(F.count("*")).scalar()).alias("flagged"))


def category_coverage(df: DataFrame, m: Column) -> DataFrame:
    """Per category with items: records and items."""
    rows = df.select(F.explode(m).alias("category", "items")).where(F.size("items") > 0)
    return rows.groupBy("category").agg(F.count("*").alias("n_records"), F.sum(F.size("items")).cast("bigint").alias("n_items"))


def constraint_totals(df: DataFrame, m: Column) -> DataFrame:
    """Records, items of all their categories, and mean items per record."""
    items = F.aggregate(F.coalesce(F.map_values(m), F.array()), F.lit(0), lambda n, x: n + F.greatest(F.coalesce(F.size(x), F.lit(0)), F.lit(0)))
    n, k = F.count("*"), F.coalesce(F.sum(items), F.lit(0)).cast("bigint")
    return df.agg(n.alias("n_records"), k.alias("n_items"), (k / F.greatest(n, F.lit(1))).alias("mean_items"))


def field_presence(df: DataFrame, cell: Column) -> DataFrame:
    """Records that have each top-level key of a JSON object cell."""
    keys = F.json_object_keys(cell)
    return df.select(F.explode(F.array_distinct(keys)).alias("field")).groupBy("field").agg(F.count("*").alias("n_records"))


def field_coverage(df: DataFrame, fields: list[str]) -> DataFrame:
    """(field, n_filled): values that are neither null nor blank, in one pass."""
    one = df.agg(*(F.count_if(X.trim_ws(F.col(f)) != "").alias(f) for f in fields))
    return one.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("n_filled")) for f in fields))).alias("x")).select("x.*")


def length_stats(df: DataFrame, fields: list[str]) -> DataFrame:
    """Exact minimum, truncated median, mean and maximum of words per field, texts without words left out."""
    parts = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), X.word_count(F.col(f)).alias("n")) for f in fields))).alias("x")
    rows = df.select(parts).select("x.*").where("n > 0")
    return rows.groupBy("field").agg(F.min("n").cast("bigint").alias("min_words"), F.median("n").cast("bigint").alias("median_words"), (F.sum("n") / F.count("n")).alias("mean_words"), F.max("n").cast("bigint").alias("max_words"))


def non_ascii_audit(df: DataFrame, fields: list[str]) -> DataFrame:
    """Per field: records with a non-ASCII character, and the number of such characters."""
    parts = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.size(X.non_ascii(F.coalesce(F.col(f), F.lit("")))).alias("n")) for f in fields))).alias("x")
    return df.select(parts).select("x.*").groupBy("field").agg(F.count_if(F.col("n") > 0).alias("n_records"), F.sum("n").cast("bigint").alias("n_chars"))


def top_chars(df: DataFrame, fields: list[str], k: int = 20) -> DataFrame:
    """The k most frequent non-ASCII characters of the fields."""
    chars = df.select(F.explode(F.flatten(F.array(*(X.non_ascii(F.coalesce(F.col(f), F.lit(""))) for f in fields)))).alias("ch"))
    return chars.groupBy("ch").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ch").limit(k)


_NAMED = T.StructType([T.StructField("name", T.StringType()), T.StructField("category", T.StringType())])


@F.arrow_udf(_NAMED)
def _named(chars: pa.Array) -> pa.Array:
    cs = chars.to_pylist()
    return pa.StructArray.from_arrays([pa.array([unicodedata.name(c, "UNNAMED") for c in cs], pa.string()), pa.array([unicodedata.category(c) for c in cs], pa.string())], ["name", "category"])


def named_chars(top: DataFrame) -> DataFrame:
    """Unicode name and category of the few characters of top_chars()."""
    return top.select("*", _named(F.col("ch")).alias("x")).select(*top.columns, "x.*")
