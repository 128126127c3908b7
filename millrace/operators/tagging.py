"""Rule-based tagging of records by their constraint categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as X


def constraint_counts(df: DataFrame, key: str, m: Column) -> DataFrame:
    """(key, category, n): items per canonical category; a null list counts as one item, an empty one as none."""
    rows = df.select(key, F.explode(m).alias("raw", "items"))
    n = F.when(F.col("items").isNull(), 1).otherwise(F.size("items"))
    return rows.select(key, X.normalise_category(F.col("raw")).alias("category"), n.alias("n")).groupBy(key, "category").agg(F.sum("n").cast("bigint").alias("n"))


def constraint_counts_json(df: DataFrame, key: str, cell: Column) -> DataFrame:
    """The same for cells of JSON text: of an object, the items of each list (one for any other value); of a list, one per
    item under its type, constraint_type or other (a text under itself). Other and broken cells have none."""
    v = X.strict_json(cell)
    named = F.try_variant_get(v, "$", "map<string,variant>")
    of_object = F.transform(F.map_entries(named), lambda e: F.struct(e["key"].alias("raw"), F.coalesce(F.size(F.try_variant_get(e["value"], "$", "array<variant>")), F.lit(1)).alias("n")))
    kind = lambda x: F.coalesce(F.nullif(F.try_variant_get(x, "$.type", "string"), F.lit("")), F.nullif(F.try_variant_get(x, "$.constraint_type", "string"), F.lit("")), F.when(F.startswith(F.schema_of_variant(x), F.lit("OBJECT")), F.lit("other")), F.try_variant_get(x, "$", "string"))
    of_list = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.struct(kind(x).alias("raw"), F.lit(1).alias("n")))
    rows = df.select(key, F.inline(F.coalesce(of_object, of_list))).where("raw IS NOT NULL")
    return rows.select(key, X.normalise_category(F.col("raw")).alias("category"), "n").groupBy(key, "category").agg(F.sum("n").cast("bigint").alias("n"))


def assign(df: DataFrame, key: str, m: Column) -> DataFrame:
    """(key, categories, num_constraint_types, primary_cluster, cluster_label) of every record.

    The primary cluster is the category with most items, mixed where several have; records without any are
    unconstrained, as one type.
    """
    counts = constraint_counts(df, key, m)
    grouped = counts.groupBy(key).agg(F.array_sort(F.collect_set("category")).alias("cats"), F.max("n").alias("top"), F.max_by("category", "n").alias("lead"), F.collect_list("n").alias("ns"))
    ties = F.size(F.filter("ns", lambda x: x == F.col("top")))
    out = df.select(key).join(grouped, key, "left")
    none = F.col("cats").isNull()
    return out.select(
        key,
        F.when(none, F.array(F.lit("unconstrained"))).otherwise(F.col("cats")).alias("categories"),
        F.when(none, 1).otherwise(F.size("cats")).cast("bigint").alias("num_constraint_types"),
        F.when(none, "unconstrained").when(ties == 1, F.col("lead")).otherwise("mixed").alias("primary_cluster"),
        F.when(none, "unconstrained").otherwise(F.array_join("cats", "+")).alias("cluster_label"),
    )


def distribution(df: DataFrame, col: str) -> DataFrame:
    """(col, n, share) of each value."""
    counts = df.groupBy(col).agg(F.count("*").alias("n"))
    return counts.select(col, "n", (F.col("n") / counts.agg(F.sum("n")).scalar()).alias("share"))


def top_labels(df: DataFrame, label: str, order: str, k: int = 20) -> DataFrame:
    """The k most frequent labels; ties by first appearance."""
    return df.groupBy(label).agg(F.count("*").alias("n"), F.min(order).alias("first_seen")).orderBy(F.desc("n"), "first_seen").limit(k)


def category_presence(assigned: DataFrame) -> DataFrame:
    """(category, n, share): records that have each category, against all records."""
    total = assigned.agg(F.count("*")).scalar()
    counts = assigned.select(F.explode("categories").alias("category")).groupBy("category").agg(F.count("*").alias("n"))
    return counts.select("category", "n", (F.col("n") / total).alias("share"))


def summary(assigned: DataFrame, order: str, k: int = 20) -> DataFrame:
    """The cluster summary as rows (section, value, n, pct): primary clusters, categories present, numbers of types, and the
    k most frequent labels (ties by first appearance); pct of all records, to two places. One pass counts all sections."""
    total = assigned.agg(F.count("*")).scalar()
    item = lambda section, value: F.struct(F.lit(section).alias("section"), value.cast("string").alias("value"))
    fixed = F.array(item("by_primary_cluster", F.col("primary_cluster")), item("num_constraint_types", F.col("num_constraint_types")), item("top_cluster_labels", F.col("cluster_label")))
    present = F.transform("categories", lambda c: item("category_presence", c))
    counts = assigned.select(order, F.inline(F.concat(fixed, present))).groupBy("section", "value").agg(F.count("*").alias("n"), F.min(order).alias("first_seen"))
    place = F.row_number().over(Window.partitionBy("section").orderBy(F.desc("n"), "first_seen"))
    ranked = counts.withColumn("place", place).where((F.col("section") != "top_cluster_labels") | (F.col("place") <= k))
    return ranked.select("section", "value", "n", F.round(100 * F.col("n") / total, 2).alias("pct"))
