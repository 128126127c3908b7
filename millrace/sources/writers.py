"""Writers: JSON lines, CSV with a summary row, companions of metadata, idempotent and appending sinks, reports."""

from __future__ import annotations

import io
import json
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object a line, in UTF-8 without escapes; null fields are left out."""
    df.write.mode(mode).json(path)


def once(df: DataFrame, path: str, force: bool = False) -> dict[str, str]:
    """Write unless the path exists; ``force`` writes anew."""
    if exists(df.sparkSession, path) and not force:
        return {"status": "skipped"}
    json_lines(df, path)
    return {"status": "written"}


def append(df: DataFrame, path: str, key: str | None = None, batches: int = 1) -> None:
    """Add rows to a checkpoint; readers.checkpointed() gives them back.

    With a ``key`` the rows are added in so many batches by its hash, each on disk before the next is computed, so that a
    run that fails loses one batch; the next run leaves out what is done (inference.not_done).
    """
    for i in range(batches if key else 1):
        part = df.where(F.pmod(F.xxhash64(key), F.lit(batches)) == i) if key else df
        json_lines(part, path, "append")


def csv_with_summary(rows: DataFrame, summary: DataFrame, path: str, key: str = "id") -> None:
    """Rows, then summary rows under the key SUMMARY, sorted by key within the rows."""
    named = summary.withColumn(key, F.lit("SUMMARY"))
    both = rows.withColumn("_last", F.lit(0)).unionByName(named.withColumn("_last", F.lit(1)), allowMissingColumns=True)
    # a range partitioning keeps the files in order without one task sorting all
    both.repartitionByRange("_last", key).sortWithinPartitions("_last", key).drop("_last").write.mode("overwrite").csv(path, header=True)


def verdict_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    df.select(*columns).write.mode("overwrite").csv(path, header=True)


def metadata(spark: SparkSession, path: str, **values) -> None:
    """A one-row JSON companion."""
    spark.createDataFrame([(json.dumps(values, ensure_ascii=False, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def zipped(df: DataFrame, path: str, most: int = 100_000) -> None:
    """A small result as JSON lines in a zip archive of one member."""
    rows = df.limit(most + 1).toJSON().collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows; use json_lines()")
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("records.jsonl", "\n".join(rows))
    spark = df.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    out.write(bytearray(buffer.getvalue()))
    out.close()


def by_fold(df: DataFrame, path: str, fold: str = "fold") -> None:
    """Results in one folder per fold."""
    df.write.mode("overwrite").partitionBy(fold).json(path)


def pretty(df: DataFrame, most: int = 10_000) -> str:
    """A small result as indented JSON text."""
    rows = df.limit(most + 1).toJSON().collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows; use json_lines()")
    return json.dumps([json.loads(r) for r in rows], ensure_ascii=False, indent=2)


def report(title: str, df: DataFrame, most: int = 200) -> str:
    """A small result as a text table."""
    rows = df.limit(most).collect()
    cells = [list(map(str, df.columns)), *[["" if v is None else str(v) for v in r] for r in rows]]
    width = [max(len(r[i]) for r in cells) for i in range(len(df.columns))]
    return "\n".join([title, "=" * len(title), *("  ".join(c.ljust(w) for c, w in zip(r, width)).rstrip() for r in cells)])
