"""Readers: JSON lines with line numbers, JSON arrays and wrapped objects, zip archives, checkpoints and CSV globs.

Records are read as declared columns or as a ``raw`` Variant that keeps unknown keys. Whole-file formats (arrays, wrapped
objects, zip members) cannot be split and hold one file a row, of up to 2 GB; all others are split.
"""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.session import broadcast_if_small, cut

WRAPPERS = ("data", "instances", "examples", "records")


def guard(spark: SparkSession, path: str) -> None:
    """Refuse an empty file, and a pointer of large-file storage that stands for one."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where) or fs.getContentSummary(where).getLength() == 0:  # empty files never reach a scan
        raise ValueError(f"{path} is empty or missing")
    head = F.decode(F.substring("content", 1, 1024), "ISO-8859-1")
    small = spark.read.format("binaryFile").load(path).where("length < 1024")
    if not small.where(F.contains(head, F.lit("git-lfs"))).isEmpty():
        raise ValueError(f"{path} is a large-file pointer, not the data")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value): lines numbered from 1 in each file, though files are read in blocks by many tasks.

    The rows of a block are counted in a pass of their own that reads no more than line ends; a line's number is the count
    before its block plus its place in the block. The table of blocks, one short row each, is written and broadcast, so that
    no text is shuffled (where it is too large to be, the text is joined by file and block).
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    blocks = raw.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = blocks.select("file", "block", "first", F.coalesce(before, F.lit(0)).alias("before"))
    return raw.join(broadcast_if_small(cut(offsets)), ["file", "block"]).select("file", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line_no"), "value")


def parsed(rows: DataFrame) -> DataFrame:
    """Add ``raw`` (Variant) and ``status``: empty_line (not counted as a record), json_error or ok."""
    body = X.trim_ws(F.col("value"))
    v = X.strict_json(body)
    return rows.select("*", v.alias("raw"), F.when(body == "", "empty_line").when(v.isNull(), "json_error").otherwise("ok").alias("status"))


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, raw): the records of JSON lines; broken and blank lines are skipped."""
    return parsed(lines(spark, path)).where("status = 'ok'").select("file", "line_no", "raw")


def lenient_lines(spark: SparkSession, path: str) -> DataFrame:
    """As json_lines, with broken UTF-8 replaced before parsing. Files are split as those of lines() are."""
    rows = lines(spark, path).withColumn("value", F.make_valid_utf8("value"))
    return parsed(rows).where("status = 'ok'").select("file", "line_no", "raw")


def _exploded(whole: DataFrame) -> DataFrame:
    """Records of whole texts: array items, items under a wrapper key, the object itself, or JSON lines."""
    v = X.strict_json(F.col("value"))
    wrapped = F.coalesce(*(F.try_variant_get(v, f"$.{k}", "array<variant>") for k in WRAPPERS))
    single = F.when(v.isNotNull(), F.array(v))
    by_line = F.filter(F.transform(F.filter(F.split("value", "\n"), lambda x: X.trim_ws(x) != ""), lambda x: X.strict_json(x)), lambda x: x.isNotNull())
    items = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), wrapped, single, by_line)
    return whole.select("file", F.posexplode(items).alias("pos", "raw")).select("file", (F.col("pos") + 1).cast("bigint").alias("line_no"), "raw")


def json_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of a file that is a JSON array, an object that wraps one (or is itself one record), or JSON lines."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return _exploded(whole)


def json_values(spark: SparkSession, path: str) -> DataFrame:
    """Records that are the values of one object."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    vals = F.map_values(F.try_variant_get(X.strict_json(F.col("value")), "$", "map<string,variant>"))
    return whole.select("file", F.posexplode(vals).alias("pos", "raw")).select("file", (F.col("pos") + 1).cast("bigint").alias("line_no"), "raw")


def zipped(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (".jsonl", ".json", "")) -> DataFrame:
    """Records of the first member with the first suffix that any has, of each zip archive."""

    def members(batches):
        for batch in batches:
            names, texts = [], []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    inside = sorted(n for n in z.namelist() if not n.endswith("/"))
                    found = next((n for s in suffixes for n in inside if n.endswith(s)), None)
                    if found is not None:
                        names.append(f"{name}!{found}")
                        texts.append(z.read(found).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.string())], ["file", "value"])

    return _exploded(spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(members, "file string, value string"))


def fields(records: DataFrame, **columns: str) -> DataFrame:
    """Typed columns of Variant records: name=type; a value of another type is null."""
    return records.select("*", *(F.try_variant_get("raw", f"$.{name}", kind).alias(name) for name, kind in columns.items()))


def truthy_pairs(records: DataFrame, prompt: tuple[str, ...], response: tuple[str, ...]) -> DataFrame:
    """Records whose prompt and response are not empty, the first key that is filled of each; ``raw`` is kept."""
    get = lambda names: X.first_truthy(*(F.try_variant_get("raw", f"$.{n}", "string") for n in names))
    return records.select("*", get(prompt).alias("prompt"), get(response).alias("response")).where("prompt <> '' AND response <> ''")


def checkpointed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows an earlier run has appended; none where there is no checkpoint yet."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def csv_glob(spark: SparkSession, paths: list[str]) -> DataFrame:
    """CSV files with headers as one table; columns a file lacks are null."""
    out: DataFrame | None = None
    for p in paths:
        one = spark.read.csv(p, header=True)
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        raise ValueError("no CSV files")
    return out


def present(raw: Column, name: str) -> Column:
    """Whether a record has the key, null or not."""
    return F.array_contains(F.map_keys(F.try_variant_get(raw, "$", "map<string,variant>")), name)
