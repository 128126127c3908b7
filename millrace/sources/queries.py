"""Queries of the sources and sinks: tables written in each form and read back."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.inference import not_done
from millrace.session import checkpoint_dir, table
from millrace.sources import readers, writers
from millrace.streaming import clean

Query = Callable[[SparkSession, str], DataFrame]
IO: dict[str, Query] = {}


def _io(f: Query) -> Query:
    IO[f.__name__] = f
    return f


def _place(spark: SparkSession) -> str:
    """A new folder in the cluster's shared one."""
    return f"{checkpoint_dir(spark).rstrip('/')}/io-{uuid.uuid4().hex}"


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "cv_records").select("row_no", "id", "fold", "source", "winner_prompt")


def _typed(records: DataFrame) -> DataFrame:
    return readers.fields(records, row_no="bigint", id="string", fold="int", source="string", winner_prompt="string").select("row_no", "id", "fold", "source", "winner_prompt")


@_io
def io_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _place(spark)
    writers.json_lines(_records(spark, sf_dir), at)
    return _typed(readers.json_lines(spark, at))


@_io
def io_line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file numbers its lines from 1 without a gap: files, lines, and the largest number of any file less its lines."""
    at = _place(spark)
    writers.json_lines(_records(spark, sf_dir), at)
    per = readers.lines(spark, at).groupBy("file").agg(F.count("*").alias("n"), F.count_distinct("line_no").alias("d"), F.min("line_no").alias("lo"), F.max("line_no").alias("hi"))
    return per.agg(F.sum("n").alias("n_lines"), F.count_if((F.col("lo") != 1) | (F.col("hi") != F.col("n")) | (F.col("d") != F.col("n"))).alias("n_wrong"))


@_io
def io_line_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are records, broken ones (every tenth) and blank ones (where there is no fold)."""
    at = _place(spark)
    line = F.when(F.col("fold").isNull(), " ").when(F.col("row_no") % 10 == 0, '{"row_no": ').otherwise(F.to_json(F.struct("row_no", "id")))
    _records(spark, sf_dir).select(line.alias("value")).write.text(at)
    return readers.parsed(readers.lines(spark, at)).groupBy("status").agg(F.count("*").alias("n"))


@_io
def io_lenient_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _place(spark)
    writers.json_lines(_records(spark, sf_dir), at)
    return _typed(readers.lenient_lines(spark, at))


def _whole(spark: SparkSession, sf_dir: str, form: Callable) -> str:
    """The evaluation prompts (a table of fixed size) as one JSON text of a form, in a file of its own."""
    at = _place(spark)
    rows = table(spark, sf_dir, "eval_prompts").select(F.to_json(F.struct("id", "winner_prompt")).alias("j"), "id")
    rows.coalesce(1).agg(F.array_sort(F.collect_list("j")).alias("js")).select(form(F.col("js")).alias("value")).write.text(at)
    return at


def _prompts(records: DataFrame) -> DataFrame:
    return readers.fields(records, id="string", winner_prompt="string").select("id", "winner_prompt")


_LIST = lambda js: F.concat(F.lit("["), F.array_join(js, ","), F.lit("]"))


@_io
def io_json_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prompts(readers.json_records(spark, _whole(spark, sf_dir, _LIST)))


@_io
def io_wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prompts(readers.json_records(spark, _whole(spark, sf_dir, lambda js: F.concat(F.lit('{"instances":'), _LIST(js), F.lit("}")))))


@_io
def io_json_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = lambda js: F.concat(F.lit("{"), F.array_join(F.transform(js, lambda j, i: F.concat(F.lit('"k'), i.cast("string"), F.lit('":'), j)), ","), F.lit("}"))
    return _prompts(readers.json_values(spark, _whole(spark, sf_dir, named)))


@_io
def io_zipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _place(spark)
    writers.zipped(table(spark, sf_dir, "eval_prompts").select("id", "winner_prompt"), f"{at}.zip")
    return _prompts(readers.zipped(spark, f"{at}.zip"))


@_io
def io_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which files are refused: a missing one, a pointer, a good one."""
    at, out = _place(spark), []
    rows = table(spark, sf_dir, "eval_prompts").select("id")
    writers.json_lines(rows, f"{at}/good")
    spark.createDataFrame([("version https://git-lfs.github.com/spec/v1",)], "value string").coalesce(1).write.text(f"{at}/pointer")
    for name in ("good", "missing", "pointer"):
        try:
            readers.guard(spark, f"{at}/{name}")
            out.append((name, False))
        except ValueError:
            out.append((name, True))
    return spark.createDataFrame(out, "file string, refused boolean")


@_io
def io_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _place(spark)
    rows = table(spark, sf_dir, "instruction_records")
    writers.json_lines(rows.select(F.col("line_no").alias("key"), F.col("winner_prompt").alias("instruction"), F.col("prompt_winner").alias("input"), F.col("response_of_winner_prompt").alias("output")), at)
    got = readers.truthy_pairs(readers.json_lines(spark, at), ("instruction", "input"), ("output",))
    return readers.fields(got, key="bigint").select(F.col("key").alias("line_no"), "prompt", "response")


@_io
def io_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the rows done in an earlier run, the rest added in four batches: all of them, once each."""
    at, rows = _place(spark), _records(spark, sf_dir).select("row_no", "id")
    schema = "row_no bigint, id string"
    writers.append(rows.where("row_no % 2 = 0"), at)
    writers.append(not_done(rows, readers.checkpointed(spark, at, schema), "row_no"), at, "row_no", 4)
    return readers.checkpointed(spark, at, schema)


@_io
def io_csv_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    at, rows = _place(spark), table(spark, sf_dir, "cv_scores")
    writers.verdict_csv(rows.where("fold % 2 = 0"), f"{at}/even", ["score_id", "fold", "model", "length_ok"])
    writers.verdict_csv(rows.where("fold % 2 = 1"), f"{at}/odd", ["score_id", "fold", "model", "length_ok", "csr"])
    got = readers.csv_glob(spark, [f"{at}/even", f"{at}/odd"])
    return got.select(F.col("score_id").cast("bigint").alias("score_id"), F.col("fold").cast("int").alias("fold"), "model", F.col("length_ok").cast("boolean").alias("length_ok"), F.col("csr").cast("double").alias("csr"))


@_io
def io_csv_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    at, rows = _place(spark), table(spark, sf_dir, "cv_scores").select(F.col("score_id").cast("string").alias("id"), "csr")
    writers.csv_with_summary(rows, rows.agg(F.max("csr").alias("csr")), at)
    return spark.read.csv(at, header=True).select("id", F.col("csr").cast("double").alias("csr"))


@_io
def io_by_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _place(spark)
    writers.by_fold(table(spark, sf_dir, "cv_scores").select("score_id", "fold", "model"), at)
    return spark.read.json(at).select("score_id", F.col("fold").cast("int").alias("fold"), "model")


@_io
def io_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of three writes does; the third is forced."""
    at, rows = _place(spark), table(spark, sf_dir, "cv_scores").select("score_id")
    did = [writers.once(rows, at)["status"], writers.once(rows.limit(0), at)["status"]]
    n = [spark.read.json(at).count()]
    did.append(writers.once(rows.where("score_id % 2 = 0"), at, force=True)["status"])
    n.append(spark.read.json(at).count())
    return spark.createDataFrame([(1, did[0], n[0]), (2, did[1], n[0]), (3, did[2], n[1])], "step int, status string, n_rows bigint")


@_io
def io_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    at, n = _place(spark), table(spark, sf_dir, "cv_scores").count()
    writers.metadata(spark, at, name="fólds", n=n)
    return spark.read.json(at).select("name", "n")


@_io
def io_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The indented JSON and the text report of the folds, read back."""
    folds = table(spark, sf_dir, "cv_scores").groupBy("fold").agg(F.count("*").alias("n")).orderBy("fold")
    shown = [line.split() for line in writers.report("Folds", folds).split("\n")[3:]]
    both = spark.createDataFrame([("report", int(f), int(n)) for f, n in shown], "form string, fold int, n bigint")
    whole = spark.createDataFrame([(writers.pretty(folds),)], "value string")
    items = whole.select(F.explode(F.from_json("value", "array<struct<fold:int,n:bigint>>")).alias("x"))
    return both.unionByName(items.select(F.lit("pretty").alias("form"), "x.fold", "x.n"))


@_io
def stream_skip_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming form of the gates over files as they arrive: skip reasons per day of creation (no language detected)."""
    at, name = _place(spark), f"skip_counts_{uuid.uuid4().hex}"
    columns = [x.split()[0] for x in clean.SCHEMA.split(", ")]
    writers.json_lines(table(spark, sf_dir, "instruction_records").select(*columns), f"{at}/in")
    counts = clean.skip_counts(clean.source(spark, f"{at}/in"))
    sink = counts.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", f"{at}/state")
    sink.trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "skip_reason", F.col("count").alias("n"))


def io_queries() -> dict[str, Query]:
    return dict(IO)


def io_sql() -> dict[str, str]:
    """The same in SQL: what was written is what is read."""
    rows = "SELECT row_no, id, fold, source, winner_prompt FROM cv_records"
    prompts = "SELECT id, winner_prompt FROM eval_prompts"
    first = "coalesce(nullif({}, ''), nullif({}, ''), '')"
    return {
        "io_json_lines": rows,
        "io_line_numbers": "SELECT count(*) AS n_lines, 0::BIGINT AS n_wrong FROM cv_records",
        "io_line_status": "SELECT CASE WHEN fold IS NULL THEN 'empty_line' WHEN row_no % 10 = 0 THEN 'json_error' ELSE 'ok' END AS status, count(*) AS n FROM cv_records GROUP BY 1",
        "io_lenient_lines": rows, "io_json_array": prompts, "io_wrapped": prompts, "io_json_values": prompts, "io_zipped": prompts,
        "io_guards": "SELECT * FROM (VALUES ('good', false), ('missing', true), ('pointer', true)) t(file, refused)",
        "io_pairs": f"SELECT line_no, {first.format('winner_prompt', 'prompt_winner')} AS prompt, response_of_winner_prompt AS response FROM instruction_records WHERE {first.format('winner_prompt', 'prompt_winner')} <> '' AND response_of_winner_prompt <> ''",
        "io_checkpoint": "SELECT row_no, id FROM cv_records",
        "io_csv_glob": "SELECT score_id, fold, model, length_ok, CASE WHEN fold % 2 = 1 THEN csr END AS csr FROM cv_scores",
        "io_csv_summary": "SELECT score_id::VARCHAR AS id, csr FROM cv_scores UNION ALL SELECT 'SUMMARY', max(csr) FROM cv_scores",
        "io_by_fold": "SELECT score_id, fold, model FROM cv_scores",
        "io_once": "SELECT 1 AS step, 'written' AS status, count(*) AS n_rows FROM cv_scores UNION ALL SELECT 2, 'skipped', count(*) FROM cv_scores UNION ALL SELECT 3, 'written', count(*) FROM cv_scores WHERE score_id % 2 = 0",
        "io_metadata": "SELECT 'fólds' AS name, count(*) AS n FROM cv_scores",
        "io_reports": "SELECT f AS form, fold, count(*) AS n FROM cv_scores, (VALUES ('report'), ('pretty')) t(f) GROUP BY f, fold",
    }
