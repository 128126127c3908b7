import json
import zipfile

import pytest
from pyspark.sql import functions as F

from millrace.sources import readers, writers
from millrace.streaming import clean


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_line_numbers_over_blocks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, n in (("a.jsonl", 5000), ("b.jsonl", 700)):
        (tmp_path / "in" / name).write_text("".join(json.dumps({"id": f"{name}{i}"}) + "\n" for i in range(1, n + 1)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        got = readers.fields(readers.json_lines(spark, str(tmp_path / "in")), id="string")
        assert got.where(F.col("id") != F.concat(F.regexp_extract("file", "([ab].jsonl)$", 1), F.col("line_no"))).count() == 0
        assert got.count() == 5700 and got.rdd.getNumPartitions() > 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_blank_and_broken_lines(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_bytes(b'{"id": "a"}\n\n  \n{bad\n{"id": "b\xff"}\n')
    st = readers.parsed(readers.lines(spark, str(p)))
    assert rows(st, "line_no", "status") == [(1, "ok"), (2, "empty_line"), (3, "empty_line"), (4, "json_error"), (5, "ok")]
    assert rows(readers.fields(readers.lenient_lines(spark, str(p)), id="string"), "line_no", "id") == [(1, "a"), (5, "b�")]


@pytest.mark.parametrize("text", ['[{"id": 1}, {"id": 2}]', '{"data": [{"id": 1}, {"id": 2}]}', '{"records": [{"id": 1}, {"id": 2}]}', '{"id": 1}\n\n{"id": 2}\n', '\n [\n{"id": 1},\n{"id": 2}]'])
def test_shapes(spark, tmp_path, text):
    p = tmp_path / "x.json"
    p.write_text(text)
    assert rows(readers.fields(readers.json_records(spark, str(p)), id="int"), "line_no", "id") == [(1, 1), (2, 2)]
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("readme.txt", "no")
        z.writestr("x.jsonl", text)
    assert rows(readers.fields(readers.zipped(spark, str(tmp_path / "x.zip")), id="int"), "id") == [(1,), (2,)]


def test_single_objects_and_values(spark, tmp_path):
    p = tmp_path / "x.json"
    p.write_text('{"a": {"id": 1}, "b": {"id": "2"}}')
    assert rows(readers.fields(readers.json_values(spark, str(p)), id="int"), "id") == [(1,), (2,)]
    assert readers.json_records(spark, str(p)).count() == 1
    pairs = tmp_path / "p.jsonl"
    pairs.write_text('{"input": "q", "output": "a"}\n{"input": "", "instruction": "r", "output": "b"}\n{"input": "s"}\n')
    got = readers.truthy_pairs(readers.json_lines(spark, str(pairs)), ("input", "instruction"), ("output",))
    assert rows(got, "prompt", "response") == [("q", "a"), ("r", "b")]


def test_guards(spark, tmp_path):
    for name, text in (("empty", ""), ("pointer", "version https://git-lfs.github.com/spec/v1\noid sha256:0\nsize 1\n")):
        p = tmp_path / name
        p.write_text(text)
        with pytest.raises(ValueError):
            readers.guard(spark, str(p))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", 1.0), ("a", 0.5)], "id string, score double")
    out = str(tmp_path / "o")
    assert writers.once(df, out) == {"status": "written"} and writers.once(df, out) == {"status": "skipped"}
    assert readers.checkpointed(spark, str(tmp_path / "none"), "id string").count() == 0
    writers.append(df, out)
    assert readers.checkpointed(spark, out, "id string, score double").count() == 4
    writers.csv_with_summary(df, df.agg(F.avg("score").alias("score")), str(tmp_path / "c"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "c").glob("*.csv")))
    assert [x.split(",")[0] for x in text.split() if not x.startswith("id")] == ["a", "b", "SUMMARY"]
    writers.metadata(spark, str(tmp_path / "m"), name="é", n=1)
    assert json.loads(spark.read.text(str(tmp_path / "m")).first()[0]) == {"name": "é", "n": 1}
    writers.by_fold(df.withColumn("fold", F.lit(3)), str(tmp_path / "f"))
    assert (tmp_path / "f" / "fold=3").is_dir()
    assert "score" in writers.report("T", df) and json.loads(writers.pretty(df))[0]["id"] == "b"
    both = readers.csv_glob(spark, [str(tmp_path / "c"), str(tmp_path / "c")])
    assert both.count() == 6


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    text = "Please write a short and friendly note about the old harbour wall near our little town"
    rec = lambda i, p: json.dumps({"id": i, "winner_prompt": p, "response_of_winner_prompt": "ok", "added_constraint": {"a": ["x"]}, "added_constraint_num": 1, "created_at": "2025-01-01T00:00:00Z"})
    (tmp_path / "in" / "1.json").write_text("\n".join([rec("1", text), rec("2", "short"), rec("3", text.upper())]))
    s = clean.cleaned(clean.source(spark, str(tmp_path / "in")))
    clean.write(s, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    (tmp_path / "in" / "2.json").write_text(rec("4", text + "!!"))
    s = clean.cleaned(clean.source(spark, str(tmp_path / "in")))
    clean.write(s, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.json(str(tmp_path / "out"))
    assert got.count() == 2 and got.where("id = '4'").count() == 1
