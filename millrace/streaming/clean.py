"""Optional streaming form of the preprocessing: JSON lines as they arrive, cleaned, gated and without exact copies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.operators import gates

SCHEMA = "id string, source string, winner_prompt string, response_of_winner_prompt string, added_constraint map<string,array<string>>, added_constraint_num int, prompt_lang string, created_at timestamp"


def source(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(path)


def cleaned(rows: DataFrame, lateness: str = "30 days") -> DataFrame:
    """Kept records of a stream; a copy of a prompt within the watermark is dropped, so that the state stays bounded."""
    clean = rows.withColumns({"prompt": F.coalesce(X.clean_text(F.col("winner_prompt")), F.lit("")), "response": F.coalesce(X.clean_text(F.col("response_of_winner_prompt")), F.lit(""))})
    reason = gates.skip_reason(F.col("prompt"), F.col("response"), F.lit(None).cast("string"), F.col("added_constraint"), F.col("added_constraint_num"))
    live = clean.withColumn("skip_reason", reason).where("skip_reason IS NULL").withColumn("fp", X.fingerprint(X.remove_stopwords(F.col("prompt"))))
    return live.withWatermark("created_at", lateness).dropDuplicatesWithinWatermark(["fp"]).select("id", "source", "prompt", "response", "created_at")


def skip_counts(rows: DataFrame, lateness: str = "1 day", window: str = "1 day") -> DataFrame:
    """Reasons per day of creation, late rows within the watermark included."""
    clean = rows.withColumns({"prompt": F.coalesce(X.clean_text(F.col("winner_prompt")), F.lit("")), "response": F.coalesce(X.clean_text(F.col("response_of_winner_prompt")), F.lit(""))})
    reason = gates.skip_reason(F.col("prompt"), F.col("response"), F.lit(None).cast("string"), F.col("added_constraint"), F.col("added_constraint_num"))
    return clean.withColumn("skip_reason", F.coalesce(reason, F.lit("kept"))).withWatermark("created_at", lateness).groupBy(F.window("created_at", window), "skip_reason").count()


def write(rows: DataFrame, path: str, checkpoint: str):
    """Append to JSON lines exactly once; the checkpoint folder must be shared by the cluster."""
    return rows.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
