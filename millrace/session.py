"""Session helpers shared by all operators: checkpointing, bounded broadcasts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str, costly: bool = False) -> DataFrame:
    """A table; spread() before work that is ``costly`` by row."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if costly else df


def spread(df: DataFrame) -> DataFrame:
    """A scan (of files or of a checkpoint) that has fewer tasks than there are cores, dealt out to all of them: small inputs
    before work that is costly by row. Larger ones stay as they are, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder of reliable checkpoints: the cluster's own. Where none is set, one beside the warehouse, or a temporary
    one in local mode."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return sc._jsc.sc().getCheckpointDir().get()
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        alone = sc.master.startswith("local[") or sc.master == "local"
        where = tempfile.mkdtemp(prefix="millrace-ckpt-") if alone else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    sc.setCheckpointDir(where)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder; survives lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, max_bytes: int = 32 << 20) -> DataFrame:
    """Broadcast ``df`` only when its rows are proven to hold at most ``max_bytes`` (summed over all of them, by their
    JSON texts); otherwise leave the choice to AQE. The proof is one pass over ``df``: give it a table or a written one."""
    row = F.octet_length(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)))) + F.lit(16)
    return F.broadcast(df) if (df.agg(F.sum(row)).first()[0] or 0) <= max_bytes else df
