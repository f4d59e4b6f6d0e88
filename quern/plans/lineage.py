"""Cutting lineage through the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session, which the cluster names in ``spark.checkpoint.dir``. Where it is unset, a
    session whose executors are this very process (master ``local``) gets a temporary folder; any other raises, as a
    folder of one machine can't be read by the others."""
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="quern-checkpoint-")
    spark.sparkContext.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder (survives the loss of executors)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of a few numbers each up to which a table is broadcast: 8 to 24 MB as it is sent.
BROADCAST_ROWS = 1_000_000


def checked_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, whose columns are all of fixed width, with a broadcast hint if it has at most ``limit`` rows, so that
    its bytes are bounded; else ``df`` itself, and the join shuffles. The count stops after ``limit`` + 1 rows."""
    wide = [f.name for f in df.schema if f.dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean", "date", "timestamp")]
    if wide:
        raise ValueError(f"columns without a fixed width: {wide}")
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df
