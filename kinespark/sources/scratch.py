"""Lineage cuts in the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint, in the session's spark.checkpoint.dir; a
    folder in /tmp only where a session on one machine names none. For small tables that later
    steps read more than once."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return df.checkpoint()
