"""Cuts of lineage for work that goes on in rounds."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder that driver and executors share, and read from it.

    The folder is the session's spark.checkpoint.dir, or the context's. Only in local mode a temporary one takes its place where neither is set.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir must name a shared folder on {context.master}")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="pagewright-"))
    return df.checkpoint()
