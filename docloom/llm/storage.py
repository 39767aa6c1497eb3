"""Cutting lineage in storage that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def materialise(df: DataFrame) -> DataFrame:
    """``df``, computed once and reread from the session's checkpoint folder.

    The folder is ``spark.checkpoint.dir`` of the session.  Only where that is unset
    and nothing else has set one, and all executors are on this machine, as in local
    tests, a temporary folder is taken; on a cluster that is an error.
    """
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="docloom-"))
    return df.checkpoint(eager=True)


def read(spark, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
