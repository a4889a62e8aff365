"""Tables computed once in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder inside the one that ``spark.checkpoint.dir`` names.

    Where that is unset, a session in one process takes a temporary folder; on a cluster it is an error.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tarnwell-checkpoint-"))
    return f"{sc._jsc.sc().getCheckpointDir().get()}/engine-{uuid.uuid4().hex}"


def stable(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
