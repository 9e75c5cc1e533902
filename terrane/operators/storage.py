"""Results that are written down between stages, so that plans stay small."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or where it is unset the context's folder.

    Where there is neither, a temporary one is made if the master is local; on a
    cluster no folder of one machine will do.
    """
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='terrane-')}")
    return sc.getCheckpointDir().rstrip("/")


def settled(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: what follows neither plans nor computes it again."""
    path = f"{shared_folder(df.sparkSession)}/terrane/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
