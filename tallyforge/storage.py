"""Intermediate tables that survive the loss of executors."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: dict[str, str] = {}


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def folder(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``, deleted when it ends.

    Only where the session names none, and runs in one process, is it a temporary one.
    """
    context = spark.sparkContext
    if context.applicationId not in _FOLDERS:
        named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
        if not named and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = named.rstrip("/") if named else "file://" + tempfile.mkdtemp(prefix="tallyforge-kept-")
        _FOLDERS[context.applicationId] = path = f"{base}/tallyforge-kept-{context.applicationId}"
        atexit.register(_delete, spark, path)
    return _FOLDERS[context.applicationId]


def kept(df: DataFrame) -> DataFrame:
    """``df``, computed once, written to the shared folder and read from there."""
    path = f"{folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
