"""Durable intermediate tables in the folder that all executors share.

Lineage of iterative jobs is cut by writing Parquet below ``spark.checkpoint.dir``, which survives
the loss of any executor. Only where that setting is absent (unit tests in local mode) is a folder
of our own used.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIRS: dict[str, str] = {}
_ROOTS: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by the session; a temporary one only in local mode without it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    set_dir = context.getCheckpointDir()
    if set_dir:
        return set_dir.rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    key = context.applicationId
    if key not in _LOCAL_DIRS:
        _LOCAL_DIRS[key] = "file://" + tempfile.mkdtemp(prefix="tallyforge-")
    return _LOCAL_DIRS[key]


def _root(spark: SparkSession) -> str:
    root = f"{shared_dir(spark)}/tallyforge-{spark.sparkContext.applicationId}"
    if root not in _ROOTS:
        _ROOTS[root] = spark
        atexit.register(_remove_quietly, spark, root)
    return root


def _remove_quietly(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # the session may already be stopped at exit; nothing can be removed then
        return


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path through the Hadoop file system that owns it."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Tables written for one operator call.

    ``keep`` writes a frame and rereads it. ``drop`` deletes a table that later tables have
    superseded. Tables that the returned lazy plan still reads stay until the application ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.count = 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.base}/{self.count}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def keep_bucketed(self, df: DataFrame, key: str) -> DataFrame:
        """``keep`` in as many buckets of ``key`` as a shuffle has partitions, one file each.

        Joins on ``key`` leave this side in place.
        """
        self.count += 1
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        name = f"tallyforge_{uuid.uuid4().hex}"
        path = f"{self.base}/{self.count}"
        writer = df.repartition(n, key).write.bucketBy(n, key).format("parquet").option("path", path)
        writer.saveAsTable(name)
        return self.spark.table(name)

    def drop(self, df: DataFrame) -> None:
        remove(self.spark, df._scratch_path)
