"""Tables that cut lineage: Parquet under the folder in spark.checkpoint.dir, which all executors and the driver share.

A lost executor then costs the tasks that read such a table, not the work before it.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_known: list[str] = []


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset and all runs in one process, as in tests, a temporary folder, set for the
    session. On a cluster without a shared folder it raises."""
    named = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="emberlog-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def reserved(spark: SparkSession) -> str:
    """The path of a new folder in the shared one, which clean() deletes."""
    path = f"{folder(spark)}/emberlog-{uuid.uuid4().hex}"
    _known.append(path)
    return path


def saved(df: DataFrame, *partitioned: str) -> DataFrame:
    """df written once and read back; a folder for each value of the columns in partitioned."""
    path = f"{folder(df.sparkSession)}/emberlog-{uuid.uuid4().hex}"
    df.write.partitionBy(*partitioned).parquet(path)
    _known.append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._emberlog_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    if path in _known:
        _known.remove(path)


def dropped(table: DataFrame) -> None:
    """Deletes a table of saved() that nothing reads any more."""
    path = getattr(table, "_emberlog_path", None)
    if path:
        _delete(table.sparkSession, path)


def clean(spark: SparkSession) -> None:
    """Deletes all tables that saved() has written in this process."""
    for path in list(_known):
        _delete(spark, path)
