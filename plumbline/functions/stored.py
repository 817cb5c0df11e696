"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_folders: dict[str, str] = {}


def hadoop(spark: SparkSession, path: str):
    """The Hadoop file system of path, and its path there: what Spark's readers and writers see."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _release(app: str) -> None:
    spark, folder = SparkSession.getActiveSession(), _folders.pop(app, None)
    if folder and spark and spark.sparkContext.applicationId == app:
        system, at = hadoop(spark, folder)
        system.delete(at, True)


def folder(spark: SparkSession) -> str:
    """One folder for the application in spark.checkpoint.dir, which is removed as the driver's Python ends. Only a session whose
    driver and executors are one process may do without that setting."""
    app = spark.sparkContext.applicationId
    if app not in _folders:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
        if not base:
            if spark.sparkContext.master.split("[")[0] != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            base = tempfile.mkdtemp(prefix="plumbline-")
            spark.sparkContext.setCheckpointDir(base)
        system, at = hadoop(spark, base)
        _folders[app] = f"{system.makeQualified(at).toString().rstrip('/')}/tables-{uuid.uuid4().hex}"
        atexit.register(_release, app)
    return _folders[app]


def kept(df: DataFrame, name: str = "kept") -> DataFrame:
    """df written and read again, where several consumers would each compute it: lineage ends here and a lost executor costs its
    running tasks only."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
