"""Shared folders, written tables and table access of the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import uuid
from contextlib import contextmanager
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
#: Bytes of rows that go to a Python worker at once while a table is written: texts are in memory several times there, as Arrow,
#: as Python's strings and as what is made of them. A longer text goes alone.
BATCH_BYTES = 4 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free(name: str, *frames: DataFrame) -> str:
    """name, longer by underscores until no column of the frames is called so."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


_made: list[list[str]] = []


def _hadoop(spark: SparkSession, path: str):
    """The Hadoop file system of path, and its path there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def shared_dir(spark: SparkSession) -> str:
    """A new folder in the one that the cluster names in spark.checkpoint.dir. A temporary one stands in only where that is unset
    and driver and executors are one process; a cluster without it is an error, since its executors share no local folder."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="plumbline-")
        spark.sparkContext.setCheckpointDir(base)
    # as Hadoop names it in full: a path without a scheme is another thing to Spark than to a task's own file access
    system, at = _hadoop(spark, base)
    path = f"{system.makeQualified(at).toString().rstrip('/')}/plumbline-{uuid.uuid4().hex}"
    if _made:
        _made[-1].append(path)
    return path


def remove(paths: list[str]) -> None:
    for path in paths:
        system, at = _hadoop(SparkSession.active(), path)
        system.delete(at, True)


@contextmanager
def scratch():
    """Folders made inside are removed at the end: for work whose result has been written elsewhere by then."""
    _made.append([])
    try:
        yield
    finally:
        remove(_made.pop())


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: lineage ends here, lost executors cost no more than
    their running tasks, and the planner knows the table's size."""
    return written_at(df, f"{shared_dir(df.sparkSession)}/{name}")


def written_at(df: DataFrame, path: str) -> DataFrame:
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession):
    """Inside, Arrow batches hold ``BATCH_BYTES`` at most, or what the session allows where that is less; its setting is put back."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before)
    spark.conf.set(key, f"{min(BATCH_BYTES, now)}b")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def give_back() -> None:
    """Returns to the system what this process has freed. Workers live through many stages; what the allocators keep of one stage's peak
    would stand beside the next one's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None
    if trim:
        trim(0)


def lean(task):
    """A task over an iterator of batches, after which its worker gives back memory; the task's own variables are gone by then."""

    @wraps(task)
    def run(batches):
        yield from task(batches)
        give_back()

    return run


def doc_crc(column: str = "doc_id"):
    """crc32 of an id's decimal text, as the fold rules use it."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def teaching(labels: DataFrame, target: str, allowed) -> DataFrame:
    """(doc_id, y) of the labelled ids that ``allowed`` admits. Label rows with a null id or label, and ids with labels that
    disagree, teach nothing; repeated rows count once."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(target).isin(0, 1) & allowed)
    return rows.groupBy("doc_id").agg(F.min(target).alias("y"), F.max(target).alias("y2")).where("y = y2").select("doc_id", F.col("y").cast("int").alias("y"))
