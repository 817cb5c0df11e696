"""Outputs: partitioned tables, upserts, resumable stages, metadata."""

from __future__ import annotations

import json
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stored import kept
from ..operators.decontaminate import upsert
from .tables import _exists


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a whole table stands there."""
    return _exists(spark, f"{path}/_SUCCESS")


def write_tasks(m: DataFrame, path: str) -> None:
    """Measurements and entities by task, and the table of tasks."""
    from ..operators.replicate import entities, task_summary

    for name, df in (("measurements", m), ("entities", entities(m))):
        df.write.mode("overwrite").partitionBy("task").parquet(f"{path}/{name}")
    task_summary(m).write.mode("overwrite").parquet(f"{path}/tasks")


def snapshot(df: DataFrame, path: str) -> DataFrame:
    """df as it is before it is cleaned, once: a table that stands there stays."""
    return stage(df.sparkSession, path, lambda: df)


def store_vectors(wanted: DataFrame, path: str, embed, key: str, revision: str) -> DataFrame:
    """A store of vectors at path, brought up to ``wanted`` ids: only those that it lacks at that revision are embedded, by a function of
    their DataFrame to (key, vector), and appended; a call that was interrupted goes on with what is missing."""
    spark = wanted.sparkSession
    if exists(spark, path):
        wanted = wanted.join(missing_ids(wanted, spark.read.parquet(path), key, revision), key, "left_semi")
    embed(wanted).withColumn("revision", F.lit(revision)).write.mode("append").parquet(path)
    return spark.read.parquet(path).where(F.col("revision") == revision)


def write_registry(df: DataFrame, path: str) -> None:
    """Distinct structures of each source; rows without a full key are told apart by the short one. Sources not in df stay."""
    rows = df.dropDuplicates(["source", "key_full", "key_short"])
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(path)


def merge(spark: SparkSession, path: str, new: DataFrame, key: str, to: str) -> DataFrame:
    """The table at path with its rows of new's keys replaced, written to ``to``, another folder."""
    if path.rstrip("/") == to.rstrip("/"):
        raise ValueError("a table can't be written over while it is read")
    out = upsert(spark.read.parquet(path), new, key) if _exists(spark, path) else new
    out.write.mode("overwrite").parquet(to)
    return spark.read.parquet(to)


def stage(spark: SparkSession, path: str, make) -> DataFrame:
    """The table at path; made and written first where it isn't whole."""
    if not exists(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def missing_ids(wanted: DataFrame, store: DataFrame, key: str, revision: str) -> DataFrame:
    """Ids that a store of vectors lacks at that revision."""
    return wanted.select(key).distinct().join(store.where(F.col("revision") == revision), key, "left_anti")


def pilot(m: DataFrame, meta: DataFrame, tasks: list[str]) -> tuple[DataFrame, DataFrame]:
    """Measurements of some tasks, and their summary with what meta knows of them; all are admitted."""
    from ..operators.replicate import task_summary

    part = m.where(F.col("task").isin(*tasks))
    return part, task_summary(part).drop("target", "type", "passes").join(meta, "task", "left").withColumn("passes", F.lit(True))


#: The keys and types of the public dataset description, version 1.0.
_JSON_TYPES = {"string": "sc:Text", "double": "sc:Float", "float": "sc:Float", "int": "sc:Integer", "bigint": "sc:Integer", "boolean": "sc:Boolean", "date": "sc:Date"}
CONTEXT = {"@vocab": "https://schema.org/", "sc": "https://schema.org/", "cr": "http://mlcommons.org/croissant/", "dct": "http://purl.org/dc/terms/", "conformsTo": "dct:conformsTo"}
CONFORMS_TO = "http://mlcommons.org/croissant/1.0"


def digest(path: str) -> str:
    """md5 of a file's bytes, read a block at a time."""
    import hashlib

    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else os.path.abspath(path))
    out = hashlib.md5(usedforsecurity=False)
    with system.open_input_stream(root) as f:
        while block := f.read(1 << 22):
            out.update(block)
    return out.hexdigest()


def metadata(name: str, tables: dict[str, DataFrame], base_url: str, digests: dict[str, str] | None = None) -> str:
    """JSON-LD that describes each table's files and fields; the md5 of each of its files, where digests isn't given."""
    files, sets = [], []
    for t, df in tables.items():
        parts = {} if digests else {p.rsplit("/", 1)[-1]: digest(p) for p in sorted(df.inputFiles())}
        for k, (part, md5) in enumerate((parts or {"": (digests or {}).get(t)}).items()):
            files.append({"@type": "cr:FileObject", "@id": t if k == 0 else f"{t}/{k}", "contentUrl": f"{base_url}/{t}/{part}".rstrip("/"), "encodingFormat": "application/x-parquet", "md5": md5})
        fields = [{"@type": "cr:Field", "@id": f"{t}/{c}", "name": c, "dataType": _JSON_TYPES.get(k, "sc:Text"), "source": {"fileObject": {"@id": t}, "extract": {"column": c}}} for c, k in df.dtypes]
        sets.append({"@type": "cr:RecordSet", "@id": f"{t}_records", "field": fields})
    return json.dumps({"@context": CONTEXT, "@type": "sc:Dataset", "conformsTo": CONFORMS_TO, "name": name, "distribution": files, "recordSet": sets}, indent=1)
