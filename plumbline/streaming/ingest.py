"""Measurement files as they arrive: each is read once, however often the job starts again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import MEASUREMENTS


def arrivals(spark: SparkSession, path: str, schema: str = MEASUREMENTS) -> DataFrame:
    """A stream of the Parquet files in a folder."""
    return spark.readStream.schema(schema).parquet(path)


def append(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Writes what has arrived since the last call to a table partitioned by task, and returns. Rows without a key or value go."""
    rows = stream.where("mol_id IS NOT NULL AND doc_id IS NOT NULL AND y IS NOT NULL AND NOT isnan(y)")
    query = rows.writeStream.format("parquet").partitionBy("task").option("path", path).option("checkpointLocation", checkpoint)
    query.trigger(availableNow=True).start().awaitTermination()


def running_counts(stream: DataFrame) -> DataFrame:
    """Measurements and mean of each task so far, for a sink in complete or update mode."""
    return stream.groupBy("task").agg(F.count("y").alias("n"), F.avg("y").alias("mean"))
