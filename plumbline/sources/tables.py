"""The engine's inputs as views of the star schema's tables, and readers for its own files."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stored import hadoop

MEASUREMENTS = "task string, target string, type string, mol_id string, structure string, doc_id string, assay_id string, year int, y double"
RAW = (
    "target_id string, target_name string, molecule_id string, structure string, standard_type string, value double, "
    "assay_id string, doc_id string, doc_year int, validity_comment string"
)
REGISTRY = "key_short string, key_full string, structure string, source string, url string, downloaded date"
PREDICTION_KEYS = ("task", "split", "seed", "model", "mol_id", "pred")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of files whose rows one task takes where rows are dealt by their number: about half a million line items.
DEALT = 8 << 20


def dealt(df: DataFrame, key: str) -> DataFrame:
    """df dealt by key to so many tasks that one's rows stay as many however large the files are; at least as many as Spark would take."""
    size = 0
    for file in df.inputFiles():
        system, at = hadoop(df.sparkSession, file)
        size += system.getFileStatus(at).getLen()
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // DEALT)), key)


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """task, target, type, mol_id, structure, doc_id, assay_id, year, y: a measurement for each line item."""
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    place = (
        table(spark, sf_dir, "supplier")
        .join(F.broadcast(table(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("s_suppkey", "r_name")
    )
    rows = line.join(part, F.col("l_partkey") == F.col("p_partkey")).join(place, F.col("l_suppkey") == F.col("s_suppkey"))
    kind = F.when(F.col("l_linestatus") == "F", "IC50").otherwise("Ki")
    return rows.select(
        F.concat_ws("_", "r_name", kind).alias("task"), F.col("r_name").alias("target"), kind.alias("type"),
        F.col("l_partkey").alias("mol_id"), F.concat_ws(" ", "p_brand", "p_type").alias("structure"), F.col("l_suppkey").alias("doc_id"),
        F.col("l_orderkey").alias("assay_id"), F.year("l_shipdate").alias("year"),
        (F.lit(4.0) + F.col("p_size") / F.lit(25.0) + F.log10("l_extendedprice") / F.lit(2.0)).alias("y"),
    )


WORDS = r"[\p{L}\p{M}\p{N}]+"


def words_of(text: str):
    """Runs of letters, marks and digits of any script, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORDS), F.lit(0))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, key_full, key_short, words, in_registry: documents with an exact and an order-free key; a text without words has
    no order-free key and matches nothing by it."""
    rows = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    rows = rows.select("doc_id", "source", F.md5("text").alias("key_full"), words_of("text").alias("words"))
    short = F.when(F.size("words") > 0, F.md5(F.array_join(F.array_sort(F.array_distinct("words")), " ")))
    return rows.select("doc_id", "source", "key_full", short.alias("key_short"), "words", F.col("source").isin("src0", "src1", "src2", "src3").alias("in_registry"))


def cutoffs(spark: SparkSession, rows=None, today: str = "2001-06-30") -> DataFrame:
    """model, cutoff, basis, cut_year: a model's training cut-off, else its paper's date, else today."""
    rows = rows or [("alpha", "1998-03-01", None, "src0;src1"), ("beta", None, "1999-11-15", "src2"), ("gamma", None, None, None)]
    df = spark.createDataFrame(rows, "model string, training string, paper string, sources string")
    cut = F.coalesce(F.to_date("training"), F.to_date("paper"), F.to_date(F.lit(today)))
    basis = F.when(F.col("training").isNotNull(), "training_cutoff").when(F.col("paper").isNotNull(), "paper_date").otherwise("today")
    return df.select("model", cut.alias("cutoff"), basis.alias("basis"), F.year(cut).alias("cut_year"), F.split("sources", ";").alias("sources"))


def cutoffs_file(spark: SparkSession, path: str, today: str) -> DataFrame:
    """The same from a YAML file: models, each with training_cutoff, paper_date and registry_sources, any of them null or absent."""
    import yaml

    with open(path) as f:
        models = yaml.safe_load(f).get("models") or {}
    day = lambda x: None if x is None else str(x)
    return cutoffs(spark, [(k, day(v.get("training_cutoff")), day(v.get("paper_date")), ";".join(v.get("registry_sources") or []) or None) for k, v in models.items()], today)


def csv(spark: SparkSession, path: str, schema: str, sep: str | None = None, stem: str | None = None) -> DataFrame:
    """CSV files, plain or gzipped, by a fixed schema; ``sep`` is found from the first line where it isn't given. Empty files have no
    rows. With ``stem``, a column of that name holds each row's file name up to its first dot."""
    if sep is None:
        first = spark.read.text(path).limit(1).collect()
        line = first[0].value if first else ""
        sep = "\t" if line.count("\t") > line.count(",") else ","
    df = spark.read.schema(schema).option("header", True).option("sep", sep).csv(path)
    return df.withColumn(stem, F.substring_index(F.col("_metadata.file_name"), ".", 1)) if stem else df


#: Names of a structure column, the first that is there counts.
STRUCTURE_COLUMNS = ("smiles", "mol", "drug", "x", "canonical_smiles", "mol_smiles", "smiles_text")


def structure_column(columns, names=(*STRUCTURE_COLUMNS, "structure", "molecule", "text")) -> str:
    """The first of ``names`` that the columns have, whatever their case."""
    lower = {c.lower(): c for c in columns}
    for n in names:
        if n in lower:
            return lower[n]
    raise ValueError(f"no structure column among {list(columns)}")


def _exists(spark: SparkSession, path: str) -> bool:
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else os.path.abspath(path))
    return system.get_file_info(root).type != fs.FileType.NotFound


def registry(spark: SparkSession, path: str, sources=None) -> DataFrame:
    """The registry's files, partitioned by source; a folder that isn't there gives an empty table of its schema."""
    df = spark.read.schema(REGISTRY).parquet(path) if _exists(spark, path) else spark.createDataFrame([], REGISTRY)
    return df.where(F.col("source").isin(*sources)) if sources else df


def paired(measurements: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables of the tasks that have both: a task's entities count only where its measurements are there."""
    tasks = measurements.select("task").distinct()
    kept = entities.join(tasks, "task", "left_semi")
    return measurements.join(kept.select("task").distinct(), "task", "left_semi"), kept


def shards(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One table of Parquet tables whose columns may differ; what one lacks is null."""
    from functools import reduce

    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (spark.read.parquet(p) for p in paths))


def predictions(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet table at path, else the CSV file of that name or with .csv for .parquet; None where neither is there. Every required
    column must be there."""
    plain = path.removesuffix(".parquet") + ".csv"
    if _exists(spark, path) and not path.endswith((".csv", ".csv.gz")):
        df = spark.read.parquet(path)
    elif found := next((p for p in (path, plain, f"{plain}.gz") if p.endswith((".csv", ".csv.gz")) and _exists(spark, p)), None):
        df = spark.read.option("header", True).option("inferSchema", True).csv(found)
    else:
        return None
    missing = [c for c in PREDICTION_KEYS if c not in df.columns]
    if missing:
        raise ValueError(f"predictions lack {missing}")
    return df
