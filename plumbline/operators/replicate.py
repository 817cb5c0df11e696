"""Noise from replicates: one value for each entity and document, an entity's spread over documents, ceilings for each task.

Everything is a sum that partial aggregation reduces before each of three exchanges (document, entity, task); a skewed task or
entity costs no more than its partial sums.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.safe import clip, ratio

GRID = tuple((d, r) for d in (2, 3) for r in (None, 0.6, 0.4, 0.2))


def doc_level(m: DataFrame) -> DataFrame:
    """Mean of an entity's values in each document. Rows without a key or value have no part."""
    return m.where("mol_id IS NOT NULL AND doc_id IS NOT NULL AND y IS NOT NULL AND NOT isnan(y)").groupBy("task", "mol_id", "doc_id").agg(F.avg("y").alias("y"))


def entity_stats(docs: DataFrame) -> DataFrame:
    """n documents, mean of their means, within sum of squares and range of each entity."""
    return docs.groupBy("task", "mol_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean"), (F.var_pop("y") * F.count(F.lit(1))).alias("ss"), (F.max("y") - F.min("y")).alias("range")
    )


def entities(m: DataFrame) -> DataFrame:
    """mol_id, y (mean of document means), n_docs, first_year, structure for each entity of a task; the structure of the earliest
    measurement, by document and assay where years tie."""
    first = F.min(F.struct(F.coalesce("year", F.lit(9999)).alias("year"), "doc_id", "assay_id", "structure"))
    rows = m.where("mol_id IS NOT NULL AND doc_id IS NOT NULL AND y IS NOT NULL AND NOT isnan(y)")
    by_doc = rows.groupBy("task", "mol_id", "doc_id").agg(F.avg("y").alias("y"), F.min("year").alias("year"), first.alias("first"))
    return by_doc.groupBy("task", "mol_id").agg(
        F.avg("y").alias("y"), F.count(F.lit(1)).alias("n_docs"), F.min("year").alias("first_year"), F.min("first")["structure"].alias("structure")
    )


def _ceiling_columns(df: DataFrame, k) -> DataFrame:
    df = df.withColumn("s2", ratio("ss", "dof")).withColumn("k", k)
    floor = F.sqrt(F.col("s2") * F.col("k"))
    return df.withColumns(
        {
            "sigma": F.sqrt("s2"),
            "rmse_floor": floor,
            "r2_max": clip(1 - ratio(F.col("s2") * F.col("k"), "var_y"), 0.0, 1.0),
            "mae_floor": floor * math.sqrt(2 / math.pi),
        }
    )


CEILING = ("n_mols_rep", "n_meas_rep", "sigma", "var_y", "rmse_floor", "r2_max", "mae_floor")


def _reduce(stats: DataFrame, keep, *by: str) -> DataFrame:
    return stats.groupBy(*by).agg(
        F.count_if(keep).alias("n_mols_rep"), F.coalesce(F.sum(F.when(keep, F.col("n"))), F.lit(0)).alias("n_meas_rep"),
        F.sum(F.when(keep, F.col("ss"))).alias("ss"), F.sum(F.when(keep, F.col("n") - 1)).alias("dof"),
        F.var_samp("mean").alias("var_y"), F.avg(1 / F.col("n")).alias("inv_docs"),
    )


def ceilings(m: DataFrame, min_docs: int = 2, max_range: float | None = 3.0) -> DataFrame:
    """A task's pooled noise and what it leaves attainable where labels are means over documents. A task without replicates has
    null noise, and keeps its row."""
    keep = (F.col("n") >= min_docs) & (F.lit(True) if max_range is None else F.col("range") <= max_range)
    return _ceiling_columns(_reduce(entity_stats(doc_level(m)), keep, "task"), F.col("inv_docs")).select("task", *CEILING)


def single_label_ceilings(m: DataFrame, min_docs: int = 2, max_range: float = 3.0) -> DataFrame:
    """The same where a label is a single document's value: no averaging, and the variance is over documents' values."""
    docs = doc_level(m)
    keep = (F.col("n") >= min_docs) & (F.col("range") <= max_range)
    spread = docs.groupBy("task").agg(F.var_samp("y").alias("var_y"))
    return _ceiling_columns(_reduce(entity_stats(docs), keep, "task").drop("var_y").join(spread, "task"), F.lit(1.0)).select("task", *CEILING)


def sensitivity(m: DataFrame, grid=GRID) -> DataFrame:
    """Ceilings for every (least documents, largest range) of the grid in one pass over the entities."""
    cells = F.array(*[F.struct(F.lit(d).alias("min_docs"), F.lit(r).cast("double").alias("max_range")) for d, r in grid])
    rows = entity_stats(doc_level(m)).select("*", F.explode(cells).alias("cell")).select("*", "cell.*")
    keep = (F.col("n") >= F.col("min_docs")) & (F.col("max_range").isNull() | (F.col("range") <= F.col("max_range")))
    return _ceiling_columns(_reduce(rows, keep, "task", "min_docs", "max_range"), F.col("inv_docs")).select("task", "min_docs", "max_range", *CEILING)


def label_noise_factor(m: DataFrame) -> DataFrame:
    return entity_stats(doc_level(m)).groupBy("task").agg(F.avg(1 / F.col("n")).alias("inv_docs"))


def task_summary(m: DataFrame, least: int = 100) -> DataFrame:
    """Entities, replicated ones and documents of each task, and whether it is admitted."""
    docs = doc_level(m)
    counts = docs.groupBy("task", "mol_id").agg(F.count(F.lit(1)).alias("n")).groupBy("task").agg(F.count(F.lit(1)).alias("n_mols"), F.count_if(F.col("n") >= 2).alias("n_rep_mols"))
    sources = docs.groupBy("task").agg(F.count_distinct("doc_id").alias("n_docs"))
    out = counts.join(sources, "task").withColumn("passes", F.col("n_rep_mols") >= least)
    return out.select("task", F.regexp_extract("task", "^(.*)_([^_]*)$", 1).alias("target"), F.regexp_extract("task", "^(.*)_([^_]*)$", 2).alias("type"), "n_mols", "n_rep_mols", "n_docs", "passes")


def replicate_windows(docs: DataFrame) -> DataFrame:
    """Each document's value beside its entity's count, range, deviation and mean of the others."""
    from pyspark.sql import Window

    w = Window.partitionBy("task", "mol_id")
    n = F.count(F.lit(1)).over(w)
    return docs.select(
        "task", "mol_id", "doc_id", "y", n.alias("n"), (F.max("y").over(w) - F.min("y").over(w)).alias("range"),
        (F.col("y") - F.avg("y").over(w)).alias("deviation"), F.when(n > 1, (F.sum("y").over(w) - F.col("y")) / (n - 1)).alias("others"),
    )
