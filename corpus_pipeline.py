"""A corpus in five stages, each written as Parquet and read again by the next: toxic documents go, one document of each group
of near-duplicates stays, contaminated documents go, personal data is masked, and what is left is packed into sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import decontam, packing, pii, simhash, toxicity
from plumbline.llm.common import free, read, remove, scratch, shared_dir, written_at


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under 0.5, by a model of the labelled documents among docs; null and empty texts stay."""
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    score, toxic = free("__score", docs), free("__toxic", docs)
    return toxicity.scored(docs, model, score, toxic).where(F.col(toxic) == 0).drop(score, toxic)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each component of near-duplicates."""
    return simhash.deduplicated(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.cleaned(docs, read(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its personal data masked and n_chars counted anew."""
    return pii.redacted(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece, with its sequence and place."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("simhash near-dedup", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: Trained models, XXH64 and a tokenizer are beyond SQL; tests/llm/test_pipeline.py runs the stages against plain ones.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage wrote on its way goes once its own table is written, and that once the next one's is."""
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = shared_dir(spark)
        with scratch():
            docs = written_at(stage(spark, docs, sf_dir), f"{path}/{name.replace(' ', '_')}")
        if before:
            remove([before])
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
