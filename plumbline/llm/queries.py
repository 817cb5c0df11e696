"""The operators' queries with their production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from . import decontam, graphs, packing, periodic, pii, quality, sharding, simhash, tokenids, topk, toxicity, urlfilter, variants
from .common import read


def op1_simhash(spark, sf_dir):
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op2_toxicity(spark, sf_dir):
    return toxicity.classified(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_pii(spark, sf_dir):
    return pii.digest(read(spark, sf_dir, "documents"))


def op4_urlfilter(spark, sf_dir):
    return urlfilter.judge(read(spark, sf_dir, "pages"), urlfilter.entries(spark))


def op5_decontam(spark, sf_dir):
    return decontam.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op6_topk(spark, sf_dir):
    return topk.nearest(read(spark, sf_dir, "embeddings"))


def op7_quality(spark, sf_dir):
    return quality.classified(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_sharding(spark, sf_dir):
    return sharding.shard(read(spark, sf_dir, "documents"))


def op9_tokenids(spark, sf_dir):
    return tokenids.round_trip(read(spark, sf_dir, "documents"))


def op10_packing(spark, sf_dir):
    return packing.pack(read(spark, sf_dir, "documents"))


def op11_periodic(spark, sf_dir):
    return periodic.digest(read(spark, sf_dir, "documents"))


def op12_variants(spark, sf_dir):
    return variants.grouped(read(spark, sf_dir, "documents"))


def op13_neighbours(spark, sf_dir):
    return graphs.nearest(read(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash, op2_toxicity, op3_pii, op4_urlfilter, op5_decontam, op6_topk, op7_quality, op8_sharding, op9_tokenids, op10_packing, op11_periodic, op12_variants,
        op13_neighbours,
    )
}
ORACLE = {"op4_urlfilter": urlfilter.ORACLE, "op6_topk": topk.ORACLE}
