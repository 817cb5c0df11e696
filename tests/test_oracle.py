"""Queries against the same in SQL, on the smallest tables."""

import glob
import os

import pytest

import __spark_entry__
from plumbline.plans import catalogue, oracle

duckdb = pytest.importorskip("duckdb")
CHECKED = ("task_ceiling", "ceiling_sensitivity", "audit_summary", "delta_profile", "exact_match_flags", "decontam_funnel", "split_scaffold", "leaderboard", "ceiling_bootstrap_hash", "holm_bh",
           "audit_table", "type_compare", "sigma_from_pairs", "within_doc_pairs", "big_pairs", "max_similarity", "similarity_quantiles", "regression_metrics", "comparison_artifacts",
           "split_temporal", "split_random", "ks_statistic", "value_quantiles", "parse_records")


def rows(frame):
    def cell(x):
        return "null" if x is None or x != x else f"{x:.5f}" if isinstance(x, float) else str(x)

    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple(map(cell, r)) for r in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def connection(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", CHECKED)
def test_query(spark, sf, connection, name):
    assert rows(catalogue.QUERIES[name](spark, sf).toPandas()) == rows(connection.execute(oracle.SQL[name]).df())


def test_every_oracle_has_a_query():
    queries = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(queries) and len(queries) >= 76


def test_entry(spark, sf):
    assert __spark_entry__.entry(spark).count() == 10
