"""The registered queries on the smallest tables, whole."""

import glob
import os
import zlib

import numpy as np
import pytest

from plumbline.llm import queries
from plumbline.llm.packing import lower_bound

from .test_simhash import brute_components, brute_fingerprint
from .test_text_operators import brute_contaminated

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def tables(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(spark, sf, tables, name):
    got = queries.QUERIES[name](spark, sf).toPandas()
    expect = tables.execute(queries.ORACLE[name]).df()[list(got.columns)]
    key = lambda d: sorted(map(str, d.astype(object).where(d.notna(), None).itertuples(index=False, name=None)))
    assert key(got) == key(expect) and len(got)


def test_simhash(spark, sf, tables):
    fps = {i: brute_fingerprint(t) for i, t in tables.execute("SELECT doc_id, text FROM documents").fetchall()}
    got = queries.op1_simhash(spark, sf).collect()
    assert {r.doc_id: r.component_id for r in got} == brute_components(fps) and len(got) == len(fps)


def test_decontam(spark, sf, tables):
    texts, items = (dict(tables.execute(f"SELECT * FROM (SELECT {k}, text FROM {t})").fetchall()) for k, t in (("doc_id", "documents"), ("item_id", "benchmark")))
    got = {(r.doc_id, r.item_id, r.windows, r.item_windows, r.aligned) for r in queries.op5_decontam(spark, sf).collect()}
    assert got == brute_contaminated(texts, items) and got


def test_tokens_and_packing(spark, sf, tables):
    from plumbline.llm.tokens import encoder

    encode = lambda t: np.array([*encoder().tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
    ids = {i: encode(t) for i, t in tables.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()}
    got, start = {r.doc_id: r for r in queries.op9_tokenids(spark, sf).collect()}, 0
    for i in sorted(ids):
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids[i]), zlib.crc32(ids[i].tobytes()))
        start += len(ids[i])
    rows = queries.op10_packing(spark, sf).collect()
    assert sum(r.length for r in rows) == start
    assert all(zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in rows)
    assert len({r.sequence_id for r in rows}) <= lower_bound(np.array([r.length for r in rows])) + 2


@pytest.mark.parametrize("name,label,fold,rest", [("op2_toxicity", "toxic", 5, 0), ("op7_quality", "quality", 3, 1)])
def test_classifiers(spark, sf, tables, name, label, fold, rest):
    rows = queries.QUERIES[name](spark, sf).collect()
    n = tables.execute("SELECT count(*) FROM documents").fetchall()[0][0]
    assert len(rows) == n and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % fold == rest) for r in rows)
    truth = dict(tables.execute(f"SELECT doc_id, {label} FROM labels").fetchall())
    held = [r.predicted == truth[r.doc_id] for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean(held) > 0.75


def test_others_return_every_row(spark, sf, tables):
    n = tables.execute("SELECT count(*) FROM documents").fetchall()[0][0]
    for name in ("op3_pii", "op8_sharding"):
        assert queries.QUERIES[name](spark, sf).count() == n
