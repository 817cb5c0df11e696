import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from pyspark.sql import functions as F

from plumbline.llm import sharding, topk, urlfilter


def test_urls_match_brute_force(spark):
    urls = [None, "", "nothing", "http://COM/", "http://a.com", "http://a.com/x", "https://Example.com/en/1?q#f", "http://x.www.example.com/en/", "http://www.example.com/EN/", "ftp://b.net/es/1", "http://b.net/fr",
            "http://casino-win.example.org/", "http://m.free-bets.example.net/de/", "http://notcasino-win.example.org/", "a://b://c.com/d", "http://..com/", "http:///com/", "http://" + "a." * 3000 + "net/es/" + "y" * 5000,
            "http://me@free-bets.example.net:8080/x", "http://CHEAP-pills.example.com.", "http://cheap-pills.example.com?q", "http://com:80/", "http://a.com./"]
    rows = [(i % 15, u) for i, u in enumerate(urls)] + [(None, "http://a.com/x")]
    pages = spark.createDataFrame([(i, u, "h", "h2") for i, u in rows], "page_id long, url string, html string, host string")

    def brute(url):
        rest = url[url.index("://") + 3 :] if url and "://" in url else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]

        plain = re.sub(r"\.+$", "", re.sub(r":[0-9]*$", "", host.rpartition("@")[2]))

        def fits(entry, host=host):
            h, p = entry.split("/", 1)
            return (host == h or host.endswith("." + h)) and path.startswith("/" + p)

        best = max((e for e, _ in urlfilter.RULES if fits(e)), key=len, default=None)
        hit = any(plain == h or plain.endswith("." + h) for h in (x.split("/")[2] for x in urlfilter.LISTED))
        verdict = dict(urlfilter.RULES)[best] if best else "block" if hit else "allow"
        return host, path, best, verdict

    expect = sorted(((i, *brute(u)) for i, u in rows), key=str)
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(pages.drop("host"), urlfilter.entries(spark)).collect()]
    assert sorted(got, key=str) == expect
    renamed = pages.select(urlfilter.host_and_path(F.col("html"))[0].alias("h"), "page_id")  # any column will do
    assert {r.h for r in renamed.collect()} == {""}
    t = pages.drop("host").toPandas()
    import duckdb

    assert sorted(duckdb.sql(urlfilter.ORACLE.replace("FROM pages", "FROM t")).fetchall(), key=str) == expect and len(t) == len(rows)
    assert urlfilter.judge(pages.drop("host").limit(0), urlfilter.entries(spark)).collect() == []


def test_many_listed_entries_and_false_positives(spark, monkeypatch):
    monkeypatch.setattr(urlfilter, "MAX_BLOCKS", 2)  # a full filter lets everything through
    listed = spark.createDataFrame([(f"{'https://' * (i % 2)}H{i}.org{':80' * (i % 3 == 1)}/p{i}/?q",) for i in range(300)] + [(None,), ("",)], "url string")
    pages = spark.createDataFrame([(i, f"http://s.h{i}.org/p{i + i % 2}/x") for i in range(300)], "page_id long, url string")
    got = urlfilter.judge(pages, urlfilter.entries(spark, (), listed)).collect()
    assert {r.page_id for r in got if r.verdict == "block"} == {i for i in range(300) if i % 2 == 0}


def test_shards(spark, docs):
    rng = random.Random(6)
    texts = [None, "", "same text " * 30] + ["same text " * 30] * 400 + ["é" * rng.randrange(1, 900) for _ in range(700)]
    df = docs(texts).selectExpr("*", "1 AS key", "2 AS cell")
    rows = sharding.shard(df).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    size = {}
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        size.setdefault(r.shard, []).append(r)
    assert set(size) == set(range(8))
    total = [sum(r["size"] for r in rs) for rs in size.values()]
    assert max(total) - min(total) <= 2 * max(r["size"] for r in rows) + 4 * sharding.TOLERANCE * sum(total) / 8
    for rs in size.values():
        assert sorted(r.slot for r in rs) == list(range(len(rs)))
    again = sharding.shard(df.repartition(7)).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, again), key=str)


def test_shards_of_repeats_and_of_nothing(spark, docs):
    for ids in ([1] * 4000, [None] * 4000, [*range(2000), *[7] * 2000]):
        df = docs(["some text of a copy"] * 4000, ids).repartition(5)
        rows = sharding.shard(df).collect()
        assert len(rows) == 4000 and len({(r.shard, r.slot) for r in rows}) == 4000
        n = [sum(r.shard == k for r in rows) for k in range(8)]
        assert max(n) - min(n) <= 4 and all({r.slot for r in rows if r.shard == k} == set(range(n[k])) for k in range(8))
    assert sharding.shard(docs(["t"]).limit(0)).collect() == []
    assert [(r.shard is not None, r.slot) for r in sharding.shard(docs(["t"])).collect()] == [(True, 0)]


def test_shards_are_in_order_of_texts(spark, docs):
    """Against a plain sort: texts with one crc32 don't mix, slots follow the order, and shards are cut where bytes say."""
    one, two = "a02552f76dbdf5fd", "670009b22c087272"
    assert zlib.crc32(one.encode()) == zlib.crc32(two.encode())
    rng = random.Random(8)
    texts = [one, two] * 20 + ["copy " * 9] * 900 + [f"t{i} " * rng.randrange(60) for i in range(600)] + [None, ""]
    df = docs(texts)
    keys = {i: tuple(xxhash.xxh64_intdigest(b, 42) & (2**63 - 1) for b in ((t or "").encode(), i.to_bytes(8, "little"))) for i, t in enumerate(texts)}
    rows = sorted(sharding.shard(df).collect(), key=lambda r: (r.shard, r.slot))
    assert [keys[r.doc_id] for r in rows] == sorted(keys.values())
    order = [texts[r.doc_id] or "" for r in rows]
    assert sum(a != b for a, b in zip(order, order[1:])) == len(set(order)) - 1
    total, largest = sum(r["size"] for r in rows), max(r["size"] for r in rows)
    for k in range(1, 8):
        below = sum(r["size"] for r in rows if r.shard < k)
        assert abs(below - total * k / 8) <= max(largest, sharding.TOLERANCE * total / 8)
    for k in range(8):
        assert [r.slot for r in rows if r.shard == k] == list(range(sum(r.shard == k for r in rows)))


def test_many_cells(docs, monkeypatch):
    monkeypatch.setattr(sharding, "CELL_BYTES", 256)
    df = docs(["copy"] * 1500 + [f"text {i}" for i in range(1500)])
    rows = sharding.shard(df).collect()
    assert len({(r.shard, r.slot) for r in rows}) == 3000
    assert all({r.slot for r in rows if r.shard == k} == set(range(sum(r.shard == k for r in rows))) for k in range(8))


def test_written_shards_hold_every_row(docs, tmp_path):
    df = docs([f"text {i} " * (i % 40) for i in range(300)])
    df = df.selectExpr("*", "'x' AS shard", "1 AS key", "2 AS __cell", "3 AS __place", "4 AS __number")
    out = sharding.write_shards(df, str(tmp_path / "s"))
    assert set(out.columns) == {*df.columns, "slot"}
    assert sorted(r.doc_id for r in out.collect()) == list(range(300)) and out.select("shard").distinct().count() == 8


def test_topk_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 0.1, (900, 16)).astype(np.float32)
    x[50:60] = x[0]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    bad = [(1000, None), (1001, [float("nan")] * 16), (1002, [None] * 16), (1003, [float("inf")] * 16), (None, rows[0][1]), (1100, [1.0, 2.0]), (1101, [0.5, 0.5])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").selectExpr("*", "1 AS label", "2 AS v")
    got = {}
    for r in topk.nearest(df).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    v = np.floor(1024 * np.concatenate((x, x[:1])).astype(np.float64)).astype(np.int64)
    for q in range(0, 900, 100):
        s = v @ v[q]
        order = sorted((i for i in range(901) if i != q), key=lambda i: (-s[i], i))[:10]  # the row without an id is 900 here, last of ties
        assert sorted(got[q]) == [(k + 1, i if i < 900 else None, int(s[i])) for k, i in enumerate(order)]
    assert [g[1] for g in got[1100]] == [1101]
    assert set(got) == set(range(0, 900, 100)) | {1100}
    assert topk.nearest(df.limit(0)).collect() == []


def test_topk_keeps_every_row_of_a_repeated_id(spark):
    rows = [(0, [1.0, 0.0]), (1, [9.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (100, [0.0, 1.0]), (100, [1.0, 1.0]), (100, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.nearest(df).collect())
    v, expect = [(i, np.array(x) * 1024) for i, x in rows], []
    for a, (i, x) in enumerate(v):
        if i % 100 == 0:
            order = sorted(((-int(x @ y), j) for b, (j, y) in enumerate(v) if a != b))
            expect += [(i, k + 1, j, -s) for k, (s, j) in enumerate(order)]
    assert got == sorted(expect) and (0, 1, 1, 9 * 1024 * 1024) in got
    import duckdb

    t = df.toPandas()
    sql = duckdb.sql(topk.ORACLE.replace("FROM embeddings", "FROM t")).fetchall()
    assert sorted(sql) == got and len(t) == 7


def test_topk_of_large_components_is_exact_or_an_error(spark):
    def top(rows):
        return [(r.vec_id, r.score) for r in sorted(topk.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 100).collect(), key=lambda r: r["rank"])]

    a, b = 2.0**17 + 1, 2.0**17 - 1  # products beyond 2 ** 53
    assert top([(0, [a, b]), (1, [a, a]), (3, [a, b + 2**-9])]) == [(1, int(a * 1024) * (int(a * 1024) + int(b * 1024))), (3, int(a * 1024) ** 2 + int(b * 1024) * int((b + 2**-9) * 1024))]
    for bad in (1e30, 1e9):
        with pytest.raises(Exception, match="64 bits"):
            top([(0, [bad, 1.0]), (1, [bad, 2.0])])


def test_topk_with_huge_vectors_beside_others(spark):
    rows = [(0, [1.0, 0.0]), (100, [3e12, 1.0]), (1, [0.0, 1e30]), (2, [-1e30, 0.0])] + [(i, [float(i), 1.0]) for i in range(3, 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in topk.nearest(df, 1000).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    best = [(1, 100, 1024 * 1024 * 3 * 10**12)] + [(k, i, 1024 * 1024 * i) for k, i in enumerate(range(15, 6, -1), 2)]
    assert {q: sorted(v) for q, v in got.items()} == {0: best}
    with pytest.raises(Exception, match="query 0 doesn't fit 64 bits"):
        topk.nearest(df.where("vec_id <> 15"), 1000, 17).collect()


def test_batches_of_queries_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(100 * i, [float(v) for v in r]) for i, r in enumerate(rng.normal(0, 1, (60, 8)))], "vec_id long, embedding array<float>")
    whole = sorted(topk.nearest(df).collect())
    monkeypatch.setattr(topk, "BATCH", 16)
    assert sorted(topk.nearest(df).collect()) == whole and len(whole) == 600


def test_a_block_stops_early_on_proof(monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.integers(-300, 300, (4000, 32))
    x[7] = x[11] = 900
    block, q = topk.Block(np.arange(4000), np.arange(4000), np.ones(4000, bool), x), np.full(32, 50)
    at, scores = block.search(-1, q, 2, None)
    assert {7, 11} <= set(at.tolist()) and len(at) < 4000 and (scores == x[at] @ q).all()
