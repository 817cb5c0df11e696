"""Operators 11 to 13 against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from plumbline.llm import graphs, periodic, queries, variants

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LETTERS = re.compile(r"[A-Za-zÀ-ÿ]+")


def brute_runs(w):
    out = set()
    for p in range(1, len(w) // 4 + 1):
        s = 0
        while s + p < len(w):
            e = s + p
            while e < len(w) and w[e] == w[e - p]:
                e += 1
            if e - s >= max(6, 4 * p) and not any(all(w[k] == w[k + q] for k in range(s, e - q)) for q in range(1, p)):
                out.add((s, e - s, p))
            s = max(s + 1, e - p)  # a stretch that ends at e leaves the next at e - p + 1 or later
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_digest(doc_id, text):
    w, h = WORD.findall(text or ""), None if doc_id is None else zlib.crc32(str(doc_id).encode())
    n = len(w)
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    best = min(runs, key=lambda r: (-r[1] * np.lcm.reduce([x[2] for x in runs]) // r[2], r[0], r[2]), default=(None,) * 3)
    dropped = {i for s, k, p in runs for i in range(s + p, s + k)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    milli = 1000 * best[1] // best[2] if runs else None
    return (doc_id, len(runs), *best, milli, sha("".join(f"{s},{k},{p}\n" for s, k, p in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in dropped)))


def test_runs_of_small_alphabets():
    rng = random.Random(5)
    for _ in range(150):
        texts = []
        for _ in range(rng.randrange(1, 6)):
            w = [rng.choice("aab"[: rng.choice([1, 3])] + "cd" * rng.randrange(2)) for _ in range(rng.randrange(60))]
            if rng.random() < 0.5:
                w += [rng.choice("abcdef") for _ in range(rng.randrange(1, 6))] * rng.randrange(2, 8)
            texts.append(w)
        offsets, found, _ = periodic._pack([" ".join(t).encode() for t in texts])
        for k, w in enumerate(texts):
            assert [tuple(r) for r in found[:, offsets[k] : offsets[k + 1]].T.tolist()] == brute_runs(w)


def test_grid_in_parts(monkeypatch):
    rng = random.Random(6)
    w = [rng.choice("abc") for _ in range(300)] + ["x", "y", "z"] * 40
    x = np.array([ord(c) for c in w], np.int64)
    whole = periodic.runs(x, np.array([len(w)]))
    monkeypatch.setattr(periodic, "GRID", 50)
    assert all((a == b).all() for a, b in zip(whole, periodic.runs(x, np.array([len(w)])))) and len(whole[0])


def test_periodic_digest(spark, docs):
    rng = random.Random(9)
    texts = [None, "", " \t ", "a a a a a a", "a  b c\na", "go " * 9000, "ä ö " * 30 + "ende", "a b c " * 3, "a b " * 5 + "q " + "c d e " * 6 + "z " * 9] + [
        " ".join(rng.choice("uno due tre".split()) for _ in range(rng.randrange(80))) for _ in range(120)
    ]
    ids = [*range(len(texts) - 2), None, 3]  # a null id, a repeated one
    table = docs(texts, ids).selectExpr("*", "1 AS key", "2 AS runs", "3 AS best")
    got = [tuple(r) for r in periodic.digest(table).collect()]
    expect = [brute_digest(i, t) for i, t in zip(ids, texts)]
    assert sorted(map(repr, got)) == sorted(map(repr, expect)) and any(r[1] > 1 for r in got)
    assert periodic.digest(docs([])).collect() == []


def test_op11_on_whole_tables(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, queries.op11_periodic(spark, sf).collect())) == sorted(brute_digest(*r) for r in rows)


def distance_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in LETTERS.findall(text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    blanks = {}
    for w in n:  # words at distance one agree after a blank put in some place
        for i in range(len(w) + 1):
            for key in {w[:i] + "\0" + w[i:], w[:i] + "\0" + w[i + 1 :]}:
                blanks.setdefault(key, set()).add(w)
    near = {w: set() for w in n}
    for group in blanks.values():
        for w in group:
            near[w] |= {v for v in group if distance_one(w, v)}
    form = {w: min(near[w], key=lambda v: (-n[v], v), default=None) for w in n}
    form = {w: f if f and n[f] >= 2 * n[w] else None for w, f in form.items()}

    def root(w):
        return root(form[w]) if form[w] else w

    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def test_trie_join():
    rng = random.Random(1)
    for _ in range(100):
        words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(6))) for _ in range(rng.randrange(1, 60))})
        got = {i: sorted(j) for i, j in variants.near(words)}
        expect = {i: [j for j in range(len(words)) if distance_one(words[i], words[j])] for i in range(len(words))}
        assert got == {i: j for i, j in expect.items() if j}


@pytest.mark.parametrize("held", [variants.HELD, 3])
def test_variants(spark, docs, monkeypatch, held):
    monkeypatch.setattr(variants, "HELD", held)
    rng = random.Random(2)
    words = ["".join(rng.choice("abÄé÷x") for _ in range(rng.randrange(4, 8))) for _ in range(60)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(200))) for _ in range(30)]
    texts += ["house " * 50 + "housse " * 20 + "housses " * 9 + "hous " * 4 + "Mouse " * 25, None, "", "1234 -- 日本語", "long" * 50_000]
    ids = [*range(len(texts) - 1), None]
    table = docs(texts, ids).selectExpr("*", "1 AS word", "2 AS n")
    got = {tuple(r) for r in variants.grouped(table).collect()}
    assert got == brute_variants(list(zip(ids, texts))) and len({r[2] for r in got}) < len(got)
    found = {(r.a, r.b) for r in variants.links(variants.vocabulary(table)).collect()}
    names = sorted(r[0] for r in got)
    assert found == {(a, b) for a in names for b in names if a < b and distance_one(a, b)}
    assert variants.grouped(docs([None, "a b"])).collect() == []


def test_op12_on_whole_tables(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = queries.op12_variants(spark, sf).collect()
    assert {tuple(r) for r in got} == brute_variants(rows) and len(got) == len({r.word for r in got})


def exact(vectors, every, k):
    """query row -> [(score, vec_id)] by brute force, ties to the smaller id."""
    out = {}
    for r, (i, v) in enumerate(vectors):
        if i % every == 0:
            out[r] = sorted((-float(np.dot(v, w)), j) for s, (j, w) in enumerate(vectors) if s != r and len(w) == len(v))[:k]
    return out


def recall(got, expect, vectors):
    by = {}
    for g in got:
        by.setdefault(g.query_id, {})[g.rank] = g
    hits = total = 0
    for r, best in expect.items():
        own = by.get(vectors[r][0], {})
        assert sorted(own) == list(range(1, len(best) + 1))
        scores = [own[k].score for k in sorted(own)]
        assert scores == sorted(scores, reverse=True)
        hits += len({g.vec_id for g in own.values()} & {j for _, j in best})
        total += len(best)
    return hits / total


@pytest.mark.parametrize("kind", ["even", "uneven", "copies"])
def test_neighbours(spark, monkeypatch, kind):
    monkeypatch.setattr(graphs, "SHARD", 700)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 16))
    if kind == "even":
        x /= np.linalg.norm(x, axis=1)[:, None]
    if kind == "copies":
        x[rng.permutation(1500)[:500]] = x[0]
    vectors = [(i, v) for i, v in enumerate(x.astype(np.float32).astype(float))]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in vectors], "vec_id long, embedding array<float>")
    got = graphs.nearest(table).collect()
    expect = exact(vectors, 20, 20)
    assert len(got) == 75 * 20 and recall(got, expect, vectors) >= 0.95
    for g in got:
        assert abs(g.score - float(np.dot(vectors[g.query_id][1], vectors[g.vec_id][1]))) < 1e-12
    if kind == "copies":  # ties to the smaller id
        best = [g for g in got if g.query_id == 0]
        copies = [i for i, v in vectors if i and (v == vectors[0][1]).all()]
        assert [g.vec_id for g in sorted(best, key=lambda g: g.rank)] == copies[:20]


def test_neighbours_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [nan, 1.0]), (20, [inf, 1.0]), (None, [1.0, 1.0]), (None, [3.0, 1.0]), (5, [3.0, 1.0]), (40, [1.0, 2.0, 3.0]), (6, [])]
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, shard int, row int")
    got = sorted((tuple(r) for r in graphs.nearest(table).collect()), key=str)
    assert got == sorted(2 * [(0, 1, 0, 5.0), (0, 2, 5, 5.0), (0, 3, None, 5.0), (0, 4, None, 3.0)], key=str)
    assert graphs.nearest(table.where("vec_id = 1")).collect() == []


def test_op13_recall(spark, sf):
    vectors = [(r.vec_id, np.array(r.embedding, float)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert recall(queries.op13_neighbours(spark, sf).collect(), exact(vectors, 20, 20), vectors) >= 0.95
