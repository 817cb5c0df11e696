import random
import re

import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import components, simhash


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    """doc_id -> least doc_id reachable over links of at most 2 bits."""
    left, out = dict(fps), {}
    while left:
        seed = min(left)
        group, todo = {seed}, [left.pop(seed)]
        while todo:
            f = todo.pop()
            near = [i for i, g in left.items() if (f ^ g).bit_count() <= 2]
            todo += [left.pop(i) for i in near]
            group.update(near)
        out |= dict.fromkeys(group, min(group))
    return out


@given(st.text(alphabet=st.sampled_from("aAbZ É\t\n\x0b\x1c\x85ß"), max_size=60))
@settings(max_examples=200, deadline=None)
def test_fingerprint_is_the_contracts(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_long_text_is_counted_in_chunks(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(5000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "CHUNK", 64)
    assert simhash.fingerprint(text) == whole == brute_fingerprint(text)


def test_components_match_brute_force(spark, docs):
    rng = random.Random(5)
    base = [" ".join(f"w{rng.randrange(200)}" for _ in range(120)) for _ in range(12)]
    texts = [None, "", " \t", "one", "ONE"]
    for b in base:
        for _ in range(rng.randrange(1, 9)):
            w = b.split()
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(9)}"
            texts.append(" ".join(w))
    rng.shuffle(texts)
    got = simhash.near_duplicates(docs(texts)).collect()
    expect = brute_components({i: brute_fingerprint(t) for i, t in enumerate(texts)})
    assert {r.doc_id: r.component_id for r in got} == expect
    assert {r.doc_id: r.fingerprint for r in got} == {i: f"{brute_fingerprint(t):016x}" for i, t in enumerate(texts)}


def test_links_are_all_pairs_within_two_bits(spark):
    rng = random.Random(7)
    centre = [rng.getrandbits(64) for _ in range(4)]
    fps = {c ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for c in centre for _ in range(30)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    expect = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2}
    assert {tuple(r) for r in simhash.links(df).collect()} == expect
    chained = {tuple(r) for r in simhash.chain(df).collect()}
    assert chained <= expect


def test_long_chain_is_one_component(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (5, 5), (3, 2)], "a long, b long")
    got = {r.node: r.root for r in components.components(edges).collect()}
    assert len({got[i] for i in range(n + 1)}) == 1
    assert got[1000] == got[1001] != got[0] and len(got) == n + 3
    assert components.components(edges.where("a < 0")).count() == 0


def test_one_document_of_each_group_stays(spark, docs):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    df = docs([a, a, b, b, "solo", None, None], [7, 3, 9, 9, 4, None, 12])
    kept = sorted(((r.doc_id is None, r.doc_id or 0, r.text) for r in simhash.deduplicated(df).collect()), key=str)
    assert kept == sorted([(False, 3, a), (False, 9, b), (False, 4, "solo"), (False, 12, None)], key=str)
    near = a.upper()
    kept = simhash.deduplicated(docs([a, near, near, b, b, "solo"], [1, 1, 1, None, None, None])).collect()
    assert len(kept) == 3 and {r.doc_id for r in kept} == {1, None} and {r.text for r in kept} >= {b, "solo"}


def test_empty_and_clashing_columns(spark, docs):
    df = docs(["x y z"]).limit(0)
    assert simhash.near_duplicates(df).collect() == []
    more = docs(["x y z"]).selectExpr("*", "1 AS fp", "2 AS root", "3 AS component_id", "4 AS variant")
    assert simhash.near_duplicates(more).collect()[0].component_id == 0
    assert simhash.deduplicated(more).columns == more.columns
