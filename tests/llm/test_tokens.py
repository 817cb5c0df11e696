import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import packing, tokenids, tokens

ODD = ["a  b", "a \n b", "\n\n x  y\n", "  lead", "trail  ", "it's we'll  don't", "x<|endoftext|>y z", "", "a\t b", "12 34,5  6.7\r\n q",
       "é ñ   ü", " ", "a\x0b b", "a\x1c b", "a\x85 b​ c", "x' s 's it'S", "½ x² Ⅷ", "µª ×÷ ß", "ж mixed жabc d"]


def whole(text):
    return tokens.encoder().tokenizer.encode(text or "", add_special_tokens=False).ids + [2]


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(text):
    assert np.frombuffer(tokens.encoder().encode(text), "<u4").tolist() == whole(text)


@given(st.text(alphabet=st.sampled_from("ab Z'stß\n\t.,9 ½ж#|<>"), max_size=40))
@settings(max_examples=300, deadline=None)
def test_pieces_give_the_whole_texts_ids(text):
    assert np.frombuffer(tokens.encoder().encode(text), "<u4").tolist() == whole(text)


def test_generations(monkeypatch):
    made = []
    kept = tokens._Kept(2, lambda k: made.append(k) or k.encode())
    assert [kept[k] for k in "abcabcab"] == [k.encode() for k in "abcabcab"]


def test_files_round_trip(spark, docs, tmp_path, monkeypatch):
    texts = ["the quick brown fox", None, "", "été " * 500, "same", "same", "x"] + [f"doc {i} " * (i % 7) for i in range(200)]
    ids = [5, 900, -3, 17, 40, 40, None, *range(1000, 1200)]
    df = docs(texts, ids).repartition(5)
    monkeypatch.setattr(tokenids, "FILE_BYTES", 3000)
    df = df.selectExpr("*", "1 AS row", "2 AS file", "3 AS start")
    manifest = tokenids.write(df, str(tmp_path / "ids"))
    assert len(manifest) > 4
    got = tokenids.fetch(df, manifest).collect()
    order = sorted(zip(ids, texts), key=lambda p: (p[0] is not None, p[0] or 0))
    start, expect = 0, []
    for i, t in order:
        x = np.array(whole(t), "<u4")
        expect.append((i, start, len(x), zlib.crc32(x.tobytes())))
        start += len(x)
    assert sorted(map(tuple, got), key=str) == sorted(expect, key=str)
    assert [x.tolist() for x in tokenids.lookup(manifest, 17)] == [whole("été " * 500)]
    for i, t in zip(ids[8:], texts[8:]):
        if i is None or i >= 1000:
            assert [x.tolist() for x in tokenids.lookup(manifest, i)] == [whole(t)]
    assert [x.tolist() for x in tokenids.lookup(manifest, None)] == [whole("x")]
    assert len(tokenids.lookup(manifest, 40)) == 2 and tokenids.lookup(manifest, 41) == [] == tokenids.lookup(manifest, 1 << 40)
    some = spark.createDataFrame([(17,), (None,), (41,), (40,), (17,)], "k long")
    assert sorted(r.doc_id or 0 for r in tokenids.fetch(some, manifest, "k").collect()) == [0, 17, 40, 40]
    assert tokenids.round_trip(df.limit(0)).collect() == []


def test_repeats_fill_several_files(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenids, "FILE_BYTES", 2000)
    df = docs(["same text"] * 300 + ["other"], [7] * 300 + [8])
    manifest = tokenids.write(df, str(tmp_path / "ids"))
    assert len(manifest) > 3 and max(f.docs for f in manifest) < 250
    assert len(tokenids.lookup(manifest, 7)) == 300 and len(tokenids.lookup(manifest, 8)) == 1
    rows = sorted(r.start for r in tokenids.fetch(df, manifest).collect())
    n = len(whole("same text"))
    assert rows == [n * i for i in range(301)]


def test_lookup_reads_a_few_bytes(docs, tmp_path):
    manifest = tokenids.write(docs([f"text {i} " * 20 for i in range(3000)]).repartition(1), str(tmp_path / "ids"))
    reader = tokenids.Reader(manifest[0].file)
    read, real = [], reader.source

    class Source:
        def read_at(self, n, at):
            read.append(n)
            return real.read_at(n, at)

    reader.source = Source()
    assert len(reader.get(manifest[0].last[1])) == 1 and sum(read) < 2000


def test_a_tokenizer_with_another_pattern_is_not_cut():
    spec = tokens.json.loads(tokens.encoder().tokenizer.to_str())
    assert tokens.cuttable(spec)
    for key, value in (("normalizer", {"type": "NFC"}), ("pre_tokenizer", {"type": "Whitespace"}), ("added_tokens", [{"content": "foo"}])):
        assert not tokens.cuttable(spec | {key: value})


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(3).integers(0, 1 << 62, 5000).astype(np.uint64))
    mph = tokenids.PerfectHash.build(keys)
    assert sorted(mph.slots(keys).tolist()) == list(range(len(keys)))


def brute_bins(lengths, room):
    """Least bins by search."""
    best = len(lengths)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for k in sorted({b: k for k, b in enumerate(bins)}.values()):
            if bins[k] >= lengths[i]:
                place(i + 1, bins[:k] + [bins[k] - lengths[i]] + bins[k + 1 :])
        place(i + 1, bins + [room - lengths[i]])

    place(0, [])
    return best


@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
@settings(max_examples=150, deadline=None)
def test_bound_and_packing_enclose_the_best(lengths):
    x = np.array(sorted(lengths, reverse=True))
    bins, offsets = packing.best_fit(x, 20)
    used = np.bincount(bins, weights=x)
    assert used.max() <= 20
    best = brute_bins(x.tolist(), 20)
    assert packing.lower_bound(x, 20) <= best <= len(used)


def test_pack(spark, docs):
    texts = ["word " * n for n in (1, 10, 700, 1500, 3000, 1023, 1024)] + [None, "", "same", "same"] + [f"filler {i} " * (i % 90) for i in range(300)]
    df = docs(texts).selectExpr("*", "1 AS part", "2 AS bin", "3 AS salt")
    rows = packing.pack(df).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for i, t in enumerate(texts):
        x, at = np.array(whole(t), "<u4"), 0
        for k, r in enumerate(sorted(by_doc[i], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and zlib.crc32(x[at : at + r.length].tobytes()) == r.ids_crc32
            assert r.length == 1024 or k == 0
            at += r.length
        assert at == len(x)
    for seq in by_seq.values():
        at = 0
        for r in sorted(seq, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert len(by_seq) <= packing.lower_bound(np.array([r.length for r in rows])) + 1
    assert packing.pack(df.limit(0)).collect() == []


def test_repeated_rows_are_all_packed(spark, docs):
    df = docs(["same text " * 40] * 500, [1] * 500)
    rows = packing.pack(df).collect()
    assert len(rows) == 500 and len({(r.sequence_id, r.offset) for r in rows}) == 500


def test_gaps_are_repacked(spark, docs, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 16)
    texts = ["w " * (i * 37 % 600 + 20) for i in range(160)]
    rows = packing.pack(docs(texts)).collect()
    assert sorted(r.doc_id for r in rows if r.piece == 0) == list(range(160))
    used = {}
    for r in rows:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert max(used.values()) <= 1024
    assert len(used) <= packing.lower_bound(np.array([r.length for r in rows])) + 2


def test_sequence_numbers_of_many_groups_stay_apart(spark):
    from pyspark.sql import functions as F

    cells = [(r, p, b) for r in range(4) for p in (0, 1, 2**20 - 1, 2**20, 2**33) for b in (0, 1, 2**20 - 1)]
    df = spark.createDataFrame([(p, b) for _, p, b in cells if _ == 0], "part long, bin long")
    made = [x[0] for r in range(4) for x in df.select(packing.sequence_number(r, F.col("part"), F.col("bin"))).collect()]
    assert len(set(made)) == len(cells) and all(x >= 0 and x % 2 == 0 for x in made)
    assert packing.GROUP << 2 * (packing.ROUNDS - 1) <= 2**20 and packing.ROUNDS <= 4
