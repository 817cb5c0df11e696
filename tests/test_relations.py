import json
import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from plumbline.operators import audit, decontaminate, evaluate, order, similarity, slices, splits
from plumbline.sources import records, sinks, tables


def _features(spark, sets, key):
    return spark.createDataFrame([(k, f, len(s)) for k, s in sets.items() for f in s], f"{key} string, feature string, n int")


def test_prefix_filter_finds_exactly_the_similar(spark):
    rng = random.Random(3)
    base = [frozenset(rng.sample("abcdefghijklmnopqrst", rng.randrange(2, 12))) for _ in range(30)]
    left, right = {f"l{i}": s for i, s in enumerate(base)}, {}
    for i, s in enumerate(base):
        t = set(s)
        for _ in range(rng.randrange(3)):
            t ^= {rng.choice("abcdefghijklmnopqrst")}
        if t:
            right[f"r{i}"] = t
    for per_mille, inclusive in ((800, True), (800, False), (500, True), (1000, True)):
        got = {(r.l, r.r) for r in similarity.similar(_features(spark, left, "l"), _features(spark, right, "r"), "l", "r", per_mille, inclusive).collect()}
        def near(a, b):
            x, y = 1000 * len(a & b), per_mille * len(a | b)
            return x >= y if inclusive else x > y
        assert got == {(i, j) for i, a in left.items() for j, b in right.items() if near(a, set(b))}


@pytest.mark.parametrize("frequent,sent", [(1, 10**6), (2, 3), (10**9, 1)])
def test_rows_meet_by_the_hashes_of_their_prefixes(spark, monkeypatch, frequent, sent):
    """Equal to brute force whichever features are known to be frequent; no feature's text is shuffled, and a passage that all texts
    share makes no candidate."""
    monkeypatch.setattr(similarity, "FREQUENT", frequent)
    monkeypatch.setattr(similarity, "SENT", sent)
    rng, passage = random.Random(5), [f"p{i}" for i in range(20)]
    texts = [[f"w{rng.randrange(40)}" for _ in range(rng.randrange(0, 40))] for _ in range(60)]
    texts += [t[:-1] for t in texts[:25]] + [t + ["z"] for t in texts[:25]] + [passage + [f"{k}.{i}" for i in range(60)] for k in range(30)]
    rows = similarity.rows(spark.createDataFrame(list(enumerate(texts)), "a long, words array<string>"), "a")
    sets = [{" ".join(t[i : i + 5]) for i in range(max(1, len(t) - 4))} if t else set() for t in texts]
    for per_mille, where in ((800, None), (800, "a < b"), (300, None)):
        got = {(r.a, r.b): r.similarity for r in similarity.similar_rows(rows, rows.withColumnRenamed("a", "b"), "a", "b", per_mille, where=where).collect()}
        pairs = {(a, b): len(x & y) / len(x | y) for a, x in enumerate(sets) for b, y in enumerate(sets) if x and y and (a < b or not where)}
        assert got == {p: v for p, v in pairs.items() if v >= per_mille / 1000}
    assert "feature" not in rows.columns and dict(rows.dtypes)["hashes"] == "array<bigint>"


def test_funnel_balances(spark):
    data = spark.createDataFrame([(1, "s", "f1", "k1", ["a", "b", "c", "d"]), (2, "s", "f9", "k1", ["d", "a", "b", "c"]), (3, "s", "f8", "k8", list("abcdefghijklmnopqrsu")), (4, "s", "f7", "k7", ["x", "y", "z"]), (5, "s", None, None, [])],
                                 "doc_id long, source string, key_full string, key_short string, words array<string>")
    registry = spark.createDataFrame([("src", "f1", "k1", ["a", "b", "c", "d"]), ("src", "f0", "k0", list("abcdefghijklmnopqrst"))], "source string, key_full string, key_short string, words array<string>")
    log = decontaminate.funnel(decontaminate.annotate(data, registry), "source").orderBy("step_no").collect()
    assert [(r.step, r.removed, r.left) for r in log] == [("raw", 0, 5), ("exact_full", 1, 4), ("exact_short", 1, 3), ("near", 1, 2)]
    assert sorted(r.doc_id for r in decontaminate.cleaned(data, decontaminate.annotate(data, registry)).collect()) == [4, 5]


def test_near_looks_at_every_order_of_the_same_words(spark):
    """Two registry texts of one short key, each with a near copy; one at 0.8 itself is no match."""
    a, five = list("abcdefghijklmnopqrst"), [f"x{i}" for i in range(8)]
    b, short = a[10:] + a[:10], F.md5(F.array_join(F.array_sort(F.array_distinct("words")), " "))
    registry = spark.createDataFrame([(1, a), (2, b), (3, five)], "id long, words array<string>").select(F.lit("src").alias("source"), F.md5(F.col("id").cast("string")).alias("key_full"), short.alias("key_short"), "words")
    data = spark.createDataFrame([(1, [*a, "z"]), (2, [*b, "z"]), (3, [*five, "z"])], "doc_id long, words array<string>").select("doc_id", F.md5(F.concat(F.lit("d"), F.col("doc_id"))).alias("key_full"), short.alias("key_short"), "words")
    assert registry.select("key_short").distinct().count() == 2
    assert {r.doc_id: r.near for r in decontaminate.annotate(data, registry).collect()} == {1: True, 2: True, 3: False}


def test_year_filter_is_strict(spark):
    df = spark.createDataFrame([(2019,), (2020,), (2021,), (None,)], "year int")
    assert [r.year for r in decontaminate.after_year(df, 2020).collect()] == [2021]


def test_upsert(spark):
    old, new = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"), spark.createDataFrame([("b", 3), ("c", 4)], "k string, v int")
    assert sorted(tuple(r) for r in decontaminate.upsert(old, new, "k").collect()) == [("a", 1), ("b", 3), ("c", 4)]


def test_splits_are_whole_and_apart(spark):
    rows = [(t, f"m{i}", f"s{i % 6}", 2000 + i % 15) for t in ("A", "B") for i in range(60)]
    e = spark.createDataFrame(rows, "task string, mol_id string, structure string, first_year int").cache()
    for name, split in splits.SPLITS.items():
        got = split(e).collect()
        assert len(got) == 120 and {r.part for r in got} == {"train", "test"}
        for t in ("A", "B"):
            test = [r for r in got if r.task == t and r.part == "test"]
            assert len(test) <= 12 and (name == "scaffold" or len(test) == 12)
            if name == "scaffold":
                assert not {r.structure for r in test} & {r.structure for r in got if r.task == t and r.part == "train"}
            if name == "temporal":
                assert min(r.first_year for r in test) >= max(r.first_year for r in got if r.task == t and r.part == "train")
    assert splits.temporal_split(e, 0.0).where("part = 'test'").count() == 0


def test_cutoff_precedence(spark):
    rows = [("a", "2020-01-01", "2021-01-01", None), ("b", None, "2021-02-03", None), ("c", None, None, None)]
    got = {r.model: (str(r.cutoff), r.basis) for r in tables.cutoffs(spark, rows, "2024-05-06").collect()}
    assert got == {"a": ("2020-01-01", "training_cutoff"), "b": ("2021-02-03", "paper_date"), "c": ("2024-05-06", "today")}


def _record(**kw):
    r = {"target_chembl_id": "T", "target_pref_name": "n", "molecule_chembl_id": "M", "canonical_smiles": "C", "standard_type": "Ki", "standard_relation": "=", "pchembl_value": "7.1",
         "assay_chembl_id": "A", "document_chembl_id": "D", "document_year": 2010, "data_validity_comment": None, "potential_duplicate": 0}
    return r | kw


def test_record_rules_and_paging(spark):
    all_ = [_record(), _record(standard_relation="<"), _record(pchembl_value=None), _record(pchembl_value=""), _record(data_validity_comment="x"), _record(potential_duplicate=1), _record(potential_duplicate="True"),
            _record(canonical_smiles=None), _record(document_year=None), _record(assay_chembl_id="Z")]
    served = {"http://s/api/u?a=1": {"activities": all_[:4], "page_meta": {"next": "/api/v?offset=4"}}, "http://s/api/v?offset=4": {"activities": all_[4:], "page_meta": {"next": None}}}
    tries = []

    def get(url):
        tries.append(url)
        if len(tries) == 1:
            raise OSError("busy")
        return json.dumps(served[url])

    waits = []
    got = list(records.pages(get, "http://s/api/u?a=1", "activities", waits.append))
    assert len(got) == 10 and waits == [2]
    names = [c.split()[0] for c in records.RECORD.split(", ")]
    df = spark.createDataFrame([tuple(r[n] if r[n] is None or n == "document_year" else str(r[n]) for n in names) for r in got], records.RECORD)
    kept = records.parse(df, spark.createDataFrame([("A",)], "assay_chembl_id string")).collect()
    assert len(kept) == 1 and kept[0].value == 7.1
    with pytest.raises(OSError):
        records.fetch(lambda u: (_ for _ in ()).throw(OSError("down")), "u", waits.append)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("t1", 1.0), ("t2", 2.0)], "task string, y double")
    path = str(tmp_path / "stage")
    made = []
    for _ in range(2):
        out = sinks.stage(spark, path, lambda: made.append(1) or df)
    assert out.count() == 2 and made == [1]
    merged = sinks.merge(spark, str(tmp_path / "none"), df, "task", str(tmp_path / "merged"))
    assert merged.count() == 2
    text = json.loads(sinks.metadata("d", {"t": df}, "http://x"))
    assert [f["dataType"] for f in text["recordSet"][0]["field"]] == ["sc:Text", "sc:Float"]
    (tmp_path / "a.csv").write_text("a\tb\n1\tx,y\n")
    assert tables.csv(spark, str(tmp_path / "a.csv"), "a int, b string").first().b == "x,y"
    assert tables.structure_column(["ID", "SMILES"]) == "SMILES"
    assert tables.registry(spark, str(tmp_path / "nowhere")).count() == 0


def answer(url):
    """A service of two pages for each target and type, with a relative next."""
    from urllib.parse import parse_qs, urlparse

    q = {k: v[0] for k, v in parse_qs(urlparse(url).query, keep_blank_values=True).items()}
    assert q["standard_relation"] == "=" and q["data_validity_comment__isnull"] == "true" and q["limit"] == "1000" and q["assay_type"] == "B"
    page = int(q.get("offset", 0))
    rows = [_record(target_chembl_id=q["target_chembl_id"], standard_type=q["standard_type"], molecule_chembl_id=f"M{page}{i}", document_chembl_id=d) for i, d in enumerate("DE")]
    rows = [r for r in rows if q.get("document_chembl_id", r["document_chembl_id"]) == r["document_chembl_id"]]
    following = None if page else "/api/activity.json?" + urlparse(url).query + "&offset=2"
    return json.dumps({"activities": rows, "page_meta": {"next": following}})


def test_activities_source(spark):
    spark.dataSource.register(records.Activities)
    options = {"url": "http://s/api/activity.json", "targets": "T1,T2", "types": "Ki,IC50", "get": f"{__name__}:answer"}
    df = spark.read.format("activities").options(**options).load()
    assert df.rdd.getNumPartitions() == 4 and df.count() == 16
    assert {(r.target_chembl_id, r.standard_type) for r in df.collect()} == {(t, k) for t in ("T1", "T2") for k in ("Ki", "IC50")}
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    some = spark.read.format("activities").options(**options, push="true").load().where("document_chembl_id = 'E' AND standard_type = 'Ki'")
    assert some.count() == 4 and records.parse(some).count() == 4
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_catalogue_takes_molecules_only(spark):
    row = {"owner": {"slug": "o"}, "slug": "s", "nRows": 3, "createdAt": "2024-02-03T01:02", "tags": ["b", "a"], "annotations": {"m": {"modality": "MOLECULE"}, "p": {"modality": "PROTEIN"}, "q": {"modality": None}}}
    df = spark.read.schema(records.CATALOGUE).json(spark.sparkContext.parallelize([json.dumps(row), json.dumps({"slug": "t"})]))
    a, b = sorted(records.catalogue(df, "2024-05-06").collect(), key=lambda r: r.slug)
    assert (a.owner, a.n_rows, a.table_bytes, a.created, a.tags, a.mol_cols, a.downloaded) == ("o", 3, None, "2024-02-03", "b;a", "m", "2024-05-06")
    assert (b.owner, b.tags, b.mol_cols) == (None, "", "")


def test_readers(spark, tmp_path):
    (tmp_path / "c.yaml").write_text("models:\n  a: {training_cutoff: 2020-01-02, paper_date: 2021-01-01, registry_sources: [s1, s2]}\n  b: {training_cutoff: null, paper_date: 2022-03-04}\n  c: {}\n")
    got = {r.model: (str(r.cutoff), r.basis, r.sources) for r in tables.cutoffs_file(spark, str(tmp_path / "c.yaml"), "2024-05-06").collect()}
    assert got == {"a": ("2020-01-02", "training_cutoff", ["s1", "s2"]), "b": ("2022-03-04", "paper_date", None), "c": ("2024-05-06", "today", None)}
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "T1.csv").write_text("a,b\n1,x\n")
    (tmp_path / "raw" / "T2.csv").write_text("")
    assert [tuple(r) for r in tables.csv(spark, str(tmp_path / "raw"), "a int, b string", stem="target").collect()] == [(1, "x", "T1")]
    assert tables.structure_column(["id", "X"]) == "X" and tables.structure_column(["canonical_smiles", "Drug"]) == "Drug"
    m = spark.createDataFrame([("t1", 1), ("t2", 2)], "task string, mol_id int")
    e = spark.createDataFrame([("t2", 2), ("t3", 3)], "task string, mol_id int")
    assert [[r.task for r in df.collect()] for df in tables.paired(m, e)] == [["t2"], ["t2"]]
    m.write.parquet(str(tmp_path / "s1"))
    e.withColumnRenamed("mol_id", "n").write.parquet(str(tmp_path / "s2"))
    assert tables.shards(spark, [str(tmp_path / "s1"), str(tmp_path / "s2")]).count() == 4
    assert tables.predictions(spark, str(tmp_path / "p.parquet")) is None
    (tmp_path / "p.csv").write_text("task,split,seed,model,mol_id,pred\nt,random,0,m,1,2.5\n")
    assert tables.predictions(spark, str(tmp_path / "p.parquet")).first().pred == 2.5
    with pytest.raises(ValueError):
        tables.predictions(spark, str(tmp_path / "s1"))


def test_vector_store_embeds_only_what_is_missing(spark, tmp_path):
    asked = []

    def embed(df):
        asked.append(sorted(r.k for r in df.collect()))
        return df.selectExpr("k", "array(1.0, 2.0) AS vector")

    ids = spark.createDataFrame([(1,), (2,), (3,)], "k long")
    assert sinks.store_vectors(ids.where("k < 3"), str(tmp_path / "v"), embed, "k", "r1").count() == 2
    assert sinks.store_vectors(ids, str(tmp_path / "v"), embed, "k", "r1").count() == 3 and asked == [[1, 2], [3]]
    text = json.loads(sinks.metadata("d", {"v": spark.read.parquet(str(tmp_path / "v"))}, "http://x"))
    assert all(len(f["md5"]) == 32 for f in text["distribution"]) and text["conformsTo"].endswith("/1.0")
    with pytest.raises(ValueError):
        sinks.merge(spark, "/a/b", ids, "k", "/a/b/")


def test_loss_log_balances(spark):
    m = spark.createDataFrame([("t", i, y) for i in range(6) for y in (1990, 2005)][:-1], "task string, mol_id int, year int")
    flags = spark.createDataFrame([(0, True, True, False), (1, False, True, False), (2, False, False, True), (3, False, False, False), (4, False, False, False), (5, False, False, False)], "mol_id int, exact_full boolean, exact_short boolean, near boolean")
    log = [tuple(r)[2:] for r in decontaminate.loss_log(m, flags, 2000).orderBy("step_no").collect()]
    assert log == [("raw", 0, 0, 6, 11), ("exact_full", 1, 2, 5, 9), ("exact_short", 1, 2, 4, 7), ("near", 1, 2, 3, 5), ("year>2000", 1, 3, 2, 2)]
    cuts = tables.cutoffs(spark, [("a", "1995-01-01", None, None), ("b", "2010-01-01", None, None)], "2020-01-01")
    got = {r.model: (r.n_mols, r.n_meas) for r in decontaminate.model_cutoffs(decontaminate.clean_base(m, flags), cuts).collect()}
    assert got == {"a": (2, 2), "b": (0, 0)} and decontaminate.cutoff_year(cuts) == 2010 and decontaminate.cutoff_year(cuts, ["a"]) == 1995 and decontaminate.cutoff_year(cuts, None, 0) == 0


def _sets(spark, rows, key):
    return spark.createDataFrame([(k, f, len(s)) for k, s in enumerate(rows) for f in s], f"{key} long, feature string, n int")


def test_best_match_with_a_falling_bound(spark):
    """Equal to brute force to the last digit; what is compared in full stays far under what a common feature would join."""
    rng = random.Random(3)
    common = {f"b{i}" for i in range(20)}

    def row(shared):
        return (set(common) if rng.random() < shared else set()) | {f"w{rng.randrange(300)}" for _ in range(rng.randrange(30))}

    left, right = [row(0.5) for _ in range(120)] + [{"only"}, set(), {"b0"}], [row(0.5) for _ in range(120)]
    for i in range(40):
        right[i] = left[i] | ({f"z{i}"} if i % 2 else set())
    expect = {k: m for k, s in enumerate(left) if (m := max(len(s & r) / len(s | r) if s | r else 0 for r in right)) > 0}
    for falls in (similarity.FALLS, (0,), (1000, 999, 1, 0)):
        got = {r.a: r.similarity for r in similarity.best(_sets(spark, left, "a"), _sets(spark, right, "b"), "a", "b", falls).collect()}
        assert got == expect
    assert similarity.best(_sets(spark, [set(), {"x"}], "a"), _sets(spark, [{"y"}], "b"), "a", "b").collect() == []


def test_a_boilerplate_feature_joins_nothing(spark):
    """Texts of own shingles and a passage that all share: the passage's witness proves each row, no pair is compared."""
    passage = {f"p{i}" for i in range(15)}
    left, right = ([passage | {f"{side}{k}.{i}" for i in range(30 + k % 3)} for k in range(200)] for side in "lr")
    joined = []
    got = similarity.best(_sets(spark, left, "a"), _sets(spark, right, "b"), "a", "b", joined=joined).collect()
    assert {round(r.similarity, 9) for r in got} == {round(15 / (75 + k), 9) for k in range(3)} and len(got) == 200
    assert sum(joined) == 0  # the common features alone would join 200 x 200 rows fifteen times


@pytest.mark.parametrize("listed,cell,group", [(2048, 100_000, 10**6), (3, 4, 1), (3, 10**5, 1000)])
def test_order_statistics_and_ranks(spark, monkeypatch, listed, cell, group):
    for name, value in (("LISTED", listed), ("CELL", cell), ("GROUP", group)):
        monkeypatch.setattr(order, name, value)
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([rng.gauss(0, 1), round(rng.gauss(0, 1), 1), None, float("nan")]), float(rng.randrange(5))) for _ in range(3000)]
    rows += [("c", None, 1.0), ("d", 2.5, None), ("e", float("inf"), -0.0), ("e", -1e-310, 0.0)]
    df = spark.createDataFrame(rows, "t string, x double, y double")
    real = lambda g, i: [r[i] for r in rows if r[0] == g and r[i] is not None and r[i] == r[i]]
    wanted = {"a": ("x", 0.05), "b": ("x", 0.5), "c": ("y", 0.9), "d": ("y", 1 / 3)}
    got = {r.t: r for r in order.quantiles(df, ["t"], wanted).collect()}
    for g in ("a", "b", None, "c", "d"):
        for name, (column, p) in wanted.items():
            v = real(g, "txy".index(column))
            assert got[g][name] == (pytest.approx(float(np.quantile(v, p))) if v else None)
    ranked = order.ranks(df, ["t"], {"rx": "x", "ry": "y"}).collect()
    assert len(ranked) == len(rows)
    values = {(g, i): np.array(real(g, i)) for g in ("a", "b", None, "c", "d", "e") for i in (1, 2)}
    for r in ranked:
        for i, x, rank in ((1, r.x, r.rx), (2, r.y, r.ry)):
            v = values[r.t, i]
            assert rank == (None if x is None or x != x else (v < x).sum() + ((v == x).sum() + 1) / 2)
    assert order.quantiles(df.where("false"), (), {"a": ("x", 0.5)}).collect() == [(None,)]


def test_ordered_is_the_bits_of_a_double(spark):
    import math
    import struct

    rng = random.Random(2)
    xs = [0.0, -0.0, 1.0, -1.0, 5e-324, 1e-310, 2.0**-1022, 1.7976931348623157e308, float("inf"), float("-inf"), 7.999999999999999, 8.0, 8.000000000000002, 2.0**1023]
    xs += [rng.choice([-1, 1]) * math.ldexp(rng.random() + 0.5, rng.randrange(-1070, 1023)) for _ in range(2000)]
    got = spark.createDataFrame(list(enumerate(xs)), "i int, x double").select("i", order.ordered(F.col("x")).alias("k")).orderBy("i").collect()
    assert [r.k for r in got] == [(-1 if x < 0 else 1) * struct.unpack("<q", struct.pack("<d", abs(x)))[0] for x in xs]


def test_group_splits_walk_through_hashed_groups(spark):
    """Rounds of prefix sums take what a walk takes, group by group."""
    rng = random.Random(11)
    rows = [(t, f"m{i}", rng.choice([None, *[f"g{k}" for k in range(40)], "big", "big", "big"])) for t in ("a", "b", "c") for i in range(300)] + [("d", "m0", "whole")]
    e = spark.createDataFrame(rows, "task string, mol_id string, structure string")
    for share in (0.2, 0.03, 0.0):
        got = splits.group_splits(e, "structure", (0, 3), share)
        hashed = {(r.task, r.structure, r.seed): r.h for r in splits.seeded(e, (0, 3)).select("task", "structure", "seed", splits.hash_unit("seed", "task", "structure").alias("h")).distinct().collect()}
        parts = {(r.task, r.seed, r.mol_id): r.part for r in got.collect()}
        assert len(parts) == 2 * len(rows)
        for task in "abcd":
            for seed in (0, 3):
                size = {}
                for t, _, g in rows:
                    if t == task and g is not None:
                        size[g] = size.get(g, 0) + 1
                left, test = round(sum(t == task for t, *_ in rows) * share), set()
                for g in sorted(size, key=lambda g: (hashed[task, g, seed], g)):
                    if size[g] <= left:
                        left, test = left - size[g], test | {g}
                assert {m for t, m, g in rows if t == task and g in test} == {m for (t, s, m), p in parts.items() if (t, s, p) == (task, seed, "test")}


@pytest.mark.parametrize("kind", ["long", "string"])
def test_temporal_split_cuts_within_a_year(spark, kind):
    rng = random.Random(12)
    rows = [(t, i, rng.choice([None, 2000, 2001, 2001, 2001, 2002])) for t in ("a", "b") for i in range(90)] + [("c", i, 1999) for i in range(10)]
    e = spark.createDataFrame(rows, "task string, mol_id long, first_year int").withColumn("mol_id", F.lpad(F.col("mol_id").cast("string"), 3, "0").cast(kind))
    for share in (0.2, 0.5, 1.0):
        got = {(r.task, int(r.mol_id)) for r in splits.temporal_split(e, share).where("part = 'test'").collect()}
        expect = set()
        for task in "abc":
            own = sorted((y if y is not None else -1, i) for t, i, y in rows if t == task)
            expect |= {(task, i) for _, i in own[len(own) - round(len(own) * share) :]}
        assert got == expect
    assert splits.temporal_split(e).columns == [*e.columns, "part"]


def test_pair_statistics_without_pairs(spark):
    """Equal to those of the pairs themselves, with unknown years and repeated assays."""
    rng = random.Random(13)
    rows = [(t, f"m{rng.randrange(6)}", f"d{i}", rng.choice(["a", "b", "c"]), rng.choice([None, *range(1990, 2003)]), 5 + rng.gauss(0, 1)) for t in ("t", "u") for i in range(60)]
    rows += [("one", "m", "d", "a", 2000, 1.0), ("same", "m", "d1", "a", None, 1.0), ("same", "m", "d2", "a", 2000, 1.0)]
    m = spark.createDataFrame(rows, "task string, mol_id string, doc_id string, assay_id string, year int, y double")
    got = {r.task: r for r in audit.sigma_from_pairs(audit.doc_facts(m)).collect()}
    pairs = audit.doc_pairs(m).collect()
    assert set(got) == {p.task for p in pairs} == {"t", "u", "same"}
    for task, r in got.items():
        own = [p for p in pairs if p.task == task]
        close, far = ([p.delta for p in own if p.d_year is not None and (p.d_year <= 3) == near] for near in (True, False))
        sigma = lambda d: (sum(x * x for x in d) / len(d) / 2) ** 0.5 if d else None
        assert (r.n_near, r.n_far) == (len(close), len(far)) and r.frac_same_assays == pytest.approx(sum(p.same_assays for p in own) / len(own))
        for value, expect in ((r.sigma_pairs, sigma([p.delta for p in own])), (r.sigma_near, sigma(close)), (r.sigma_far, sigma(far))):
            assert value == (None if expect is None else pytest.approx(expect))


def test_targets_of_few_common_entities_keep_their_row(spark):
    rows = [("T", k, f"m{i}", f"d{j}", 5.0 + i + (k == "Ki") + 0.1 * j) for k in ("IC50", "Ki") for i in range(6) for j in range(2)]
    rows += [("U", "IC50", "m1", "d1", 1.0), ("U", "IC50", "m1", "d2", 2.0), ("U", "Ki", "m2", "d1", 1.0), ("V", "Ki", "m1", "d1", 1.0)]
    m = spark.createDataFrame(rows, "target string, type string, mol_id string, doc_id string, y double")
    got = {r.target: r for r in audit.type_compare(m).collect()}
    assert set(got) == {"T", "U"} and got["T"].n_both == 6 and got["T"].mean_diff == pytest.approx(1.0) and got["T"].pearson == pytest.approx(1.0)
    assert (got["U"].n_both, got["U"].mean_diff, got["U"].spearman, got["U"].sigma_ki) == (0, None, None, None) and got["U"].sigma_ic50 == pytest.approx(0.5**0.5)
    assert got["T"].sigma_ki == pytest.approx((0.005) ** 0.5)


def test_rows_without_a_short_key_are_known_by_their_id(spark):
    df = spark.createDataFrame([(1, "k"), (2, None)], "doc_id long, key_short string")
    assert sorted(r.key_short for r in decontaminate.keyed(df, "doc_id").collect()) == ["2", "k"]


def test_pairs_are_added_up_where_they_are_made(spark):
    """The metrics of a table of pairs, from entities that carry their predictions."""
    rng = random.Random(2)
    parts = [("t", "s", seed, i, f"x{i % 3}" if i % 7 else None, rng.uniform(0, 6), "test" if i % 4 else "train") for seed in (0, 1) for i in range(60)]
    df = spark.createDataFrame(parts, "task string, split string, seed int, mol_id long, structure string, y double, part string")
    pairs = spark.createDataFrame([(a, b, 1.0 if a == b else 0.8) for a in ("x0", "x1", "x2") for b in ("x0", "x1", "x2") if (a, b) not in (("x0", "x2"), ("x2", "x0"))], "structure string, other string, sim double")
    preds = [("t", "s", r[2], m, r[3], r[5], rng.uniform(0, 6)) for r in parts if r[6] == "test" for m in ("m", "n") if (m, r[3] % 5) != ("n", 0)]
    p = spark.createDataFrame(preds, "task string, split string, seed int, model string, mol_id long, y double, pred double")
    keys = ["task", "split", "seed", "model"]
    rows = lambda out: {tuple(r[k] for k in keys): (r.n_pairs, pytest.approx(r.sign_acc), pytest.approx(r.rmse_delta)) for r in out.collect()}
    fused = slices.similar_pair_metrics(df, pairs, p)
    got = {tuple(r[k] for k in keys): (r.n_pairs, r.sign_acc, r.rmse_delta) for r in fused.collect()}
    assert got == rows(evaluate.pair_metrics(slices.similar_pairs(df, pairs), p)) and len(got) == 4


@pytest.mark.parametrize("held", [1 << 18, 7])
def test_no_pair_is_made(spark, monkeypatch, held):
    """Equal to a walk over all pairs, at bounds that ties and rounding meet; missing models and predictions, groups that go on over batches."""
    from plumbline.operators import pairs as pair_sums

    monkeypatch.setattr(pair_sums, "HELD", held)
    rng = random.Random(6)
    data = [("t", "s", seed, i, f"x{i % 4}" if i % 9 else None, rng.choice([0.1 * rng.randrange(40), rng.uniform(0, 4), None]), [(m, rng.choice([None, 0.5, 0.3 * rng.randrange(9)])) for m in "mno" if (i, m) not in ((3, "n"), (8, "n")) and m != "o" or i == 2]) for seed in (0, 1) for i in range(80)]
    test = spark.createDataFrame(data, "task string, split string, seed int, mol_id long, structure string, y double, preds array<struct<model:string,pred:double>>").repartition(3)
    similar = {(a, b) for a in ("x0", "x1", "x2", "x3") for b in ("x0", "x1", "x2", "x3") if {a, b} != {"x0", "x2"} and (a, b) != ("x3", "x3")}
    sim = spark.createDataFrame([(a, b, 0.8) for a, b in sorted(similar)], "structure string, other string, sim double")
    df = slices.tested_pair_metrics(test, sim, delta=0.3)
    expect = {}
    for a in data:
        for b in data:
            if a[2] == b[2] and a[3] < b[3] and (a[4], b[4]) in similar and None not in (a[5], b[5]) and abs(a[5] - b[5]) >= 0.3:
                for m, u in a[6]:
                    for v in (v for k, v in b[6] if k == m):
                        dy, dp = a[5] - b[5], None if None in (u, v) else u - v
                        expect.setdefault((a[2], m), []).append((dp is not None and np.sign(dy) == np.sign(dp), None if dp is None else (dy - dp) ** 2))
    got = {(r.seed, r.model): (r.n_pairs, r.sign_acc, r.rmse_delta) for r in df.collect()}
    want = {k: (len(v), sum(s for s, _ in v) / len(v), np.sqrt(np.mean([e for _, e in v if e is not None]))) for k, v in expect.items()}
    assert got.keys() == want.keys() and len(got) == 4 and all(got[k] == pytest.approx(want[k]) for k in got)
    assert df.schema["seed"].dataType.simpleString() == "int"
