"""Hand-computed micro-tables."""

import math

import pytest

from pyspark.sql import functions as F

from plumbline.operators import audit, replicate, resample

ROWS = [
    ("T_Ki", "m1", "d1", "a1", 2000, 5.0), ("T_Ki", "m1", "d1", "a2", 2000, 5.4), ("T_Ki", "m1", "d2", "a3", 2004, 6.0),
    ("T_Ki", "m2", "d1", "a1", 2000, 7.0), ("T_Ki", "m2", "d2", "a3", 2004, 7.2), ("T_Ki", "m2", "d3", "a4", 2009, 7.7),
    ("T_Ki", "m3", "d1", "a1", 2000, 4.0), ("T_Ki", "m3", "d2", "a3", 2004, 8.0), ("T_Ki", "m4", "d1", "a1", 2000, 6.5), ("T_Ki", None, "d1", "a1", 2000, 9.9),
    ("U_X_Ki", "m1", "d1", "a1", None, 5.0), ("U_X_Ki", "m2", "d1", "a1", 2001, None), ("U_X_Ki", "m2", "d1", "a1", 2001, float("nan")),
]


@pytest.fixture(scope="module")
def m(spark):
    df = spark.createDataFrame(ROWS, "task string, mol_id string, doc_id string, assay_id string, year int, y double")
    return df.selectExpr("*", "'s' AS structure", "'T' AS target", "'Ki' AS type").cache()


def test_ceiling(m):
    rows = {r.task: r for r in replicate.ceilings(m).collect()}
    r = rows["T_Ki"]
    assert (r.n_mols_rep, r.n_meas_rep) == (2, 5)
    assert [r.sigma, r.var_y, r.rmse_floor, r.r2_max, r.mae_floor] == pytest.approx([0.439697, 0.536667, 0.335824, 0.789855, 0.267949], abs=1e-6)
    alone = rows["U_X_Ki"]
    assert alone.n_mols_rep == 0 and alone.sigma is None and alone.var_y is None and alone.r2_max is None


def test_no_trim_clips(m):
    r = replicate.ceilings(m, max_range=None).where("task = 'T_Ki'").first()
    assert (r.n_mols_rep, r.n_meas_rep, r.r2_max) == (3, 7, 0.0)
    assert [r.sigma, r.rmse_floor, r.mae_floor] == pytest.approx([1.464582, 1.118593, 0.892508], abs=1e-6)


def test_sensitivity_agrees_with_single_ceilings(m):
    grid = replicate.sensitivity(m, ((2, None), (2, 3.0), (3, 3.0))).where("task = 'T_Ki'").collect()
    by = {(r.min_docs, r.max_range): r for r in grid}
    assert by[(2, 3.0)].sigma == pytest.approx(0.439697, abs=1e-6) and by[(2, None)].sigma == pytest.approx(1.464582, abs=1e-6)
    assert by[(3, 3.0)].n_mols_rep == 1


def test_summary_splits_the_task_at_its_last_underscore(m):
    rows = {r.task: r for r in replicate.task_summary(m, 2).collect()}
    assert (rows["U_X_Ki"].target, rows["U_X_Ki"].type, rows["U_X_Ki"].passes) == ("U_X", "Ki", False)
    assert (rows["T_Ki"].n_mols, rows["T_Ki"].n_rep_mols, rows["T_Ki"].n_docs, rows["T_Ki"].passes) == (4, 3, 3, True)


def test_pairs(m):
    pairs = audit.doc_pairs(m)
    assert sorted(round(r.delta, 6) for r in pairs.collect()) == [0.2, 0.5, 0.7, 0.8, 4.0]
    r = audit.delta_profile(pairs, "k").first()
    assert [r.q50, r.q75, r.q90, r.q95, r.q99, r.max] == pytest.approx([0.7, 0.8, 2.72, 3.36, 3.872, 4.0])
    assert audit.sigma_from_pairs(audit.doc_facts(m)).first().sigma_pairs == pytest.approx(1.319848, abs=1e-6)
    assert audit.within_doc_pairs(m).count() == 1


def test_shift(m):
    rows = {r.doc_id: r for r in audit.doc_shift(m).collect()}
    assert [rows["d1"].n_overlap, rows["d1"].mean_shift, rows["d1"].sd, rows["d1"].se, rows["d1"].z] == pytest.approx([3, -1.75, 1.9564, 1.129528, -1.54932], abs=1e-5)
    assert rows["d2"].z == pytest.approx(1.234743, abs=1e-5) and rows["d3"].sd is None and not any(r.flag_shift for r in rows.values())


def test_permuted_input_gives_the_same(m):
    a = replicate.entities(m).orderBy("task", "mol_id").collect()
    assert a == replicate.entities(m.orderBy("y").repartition(7)).orderBy("task", "mol_id").collect()


@pytest.mark.parametrize("mode", ["hash", "poisson"])
def test_bootstrap_brackets_sigma(spark, mode):
    import random

    rng = random.Random(1)
    rows = [("T", f"m{i}", f"d{j}", "a", 2000, t + rng.gauss(0, 0.5)) for i in range(300) for t in [rng.gauss(0, 1)] for j in range(3)]
    df = spark.createDataFrame(rows, "task string, mol_id string, doc_id string, assay_id string, year int, y double")
    sigma = replicate.ceilings(df).first().sigma
    assert abs(sigma - 0.5) < 0.05 and abs(replicate.ceilings(df).first().r2_max - (1 - 0.25 / 3 / (1 + 0.25 / 3))) < 0.05
    r = resample.ceiling_intervals(df, draws=60, mode=mode).first()
    assert r.sigma_lo < sigma < r.sigma_hi and r.n_valid_draws == 60
    se = (r.sigma_hi - r.sigma_lo) / 3.92
    assert 0.3 < se / (0.5 / math.sqrt(2 * 600)) < 2.5


def test_exact_resamples_draw_as_many_as_there_are(spark):
    """In each resample of each group the draws add up to its entities; sums equal those of the drawn entities, one by one."""
    import hashlib

    rows = [(t, f"m{i}", float(i), s) for t, n in (("a", 40), ("b", 7), ("c", 1)) for i in range(n) for s in ("x", None) if (i + len(s or "")) % 5]
    df = spark.createDataFrame(rows, "task string, mol_id string, v double, side string").withColumn("one", F.lit(1.0))
    got = {(r.task, r.side, r.b): (r.one, r.v) for r in resample.exact_sums(df, ["task", "side"], ["one", "v"], draws=30, seed=5).collect()}
    unit = lambda *k: int(hashlib.md5("|".join(map(str, k)).encode()).hexdigest()[:8], 16)
    for task in "abc":
        mols = sorted({m for t, m, *_ in rows if t == task}, key=lambda m: (unit(0, task, m), m))
        for b in range(30):
            drawn = [mols[unit(5, b, i) % len(mols)] for i in range(len(mols))]
            for side in ("x", None):
                own = {m: v for t, m, v, s in rows if (t, s) == (task, side)}
                expect = (sum(m in own for m in drawn), sum(own.get(m, 0.0) for m in drawn))
                assert got.get((task, side, b), (0, 0.0)) == pytest.approx(expect)
    drawn = resample.hash_weights(df, 30, 5, "task").select("task", F.explode("drawn").alias("b")).groupBy("task", "b").count().collect()
    assert len(drawn) == 90 and {(r.task, r["count"]) for r in drawn} == {("a", len({m for t, m, *_ in rows if t == "a"})), ("b", len({m for t, m, *_ in rows if t == "b"})), ("c", 1)}
    assert resample.exact_sums(df.where("false"), ["task"], ["v"], draws=3).collect() == []


def test_draws_are_counted_where_they_are_made(spark, monkeypatch):
    """Blocks of counts, as many rows as groups, blocks and resamples, hold the draws of the lists; sums over several blocks are theirs."""
    monkeypatch.setattr(resample, "BLOCK", 8)
    monkeypatch.setattr(resample, "HASHED", 5)
    df = spark.createDataFrame([(t, i, float(i * i)) for t, n in (("a", 30), ("b", 9)) for i in range(n)], "task string, mol_id long, v double")
    counts = resample.draw_counts(spark, [30, 9], 20, 3).collect()
    assert len(counts) == (4 + 2) * 20 and sum(sum(r.counts[::2]) for r in counts) == 20 * 39
    drawn = df.join(resample.hash_weights(df, 20, 3, "task"), ["task", "mol_id"]).select("task", F.explode("drawn").alias("b"), "v")
    expect = {(r.task, r.b): r.v for r in drawn.groupBy("task", "b").agg(F.sum("v").alias("v")).collect()}
    assert {(r.task, r.b): r.v for r in resample.exact_sums(df, ["task"], ["v"], 20, 3).collect()} == expect
