import pytest

from pyspark.sql import functions as F

from plumbline.functions import safe
from plumbline.operators import evaluate, significance, slices


def test_holm_and_bh(spark):
    # by hand: sorted .002 .02 .024 .2, times 4 3 2 1, then the running maximum; and times 4/1 4/2 4/3 4/4, then the minimum from above
    df = spark.createDataFrame([("a", 0.2), ("b", 0.002), ("c", 0.024), ("d", 0.02), ("e", None), ("f", float("nan"))], "k string, p double")
    rows = {r.k: (r.p_holm, r.p_bh) for r in significance.adjusted(df, "p", unique=("k",)).collect()}
    assert [rows[k][0] for k in "abcd"] == pytest.approx([0.2, 0.008, 0.06, 0.06])
    assert [rows[k][1] for k in "abcd"] == pytest.approx([0.2, 0.008, 0.032, 0.032])
    assert rows["e"] == rows["f"] == (None, None)


def test_signed_rank():
    assert significance.signed_rank([-1, -2, -3, -4, -5, -6, -7, -8]) == pytest.approx(2 / 2**8)
    assert significance.signed_rank([-1, -2, -3, -4, -5]) is None and significance.signed_rank([0.0] * 8) is None
    assert 0 < significance.signed_rank([1, -1, 2, 2, 3, 4, 0]) <= 1


def test_metrics_and_ranks(spark):
    rows = [("t", "s", 0, "m", f"e{i}", y, p, 1, 6.5) for i, (y, p) in enumerate([(5.0, 5.5), (6.0, 5.5), (7.0, 7.5), (8.0, 7.0)])]
    rows += [("t", "s", 0, "flat", f"e{i}", float(i), 1.0, 1, 1.5) for i in range(3)]
    df = spark.createDataFrame(rows, "task string, split string, seed int, model string, mol_id string, y double, pred double, n_docs long, y_train_mean double")
    got = {r.model: r for r in evaluate.metrics(df).collect()}
    r = got["m"]
    assert [r.rmse, r.mae, r.r2, r.spearman] == pytest.approx([0.661438, 0.625, 0.65, 0.737865], abs=1e-6)
    assert got["flat"].spearman is None


def test_fraction_of_ceiling(spark):
    df = spark.createDataFrame([(0.6, 1.0, 0.2), (0.6, 1.0, 1.0), (0.1, 1.0, None)], "rmse double, mean double, floor double")
    got = [r.f for r in df.select(safe.fraction_of_ceiling("rmse", "mean", "floor").alias("f")).collect()]
    assert got[0] == pytest.approx(0.5) and got[1] is None and got[2] is None


def test_clip_and_ratio_keep_null(spark):
    r = spark.range(1).select(safe.clip(F.lit(None).cast("double"), 0, 1).alias("a"), safe.ratio(F.lit(1.0), F.lit(0.0)).alias("b"), safe.clip(F.lit(-2.0), 0.0, 1.0).alias("c")).first()
    assert tuple(r) == (None, None, 0.0)


def test_power(spark):
    r = spark.range(1).select(safe.mde(F.lit(1.0)).alias("z"), safe.mde_rmse(F.lit(400.0), F.lit(0.5), F.lit(0.25), F.lit(0.7)).alias("m"), safe.chance_above(F.lit(1.96 * 2**0.5), F.lit(1.0)).alias("p")).first()
    assert r.z == pytest.approx(2.801585, abs=1e-6) and r.p == pytest.approx(0.049996, abs=1e-5) and 0.04 < r.m < 0.12


def test_ks(spark):
    df = spark.createDataFrame([(float(i), i < 5) for i in range(10)], "v double, side boolean").withColumn("g", F.lit(1))
    assert significance.ks(df, "v", "side", "g").first().ks == 1.0
    assert significance.ks(df.where("side"), "v", "side", "g").first().ks is None


def test_verdicts_and_bins(spark):
    df = spark.createDataFrame([(-2.0, -1.0), (-1.0, 1.0), (1.0, 2.0), (None, 1.0)], "lo double, hi double")
    assert [r[0] for r in df.select(slices.verdict("lo", "hi")).collect()] == ["model better", "within noise", "model worse", "no data"]
    df = spark.createDataFrame([(0.0,), (0.4,), (0.8,), (1.0,), (None,)], "x double")
    assert [r[0] for r in df.select(slices.similarity_bin("x")).collect()] == ["<0.4", "0.4-0.6", ">=0.8", ">=0.8", None]
