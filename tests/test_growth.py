"""Steps whose rows stay where they are: plans without the exchanges, and results as plain counts give them."""

import os
import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from plumbline.operators import evaluate, order, replicate, resample, slices, splits
from plumbline.plans import catalogue
from plumbline.sources import tables

PARTS = "task string, split string, seed int, mol_id long, structure string, y double, n_docs long, part string, g string"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def parts(spark, n=60):
    rng = random.Random(5)
    rows = [(t, "s", seed, i, f"x{i % 4}", rng.uniform(0, 6), 1 + i % 3, rng.choice(["test", "train"]), f"g{i % 5}") for t in "ab" for seed in (0, 1) for i in range(n)]
    y = {(r[0], r[3]): r[5] for r in rows}
    return spark.createDataFrame([(*r[:5], y[r[0], r[3]], *r[6:]) for r in rows], PARTS)


def test_predictions_move_no_entity(spark):
    p = evaluate.group_mean_predictions(parts(spark), {"all": None, "own": "g"})
    assert "Exchange hashpartitioning" not in plan(p)
    assert p.columns == ["task", "split", "seed", "model", "mol_id", "y", "pred", "n_docs", "y_train_mean"]


def test_a_rank_is_one_sort(spark):
    df = spark.createDataFrame([("a", float(i % 7), float(i)) for i in range(50)], "t string, x double, z double")
    assert plan(order.ranks(df, ["t"], {"rx": "x", "rz": "z"}, stored=True)).count("Exchange hashpartitioning") == 1


def test_all_splits_are_the_splits(spark):
    rng = random.Random(8)
    rows = [(t, i, f"s{rng.randrange(9)}" if i % 7 else None, rng.choice([None, 2000, 2001, 2002])) for t in ("A", "B") for i in range(70)]
    e = spark.createDataFrame(rows, "task string, mol_id long, structure string, first_year int")
    every = splits.all_splits(e, seeds=(0, 3))
    assert "Exchange" not in plan(every)
    got = {(r.task, r.split, r.seed, r.mol_id): r.part for r in every.collect()}
    assert len(got) == 6 * len(rows)
    for name, split in splits.SPLITS.items():
        for seed in (0, 3):
            assert {(r.task, r.mol_id): r.part for r in split(e, seed).collect()} == {(t, m): p for (t, n, s, m), p in got.items() if (n, s) == (name, seed)}


def test_weights_are_those_of_the_generator():
    state = np.array([1, 2, 48271, resample.PRIME - 1, *np.random.default_rng(0).integers(1, resample.PRIME, 200)], np.int64)
    plain = state[:, None] * np.array(resample.factors(70), np.int64) % resample.PRIME
    assert (resample.poisson_weights(state, 70) == sum(plain >= s for s in resample.STEPS)).all()


def test_resamples_need_no_sums_by_entity(spark):
    p = evaluate.group_mean_predictions(parts(spark), {"all": None, "own": "g"})
    c = spark.createDataFrame([("a", 0.5), ("b", 0.7)], "task string, sigma double")
    drawn = resample.fraction_draws(p, c, 20)
    assert "mol_id#" not in "".join(x.split("\n")[0] for x in plan(drawn).split("Exchange hashpartitioning(")[1:])
    by, values = ["task", "split", "model"], ["n", "e2", "b2", "inv"]
    plain = resample._fractions(resample.poisson_sums(resample.pooled_sums(p), by, values, 20), c, *by, "b")
    rows = lambda df: {(r.task, r.split, r.model, r.b): (r.rmse, r.frac) for r in df.collect()}
    got, expect = rows(drawn), rows(plain)
    assert len(got) == 80 and got.keys() == expect.keys() and all(got[k] == pytest.approx(expect[k]) for k in got)


def test_context_and_cells_by_plain_counts(spark):
    df = parts(spark)
    pairs = [(f"x{a}", f"x{b}", 1.0 if a == b else 0.8 if abs(a - b) == 1 else 0.5) for a in range(4) for b in range(4)]
    context = slices.structure_context(df, spark.createDataFrame(pairs, "structure string, other string, sim double"))
    assert context.count() <= 2 * 2 * 4  # a row for each structure, not for each entity
    data, sim = df.collect(), {(a, b): s for a, b, s in pairs}
    got = {(r.task, r.seed, r.mol_id): (r.max_sim, r.cliff) for r in slices.in_context(df.where("part = 'test'"), context).collect()}
    for r in data:
        if r.part == "test":
            train = [(sim[r.structure, q.structure], abs(r.y - q.y)) for q in data if (q.task, q.seed, q.part) == (r.task, r.seed, "train")]
            assert got[r.task, r.seed, r.mol_id] == (max(s for s, _ in train), any(s >= 0.8 and d >= 1.5 for s, d in train))
    e = slices.errors(evaluate.tested(slices.with_slices(df, context), {"base": None, "own": "g"}, ("slices",)), "base")
    out = {(r.slice_type, r.slice_value, r.task): (r.n_mols, r.n) for r in slices._admitted(e, 1).collect()}
    expect = {}
    for r in slices.labelled(df, context).collect():
        expect.setdefault((r.slice_type, r.slice_value, r.task), []).append(r.mol_id)
    assert out == {k: (len(set(v)), len(v)) for k, v in expect.items()}


def test_entities_are_dealt_by_the_size_of_the_input(spark, sf, monkeypatch):
    """The rows of a task stay as many: more files, more tasks; and one exchange does for both sums."""
    monkeypatch.setattr(tables, "DEALT", os.path.getsize(f"{sf}/lineitem.parquet") // 10)
    df = catalogue.QUERIES["entity_stats"](spark, sf)
    dealt = [x.split("\n")[0] for x in plan(df).split("Exchange hashpartitioning(")[1:] if "mol_id" in x.split(")")[0]]
    assert len(dealt) == 1 and int(dealt[0].split(", ")[1].split(")")[0]) >= 10
    plain = replicate.entity_stats(replicate.doc_level(tables.measurements(spark, sf)))
    got, expect = ({(r.task, r.mol_id): (r.n, r["mean"], r.ss, r.range) for r in x.collect()} for x in (df, plain))
    assert got.keys() == expect.keys() and all(got[k] == pytest.approx(expect[k], abs=2e-6) for k in got)
