"""Forests from cells."""

import random

import numpy as np
import pytest

from plumbline.operators import forest, models
from plumbline.operators.resample import PRIME, poisson_weights
from plumbline.operators.splits import hash_unit

PARTS = "task string, mol_id long, a int, b double, y double, part string"


def _rows(n=400):
    rng = random.Random(6)
    rows = [("ab"[i % 2], i, rng.randrange(60), rng.choice([0.5, 1.0, 3.0]), "test" if i % 5 == 0 else "train") for i in range(n)]
    return [(t, i, a, b, float(a > 20) + b * (a > 40) + rng.gauss(0, 0.1), p) for t, i, a, b, p in rows] + [("a", n, None, 1.0, 1.0, "test"), ("a", n + 1, 3, float("nan"), 1.0, "train")]


def test_a_forest_does_not_depend_on_how_rows_lie(spark, monkeypatch):
    monkeypatch.setitem(models.DEFAULTS, "rf", {"numTrees": 20, "maxDepth": 4})
    df = spark.createDataFrame(_rows(), PARTS)
    one, other = ({(r.task, r.mol_id): r.pred for r in models.fit_predict(df.repartition(k, c), ["a", "b"], "rf").collect()} for k, c in ((1, "y"), (7, "mol_id")))
    assert one.keys() == other.keys() and len(one) == 80 and all(one[k] == pytest.approx(other[k], abs=1e-9) for k in one)


def test_a_tree_by_rows(spark, monkeypatch):
    """All features at each node: trees as a plain search over the bagged rows grows them."""
    monkeypatch.setattr(forest, "ROWS", 50)
    rows = [r for r in _rows() if r[2] is not None and r[3] == r[3]]
    df = spark.createDataFrame(rows, PARTS)
    train = df.where("part = 'train'")
    got = {r.mol_id: r.pred for r in forest.predicted(train, df, ["a", "b"], 3, numTrees=3, maxDepth=3, featureSubsetStrategy="all", minInstancesPerNode=2).collect()}
    cuts = forest.edges(train, ["a", "b"])
    assert cuts[1] == [0.5, 1.0] and 20 < len(cuts[0]) < 32
    state = {r.mol_id: r.s for r in train.select("mol_id", (hash_unit(3, "task", "mol_id") % (PRIME - 1) + 1).alias("s")).collect()}
    x = np.array([(sum(r[2] > c for c in cuts[0]), sum(r[3] > c for c in cuts[1])) for r in rows])
    own = np.array([i for i, r in enumerate(rows) if r[5] == "train"])
    weights, y = poisson_weights(np.array([state[rows[i][1]] for i in own]), 3), np.array([r[4] for r in rows])
    out = np.zeros(len(rows))

    def tree(mine, taught, w, depth):
        error = lambda i, v: (v * (y[i] - np.average(y[i], weights=v)) ** 2).sum()
        found = (1e-9, None)
        for f in range(2) if depth else ():
            for c in range(x[:, f].max()):
                left = x[taught, f] <= c
                if w[left].sum() >= 2 and w[~left].sum() >= 2:
                    gain = error(taught, w) - error(taught[left], w[left]) - error(taught[~left], w[~left])
                    if gain > found[0] * (1 + 1e-9):
                        found = (gain, (f, c))
        if not found[1]:
            out[mine] += np.average(y[taught], weights=w) / 3
            return
        f, c = found[1]
        for side in (True, False):
            here = (x[taught, f] <= c) == side
            tree(mine[(x[mine, f] <= c) == side], taught[here], w[here], depth - 1)

    for b in range(3):
        tree(np.arange(len(rows)), own, weights[:, b].astype(float), 3)
    assert len(got) == len(rows) and all(got[r[1]] == pytest.approx(o, abs=1e-9) for r, o in zip(rows, out))
