"""Boosted trees on cells against trees grown row by row."""

import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from plumbline.operators import boost

SETTINGS = [{"step": 0.3, "depth": 2, "trees": 12}, {"step": 0.5, "depth": 3, "trees": 8}, {"step": 0.05, "depth": 1, "trees": 5}]


class Rows:
    """A plain version: every sum is over rows, one node at a time."""

    def __init__(self, x, y, setting):
        self.x, self.y, self.setting, self.mean, self.trees = x, y, setting, float(np.mean(y)), []
        self.pred = np.full(len(y), self.mean)

    def grow(self):
        def build(rows, depth):
            g = (self.y - self.pred)[rows]
            if depth == 0:
                return g.sum() / (len(rows) + boost.RIDGE)
            best = (1e-12, -1, -1)
            for f in range(self.x.shape[1]):
                own = None
                for at in range(int(self.x[:, f].max()) + 1):
                    left = self.x[rows, f] <= at
                    if not left.any() or left.all():
                        continue
                    a, b = g[left], g[~left]
                    gain = a.sum() ** 2 / (len(a) + boost.RIDGE) + b.sum() ** 2 / (len(b) + boost.RIDGE) - g.sum() ** 2 / (len(g) + boost.RIDGE)
                    if own is None or gain > own[0] * (1 + 1e-9):
                        own = (gain, f, at)
                if own and own[0] > best[0] * (1 + 1e-9):
                    best = own
            _, f, at = best
            if f < 0:
                return build(rows, 0)
            left = self.x[rows, f] <= at
            return f, at, build(rows[left], depth - 1), build(rows[~left], depth - 1)

        self.trees.append(build(np.arange(len(self.y)), self.setting["depth"]))
        self.pred = self.of(self.x)

    def of(self, x):
        def leaf(tree, row):
            while isinstance(tree, tuple):
                tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
            return tree

        return np.array([self.mean + self.setting["step"] * sum(leaf(t, r) for t in self.trees) for r in x])


def plain(x, y, held, test):
    best = None
    for setting in SETTINGS:
        m = Rows(x[~held], y[~held], setting)
        error = lambda: float(((y[held] - m.of(x[held])) ** 2).sum())  # noqa: B023, E731
        least = (error(), 0)
        for k in range(1, setting["trees"] + 1):
            m.grow()
            if error() < least[0] * (1 - 1e-12):
                least = (error(), k)
            if k - least[1] >= boost.PATIENCE:
                break
        if best is None or least[0] < best[0]:
            best = (least[0], setting, least[1])
    m = Rows(x, y, best[1])
    for _ in range(best[2]):
        m.grow()
    return m.of(test), m.mean, best[2], SETTINGS.index(best[1])


def _runs(spark, n=90):
    rng = random.Random(4)
    rows = []
    for task in ("t1", "t2"):
        for seed in (0, 1):
            for i in range(n):
                a, b = rng.randrange(6), rng.choice([None, rng.gauss(0, 1)])
                y = (a > 2) * 2.0 + (b or 0.5) ** 2 + rng.gauss(0, 0.1)
                rows.append((task, "random", seed, i, None if i == 5 else y, 1, a, b, "test" if i % 4 == 0 else "train"))
    rows += [("t3", "random", 0, 1, 2.0, 1, 1, 0.0, "test")]  # no train
    return spark.createDataFrame(rows, "task string, split string, seed int, mol_id long, y double, n_docs long, a int, b double, part string")


def test_boosted_equals_trees_over_rows(spark):
    runs = _runs(spark)
    got = boost.boosted(runs, ["a", "b"], SETTINGS).collect()
    bins = int(boost.CELLS**0.5) - 1
    held = F.pmod(F.xxhash64("task", "mol_id", F.lit(10_000) + F.col("seed")), F.lit(5)) == 0
    rows = boost.binned(runs, ["a", "b"], bins).withColumn("held", held).where("task <> 't3'").collect()
    assert {r.task for r in got} == {"t1", "t2"}
    for task in ("t1", "t2"):
        for seed in (0, 1):
            own = [r for r in rows if (r.task, r.seed) == (task, seed)]
            train, test = [r for r in own if r.part == "train" and r.y is not None], [r for r in own if r.part == "test"]
            cells = lambda rs: np.array([r.cell for r in rs])
            pred, mean, k, setting = plain(cells(train), np.array([r.y for r in train]), np.array([r.held for r in train]), cells(test))
            mine = {r.mol_id: r for r in got if (r.task, r.seed) == (task, seed)}
            assert [mine[r.mol_id].pred for r in test] == pytest.approx(pred.tolist(), abs=1e-9)
            assert {(r.trees, r.setting) for r in mine.values()} == {(k, setting)} and next(iter(mine.values())).y_train_mean == pytest.approx(mean)


def test_bins_have_a_place_for_null(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (None,), (3.0,), (float("nan"),)], "x double")
    got = [r.cell[0] for r in boost.binned(df, ["x"], 3).orderBy(F.monotonically_increasing_id()).collect()]
    assert got[2] == got[4] == 0 and got[0] < got[3] and min(got[0], got[1], got[3]) == 1
