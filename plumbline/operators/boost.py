"""Gradient-boosted regression trees for all runs at once, from sums of cells.

Features are binned by exact quantiles. With squared error a tree's histograms, its leaves and its loss need only the number of rows
and the sum of y of each cell, a run's rows with the same bins. So one partial aggregate over all runs gives a table of at most
``CELLS`` cells for each, whatever the number of rows, and every run is boosted from its own table, all settings in one task. The bins
of a feature are so many that their product stays within ``CELLS``; a null feature has a bin of its own.

A run's settings are compared on a hashed fifth of its train, where each also finds its number of trees (the first round of least
error, looked for until ``PATIENCE`` rounds bring nothing); the first best setting is then fitted on all of the train.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stored import kept
from .order import quantiles

CELLS = 1 << 15
PATIENCE = 10
#: Added to the rows of a node, so that small leaves are drawn to 0.
RIDGE = 1.0
RUN = ["task", "split", "seed"]


def binned(rows: DataFrame, features: list[str], bins: int) -> DataFrame:
    """rows with ``cell``, an array with each feature's bin: 0 for null, else 1 more than the cuts below it. Cuts are the distinct
    quantiles of all rows at 1 / bins, 2 / bins, ..."""
    cuts = quantiles(rows, (), {f"{i}_{j}": (f, j / bins) for i, f in enumerate(features) for j in range(1, bins)}).first()
    cell = []
    for i, f in enumerate(features):
        edges = sorted({c for j in range(1, bins) if (c := cuts[f"{i}_{j}"]) is not None})
        x = F.col(f).cast("double")
        below = reduce(lambda n, e, x=x: n + F.when(x > e, 1).otherwise(0), edges, F.lit(1))
        cell.append(F.when(x.isNull() | F.isnan(x), F.lit(0)).otherwise(below))
    return rows.withColumn("cell", F.array(*cell))


class Trees:
    """Boosted level by level on cells: bins (cells x features), n rows and s, the sum of y, of each."""

    def __init__(self, bins: np.ndarray, n: np.ndarray, s: np.ndarray, step: float, depth: int, least: int = 1):
        self.bins, self.n, self.s = bins, n, s
        self.step, self.depth, self.least = step, depth, least
        total = n.sum()
        self.pred = np.full(len(bins), s.sum() / total if total else 0.0)
        self.top = bins.max(axis=0, initial=0) + 1

    def grow(self) -> None:
        """One more tree, added to the predictions of all cells."""
        g = self.s - self.n * self.pred
        node = np.zeros(len(self.n), np.int64)
        nodes = 1
        for _ in range(self.depth):
            best = np.full(nodes, 1e-12)
            choice = np.full((nodes, 2), -1)
            all_n, all_g = np.bincount(node, self.n, nodes), np.bincount(node, g, nodes)
            whole = all_g**2 / (all_n + RIDGE)
            for f, top in enumerate(self.top):
                place = node * top + self.bins[:, f]
                left_n = np.cumsum(np.bincount(place, self.n, nodes * top).reshape(nodes, top), axis=1)
                left_g = np.cumsum(np.bincount(place, g, nodes * top).reshape(nodes, top), axis=1)
                right_n, right_g = all_n[:, None] - left_n, all_g[:, None] - left_g
                gain = left_g**2 / (left_n + RIDGE) + right_g**2 / (right_n + RIDGE) - whole[:, None]
                gain[(left_n < self.least) | (right_n < self.least)] = -np.inf
                at = np.argmax(gain, axis=1)
                value = gain[np.arange(nodes), at]
                # a later feature must be better by more than a sum's rounding
                better = value > best * (1 + 1e-9)
                best[better] = value[better]
                choice[better] = np.stack((np.full(nodes, f), at), 1)[better]
            split = choice[node]
            right = (split[:, 0] >= 0) & (self.bins[np.arange(len(node)), split[:, 0]] > split[:, 1])
            node = 2 * node + right
            nodes *= 2
        leaf_n, leaf_g = np.bincount(node, self.n, nodes), np.bincount(node, g, nodes)
        self.pred += self.step * (leaf_g / (leaf_n + RIDGE))[node]


def tuned(bins: np.ndarray, fit: tuple, held: tuple, settings: list[dict]) -> tuple[dict, int]:
    """The first best of the settings and its number of trees. fit: (n, s) of cells; held: (n, s, q), q the sum of squares."""
    n, s, q = held
    best, size = None, n.sum()
    for setting in settings:
        trees = Trees(bins, *fit, setting["step"], setting["depth"])
        error = lambda: float((q - 2 * trees.pred * s + n * trees.pred**2).sum())  # noqa: B023, E731
        least = (error(), 0)
        for k in range(1, setting["trees"] + 1):
            trees.grow()
            now = error()
            if now < least[0] * (1 - 1e-12):
                least = (now, k)
            if k - least[1] >= PATIENCE:
                break
        if best is None or least[0] < best[0]:
            best = (least[0], setting, least[1])
    return (best[1], best[2]) if size else (settings[0], settings[0]["trees"])


def cells(runs: DataFrame, features: list[str]) -> DataFrame:
    """runs with their cells, written: task, split, seed, mol_id, y, n_docs, part, cell."""
    bins = max(2, int(CELLS ** (1 / len(features))) - 1)
    return kept(binned(runs, features, bins).select(*RUN, "mol_id", "y", "n_docs", "part", "cell"), "cells")


def boosted(runs: DataFrame, features: list[str], settings: list[dict]) -> DataFrame:
    """(task, split, seed, mol_id, y, n_docs, y_train_mean, pred, trees, setting) for the test rows of every run. runs: task, split,
    seed, mol_id, y, n_docs, part and the features; a setting has step, depth and trees, the most of them. A run without train
    rows has no predictions; rows without a y teach nothing."""
    rows = cells(runs, features)
    held = F.pmod(F.xxhash64("task", "mol_id", F.lit(10_000) + F.col("seed")), F.lit(5)) == 0
    y = F.when(~F.isnan("y"), F.col("y"))
    train = (F.col("part") == "train") & y.isNotNull()
    sums = [F.sum(F.when(train & c, v).otherwise(0.0)).alias(n) for c, x in ((~held, "fit"), (held, "held")) for n, v in ((f"n_{x}", F.lit(1.0)), (f"s_{x}", y), (f"q_{x}", y * y))]
    table = rows.groupBy(*RUN, "cell").agg(*sums)

    def boost(df: pd.DataFrame) -> pd.DataFrame:
        df = df.iloc[np.lexsort(np.array(df["cell"].tolist()).T[::-1])]  # an order of its own, so that sums repeat
        bins = np.array(df["cell"].tolist(), np.int64)
        fit, out = (df["n_fit"].to_numpy(), df["s_fit"].to_numpy()), (df["n_held"].to_numpy(), df["s_held"].to_numpy(), df["q_held"].to_numpy())
        n = fit[0] + out[0]
        if not n.sum():
            return df.iloc[:0][[*RUN, "cell"]].assign(y_train_mean=0.0, fitted=0.0, trees=0, setting=0)
        setting, k = tuned(bins, fit, out, settings)
        trees = Trees(bins, n, fit[1] + out[1], setting["step"], setting["depth"])
        mean = float(trees.pred[0])
        for _ in range(k):
            trees.grow()
        return df[[*RUN, "cell"]].assign(y_train_mean=mean, fitted=trees.pred, trees=k, setting=settings.index(setting))

    kinds = ", ".join(f"{c} {runs.schema[c].dataType.simpleString()}" for c in RUN)
    fitted = table.groupBy(*RUN).applyInPandas(boost, f"{kinds}, cell array<int>, y_train_mean double, fitted double, trees int, setting int")
    out = rows.where("part = 'test'").join(fitted, [*RUN, "cell"])
    return out.select(*RUN, "mol_id", "y", "n_docs", "y_train_mean", F.col("fitted").alias("pred"), "trees", "setting")
