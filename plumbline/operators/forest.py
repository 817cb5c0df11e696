"""Random forests of regression trees from sums of cells, with the settings of MLlib's: Poisson bags, at most 32 bins a feature, some of
the features at each node, a leaf where nothing is gained.

A tree needs the bagged number of rows and sum of y of each cell, the rows of equal bins. Rows meet their weights in all trees where
they are; what moves is a table of cells for each task and tree, whatever the number of rows, and a tree is grown in one group. Bags
and choices come from hashes of keys and the seed, so they don't depend on how rows lie.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stored import kept
from .boost import CELLS
from .order import quantiles
from .resample import PRIME, poisson_weights
from .splits import hash_unit

BINS = 32
#: Rows whose weights a task holds at once.
ROWS = 4096


def edges(rows: DataFrame, features: list[str]) -> list[list[float]]:
    """The cuts of each feature: between all of its values if a bin can hold each, else its distinct quantiles."""
    bins, out = min(BINS, int(CELLS ** (1 / len(features)) + 1e-9)), []
    many = {}
    for i, f in enumerate(features):
        values = sorted(r[0] for r in rows.select(F.col(f).cast("double")).distinct().limit(bins + 1).collect())
        out.append(values[:-1])
        if len(values) > bins:
            many |= {(i, j): (f, j / bins) for j in range(1, bins)}
    if many:
        cuts = quantiles(rows, (), {f"{i}_{j}": v for (i, j), v in many.items()}).first()
        for i in {i for i, _ in many}:
            out[i] = sorted({cuts[f"{i}_{j}"] for k, j in many if k == i})
    return out


def per_node(strategy: str, features: int) -> int:
    """Features that a node looks at, by MLlib's names of them."""
    if strategy in ("auto", "onethird", "sqrt", "all"):
        return {"sqrt": math.ceil(math.sqrt(features)), "all": features}.get(strategy, math.ceil(features / 3))
    return math.ceil(float(strategy) * features)


def grown(bins: np.ndarray, n: np.ndarray, s: np.ndarray, depth: int, least: int, pick: int, rng) -> np.ndarray:
    """A tree's value for each cell. bins: cells x features; n and s: the rows of the bag and their sum of y."""
    mean = s.sum() / n.sum()
    g, node, nodes, open_ = s - n * mean, np.zeros(len(n), np.int64), 1, np.ones(1, bool)
    floor = 1e-12 * max(1.0, float(np.abs(s).sum()))
    for _ in range(depth):
        best, choice = np.full(nodes, floor), np.full((nodes, 2), -1)
        looked = rng.random((nodes, bins.shape[1])).argsort(axis=1).argsort(axis=1) < pick
        all_n, all_g = np.bincount(node, n, nodes), np.bincount(node, g, nodes)
        for f, top in enumerate(bins.max(axis=0) + 1):
            place = node * top + bins[:, f]
            left_n, left_g = (np.cumsum(np.bincount(place, v, nodes * top).reshape(nodes, top), axis=1) for v in (n, g))
            right_n, right_g = all_n[:, None] - left_n, all_g[:, None] - left_g
            gain = left_g**2 / np.maximum(left_n, 1) + right_g**2 / np.maximum(right_n, 1) - (all_g**2 / np.maximum(all_n, 1))[:, None]
            gain[(left_n < least) | (right_n < least) | ~looked[:, f, None] | ~open_[:, None]] = -np.inf
            at = np.argmax(gain, axis=1)
            value = gain[np.arange(nodes), at]
            better = value > best * (1 + 1e-9)
            best[better] = value[better]
            choice[better] = np.stack((np.full(nodes, f), at), 1)[better]
        split = choice[node]
        node = 2 * node + ((split[:, 0] >= 0) & (bins[np.arange(len(node)), split[:, 0]] > split[:, 1]))
        # a node that isn't split is a leaf: other features aren't tried on it later
        nodes, open_ = 2 * nodes, np.repeat(choice[:, 0] >= 0, 2)
    return mean + (np.bincount(node, g, nodes) / np.maximum(np.bincount(node, n, nodes), 1))[node]


def predicted(train: DataFrame, rows: DataFrame, inputs: list[str], seed: int = 0, numTrees: int = 300, maxDepth: int = 8, featureSubsetStrategy: str = "auto", minInstancesPerNode: int = 1) -> DataFrame:
    """rows with ``pred``, the mean of the trees that train teaches. Both have task, mol_id, y and the inputs, none of them null."""
    cuts = edges(train, inputs)
    tops = [len(c) + 1 for c in cuts]
    cells = math.prod(tops)
    binned = [reduce(lambda k, e, f=f: k + F.when(F.col(f) > e, 1).otherwise(0), c, F.lit(0)) for f, c in zip(inputs, cuts)]
    cell = reduce(lambda code, b: code * b[1] + b[0], zip(binned, tops), F.lit(0)).cast("int")
    pick, trees, width = per_node(featureSubsetStrategy, len(inputs)), numTrees, len(inputs)

    def bag(batches):
        n, s = np.zeros((cells, trees)), np.zeros((cells, trees))
        for batch in batches:
            code, state, y = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "state", "y"))
            for at in range(0, len(code), ROWS):
                order = at + np.argsort(code[at : at + ROWS], kind="stable")
                own = code[order]
                starts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                w = poisson_weights(state[order], trees).astype(np.float64)
                n[own[starts]] += np.add.reduceat(w, starts, axis=0)
                w *= y[order, None]
                s[own[starts]] += np.add.reduceat(w, starts, axis=0)
        offsets = pa.array(np.arange(0, (trees + 1) * cells, cells, dtype=np.int32))
        columns = [pa.array(np.arange(trees, dtype=np.int32)), *(pa.ListArray.from_arrays(offsets, pa.array(v.T.ravel())) for v in (n, s))]
        yield pa.RecordBatch.from_arrays(columns, names=["tree", "n", "s"])

    def grow(df: pd.DataFrame) -> pd.DataFrame:
        n, s = (np.sum(np.stack(df[c].tolist()), axis=0) for c in ("n", "s"))
        if not n.any():
            return pd.DataFrame({"tree": df["tree"].iloc[:0], "fitted": []})
        bins = np.stack(np.unravel_index(np.arange(cells), tops), 1).reshape(cells, width)
        tree = int(df["tree"].iloc[0])
        return pd.DataFrame({"tree": [tree], "fitted": [grown(bins, n, s, maxDepth, minInstancesPerNode, pick, np.random.default_rng([seed, tree]))]})

    sent = train.select(cell.alias("cell"), (hash_unit(seed, "task", "mol_id") % (PRIME - 1) + 1).alias("state"), F.col("y").cast("double").alias("y"))
    forest = sent.mapInArrow(bag, "tree int, n array<double>, s array<double>").groupBy("tree").applyInPandas(grow, "tree int, fitted array<double>")
    fitted = kept(forest.select(F.posexplode("fitted").alias("__cell", "v")).groupBy("__cell").agg(F.avg("v").alias("pred")), "forest")
    return rows.withColumn("__cell", cell).join(F.broadcast(fitted), "__cell").drop("__cell")
