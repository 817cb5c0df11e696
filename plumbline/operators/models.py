"""Models to judge: ridge regression from Gram sums, forests, boosted trees by MLlib, and a choice among settings."""

from __future__ import annotations

import random
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stored import kept
from . import forest

GRIDS = {
    "ridge": {"alpha": [1.0, 10.0, 100.0, 1000.0, 3000.0, 10000.0]},
    "rf": {"featureSubsetStrategy": ["sqrt", "0.2", "0.5"], "minInstancesPerNode": [1, 2, 5]},
    "gbm": {"stepSize": [0.03, 0.05, 0.1], "maxIter": [20, 40], "maxDepth": [4, 5, 6]},
}
DEFAULTS = {"rf": {"numTrees": 300, "maxDepth": 8}, "gbm": {"maxIter": 60, "stepSize": 0.05, "maxDepth": 5}}


def family(name: str) -> tuple[str, str]:
    """(features, head) of a model's name: ``ecfp_gbm`` or ``emb-<encoder>_<head>``, a variant after a colon left out."""
    features, _, head = name.split(":")[0].rpartition("_")
    if not features or head not in GRIDS:
        raise ValueError(f"no model of the name {name}")
    return features, head


def dimension(df: DataFrame, features: str) -> int:
    return df.agg(F.max(F.size(features))).first()[0] or 0


def gram(df: DataFrame, features: str, y: str) -> DataFrame:
    """(i, j, v), i <= j: sums of products of all components, a one and y, the last: all that a linear fit needs. Tasks add up outer
    products, so that what is shuffled is one matrix for each. Vectors shorter than the longest end in zeros."""
    d = dimension(df, features)

    def task(batches):
        total = np.zeros((d + 2, d + 2))
        for batch in batches:
            v, x = batch.column("v"), np.zeros((batch.num_rows, d + 2))
            length, flat = np.diff(v.offsets.to_numpy()), v.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(length)), length)
            x[row, np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)] = flat
            x[:, d], x[:, d + 1] = 1.0, batch.column("y").to_numpy(zero_copy_only=False)
            total += x.T @ x
        i, j = np.triu_indices(d + 2)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], names=["i", "j", "v"])

    whole = df.where(F.col(features).isNotNull() & F.col(y).isNotNull())
    sent = whole.select(F.transform(features, lambda v: F.coalesce(v.cast("double"), F.lit(0.0))).alias("v"), F.col(y).cast("double").alias("y"))
    return sent.mapInArrow(task, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))


def ridge(df: DataFrame, features: str, y: str, alpha: float = 10.0, scale: bool = True) -> tuple[np.ndarray, float]:
    """Weights and intercept, the intercept not shrunk, from the (d + 2) squared sums; with scale, alpha applies to components of unit
    variance, and one without variance has no weight."""
    cells = gram(df, features, y).collect()
    size = max((r.j for r in cells), default=1) + 1
    g = np.zeros((size, size))
    for r in cells:
        g[r.i, r.j] = g[r.j, r.i] = r.v
    d, n = size - 2, g[size - 2, size - 2]
    if not n:
        return np.zeros(d), 0.0
    mean, y_mean = g[:d, d] / n, g[d, d + 1] / n
    cov, xy = g[:d, :d] - n * np.outer(mean, mean), g[:d, d + 1] - n * mean * y_mean
    sd = np.sqrt(np.maximum(np.diag(cov) / n, 0)) if scale else np.ones(d)
    use = sd > 1e-12
    w = np.zeros(d)
    w[use] = np.linalg.solve(cov[np.ix_(use, use)] / np.outer(sd[use], sd[use]) + alpha * np.eye(use.sum()), xy[use] / sd[use]) / sd[use]
    return w, float(y_mean - mean @ w)


def linear(df: DataFrame, features: str, weights, intercept: float, to: str = "pred") -> DataFrame:
    w = F.array(*[F.lit(float(x)) for x in weights])
    terms = F.zip_with(F.slice(features, 1, len(weights)), w, lambda a, b: a.cast("double") * b)
    return df.withColumn(to, F.aggregate(terms, F.lit(float(intercept)), lambda s, x: s + x))


def configurations(family: str, trials: int, seed: int = 0) -> list[dict]:
    """Distinct settings of a family's grid in random order, at most all of them."""
    grid = GRIDS[family]
    all_ = [dict(zip(grid, v)) for v in product(*grid.values())]
    random.Random(seed).shuffle(all_)
    return all_[:trials]


def ensemble(family: str, train: DataFrame, rows: DataFrame, inputs: list[str], seed: int = 0, **settings) -> DataFrame:
    """rows with ``pred``: forests by :mod:`.forest`, boosted trees by MLlib."""
    if family == "rf":
        return forest.predicted(train, rows, inputs, seed, **settings)
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    vectors = VectorAssembler(inputCols=inputs, outputCol="vector")
    model = GBTRegressor(featuresCol="vector", labelCol="y", predictionCol="pred", seed=seed, **settings).fit(vectors.transform(train))
    return model.transform(vectors.transform(rows))


def fit_predict(parts: DataFrame, inputs: list[str], family: str, trials: int = 0, seed: int = 0) -> DataFrame:
    """Predictions for the test rows. With trials, settings are compared on a hashed fifth of the train, the first best wins, and
    it is fitted on all of the train. Rows that lack an input have no part."""
    from pyspark.ml.evaluation import RegressionEvaluator

    whole = reduce(lambda a, b: a & b, (F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in inputs))
    rows = kept(parts.where(whole).select("task", "mol_id", "y", "part", *inputs), "parts")
    train = rows.where("part = 'train'")
    best: dict = DEFAULTS[family]
    if trials:
        held = F.pmod(F.xxhash64("task", "mol_id", F.lit(10_000 + seed)), F.lit(5)) == 0
        score = RegressionEvaluator(labelCol="y", predictionCol="pred", metricName="rmse").evaluate
        tried = [(score(ensemble(family, train.where(~held), train.where(held), inputs, seed, **DEFAULTS[family] | c)), k, c) for k, c in enumerate(configurations(family, trials, seed))]
        best = best | min(tried, key=lambda t: t[:2])[2]
    return ensemble(family, train, rows.where("part = 'test'"), inputs, seed, **best).select("task", "mol_id", "y", "pred")


def masked_mean(df: DataFrame, tokens: str, mask: str) -> DataFrame:
    """Mean of the token vectors whose mask is 1, component by component."""
    used = F.filter(F.arrays_zip(F.col(tokens).alias("v"), F.col(mask).alias("m")), lambda t: t["m"] == 1)
    total = F.aggregate(used, F.transform(F.get(tokens, F.lit(0)), lambda x: F.lit(0.0)), lambda s, t: F.zip_with(s, t["v"], lambda a, b: a + b))
    return df.withColumn("pooled", F.when(F.size(used) > 0, F.transform(total, lambda x: x / F.size(used))))


def strict_lookup(df: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """df with its vectors; an id without one is an error."""
    missing = df.join(vectors, key, "left_anti").limit(5).collect()
    if missing:
        raise KeyError(f"no vector for {[r[key] for r in missing]}")
    return df.join(vectors, key)
