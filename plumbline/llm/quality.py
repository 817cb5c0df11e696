"""Text quality by a generalised additive model with pairwise interactions.

Cyclic boosting visits one feature after another; each visit fits a tree of at most three leaves to the current gradient over
the feature's bins and adds a small part of it to the feature's lookup table. Then the pairs of features with the largest
remaining gain get two-way tables, boosted in the same cycle by trees of four leaves. A score is the sum of the tables' entries
for a text's bins, taken for a whole Arrow batch at once.

The model is made of at most ``SAMPLE`` labelled rows, the least by a hash of the id; only their features reach the driver.
"""

from __future__ import annotations

import operator
import unicodedata
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from .common import doc_crc, teaching, written

SAMPLE = 20_000
BINS = 32
ROUNDS = 150
PAIR_ROUNDS = 60
PAIRS = 6
PAIR_BINS = 8
RATE = 0.1
RIDGE = 1.0

FEATURES = (
    "log_chars", "log_words", "word_length", "upper_share", "symbol_share", "bars", "exclamations", "digit_share",
    "stops", "other_share", "distinct_words", "repeated_words", "repeated_lines", "lines", "short_words", "ascii_share",
    "longest_line", "last_stop",
)


UPPER, LOWER, LETTER, DIGIT, SPACE, SYMBOL, STOP, OTHER = range(8)
#: Marks that end a sentence or its parts, and symbols of markup.
STOPS, SYMBOLS = ".,;:?。、，．；：？…！؟؛،।·", "#$%&*@~^_=+<>{}[]\\/"
_ENDS = frozenset(".!?。！？…।؟")


def _classes() -> np.ndarray:
    """A class for each code point of the basic plane, from its Unicode category; letters without case are LETTER."""
    kinds = {"Lu": UPPER, "Lt": UPPER, "Ll": LOWER, "Lo": LETTER, "Lm": LETTER, "Mn": LETTER, "Mc": LETTER, "Nd": DIGIT, "Zs": SPACE}
    out = np.array([kinds.get(unicodedata.category(chr(c)), OTHER) for c in range(1 << 16)], np.uint8)
    for chars, kind in ((" \t\n\r", SPACE), (STOPS, STOP), (SYMBOLS, SYMBOL)):
        out[[ord(c) for c in chars]] = kind
    return out


_CLASS = _classes()


def features(text: str | None) -> list[float]:
    """All 0 for a null text or one without words. Characters beyond the basic plane are of no class."""
    found = (text or "").split()
    if not found:
        return [0.0] * len(FEATURES)
    n, chars = len(found), len(text)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    seen = np.bincount(_CLASS[np.minimum(points, 0xFFFF)], minlength=8)
    cased, lines = seen[UPPER] + seen[LOWER], text.split("\n")
    return [
        np.log1p(chars), np.log1p(n), (chars - seen[SPACE]) / n, seen[UPPER] / max(cased, 1), seen[SYMBOL] / chars,
        text.count("|") / n, (text.count("!") + text.count("！")) / n, seen[DIGIT] / chars, seen[STOP] / n,
        seen[OTHER] / chars,
        len(set(found)) / n, sum(map(operator.eq, found, found[1:])) / n, 1 - len(set(lines)) / len(lines), len(lines) / n,
        sum(len(w) < 4 for w in found) / n, np.count_nonzero(points < 128) / chars, np.log1p(max(map(len, lines))),
        float(text.rstrip()[-1:] in _ENDS),
    ]


def _leaf(g: np.ndarray, h: np.ndarray):
    return g / (h + RIDGE)


def _gain(g, h):
    return g * g / (h + RIDGE)


def _split(g: np.ndarray, h: np.ndarray) -> int:
    """The number of bins left of the best cut, 0 for none."""
    if len(g) < 2:
        return 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = _gain(gl, hl) + _gain(g.sum() - gl, h.sum() - hl) - _gain(g.sum(), h.sum())
    best = int(np.argmax(gain))
    return best + 1 if gain[best] > 1e-9 else 0


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A value for each bin, of at most three leaves."""
    first = _split(g, h)
    if not first:
        return np.full(len(g), _leaf(g.sum(), h.sum()))
    parts = [slice(0, first), slice(first, len(g))]
    cuts = [_split(g[p], h[p]) for p in parts]
    gains = [sum(_gain(g[p][s].sum(), h[p][s].sum()) for s in (slice(0, c), slice(c, None))) - _gain(g[p].sum(), h[p].sum()) if c else 0 for p, c in zip(parts, cuts)]
    edges = {0, first, len(g)}
    k = int(np.argmax(gains))
    if cuts[k]:
        edges.add(parts[k].start + cuts[k])
    out, edges = np.zeros(len(g)), sorted(edges)
    for a, b in zip(edges, edges[1:]):
        out[a:b] = _leaf(g[a:b].sum(), h[a:b].sum())
    return out


def _corner(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and table of the best tree with one cut in either dimension."""
    gc, hc = np.cumsum(np.cumsum(g, 0), 1), np.cumsum(np.cumsum(h, 0), 1)
    a, b = gc[:-1, :-1], hc[:-1, :-1]
    quarters = [(a, b), (gc[:-1, -1:] - a, hc[:-1, -1:] - b), (gc[-1:, :-1] - a, hc[-1:, :-1] - b)]
    quarters.append((gc[-1, -1] - sum(q[0] for q in quarters), hc[-1, -1] - sum(q[1] for q in quarters)))
    gain = sum(_gain(*q) for q in quarters) - _gain(gc[-1, -1], hc[-1, -1])
    if not gain.size:
        return 0.0, np.zeros_like(g)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    out = np.zeros_like(g)
    for rows in (slice(0, i + 1), slice(i + 1, None)):
        for cols in (slice(0, j + 1), slice(j + 1, None)):
            out[rows, cols] = _leaf(g[rows, cols].sum(), h[rows, cols].sum())
    return float(gain[i, j]), out


class Additive:
    def __init__(self, x: np.ndarray, y: np.ndarray):
        """No rows, or rows of one class, give one score for all texts."""
        n, d = x.shape
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if n else np.zeros(0) for j in range(d)]
        self.coarse = [e[:: max(1, -(-len(e) // (PAIR_BINS - 1)))] for e in self.edges]
        rate = (y.sum() + 1) / (n + 2)
        self.base = float(np.log(rate / (1 - rate)))
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.pairs: list[tuple[int, int, np.ndarray]] = []
        if n == 0 or y.min() == y.max():
            return
        bins, z = self._bins(x, self.edges), np.full(n, self.base)
        for _ in range(ROUNDS):
            for j in range(d):
                z += self._visit(bins[j], y, z, self.tables[j])
        two = self._bins(x, self.coarse)
        g, h = self._slope(y, z)
        ranked = []
        for i, j in combinations(range(d), 2):
            shape = len(self.coarse[i]) + 1, len(self.coarse[j]) + 1
            at = two[i] * shape[1] + two[j]
            ranked.append((_corner(*(np.bincount(at, weights=w, minlength=shape[0] * shape[1]).reshape(shape) for w in (g, h)))[0], i, j))
        chosen = [(i, j) for gain, i, j in sorted(ranked, reverse=True)[:PAIRS] if gain > 0]
        self.pairs = [(i, j, np.zeros((len(self.coarse[i]) + 1, len(self.coarse[j]) + 1))) for i, j in chosen]
        for _ in range(PAIR_ROUNDS):
            for i, j, table in self.pairs:
                g, h = self._slope(y, z)
                at = two[i] * table.shape[1] + two[j]
                step = RATE * _corner(*(np.bincount(at, weights=w, minlength=table.size).reshape(table.shape) for w in (g, h)))[1]
                table += step
                z += step.ravel()[at]

    @staticmethod
    def _slope(y, z):
        p = 1 / (1 + np.exp(-z))
        return y - p, p * (1 - p)

    @staticmethod
    def _bins(x: np.ndarray, edges: list[np.ndarray]) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(edges)]

    def _visit(self, bins, y, z, table):
        g, h = (np.bincount(bins, weights=w, minlength=len(table)) for w in self._slope(y, z))
        step = RATE * _tree(g, h)
        table += step
        return step[bins]

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for table, b in zip(self.tables, self._bins(x, self.edges)):
            z += table[b]
        two = self._bins(x, self.coarse)
        for i, j, table in self.pairs:
            z += table[two[i], two[j]]
        return 1 / (1 + np.exp(-z))


@F.pandas_udf(ArrayType(DoubleType()))
def _features(text: pd.Series) -> pd.Series:
    return pd.Series([features(t) for t in text])


def fit(docs: DataFrame, labels: DataFrame, allowed=None) -> Additive:
    rows = teaching(labels, "quality", F.lit(True) if allowed is None else allowed).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    # of rows that repeat an id, the least text teaches
    texts = docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    sample = written(texts.select("doc_id", "y", _features("text").alias("x")), "quality_sample")
    held = sample.orderBy("doc_id").toPandas()  # at most SAMPLE rows
    x = np.array(held["x"].tolist(), float).reshape(-1, len(FEATURES))
    return Additive(x, held["y"].to_numpy(float))


def scored(docs: DataFrame, model: Additive, score: str = "score", predicted: str = "predicted") -> DataFrame:
    """docs with two more columns; columns of docs that have their names give way."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(DoubleType())
    def told(text: pd.Series) -> pd.Series:
        return pd.Series(sent.value.scores(np.array([features(t) for t in text], float).reshape(-1, len(FEATURES))))

    return docs.withColumn(score, told("text")).withColumn(predicted, F.when(F.col(score) >= 0.5, 1).otherwise(0))


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs; labels are learned from rows with crc32(doc_id) mod 3 <> 1.
    Null and empty texts have features of 0 and a score like any other; repeated rows score alike; a null id is not held out and has no
    labels; other columns are not read, whatever their names; an empty table gives no rows."""
    model = fit(docs, labels, doc_crc() % 3 != 1)
    return scored(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(doc_crc() % 3 == 1, F.lit(False)).alias("held_out"), "score", "predicted")
