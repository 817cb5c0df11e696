"""Periodic runs of words by a harmonic grid.

A run of period q is at least four periods long, so it holds four neighbouring points of the grid 0, q, 2q, ... For each period p
up to a quarter of a text, every grid point asks how far the words from jp and from (j+1)p agree onwards and backwards (LCE);
together they give the whole stretch of period p around the point. A longest common extension is the minimum of an LCP array
between two suffixes' ranks, answered by a sparse table in constant time; backward ones come from the reversed array. Points whose
next three words on the grid differ have no run that begins with them, and are left before any array is asked. The grid has
n / p points for p, n log n for a text.

A stretch found for a multiple of its smallest period has the same ends, and the smallest period stays. Texts are taken in packs of
``PACK`` words, so that short ones share numpy's calls; suffixes are ranked within their own text. A text longer than a pack is one
by itself, in memory proportional to n log n of its words, and its grid is walked ``GRID`` points at a time. There is no shuffle.

Null and empty texts have no runs and an empty collapsed text; ids may be null or repeat, each row stands for itself; an empty
table gives no rows. Other columns of docs are not read.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST = 6
POWER = 4
PACK = 1 << 17
GRID = 1 << 20
RUN = "struct<start: bigint, length: bigint, period: bigint>"


class Extensions:
    """Longest common extensions within parts of an array of numbers: suffix array by doubling, LCP array, sparse table."""

    def __init__(self, x: np.ndarray, part: np.ndarray):
        """part: ascending or descending numbers of the parts that x is cut into."""
        n = len(x)
        self.levels = [self._ranks(part.astype(np.int64) * (int(x.max(initial=0)) + 1) + x)]
        while (last := self.levels[-1]).max(initial=-1) < n - 1:
            step = 1 << (len(self.levels) - 1)
            after = np.zeros(n, np.int64)
            after[:-step] = np.where(part[step:] == part[:-step], last[step:] + 1, 0)
            self.levels.append(self._ranks(last * np.int64(n + 1) + after))
        self.rank = self.levels.pop()
        order = np.empty(n, np.int64)
        order[self.rank] = np.arange(n)
        self.table = [self._common(order)]
        widest = int(np.bincount(part - part.min(), minlength=1).max()) if n else 0
        while (half := 1 << (len(self.table) - 1)) * 2 <= widest:
            t = self.table[-1]
            self.table.append(np.concatenate((np.minimum(t[:-half], t[half:]), t[len(t) - half :])))
        self.table = np.stack(self.table)
        del self.levels

    @staticmethod
    def _ranks(key: np.ndarray) -> np.ndarray:
        order = np.argsort(key)
        held = key[order]
        out = np.empty(len(key), np.int64)
        out[order] = np.concatenate(([0], np.cumsum(held[1:] != held[:-1]))) if len(key) else 0
        return out

    def _common(self, order: np.ndarray) -> np.ndarray:
        """LCP of each suffix and the next in order. Equal ranks of a level are equal words of its length, in one part."""
        a, b = order[:-1], order[1:]
        out, n = np.zeros(len(order), np.int32), len(order)
        here = out[:-1]
        for k in range(len(self.levels) - 1, -1, -1):
            ia, ib = a + here, b + here
            inside = np.flatnonzero(np.maximum(ia, ib) < n)
            same = self.levels[k][ia[inside]] == self.levels[k][ib[inside]]
            here[inside[same]] += 1 << k
        return out

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For positions i and j that differ and share a part."""
        ri, rj = self.rank[i], self.rank[j]
        low, width = np.minimum(ri, rj), np.abs(ri - rj)
        level = np.frexp(width.astype(float))[1] - 1
        return np.minimum(self.table[level, low], self.table[level, low + width - (1 << level)])


def _points(x: np.ndarray, sizes: np.ndarray):
    """Grid points (i, p) in x whose words at i, i + p, i + 2p and i + 3p agree, ``GRID`` points looked at a time."""
    starts = np.cumsum(sizes) - sizes
    tops = sizes // POWER
    base, size = np.repeat(starts, tops), np.repeat(sizes, tops)
    p = np.arange(1, len(base) + 1) - np.repeat(np.cumsum(tops) - tops, tops)
    count = (size - 1) // p - 2
    at = np.concatenate(([0], np.cumsum(count)))
    a = 0
    while a < len(p):
        b = max(a + 1, int(np.searchsorted(at, at[a] + GRID, "right")) - 1)
        period = np.repeat(p[a:b], count[a:b])
        i = np.repeat(base[a:b], count[a:b]) + period * (np.arange(at[b] - at[a]) - np.repeat(at[a:b] - at[a], count[a:b]))
        word = x[i]
        for step in (1, 2, 3):
            same = np.flatnonzero(x[i + step * period] == word)
            i, period, word = i[same], period[same], word[same]
        yield i, period
        a = b


def runs(x: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and smallest period of every run, in order of start and period, for texts of the given sizes laid end to end
    in x (numbers of words)."""
    found = [g for g in _points(x, sizes) if len(g[0])]
    none = np.zeros(0, np.int64)
    if not found:
        return none, none, none
    i, p = (np.concatenate(c) for c in zip(*found))
    part = np.repeat(np.arange(len(sizes)), sizes)
    held = np.unique(part[i])  # only texts with such a point need arrays
    inside = np.flatnonzero(np.isin(part, held))
    where = np.zeros(len(x), np.int64)
    where[inside] = np.arange(len(inside))
    y, own, k, n = x[inside], part[inside], where[i], len(inside)
    forward, back = Extensions(y, own)(k, k + p), np.zeros(len(k), np.int64)
    mirror = Extensions(y[::-1], own[::-1])
    inner = np.flatnonzero((k > 0) & (own[np.maximum(k - 1, 0)] == own[k]))
    back[inner] = mirror(n - k[inner], n - k[inner] - p[inner])
    s, e = i - back, i + p + forward
    long = e - s >= np.maximum(LEAST, POWER * p)
    s, e, p = s[long], e[long], p[long]
    order = np.lexsort((p, e, s))
    s, e, p = s[order], e[order], p[order]
    first = np.concatenate(([True], (s[1:] != s[:-1]) | (e[1:] != e[:-1]))) if len(s) else np.zeros(0, bool)
    s, e, p = s[first], e[first], p[first]
    order = np.lexsort((p, s))
    return s[order], e[order], p[order]


def _pack(texts: list[bytes]) -> tuple[list[int], np.ndarray, list[bytes]]:
    """Offsets of each text's runs, the runs (start in its text, length, period), and the collapsed texts."""
    words = [t.split() for t in texts]  # bytes: \\x20\\x09-\\x0D only
    sizes = np.array([len(w) for w in words], np.int64)
    number: dict[bytes, int] = {}
    for w in words:
        number.update(dict.fromkeys(w))
    number = {w: k for k, w in enumerate(number)}
    x = np.fromiter(map(number.__getitem__, chain.from_iterable(words)), np.int64, int(sizes.sum()))
    s, e, p = runs(x, sizes)
    ends = np.cumsum(sizes)
    of = np.searchsorted(ends, s, "right")
    collapsed = [b" ".join(w) for w in words]
    if len(s):
        dropped = np.cumsum(np.bincount(s + p, minlength=len(x) + 1) - np.bincount(e, minlength=len(x) + 1))[:-1] > 0
        for k in np.unique(of).tolist():
            a = int(ends[k] - sizes[k])
            collapsed[k] = b" ".join(words[k][j] for j in np.flatnonzero(~dropped[a : a + int(sizes[k])]).tolist())
    offsets = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=len(texts)))))
    return offsets.tolist(), np.stack((s - (ends - sizes)[of], e - s, p)), collapsed


def _detected(batches):
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
    for batch in batches:
        texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
        a = 0
        while a < len(texts):
            b, size = a, 0
            while b < len(texts) and (b == a or size + len(texts[b]) // 2 <= PACK * 2):
                size += len(texts[b]) // 2
                b += 1
            offsets, found, collapsed = _pack(texts[a:b])
            rows = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in found], names=["start", "length", "period"])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows).cast(kind)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists, pa.array(collapsed, pa.binary()).cast(pa.string())], names=["key", "runs", "collapsed"])
            a = b


def detect(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, runs (an array of start, length, period in words, by start and period) and collapsed (the words that no run holds after
    its first period, joined by one space) for every row of docs."""
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(_detected, f"key {kind}, runs array<{RUN}>, collapsed string").withColumnRenamed("key", key)


def looped(doc_id: Column, text: Column) -> Column:
    """The text that the query reads: where 10 divides h, crc32 of the id, the words from a = floor(h / 10) % n on repeat the p words
    that begin there; else the text as it is. An id that is null has no h."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, g = F.size(words), F.floor(h / 10)
    a = (g % F.greatest(n, F.lit(1))).cast("int")
    p = (F.floor((n - a) / (3 + g % 8)) + 1).cast("int")
    times = F.ceil((n - a) / p).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), times)), F.lit(1), n - a)
    return F.when((h % 10 == 0) & (n > 0), F.array_join(F.concat(F.slice(words, F.lit(1), a), tail), " ")).otherwise(text)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run with the greatest length / period (start, length, period, exponent_milli), and sha256 of the runs and
    of the collapsed text, for every row of docs (doc_id, text)."""
    rows = detect(docs.select("doc_id", looped(F.col("doc_id"), F.col("text")).alias("text")))
    better = lambda b, r: (r["length"] * b["period"] > b["length"] * r["period"]) | (b["period"] == 0)
    start = F.lit(0).cast("long")
    none = F.struct(start.alias("start"), start.alias("length"), start.alias("period"))
    best = F.aggregate("runs", none, lambda b, r: F.when(better(b, r), r).otherwise(b))
    rows = rows.withColumn("best", F.when(F.size("runs") > 0, best))
    line = lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    milli = F.expr("best.length * 1000 div best.period")
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", milli.alias("exponent_milli"),
        sha(F.array_join(F.transform("runs", line), "")).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"),
    )
