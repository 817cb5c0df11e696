"""Exact top-k by inner product over an impact-ordered index, score at a time.

Components are integers. In a block of vectors each dimension's postings are cut into segments of one quantised value. For a
query, a segment's impact is its largest product with the query's component less the least product of that dimension in the
block, so that impacts are never negative. Segments are processed by descending impact over all dimensions. What a vector may
still gain is at most the sum, over dimensions, of the next segment's impact; what its accumulator overstates is at most the
quantising error. Processing stops only when these bounds prove that all but a few vectors are below the k-th best, of this
block or an earlier one; the possible members are then scored exactly. With nothing left to process the proof still holds.

Every task indexes the blocks of its partition once, at most ``BLOCKS`` of them, and goes through all queries, which it reads
``BATCH`` at a time from a table in the shared folder; the k best of each task are merged by a window. So there is one pass over
the vectors, whatever the number of queries, and blocks and a batch are all that is held in memory.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_dir, written, written_at

K = 10
BATCH = 4096
BLOCK = 8192
BLOCKS = 16
#: Segments processed between two tests, and the share of a block that may be rescored.
STEP = 96
MEMBERS = 1 / 32
#: Bits of a component that the index takes.
PLAIN = 40


def integers(embeddings: DataFrame, scale: int = 1024) -> DataFrame:
    """row, vec_id and floor(scale * component), whole numbers as doubles. Rows with a null vector, or a component that is null or not
    finite, or not once scaled, take no part; every other row does, those with a null id or that repeat one too: ``row`` tells
    them apart."""
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) * scale < F.lit(float("inf"))))
    rows = embeddings.where(F.col("embedding").isNotNull() & whole)
    # from 2 ** 52 on a double is a whole number
    floor = lambda y: F.when(F.abs(y) < float(1 << 52), F.floor(y).cast("double")).otherwise(y)
    v = F.transform("embedding", lambda x: floor(F.lit(scale) * x.cast("double")))
    return rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", v.alias("v"))


def _numbers(v: np.ndarray) -> np.ndarray:
    """Whole numbers in 64 bits, or Python's where one has more than ``PLAIN`` bits."""
    return v.astype(np.int64) if np.abs(v).max(initial=0) < 1 << PLAIN else np.vectorize(int, otypes=[object])(v)


class Block:
    """An impact-ordered index of vectors of one length; of components beyond 64-bit sums only the vectors, in Python's numbers."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, named: np.ndarray, vectors: np.ndarray):
        self.rows, self.ids, self.named, self.vectors = rows, ids, named, _numbers(vectors)
        n, d = vectors.shape
        self.most = [int(x) for x in np.abs(vectors).max(axis=0, initial=0)]
        self.plain = self.vectors.dtype != object
        if self.plain:
            self._index(n, d)

    def _index(self, n: int, d: int) -> None:
        vectors = self.vectors
        top = self.top = max(abs(int(vectors.max(initial=0))), abs(int(vectors.min(initial=0))))
        self.shift = max(0, top.bit_length() - 5)
        level = vectors >> self.shift
        dims, lows, postings = [], [], []
        for j in range(d):
            order = np.argsort(level[:, j], kind="stable")
            own = level[order, j]
            cut = np.flatnonzero(np.diff(own)) + 1
            postings += np.split(order, cut)
            lows.append(own[np.concatenate(([0], cut))] << self.shift)
            dims.append(np.full(len(cut) + 1, j))
        self.postings = postings
        self.sizes = np.array([len(p) for p in postings])
        self.dim = np.concatenate(dims) if dims else np.zeros(0, np.int64)
        self.low = np.concatenate(lows) if lows else np.zeros(0, np.int64)
        self.high = self.low + (1 << self.shift) - 1

    def search(self, row: int, q: np.ndarray, k: int, floor: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and exact scores of all vectors, but the query's own row, that may be among the k best scores of at least
        floor. Where sums may leave the whole numbers that a double holds, every vector is scored; where they may leave 64
        bits, in Python's numbers."""
        n, d = self.vectors.shape
        own = self.rows == row
        if not self.plain or q.dtype == object or sum(abs(a) * b for a, b in zip(q.tolist(), self.most)) >= 1 << 62:
            possible = np.flatnonzero(~own)
            return possible, self.vectors[possible].astype(object) @ q.astype(object)
        if sum(map(abs, q.tolist())) * (self.top + (1 << self.shift)) >= 1 << 51:
            possible = np.flatnonzero(~own)
            return possible, self.vectors[possible] @ q
        c = q[self.dim]
        most, least = np.where(c > 0, c * self.high, c * self.low), np.where(c > 0, c * self.low, c * self.high)
        base = np.full(d, np.iinfo(np.int64).max)
        np.minimum.at(base, self.dim, least)
        impact = most - base[self.dim]
        order = np.argsort(-impact, kind="stable")
        error = int(np.abs(q).sum()) * ((1 << self.shift) - 1)
        known = int(base.sum())
        acc = np.zeros(n)  # whole numbers below 2 ** 53
        rest = np.zeros(d, np.int64)
        np.maximum.at(rest, self.dim, impact)
        alive = np.flatnonzero(~own)
        for at in range(0, len(order), STEP):
            part = order[at : at + STEP]
            acc += np.bincount(np.concatenate([self.postings[s] for s in part]), weights=np.repeat(impact[part], self.sizes[part]), minlength=n)
            after = order[at + STEP :]
            rest = np.zeros(d, np.int64)
            np.maximum.at(rest, self.dim[after], impact[after])
            gain = int(rest.sum())
            now = acc[alive]
            if len(now) > k:
                bound = int(np.partition(now, len(now) - k)[len(now) - k]) + known - error
                if floor is None or bound > floor:
                    floor = bound
            if floor is not None:
                possible = alive[now + known + gain >= floor]
                if len(possible) <= max(4 * k, MEMBERS * n):
                    break
        else:
            possible = alive if floor is None else alive[acc[alive] + known >= floor]
        return possible, self.vectors[possible] @ q


def _blocks(batches) -> list[Block]:
    """The index of a partition, a block at a time; vectors of one length share a block, those beyond 64-bit sums one of their own."""
    out, held = [], {}

    def close(n):
        out.append(Block(*(np.concatenate(x) for x in zip(*held.pop(n)))))

    for batch in batches:
        row, ids, v = (batch.column(c) for c in ("row", "vec_id", "v"))
        named = ids.is_valid().to_numpy(zero_copy_only=False)
        row, ids = row.to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False)
        length = np.diff(v.offsets.to_numpy())
        flat, start = v.flatten().to_numpy(zero_copy_only=False), v.offsets.to_numpy()[:-1] - v.offsets[0].as_py()
        for n in np.unique(length).tolist():
            at = np.flatnonzero(length == n)
            of = flat[start[at][:, None] + np.arange(n)].reshape(len(at), n)
            plain = np.abs(of).max(axis=1, initial=0) < 1 << PLAIN
            for kind in (True, False):
                some = np.flatnonzero(plain == kind)
                for a in range(0, len(some), BLOCK):
                    part = some[a : a + BLOCK]
                    held.setdefault((n, kind), []).append((row[at[part]], ids[at[part]], named[at[part]], of[part]))
                    if sum(len(x[0]) for x in held[n, kind]) >= BLOCK:
                        close((n, kind))
    for n in list(held):
        close(n)
    return out


def _fitted(scores: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """The scores in 64 bits, the nearest that fit, and whether they do. One that doesn't is beyond all that do, at either end."""
    if scores.dtype != object:
        return pa.array(scores), pa.array(np.ones(len(scores), bool))
    held = [min(max(s, -(1 << 63)), (1 << 63) - 1) for s in scores.tolist()]
    return pa.array(held, pa.int64()), pa.array([a == b for a, b in zip(held, scores.tolist())])


def _queries(path: str):
    """(row, vec_id, vector) of the table at path, a batch at a time."""
    from pyarrow import dataset, fs

    system, root = fs.FileSystem.from_uri(path)
    for batch in dataset.dataset(root, filesystem=system, format="parquet").to_batches(columns=["row", "vec_id", "v"], batch_size=BATCH, batch_readahead=1, fragment_readahead=1):
        yield [(r, i, _numbers(np.array(v, float))) for r, i, v in zip(*(batch.column(c).to_pylist() for c in ("row", "vec_id", "v")))]


def search(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score, query_row: for each query (row, vec_id, v) its k best other rows, ties to the smaller id, rows
    without one last; fewer if there are fewer. Sums of any size are exact; a result that doesn't fit 64 bits is an error. Queries that share an id have their own ranks each. Vectors of another length than the query's have
    no product with it and take no part. No queries or no vectors give no rows."""
    spark = vectors.sparkSession
    path = f"{shared_dir(spark)}/queries"
    written_at(queries.select("row", "vec_id", "v"), path)
    n = vectors.count()
    parts = max(spark.sparkContext.defaultParallelism, -(-n // (BLOCK * BLOCKS)))

    def task(parts):
        blocks = _blocks(parts)
        for asked in _queries(path) if blocks else ():
            out = []
            for row, query_id, q in asked:
                ids, named, scores = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)
                for block in blocks:
                    if block.vectors.shape[1] != len(q):
                        continue
                    at, found = block.search(row, q, k, int(scores[-1]) if len(scores) == k else None)
                    ids, named, scores = np.concatenate((ids, block.ids[at])), np.concatenate((named, block.named[at])), np.concatenate((scores, found))
                    keep = np.lexsort((ids, ~named, -scores))[:k]
                    ids, named, scores = ids[keep], named[keep], scores[keep]
                out.append((row, query_id, ids, named, scores))
            if out:
                sizes = [len(x[2]) for x in out]
                of = pa.array(np.repeat(np.arange(len(out)), sizes))
                columns = [pa.array([x[j] for x in out], pa.int64()).take(of) for j in (0, 1)]
                columns += [pa.array(np.concatenate([x[2] for x in out]), mask=~np.concatenate([x[3] for x in out])), *_fitted(np.concatenate([x[4] for x in out]))]
                yield pa.RecordBatch.from_arrays(columns, names=["query_row", "query_id", "vec_id", "score", "fits"])

    found = vectors.select("row", "vec_id", "v").repartition(parts).mapInArrow(task, "query_row long, query_id long, vec_id long, score long, fits boolean")
    order = Window.partitionBy("query_row").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
    wrong = F.raise_error(F.concat(F.lit("a score of query "), "query_id", F.lit(" doesn't fit 64 bits"))).cast("long")
    return ranked.select("query_id", "rank", "vec_id", F.when(F.col("fits"), F.col("score")).otherwise(wrong).alias("score"), "query_row")


def nearest(embeddings: DataFrame, every: int = 100, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score. Queries are the rows whose vec_id is divisible by ``every``, candidates all rows but the
    query's own; rows that repeat an id are queries and candidates each for itself."""
    vectors = written(integers(embeddings), "vectors")
    return search(vectors, vectors.where(F.col("vec_id") % every == 0), k).drop("query_row")


ORACLE = f"""
WITH e AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.r, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
      FROM e q JOIN e c ON q.r <> c.r WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank, vec_id, score FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""
