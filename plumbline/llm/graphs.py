"""Approximate nearest neighbours by inner product, on robust-pruned directed graphs.

Equal vectors are one node, which keeps the k + 1 smallest ids of its rows (no more can be among k results); so a vector that a
third of all rows repeat costs no more than another. Nodes are dealt to shards of about ``SHARD`` by a hash of the vector. A shard's
graph is grown in batches that double: a greedy search of the graph so far proposes neighbours for each newcomer, pruning goes
through the proposals from the nearest on and drops those that a kept one is nearer to by the factor ``ALPHA`` than the newcomer is,
and edges back are added and pruned the same way. A second pass repeats this on the whole graph. The index is a table of nodes.

Distances while building are those of vectors lengthened by one component, which makes all of them equally long, so that the
nearest are those of largest inner product; where lengths differ, a newcomer also searches without that component, as a query
does. A query goes through every shard by beam search, and the results' scores are computed
again from the vectors as they came, in double precision. Searches and pruning are numpy over a batch of vectors at once.

A task holds one shard at a time; queries stream by it in batches, ordered behind the shard's nodes by the shuffle that brings both
together. Rows whose vector is null, zero, or holds a null or non-finite component take no part; rows that
repeat an id are candidates and queries each for itself, those without one candidates that come last among ties; vectors of different lengths have graphs of their own. An empty table
gives no rows. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

K = 20
SHARD = 10_000
#: Out-degree, beam of the searches that build and of those that answer, and the pruning's relaxation of squared distances.
DEGREE = 32
BUILD = 64
BEAM = 160
ALPHA = 1.1
BATCH = 512


def vectors(embeddings: DataFrame) -> DataFrame:
    """row, vec_id, v (doubles), size for the rows that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    some = F.exists("embedding", lambda x: x != 0)
    rows = embeddings.where(F.col("embedding").isNotNull() & finite & some)
    return rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.col("embedding").cast("array<double>").alias("v"), F.size("embedding").alias("size"))


def nodes(rows: DataFrame, k: int = K) -> DataFrame:
    """shard, size, v, members (the k + 1 least (vec_id, row)) for each distinct vector of rows. The tails of equal vectors go
    where the rows stand, before any shuffle."""
    order = Window.partitionBy("v").orderBy(F.col("vec_id").asc_nulls_last(), "row")
    least = rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    each = written(least.groupBy("v").agg(F.sort_array(F.collect_list(F.struct("vec_id", "row"))).alias("members")), "distinct")
    shards = -(-each.count() // SHARD)
    return each.select(F.pmod(F.xxhash64("v"), F.lit(max(1, shards))).cast("int").alias("shard"), F.size("v").alias("size"), "v", "members")


class Graph:
    """A directed graph over the rows of x. Unset edges are -1."""

    def __init__(self, x: np.ndarray, edges: np.ndarray | None = None, entry: int | None = None):
        self.x = x
        self.n = len(x)
        self.edges = np.full((self.n, DEGREE), -1, np.int32) if edges is None else edges
        self.entry = int(np.argmax(x @ x.mean(axis=0))) if entry is None else entry
        #: Where lengths differ, the factors that make a vector what it is as a query, without its last component.
        self.uneven: np.ndarray | None = None

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """For each row of q up to ``beam`` nodes by falling inner product, -1 where there are fewer; and the products."""
        m = len(q)
        rows = np.arange(m)[:, None]
        ids = np.full((m, beam), -1, np.int32)
        score = np.full((m, beam), -np.inf, np.float32)
        done = np.ones((m, beam), bool)
        ids[:, 0], score[:, 0], done[:, 0] = self.entry, q @ self.x[self.entry], False
        seen = np.zeros((m, self.n), bool)
        seen[:, self.entry] = True
        active = np.arange(m)
        while len(active):
            at = np.argmin(done[active], axis=1)  # first that isn't expanded: beams are in order
            node = ids[active, at]
            done[active, at] = True
            to = self.edges[node]
            fresh = (to >= 0) & ~seen[active[:, None], to]
            seen[active[:, None], np.where(to >= 0, to, self.entry)] = True
            got = np.einsum("mrd,md->mr", self.x[to], q[active]).astype(np.float32)
            got[~fresh] = -np.inf
            both = np.concatenate((score[active], got), axis=1)
            keep = np.argsort(-both, axis=1, kind="stable")[:, :beam]
            score[active] = np.take_along_axis(both, keep, 1)
            ids[active] = np.take_along_axis(np.concatenate((ids[active], np.where(fresh, to, -1)), axis=1), keep, 1)
            done[active] = np.take_along_axis(np.concatenate((done[active], ~fresh), axis=1), keep, 1)
            active = active[~done[active].all(axis=1)]
        ids[~np.isfinite(score)] = -1
        return ids, score

    def pruned(self, of: np.ndarray, proposed: np.ndarray) -> np.ndarray:
        """``DEGREE`` diverse neighbours for each node of ``of`` among the proposed ones (-1: none)."""
        squares = 2 - 2 * np.einsum("mcd,md->mc", self.x[proposed], self.x[of])
        squares[(proposed < 0) | (proposed == of[:, None])] = np.inf
        order = np.argsort(squares, axis=1, kind="stable")
        proposed, squares = np.take_along_axis(proposed, order, 1), np.take_along_axis(squares, order, 1)
        repeat = np.zeros_like(squares, bool)
        repeat[:, 1:] = (proposed[:, 1:] == proposed[:, :-1])
        squares[repeat] = np.inf
        points = self.x[proposed]
        out = np.full((len(of), DEGREE), -1, np.int32)
        rows = np.arange(len(of))
        for slot in range(DEGREE):
            at = np.argmin(squares, axis=1)
            live = np.isfinite(squares[rows, at])
            if not live.any():
                break
            out[live, slot] = proposed[rows[live], at[live]]
            apart = 2 - 2 * np.einsum("mcd,md->mc", points, points[rows, at])
            squares[apart * ALPHA <= squares] = np.inf
            squares[rows, at] = np.inf
        return out

    def insert(self, of: np.ndarray) -> None:
        """Searches for the nodes of ``of``, sets their edges and adds edges back, pruning where there are too many."""
        found, _ = self.search(self.x[of], BUILD)
        if self.uneven is not None:
            found = np.concatenate((found, self.search(self.x[of] * self.uneven, BUILD)[0]), axis=1)
        self.edges[of] = self.pruned(of, np.concatenate((found, self.edges[of]), axis=1))
        src = np.repeat(of, DEGREE)
        dst = self.edges[of].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        to, first, count = np.unique(dst, return_index=True, return_counts=True)
        for a in range(0, len(to), BATCH):
            t, f, c = to[a : a + BATCH], first[a : a + BATCH], count[a : a + BATCH]
            wide = int(c.max())
            j = np.arange(wide)
            back = np.where(j < c[:, None], src[np.minimum(f[:, None] + j, len(src) - 1)], -1).astype(np.int32)
            held = self.edges[t]
            back[(back[:, :, None] == held[:, None, :]).any(axis=2)] = -1
            room = (held >= 0).sum(axis=1) + (back >= 0).sum(axis=1) <= DEGREE
            both = np.concatenate((held, back), axis=1)
            packed = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), 1)[:, :DEGREE]
            self.edges[t[room]] = packed[room]
            full = np.flatnonzero(~room)
            if len(full):
                self.edges[t[full]] = self.pruned(t[full], both[full])


def grown(x: np.ndarray) -> Graph:
    """The graph of the vectors x. It depends on their order alone."""
    norms = np.einsum("nd,nd->n", x, x)
    top = norms.max(initial=0) or 1
    level = np.sqrt(np.maximum(top - norms, 0))
    graph = Graph(np.ascontiguousarray(np.concatenate((x, level[:, None]), axis=1) / np.sqrt(top), np.float32))
    if level.max(initial=0) > 0.01 * np.sqrt(top):
        graph.uneven = np.append(np.ones(x.shape[1], np.float32), np.float32(0))
    order = np.random.default_rng(7).permutation(graph.n)
    order = np.concatenate(([graph.entry], order[order != graph.entry])).astype(np.int32)
    for _ in range(2):
        a, size = 1, 1
        while a < graph.n:
            graph.insert(order[a : a + size])
            a += size
            size = min(2 * size, BATCH)
    return graph


def _frames(batches, columns: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in columns))


def _built(batches):
    """Nodes of a shard at a time, with their edges: positions in the shard in order of its nodes' first member."""
    names = ["shard", "size", "v", "members"]
    for (shard, size), rows in groupby(_frames(batches, names), lambda r: r[:2]):
        rows = list(rows)
        graph = grown(np.array([r[2] for r in rows]))
        for a in range(0, graph.n, 4096):
            part = rows[a : a + 4096]
            m = len(part)
            members = pa.array([r[3] for r in part], pa.list_(pa.struct([("vec_id", pa.int64()), ("row", pa.int64())])))
            edges = [e[e >= 0] for e in graph.edges[a : a + m]]
            columns = [pa.array([shard] * m, pa.int32()), pa.array([size] * m, pa.int32()), pa.array(range(a, a + m), pa.int32()), pa.array([graph.entry] * m, pa.int32())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([r[2] for r in part], pa.list_(pa.float64())), members, pa.array(edges, pa.list_(pa.int32()))], names=["shard", "size", "node", "entry", "v", "members", "edges"])


MEMBERS = "array<struct<vec_id: bigint, row: bigint>>"


def build(rows: DataFrame, k: int = K) -> DataFrame:
    """The index of rows (of :func:`vectors`): shard, size, node, entry, v, members, edges. Graphs of one table's rows are equal
    on every run."""
    dealt = nodes(rows, k).repartition("shard", "size").sortWithinPartitions("shard", "size", F.xxhash64("v"), "v")
    return dealt.mapInArrow(_built, f"shard int, size int, node int, entry int, v array<double>, members {MEMBERS}, edges array<int>")


def _graph(rows: list[tuple]) -> tuple[Graph, np.ndarray, list]:
    x = np.array([r[2] for r in rows])
    edges = np.full((len(rows), DEGREE), -1, np.int32)
    for i, r in enumerate(rows):
        edges[i, : len(r[4])] = r[4]
    return Graph(np.ascontiguousarray(x, np.float32), edges, rows[0][1]), x, [r[3] for r in rows]


def _answered(k: int, beam: int):
    def task(batches):
        names = ["shard", "size", "node", "entry", "v", "members", "edges", "query_row", "query_id"]
        for _, rows in groupby(_frames(batches, names), lambda r: r[:2]):
            held, graph, asked = [], None, []
            for r in rows:
                if r[2] is not None:
                    held.append(r[2:7])
                elif held:
                    if graph is None:
                        graph = _graph(held)
                    asked.append((r[7], r[8], r[4]))
                    if len(asked) == BATCH:
                        yield _found(graph, asked, k, beam)
                        asked = []
            if asked:
                yield _found(graph, asked, k, beam)

    return task


def _found(index, asked, k: int, beam: int) -> pa.RecordBatch:
    """The k best rows of a shard for each query, its own row left out, by score and id."""
    graph, x, members = index
    q = np.array([a[2] for a in asked])
    ids, _ = graph.search(q.astype(np.float32), beam)
    out: list[tuple] = []
    for (row, query_id, v), at in zip(asked, ids):
        at = at[at >= 0]
        score = (x[at] * np.array(v)).sum(axis=1)
        best = [(-s, m["vec_id"] is None, m["vec_id"]) for s, j in zip(score.tolist(), at.tolist()) for m in members[j] if m["row"] != row]
        out += [(row, query_id, vec_id, -s) for s, _, vec_id in sorted(best, key=lambda b: b[:2] + (b[2] or 0,))[:k]]
    columns = zip(*out) if out else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(),) * 3 + (pa.float64(),))], names=["query_row", "query_id", "vec_id", "score"])


def search(index: DataFrame, queries: DataFrame, k: int = K, beam: int = BEAM) -> DataFrame:
    """query_id, rank, vec_id, score, query_row for queries (row, vec_id, v, size): of every shard's findings the k of largest score,
    ties to the smaller vec_id. index must have been built for this k or a larger one; a query's own row is never among its results."""
    shards = index.select("shard", "size").distinct()
    asked = queries.join(F.broadcast(shards), "size").select(
        "shard", "size", F.lit(None).cast("int").alias("node"), F.lit(None).cast("int").alias("entry"), "v",
        F.lit(None).cast(MEMBERS).alias("members"), F.lit(None).cast("array<int>").alias("edges"), F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"),
    )
    known = index.select("shard", "size", "node", "entry", "v", "members", "edges", F.lit(None).cast("long").alias("query_row"), F.lit(None).cast("long").alias("query_id"))
    both = known.unionAll(asked).repartition("shard", "size").sortWithinPartitions("shard", "size", F.col("node").asc_nulls_last(), "query_row")
    found = both.mapInArrow(_answered(k, beam), "query_row long, query_id long, vec_id long, score double")
    order = Window.partitionBy("query_row").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "query_row")


def nearest(embeddings: DataFrame, every: int = 20, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by ``every`` the k nearest found among all other rows."""
    rows = written(vectors(embeddings), "vectors")
    index = written(build(rows, k), "index")
    return search(index, rows.where(F.col("vec_id") % every == 0), k).drop("query_row")
