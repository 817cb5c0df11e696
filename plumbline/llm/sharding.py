"""Histogram sort: rows in even shards by exact byte counts below candidate key boundaries, DataFrame functions only.

Rows are ordered by 63 bits of the text's hash, then of the id's: equal texts are neighbours (among texts that share such a hash they
mix), and a group of copies of any size can be cut between two of its rows. Splitters are found as in histogram sort: each
round counts the exact bytes and rows below equally spaced probes inside the intervals that still hold a splitter, and keeps the
sub-interval around each target until some probe is within the tolerance. Where all rows at a splitter have one text, they are cut by
their ids' hashes in the same way, and repeats of text and id by a number of their own.

Only counts come to the driver, at most ``2 ** FIRST_BITS`` rows or ``2 ** NEXT_BITS`` for each splitter. A shard is cut into ranges
(cells) of about ``CELL_BYTES``, ``CELLS`` at least and ``MOST_CELLS`` in all, so that the one exchange of the documents that follows
deals to many tasks; a row's slot is the exact number of its shard's rows in earlier cells plus its place in the cell.
"""

from __future__ import annotations

import json
from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free, shared_dir, written

KEY_BITS = 63
FIRST_BITS = 12
NEXT_BITS = 6
#: The driver holds up to ``2 ** NEXT_BITS`` counts for each of ``MOST_CELLS`` ranges; beyond them, ranges and their tasks grow.
CELLS, MOST_CELLS, CELL_BYTES = 16, 1 << 14, 1 << 28
#: Of a shard's mean bytes, how far a splitter may be from its target.
TOLERANCE = 0.0005


def text_key(text: Column) -> Column:
    """A null text counts as an empty one."""
    return F.xxhash64(F.coalesce(text, F.lit(""))).bitwiseAND(F.lit((1 << KEY_BITS) - 1))


def id_key(doc_id: Column) -> Column:
    return F.xxhash64(doc_id).bitwiseAND(F.lit((1 << KEY_BITS) - 1))


def sized(text: Column) -> Column:
    """UTF-8 bytes plus 1; a null text counts as an empty one."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(1)).cast("long")


def _narrowed(rows: DataFrame, column: str, open_: dict, targets: list[float], tolerance: float, by: tuple = ()) -> tuple[dict, dict]:
    """open_: splitter -> (group, bytes and rows below the group), group a tuple of by's values. Splits each group by ``column``.

    Returns (found, stuck): splitter -> (group, value, bytes below, rows below) where a boundary is within the tolerance, or as near as
    any, and splitter -> the same where one value's rows outweigh the tolerance on both sides."""
    found, stuck = {}, {}
    at = {j: (group, 0, b, n) for j, (group, b, n) in open_.items()}
    width, shift = FIRST_BITS, KEY_BITS - FIRST_BITS
    within = rows
    while at:
        counts = within.groupBy(*by, F.shiftright(column, shift).alias("probe")).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()
        inside: dict[tuple, list] = {}
        for r in sorted(counts):
            inside.setdefault((tuple(r[: len(by)]), r.probe >> width), []).append(r)
        still = {}
        for j, (group, prefix, bytes_below, rows_below) in at.items():
            edge = best = (prefix << width, bytes_below, rows_below)
            around = edge
            for r in inside.get((group, prefix), []):
                around = (r.probe, edge[1], edge[2])
                edge = (r.probe + 1, edge[1] + r.bytes, edge[2] + r.n)
                if abs(edge[1] - targets[j]) < abs(best[1] - targets[j]):
                    best = edge
                if edge[1] >= targets[j]:
                    break
            if abs(best[1] - targets[j]) <= tolerance:
                found[j] = (group, best[0] << shift, best[1], best[2])
            elif shift == 0:
                (stuck if edge[2] - around[2] > 1 else found)[j] = (group, *(around if edge[2] - around[2] > 1 else best))
            else:
                still[j] = (group, *around)
        at = still
        if at:
            groups = sorted({(*g, p) for g, p, _, _ in at.values()})
            if by:
                within = rows.where(F.struct(*by, F.shiftright(column, shift)).isin([F.struct(*[F.lit(x).cast("long") for x in g]) for g in groups]))
            else:
                within = rows.where(F.shiftright(column, shift).isin([p for (p,) in groups]))
            width = min(NEXT_BITS, shift)
            shift -= width
    return found, stuck


def cell_of(place: Column, edges: list[tuple[int, int, int]]) -> Column:
    """Number of edges at or below place, a struct of (key, sub, number). The edges are one value; a key's leading bits tell
    how many of them are below all such keys, so that only those with the same bits are compared."""
    shift = KEY_BITS - FIRST_BITS
    heads = [k >> shift for k, *_ in edges]
    below = [bisect_left(heads, x) for x in range((1 << FIRST_BITS) + 1)]
    start = F.from_json(F.lit(json.dumps(below)), "array<int>")
    listed = F.from_json(F.lit(json.dumps([dict(zip("ksn", e)) for e in edges])), "array<struct<k: bigint, s: bigint, n: bigint>>")
    at = F.shiftright(place["key"], shift).cast("int")
    first = F.get(start, at)
    near = F.slice(listed, first + 1, F.get(start, at + 1) - first)
    passed = lambda e: (e["k"] < place["key"]) | ((e["k"] == place["key"]) & ((e["s"] < place["sub"]) | ((e["s"] == place["sub"]) & (e["n"] <= place["number"]))))
    return first + F.aggregate(near, F.lit(0), lambda n, e: n + F.when(passed(e), 1).otherwise(0))


def write_shards(docs: DataFrame, path: str, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with all their columns, a folder for each shard, and their ``slot`` in it; returns what was written.

    Law ``bytes``: the shards' sizes are equal within ``TOLERANCE`` of their mean, or within one row where a row is larger. Every row
    is kept, null texts and ids and repeated rows too; an empty table gives an empty one. Columns shard and slot of docs give way."""
    docs = docs.drop("shard", "slot")
    key, sub, size = text_key(F.col(text_col)), id_key(F.col(id_col)), sized(F.col(text_col))
    rows = written(docs.select(key.alias("key"), sub.alias("sub"), size.alias("size")), "keys")
    total = rows.agg(F.sum("size")).first()[0] or 0
    parts = shards * max(CELLS, min(MOST_CELLS // shards, total // shards // CELL_BYTES))
    cells, tolerance = parts // shards, TOLERANCE * total / shards
    targets = [total * j / parts for j in range(1, parts)]
    found, stuck = _narrowed(rows, "key", dict.fromkeys(range(parts - 1), ((), 0, 0)), targets, tolerance)
    cut = {j: (k, 0, 0, b, n) for j, (_, k, b, n) in found.items()}
    number = F.lit(0).cast("long")
    if stuck:  # copies of a text, cut by the hashes of their ids
        copies = written(rows.where(F.col("key").isin(sorted({k for _, k, _, _ in stuck.values()}))), "copies")
        found, stuck = _narrowed(copies, "sub", {j: ((k,), b, n) for j, (_, k, b, n) in stuck.items()}, targets, tolerance, ("key",))
        cut |= {j: (*group, x, 0, b, n) for j, (group, x, b, n) in found.items()}
    if stuck:  # repeats of text and id: they need numbers that stay, so the documents are written with theirs
        own = free("__number", docs)
        docs = written(docs.withColumn(own, F.monotonically_increasing_id()), "numbered")
        number = F.col(own)
        heavy = sorted({(*group, x) for group, x, _, _ in stuck.values()})
        repeats = docs.select(key.alias("key"), sub.alias("sub"), number.alias("number"), size.alias("size"))
        repeats = written(repeats.where(F.struct("key", "sub").isin([F.struct(*[F.lit(x).cast("long") for x in g]) for g in heavy])), "repeats")
        # one repeat is one step: nothing is nearer than the nearest number
        near, rest = _narrowed(repeats, "number", {j: ((*group, x), b, n) for j, (group, x, b, n) in stuck.items()}, targets, tolerance, ("key", "sub"))
        cut |= {j: (*group, x, b, n) for j, (group, x, b, n) in (near | rest).items()}
    cuts = [cut[j] for j in range(parts - 1)]
    before = [0] + [n for *_, n in cuts]
    # rows below the cell, less those below its shard
    offsets = [before[c] - before[c // cells * cells] for c in range(parts)]
    place, cell = free("__place", docs), free("__cell", docs)
    first = F.get(F.from_json(F.lit(json.dumps(offsets)), "array<bigint>"), F.col(cell))
    placed = docs.withColumn(place, F.struct(key.alias("key"), sub.alias("sub"), number.alias("number")))
    placed = placed.withColumn(cell, cell_of(F.col(place), [c[:3] for c in cuts]))
    placed = (
        placed.withColumn("slot", (first + F.row_number().over(Window.partitionBy(cell).orderBy(place)) - 1).cast("long"))
        .withColumn("shard", F.floor(F.col(cell) / F.lit(cells)).cast("int"))
        .drop(place, cell, *([own] if stuck else []))
    )
    placed.write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.schema(placed.schema).parquet(path)


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row, read from the shards that were written."""
    out = write_shards(docs.select(id_col, text_col), f"{shared_dir(docs.sparkSession)}/shards", shards, id_col, text_col)
    return out.select(
        F.col(id_col).alias("doc_id"), sized(F.col(text_col)).alias("size"), F.crc32(F.coalesce(text_col, F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
