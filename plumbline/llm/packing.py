"""Bound-certified repacking of token pieces into fixed-length sequences.

Pieces are dealt to groups of about ``GROUP``; each group is packed by best-fit decreasing and compared with a lower bound
from dual feasible functions. Where the two agree, no packing of the group needs fewer sequences, and it is finished but for
sequences at most half full, what rounding up may have cost it. Groups with a gap keep their full sequences and give up the
pieces of all others. What is given up is dealt anew and packed again, for as
long as that saves sequences and at most ``ROUNDS`` times, in groups four times as large each time. Only counts reach the
driver; a group's bound doesn't grow with the input.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import END_ID, TOKENIZER, lean, written
from .tokens import encoder

LENGTH = 1024
GROUP = 8192
#: At most 4 rounds and 2 ** 20 bins of a group fit a sequence's number.
ROUNDS = 4

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, length: int = LENGTH, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """A row for each piece of each document: a document of over ``length`` ids is cut so that only its first piece may be
    shorter. A null text counts as an empty one: the end id alone."""

    def task(batches):
        enc = encoder(tokenizer, end_id)
        for batch in batches:
            ids, rows = batch.column("doc_id").to_pylist(), []
            for doc_id, text in zip(ids, batch.column("text")):
                raw = enc.encode(text.as_py())
                n = len(raw) // 4
                head = n % length or min(n, length)
                cuts = [0, *range(head, n + 1, length)]
                rows += [(doc_id, k, a, b - a, zlib.crc32(raw[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
            names = ("doc_id", "piece", "start", "length", "ids_crc32")
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)
        enc.forget()  # a worker that goes on to other stages doesn't carry them along

    return docs.select("doc_id", "text").mapInArrow(lean(task), PIECES)


def best_fit(lengths: np.ndarray, room: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, longest first, each into the fullest bin that holds it. A bit of ``free`` is set for each
    remaining room that some bin has."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    free, by_room, made = 0, [[] for _ in range(room + 1)], 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = free >> n
        if fits:
            left = n + (fits & -fits).bit_length() - 1
            b = by_room[left].pop()
            if not by_room[left]:
                free ^= 1 << left
        else:
            left, b, made = room, made, made + 1
        bins[i], offsets[i] = b, room - left
        left -= n
        if left:
            by_room[left].append(b)
            free |= 1 << left
    return bins, offsets


def lower_bound(lengths: np.ndarray, room: int = LENGTH) -> int:
    """The largest of the bounds by two families of dual feasible functions: for each a up to half the room, lengths over
    room - a count as a whole bin, those below a as nothing; and for each k, (k + 1) parts rounded down to k-ths."""
    n = np.bincount(lengths, minlength=room + 1)
    weight = np.arange(room + 1)
    count, mass = np.concatenate(([0], np.cumsum(n))), np.concatenate(([0], np.cumsum(n * weight)))
    a = np.arange(0, room // 2 + 1)
    whole = count[-1] - count[room - a + 1]
    middle = mass[room - a + 1] - mass[a]
    best = int(np.max(-(-(whole * room + middle) // room)))
    for k in range(1, 21):
        parts = (k + 1) * weight
        even = parts % room == 0
        # in units of 1 / (k * room)
        value = np.where(even, weight * k, parts // room * room)
        best = max(best, -(-int((value * n).sum()) // (k * room)))
    return best


def _pack(df: pd.DataFrame) -> pd.DataFrame:
    lengths = df["length"].to_numpy()
    bins, offsets = best_fit(lengths)
    used = np.bincount(bins, weights=lengths).astype(np.int64)
    gap = len(used) - lower_bound(lengths)
    return df.assign(bin=bins, offset=offsets, open=(used[bins] <= LENGTH // 2) | ((gap > 0) & (used[bins] < LENGTH)), group_bins=len(used), group_bound=len(used) - gap)


def sequence_number(round_: int, part: Column, bin_: Column) -> Column:
    """An even number for each (round, group, bin): 1 bit, 2 for the round, 20 for the bin, the other 40 for the group."""
    return (F.shiftleft(F.shiftleft(part.cast("long"), 20).bitwiseOR(bin_.cast("long")), 2) + F.lit(round_)) * 2


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset, group_bins, group_bound: a row for each piece; the last two
    are the sequences of the group it was packed in and the bound that certifies them.

    Every row of docs is packed, repeated rows, null ids and null or empty texts included; an empty table gives no rows.
    """
    made = written(pieces(docs, LENGTH, tokenizer, end_id).withColumn("salt", F.monotonically_increasing_id()), "pieces")
    names = [c for c in made.columns if c != "salt"]
    out = made.where(F.col("length") == LENGTH).select(*names, (2 * F.col("salt") + 1).alias("sequence_id"), *[F.lit(x).cast("long").alias(c) for c, x in (("offset", 0), ("group_bins", 1), ("group_bound", 1))])
    left = made.where(F.col("length") < LENGTH)
    schema = f"{PIECES}, salt long, part long, bin long, offset long, open boolean, group_bins long, group_bound long"
    last = ("sequence_id", "offset", "group_bins", "group_bound")
    before = None
    for k in range(ROUNDS):
        n = left.count()
        if not n:
            break
        dealt = left.withColumn("part", F.pmod(F.xxhash64("salt", F.lit(k)), F.lit(-(-n // (GROUP << (2 * k))))).cast("long"))
        packed = written(dealt.groupBy("part").applyInPandas(_pack, schema), f"round{k}")
        number = sequence_number(k, F.col("part"), F.col("bin")).alias("sequence_id")
        now = packed.select("part", "bin").distinct().count()
        if before is not None and now >= before[0]:
            out = out.unionByName(before[1])  # nothing saved: the last round's places stand
            break
        rows = packed.select(*names, number, *last[1:], "open", "salt")
        out = out.unionByName(rows.where("NOT open").select(*names, *last))
        open_ = rows.where("open")
        if k == ROUNDS - 1:
            out = out.unionByName(open_.select(*names, *last))
            break
        before = (open_.select("sequence_id").distinct().count(), open_.select(*names, *last))
        left = open_.select(*names, "salt")
    return out
