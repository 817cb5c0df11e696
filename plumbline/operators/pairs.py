"""Sums over pairs of rows of a group that differ by a bound or more, without a pair: counts and sums over what precedes a row in order.

With a group's rows in order of y, those that lie at least delta below a row are the first ones, so that their number, errors and
squared errors are differences of running sums; how many of them a model puts below the row too is counted bit by bit of the ranks of
its predictions (a wavelet matrix). A group of n rows costs n log n. Groups come sorted, in a stream: a task holds
``HELD`` rows, or one group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stored import kept

#: Rows that are added up at a time.
HELD = 1 << 18
MARK = "\u0001"


def _last_below(y: np.ndarray, start: np.ndarray, code: np.ndarray, delta: float) -> np.ndarray:
    """Of rows in order of (code, y), the end of those of the code, from start on, whose y is at least delta less, as doubles subtract."""
    n = len(y)
    both = np.lexsort((np.repeat([0, 1], n), np.concatenate([y, y - delta]), np.concatenate([code, code])))
    pos = np.empty(n, np.int64)
    pos[both[both >= n] - n] = np.cumsum(both < n)[both >= n]
    # a bound's own rounding may put it on the wrong side of a run of equal values
    edge = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (y[1:] != y[:-1])))
    run = np.searchsorted(edge, np.arange(n), "right") - 1
    begin, end = edge[run], np.append(edge[1:], n)[run]
    with np.errstate(invalid="ignore"):
        at = np.arange(n)
        while len(at := at[(pos[at] < at)]) and len(at := at[y[at] - y[np.minimum(pos[at], n - 1)] >= delta]):
            pos[at] = end[pos[at]]
        at = np.arange(n)
        while len(at := at[pos[at] > start[at]]) and len(at := at[~(y[at] - y[pos[at] - 1] >= delta)]):
            pos[at] = begin[pos[at] - 1]
    return pos


def _fewer(rank: np.ndarray, low: np.ndarray, high: np.ndarray, value: np.ndarray) -> np.ndarray:
    """How many of rank[low:high] are less than value, for each of the three."""
    out, low, high = np.zeros(len(low), np.int64), low.copy(), high.copy()
    for bit in range(int(max(rank.max(initial=0), value.max(initial=0))).bit_length() - 1, -1, -1):
        zero = (rank >> bit & 1) == 0
        zeros = np.append(0, np.cumsum(zero))
        l0, h0, up = zeros[low], zeros[high], (value >> bit & 1) == 1
        out += np.where(up, h0 - l0, 0)
        low, high = np.where(up, zeros[-1] + low - l0, l0), np.where(up, zeros[-1] + high - h0, h0)
        rank = np.concatenate([rank[zero], rank[~zero]])
    return out


def _added(group: np.ndarray, side: np.ndarray, y: np.ndarray, pred: np.ndarray, has: np.ndarray, delta: float) -> np.ndarray:
    """(row, model, 4): what each row adds as the greater one of its pairs: pairs, those of one sign, pairs with both predictions, the
    sum of their squared differences of errors. Rows are in order of (group, y). A row of side 0 meets all of its group, one of side 1 those of side 2
    and the other way round."""
    n = len(y)
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    start = np.repeat(first, np.diff(np.append(first, n)))
    pos = _last_below(y, start, group, delta)
    out = np.zeros((n, pred.shape[1], 4))
    for of, other in ((0, 0), (1, 2), (2, 1)):
        rows = np.flatnonzero((side == of) & (pos > start))
        if not len(rows):
            continue
        met = side == other
        for m in range(pred.shape[1]):
            mine = rows[has[rows, m]]
            known = has[:, m] & met & ~np.isnan(pred[:, m])
            with np.errstate(invalid="ignore"):
                error = y - pred[:, m]
            whole = np.isfinite(error)
            e = np.where(known & whole, error, 0.0)

            def upto(x, mine=mine):
                s = np.append(x.dtype.type(0), np.cumsum(x))
                return s[pos[mine]] - s[start[mine]]

            out[mine, m, 0] = upto((has[:, m] & met).astype(np.int64))
            mine = mine[~np.isnan(pred[mine, m])]
            if not len(mine):
                continue
            count, total, squares, odd = (upto(x, mine) for x in (known.astype(np.int64), e, e * e, (known & ~whole).astype(np.int64)))
            own = np.where(whole[mine], error[mine], 0.0)
            squares = np.maximum(count * own * own - 2 * own * total + squares, 0.0)
            squares[(odd > 0) | (~whole[mine] & (count > 0))] = np.nan
            # ranks and places of the known rows alone
            at, values = np.append(0, np.cumsum(known)), pred[known, m]
            ranks = np.unique(np.concatenate([values, pred[mine, m]]), return_inverse=True)[1]
            out[mine, m, 1] = _fewer(ranks[: len(values)], at[start[mine]], at[pos[mine]], ranks[len(values) :])
            out[mine, m, 2], out[mine, m, 3] = count, squares
    return out


SUMS = ("pairs", "signs", "known", "squares")


def _summed(table: pa.Table, delta: float, sums: dict) -> None:
    """Adds the table's groups to sums, by (run, model)."""
    g, k, side, y = (table.column(c).to_numpy() for c in ("g", "k", "side", "y"))
    group = np.cumsum(np.append(False, (g[1:] != g[:-1]) | (k[1:] != k[:-1])))
    runs, names = (table.column(c).combine_chunks().dictionary_encode() for c in ("run", "names"))
    lists = table.column("preds").combine_chunks()
    flat, offset = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()[:-1]
    kinds = [n.split(MARK) if n else [] for n in names.dictionary.to_pylist()]
    models = sorted({m for kind in kinds for m in kind})
    pred, has, kind = np.full((len(y), len(models)), np.nan), np.zeros((len(y), len(models)), bool), names.indices.to_numpy()
    for i, own in enumerate(kinds):
        rows, columns = np.flatnonzero(kind == i)[:, None], np.array([models.index(m) for m in own], np.int64)[None]
        pred[rows, columns], has[rows, columns] = flat[offset[rows] + np.arange(len(own))], True
    order = np.lexsort((y, group))
    added = _added(group[order], side[order], y[order], pred[order], has[order], delta)
    run = runs.indices.to_numpy()[order]
    for j, name in enumerate(runs.dictionary.to_pylist()):
        # few runs lie in many groups: a task's rows of one are added up at once
        own = added[run == j].sum(0)
        for i, model in enumerate(models):
            if own[i, 0]:
                sums[name, model] = sums.get((name, model), 0) + own[i]


def sums(rows: DataFrame, pairs: DataFrame, run: tuple[str, ...], delta: float) -> DataFrame:
    """(run, model, pairs, signs, known, squares) over pairs of rows of one run whose structures are similar and whose y differ by delta
    or more, where both have the model: their number, those whose predictions differ in the same direction, those with both
    predictions, and the sum over these of the squared difference of errors. rows: run, structure, y (finite or null), preds, an
    array of (model, pred); pairs: (structure, other), in both directions. A null or NaN prediction is none. Every two similar
    structures of a run are a group, as are the rows of one; a row goes to each of its own, and no pair is made."""
    if not delta > 0:
        raise ValueError("delta must be above 0")
    two = kept(pairs.select(F.least("structure", "other").alias("a"), F.greatest("structure", "other").alias("b")).distinct(), "similar")
    side = lambda c, n: F.struct(F.col(c).alias("structure"), F.lit(n).alias("side"))
    sides = two.select("a", "b", F.inline(F.when(F.col("a") == F.col("b"), F.array(side("a", 0))).otherwise(F.array(side("a", 1), side("b", 2)))))
    sent = rows.where("y IS NOT NULL AND NOT isnan(y)").join(sides, "structure").select(
        F.xxhash64(*run, "a", "b").alias("g"), F.hash(*run, "b", "a").alias("k"), "side", F.col("y").cast("double").alias("y"), F.concat_ws(MARK, *[F.col(c).cast("string") for c in run]).alias("run"),
        F.array_join(F.transform("preds", lambda x: x["model"]), MARK).alias("names"), F.transform("preds", lambda x: x["pred"].cast("double")).alias("preds"),
    )

    def task(batches):
        held, n, enough, out = [], 0, HELD, {}
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= enough:
                table = pa.Table.from_batches(held).combine_chunks()
                g, k = (table.column(c).to_numpy() for c in ("g", "k"))
                # the last group may go on
                begin = n - int(np.argmax(((g != g[-1]) | (k != k[-1]))[::-1])) if (g[0], k[0]) != (g[-1], k[-1]) else 0
                if begin:
                    _summed(table.slice(0, begin), delta, out)
                held, n = pa.Table.from_batches(table.slice(begin).to_batches()).to_batches(), n - begin
                enough = max(HELD, 2 * n)
        if n:
            _summed(pa.Table.from_batches(held), delta, out)
        names = list(out)
        yield pa.RecordBatch.from_arrays(
            [pa.array([r for r, _ in names], pa.string()), pa.array([m for _, m in names], pa.string()), *[pa.array([float(out[x][i]) for x in names], pa.float64()) for i in range(len(SUMS))]], names=["run", "model", *SUMS]
        )

    dealt = sent.repartition("g", "k").sortWithinPartitions("g", "k").mapInArrow(task, "run string, model string, " + ", ".join(f"{c} double" for c in SUMS))
    parts = F.split("run", MARK)
    back = [F.get(parts, F.lit(i)).cast(rows.schema[c].dataType).alias(c) for i, c in enumerate(run)]
    return dealt.groupBy("run", "model").agg(*[F.sum(c).alias(c) for c in SUMS]).select(*back, "model", *SUMS)
