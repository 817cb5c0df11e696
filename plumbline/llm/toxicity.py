"""Toxicity by class-conditional Kneser-Ney models of words that share their backoff counts.

Both classes, toxic and ordinary, have a model P_c(word | word before it), interpolated over three orders:

    P_c(w | h) = A_c(h w) / n_c(h) + g_c(h) P_c(w)        g_c(h): what the discounts of h's pairs left
    P_c(w)     = A_c(w) / N_c + l_c P(w)                  l_c: what the discounts of words left
    P(w)       = (k(w) - d) / K + d V / K / (V + 1)       k(w): distinct words before w, in both classes together

n_c counts labelled texts of class c that hold an expression (equal texts once in a class), n_c(h) and N_c are their sums; the last
order is a Kneser-Ney continuation count that the classes share, with d = n1 / (n1 + 2 n2), and an unknown word has its share of
it. Each of the three sums to 1. A_c is the discounted count, max(0, n_c - e_c - ``DISCOUNT`` sqrt(e_c + 1)), where e_c is the part
of both classes' count that lower orders let class c expect. So the discount isn't a constant: it takes away all that is common to
the classes or may be chance, and the shared counts get that mass; a word or pair that sets the classes apart keeps the rest. A
constant discount, n1 / (n1 + 2 n2) or larger, was tried and scored worse (README).

A text's evidence is log P_toxic(text) - log P_ordinary(text) by its number of words; two numbers fitted on labelled documents
that the counts left out turn it into a score. Only expressions with A_c > 0 in a class have a difference of their own, so that
these alone are kept, as what they add to l_toxic / l_ordinary, which every word has.

Counts and differences are Spark's; what they hold grows with the labelled rows. Only the two numbers come from a bounded sample,
a ``CALIBRATE``-th of the rows, at most ``SAMPLE / CALIBRATE`` of each class. Up to ``ENTRIES`` differences are sent to the tasks;
where there are more, texts' expressions are joined to them.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .common import doc_crc, free, give_back, lean, teaching, written

#: Of labelled documents, the part that fits the two numbers, and that part of ``SAMPLE`` of each class at most.
SAMPLE = 4000
CALIBRATE = 4
#: Expressions with a difference that are sent to the tasks at most.
ENTRIES = 1_000_000
#: Labelled rows whose keys, some 40 bytes each, are sent to where the texts are; where there are more, texts are dealt by key.
KEYS = 4_000_000
#: Distinct expressions that a task holds before it passes them on.
HELD = 120_000
#: Groups of second words, and parts of each, by which counts are dealt: a pair has one, and a frequent word's pairs have all of its parts.
GROUPS, PARTS = 1024, 16
#: Labelled texts for each task that adds up counts, the session's number of shuffle partitions being the least.
TEXTS = 1000
#: Times the square root of one more than the expected count.
DISCOUNT = 3.0
#: Words added to a text's length, so that a few words prove little.
PRIOR_WORDS = 8.0

_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def expressions(found: list[str]):
    """The words; for each pair of neighbours the first with a space after it, as a history, and both with a space between."""
    yield from found
    for a, b in zip(found, found[1:]):
        yield f"{a} "
        yield f"{a} {b}"


def _kept(n: Column, expected: Column) -> Column:
    """A_c of the docstring."""
    return F.greatest(F.lit(0.0), n - expected - DISCOUNT * F.sqrt(expected + 1))


class Model:
    """table: (entry, odds), what each expression adds to the log of P_toxic / P_ordinary; odds: the same as a dict, None where there
    are more than ``ENTRIES``; every word has ``base``, an unknown expression adds 0."""

    def __init__(self, table: DataFrame, base: float):
        self.table, self.odds, self.base = table, None, base
        if table.count() <= ENTRIES:
            self.odds = {r.entry: r.odds for r in table.toLocalIterator()}
        self.slope, self.shift = 1.0, 0.0

    def calibrate(self, evidence: np.ndarray, label: np.ndarray) -> None:
        """Logistic regression on the evidence; a fold with one class keeps slope 1 and shift 0."""
        if len(set(label.tolist())) < 2:
            return
        scale = np.std(evidence) or 1.0
        x = np.column_stack((evidence / scale, np.ones(len(label))))
        w = np.zeros(2)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
            step = np.linalg.solve(h, x.T @ (label - p) - 1e-3 * w)
            w += step
            if np.abs(step).max() < 1e-8:
                break
        self.slope, self.shift = float(w[0] / scale), float(w[1])

    def score(self, text: str | None) -> float:
        return self.probability(evidence(text, self.odds, self.base))

    def probability(self, evidence: float) -> float:
        z = max(-30.0, min(30.0, self.slope * evidence + self.shift))
        return 1 / (1 + math.exp(-z))


def _heads(odds: dict[str, float]) -> frozenset:
    return frozenset(e[:-1] for e in odds if e.endswith(" "))


def evidence(text: str | None, odds: dict[str, float], base: float, heads: frozenset | None = None) -> float:
    """Difference of the log-likelihoods, normalised by length; 0 for a text without words."""
    found, get = words(text), odds.get
    heads = _heads(odds) if heads is None else heads
    total = math.fsum(get(w, 0.0) for w in found)
    if not heads.isdisjoint(found):
        total += math.fsum(get(f"{a} ", 0.0) + get(f"{a} {b}", 0.0) for a, b in zip(found, found[1:]) if a in heads)
    return (total + base * len(found)) / (len(found) + PRIOR_WORDS)


def with_evidence(docs: DataFrame, model: Model, to: str = "evidence") -> DataFrame:
    """docs with one more column; a column of docs that has its name gives way."""
    docs = docs.drop(to)
    if model.odds is not None:
        sent = docs.sparkSession.sparkContext.broadcast((model.odds, model.base, _heads(model.odds)))

        @F.pandas_udf(DoubleType())
        def told(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            odds, base, heads = sent.value
            for text in texts:
                yield pd.Series([evidence(t, odds, base, heads) for t in text], dtype="float64")
            give_back()

        return docs.withColumn(to, told("text"))

    def task(frames):
        for df in frames:
            for text, key in zip(df["text"], df["text_key"]):
                found = words(text)
                counts = Counter(expressions(found))
                # a row of its own for the length, so that texts without a kept expression have their evidence too
                yield pd.DataFrame({"text_key": key, "size": len(found), "entry": ["", *counts], "n": [0, *counts.values()]})

    texts = docs.where("text IS NOT NULL").select("text", F.sha2(F.col("text").cast("binary"), 256).alias("text_key"))
    held = texts.mapInPandas(task, "text_key string, size long, entry string, n long")
    # copies give the same rows, which count once
    sums = held.distinct().join(model.table, "entry", "left").groupBy("text_key", "size").agg(F.sum(F.col("n") * F.coalesce("odds", F.lit(0.0))).alias("total"))
    key, told = free("__key", docs), free("__told", docs)
    sums = sums.select(F.col("text_key").alias(key), ((F.col("total") + F.lit(model.base) * F.col("size")) / (F.col("size") + PRIOR_WORDS)).alias(told))
    out = docs.join(sums, F.sha2(F.col("text").cast("binary"), 256) == F.col(key), "left")
    return out.withColumn(to, F.coalesce(told, F.lit(0.0))).drop(key, told)


def labelled(docs: DataFrame, labels: DataFrame, target: str, allowed) -> DataFrame:
    """(doc_id, y, key, rows, turn): a row for each class and text of the labelled documents, with how many rows of docs it has; of
    rows that repeat an id, those with the text of least hash."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash")).join(teaching(labels, target, allowed), "doc_id")
    each = rows.groupBy("doc_id", "y", "text_hash").agg(F.count(F.lit(1)).alias("rows"))
    each = each.groupBy("doc_id", "y").agg(F.min(F.struct("text_hash", "rows")).alias("least")).select("doc_id", "y", "least.*")
    each = each.groupBy("y", "text_hash").agg(F.min(F.struct("doc_id", "rows")).alias("least")).select("y", "text_hash", "least.*")
    return each.select("doc_id", "y", F.xxhash64("doc_id", "text_hash").alias("key"), "rows", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(CALIBRATE)).alias("turn"))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.xxhash64("doc_id", F.xxhash64("text")).alias("key"))


def _bucket(entry: str) -> int:
    """Where an entry's counts are added up: by its second word, a pair's also by its first, so that a word has ``PARTS`` buckets."""
    first, _, second = entry.partition(" ")
    group = zlib.crc32((second or first).encode()) % GROUPS * PARTS
    return group + zlib.crc32(first.encode()) % PARTS if second else group


def _count(docs: DataFrame, picked: DataFrame) -> DataFrame:
    """(entry, n): n holds how many picked texts of the ordinary class have an entry in its low 32 bits, of the toxic one above. Entries
    are words, pairs, and for each word that begins pairs the word with a space after it, which counts its pairs.

    Most pairs are seen once. So what tasks pass on has a row for each bucket, with its entries line by line and a count only where
    it isn't 1, which shuffles fewer bytes than a row for each entry."""

    def told(held: tuple[Counter, Counter]) -> pa.RecordBatch:
        sums = dict(held[0])
        for entry, n in held[1].items():
            sums[entry] = sums.get(entry, 0) + (n << 32)
        for h in held:
            h.clear()
        lines = defaultdict(list)
        for entry, n in sums.items():
            lines[_bucket(entry)].append(entry if n == 1 else f"{entry}\t{n}")
        return pa.RecordBatch.from_arrays([pa.array(list(lines), pa.int32()), pa.array(["\n".join(sorted(v)) for v in lines.values()], pa.string())], names=["bucket", "lines"])

    def task(batches):
        held = Counter(), Counter()
        for batch in batches:
            for text, y in zip(batch.column("text"), batch.column("y").to_pylist()):
                own = words(text.as_py())
                pairs = set(zip(own, own[1:]))
                held[y].update(set(own))
                held[y].update(map(" ".join, pairs))
                held[y].update([f"{a} " for a, _ in pairs])
                if len(held[0]) + len(held[1]) > HELD:
                    yield told(held)
        yield told(held)

    picked = picked.select("key", "y", "rows")
    texts_in = picked.count()
    few = texts_in <= KEYS

    def texts(rows: DataFrame) -> DataFrame:
        return _keyed(docs).join(F.broadcast(rows) if few else rows, "key").select("key", "text", "y")

    once, more = texts(picked.where("rows = 1")), texts(picked.where("rows > 1")).dropDuplicates(["key", "y"])
    seen = once.unionAll(more).select("text", "y").mapInArrow(lean(task), "bucket int, lines string")
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(GROUPS * PARTS, texts_in // TEXTS))
    line = seen.repartition(tasks, "bucket").select("bucket", F.explode(F.split("lines", "\n")).alias("line")).where("line <> ''")
    n = F.when(F.instr("line", "\t") > 0, F.substring_index("line", "\t", -1).cast("long")).otherwise(F.lit(1))
    # entries of a bucket are in one task by now
    counts = line.select("bucket", F.substring_index("line", "\t", 1).alias("entry"), n.alias("n")).groupBy("bucket", "entry").agg(F.sum("n").alias("n"))
    return counts.select("entry", "n")


def counts_table(counts: DataFrame) -> DataFrame:
    """(a, b, n, h, k): for each word b, with a null, its counts, those of the pairs that it begins, and the number of distinct words before
    it; and each pair a b that may keep a count. One pass over the counts: conditions stand within aggregates, since a filter on the
    entry would be moved before the counting and make Spark count twice."""
    parts = F.split("entry", " ")
    rows = counts.select("n", F.get(parts, F.lit(0)).alias("first"), F.get(parts, F.lit(1)).alias("second"))
    # a word has no second part, a history an empty one
    alone, history = F.col("second").isNull(), F.col("second") == ""
    pair = ~alone & ~history
    by = rows.groupBy(F.when(pair, F.col("second")).otherwise(F.col("first")).alias("b"))
    word = by.agg(F.sum(F.when(alone, F.col("n")).otherwise(0)).alias("n"), F.sum(F.when(history, F.col("n")).otherwise(0)).alias("h"), F.count_if(pair).alias("k"))
    # no count up to DISCOUNT is kept, whatever is expected
    pairs = rows.where(F.when(pair, F.greatest(_class(0), _class(1))).otherwise(0) > DISCOUNT)
    none = F.lit(None)
    return word.select(none.cast("string").alias("a"), "b", "n", "h", "k").unionAll(pairs.select(F.col("first").alias("a"), F.col("second").alias("b"), "n", none.cast("long").alias("h"), none.cast("long").alias("k")))


def _class(c: int, column: str = "n") -> Column:
    packed = F.col(column)
    return (F.shiftright(packed, 32) if c else packed.bitwiseAND(F.lit((1 << 32) - 1))).cast("double")


def differences(counts: DataFrame) -> tuple[DataFrame, float]:
    """(entry, odds) of each expression that adds to the log of P_toxic / P_ordinary, and what every word has; of counts_table's rows."""
    word = counts.where("a IS NULL").select("b", "k", *[_class(c, x).alias(f"{x}{c}") for x in "nh" for c in (0, 1)])
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("double").alias(c) for c in ("n0", "n1", "k")]
    t = word.agg(*sums, F.count(F.lit(1)).alias("v"), F.count_if(F.col("k") > 0).alias("after"), *[F.count_if(F.col("k") == i).alias(f"f{i}") for i in (1, 2)]).first()
    share = (t.n1 + 1.0) / (t.n0 + t.n1 + 2.0)
    d = t.f1 / (t.f1 + 2.0 * t.f2) if t.f1 else 0.5
    flat = d * t.after / t.k / (t.v + 1) if t.k else 1.0 / (t.v + 1)
    shared = F.greatest(F.lit(0.0), F.col("k") - F.lit(d)) / F.lit(t.k or 1.0) + F.lit(flat)
    total = F.col("n0") + F.col("n1")
    word = word.withColumns({"kept0": _kept(F.col("n0"), total * (1 - share)), "kept1": _kept(F.col("n1"), total * share)})
    kept = word.agg(*[F.coalesce(F.sum(f"kept{c}"), F.lit(0.0)) for c in (0, 1)]).first()
    left = [1 - kept[c] / (t[f"n{c}"] or 1.0) for c in (0, 1)]
    word = word.select("b", "kept0", "kept1", "h0", "h1", *[(F.col(f"kept{c}") / F.lit(t[f"n{c}"] or 1.0) + F.lit(left[c]) * shared).alias(f"p{c}") for c in (0, 1)])
    base = math.log(left[1] / left[0])
    apart = word.where("kept0 > 0 OR kept1 > 0").select(F.col("b").alias("entry"), (F.log(F.col("p1") / F.col("p0")) - F.lit(base)).alias("odds"))

    pair = counts.where("a IS NOT NULL").select("a", "b", *[_class(c).alias(f"n{c}") for c in (0, 1)])
    pair = pair.join(word.select("b", "p0", "p1"), "b").join(word.select(F.col("b").alias("a"), "h0", "h1"), "a")
    expected1 = F.col("h1") * F.col("p1") / (F.col("h0") * F.col("p0") + F.col("h1") * F.col("p1"))
    pair = pair.withColumns({"kept0": _kept(F.col("n0"), (F.col("n0") + F.col("n1")) * (1 - expected1)), "kept1": _kept(F.col("n1"), (F.col("n0") + F.col("n1")) * expected1)})
    pair = written(pair.where("kept0 > 0 OR kept1 > 0"), "toxic_pairs")
    spent = pair.groupBy("a").agg(*[(1 - F.sum(F.when(F.col(f"h{c}") > 0, F.col(f"kept{c}") / F.col(f"h{c}")).otherwise(0.0))).alias(f"g{c}") for c in (0, 1)])
    after = F.log(F.col("g1") / F.col("g0"))
    heads = spent.select(F.concat("a", F.lit(" ")).alias("entry"), after.alias("odds"))
    now = [F.when(F.col(f"h{c}") > 0, F.col(f"kept{c}") / F.col(f"h{c}")).otherwise(0.0) + F.col(f"g{c}") * F.col(f"p{c}") for c in (0, 1)]
    # less what its word and its history add on their own
    beside = pair.join(spent, "a").select(F.concat_ws(" ", "a", "b").alias("entry"), (F.log(now[1] / now[0]) - after - F.log(F.col("p1") / F.col("p0"))).alias("odds"))
    return written(apart.unionAll(heads).unionAll(beside), "toxic_odds"), base


def fit(docs: DataFrame, labels: DataFrame, allowed=None) -> Model:
    """A model of toxicity from the labelled rows that ``allowed`` (a condition on doc_id) admits. With no such rows every
    text's score is the same."""
    allowed = F.lit(True) if allowed is None else allowed
    rows = written(labelled(docs, labels, "toxic", allowed), "toxic_rows")
    order = F.xxhash64("doc_id")
    parts = [rows.where((F.col("y") == c) & (F.col("turn") == 0)).orderBy(order, "doc_id").limit(SAMPLE // CALIBRATE) for c in (0, 1)]
    out = written(parts[0].unionAll(parts[1]), "toxic_left_out")
    counted = written(rows.join(F.broadcast(out.select("key", "y")), ["key", "y"], "left_anti"), "toxic_counted")
    model = Model(*differences(written(counts_table(_count(docs, counted)), "toxic_counts")))
    # at most 2 * SAMPLE / CALIBRATE rows
    texts = _keyed(docs).join(F.broadcast(out.select("key", "y")), "key").dropDuplicates(["key", "y"])
    held = with_evidence(texts.select("text", "y"), model).select("y", "evidence").toPandas()
    model.calibrate(held["evidence"].to_numpy(float), held["y"].to_numpy(float))
    return model


def scored(docs: DataFrame, model: Model, score: str = "toxic_score", toxic: str = "toxic") -> DataFrame:
    """docs with two more columns, the score and whether it is at least 0.5; columns of docs that have their names give way."""
    told = free("__evidence", docs)
    z = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col(told) * model.slope + model.shift))
    out = with_evidence(docs, model, told).withColumn(score, 1 / (1 + F.exp(-z))).drop(told)
    return out.withColumn(toxic, F.when(F.col(score) >= 0.5, 1).otherwise(0))


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs; labels are learned from rows with crc32(doc_id) mod 5 <> 0.

    Null and empty texts have no words and evidence 0; a null id is not held out and has no label; repeated rows score alike, and count
    once; other columns are not read, whatever their names; an empty table gives no rows."""
    model = fit(docs, labels, doc_crc() % 5 != 0)
    out = scored(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(doc_crc() % 5 == 0, F.lit(False)).alias("held_out"), F.col("toxic_score").alias("score"), F.col("toxic").alias("predicted"))
