"""Spelling variants: words at edit distance one, by a self-join of tries.

The vocabulary is cut by prefixes: a pair whose shorter word has S letters shares either the first floor(S / 2) letters or the last
ones from there on, since one edit falls in one of the two. So each word goes to four groups, by its length as the shorter and as the
longer one of a pair, once by prefix and once, read backwards, by suffix. A group holds distinct words of two lengths with half of
their letters in common; it becomes a trie over the other half.

Down a trie every node carries its active nodes, those whose string is one edit from its own: its parent, its siblings, its children,
and, for each active node of its parent, that one's child by the same letter. Terminal nodes active at a terminal node are the
words near it. Nothing compares all pairs of a group, and a group is bounded by how many words share half of their letters, whatever
the number of texts.

Words and their counts come from whole texts, added up in tasks before the shuffle. Forms at least double in count at each step, so
chains of forms are short, and roots are found by jumping twice as far each round. Null texts and those without letters have no words;
a null id counts as an empty one; an empty table, or one without frequent words, gives no rows; other columns aren't read.
"""

from __future__ import annotations

from collections import Counter
from itertools import groupby
from operator import itemgetter
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

LETTERS = 5
TIMES = 3
TYPO = 97
#: Distinct words that a task counts before it hands them on.
HELD = 400_000
#: Letters of Latin-1 as the contract has them, A-Z in lower case; every other byte parts words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 192 else 32 for b in range(256))


def _counted(batches):
    """(word, n) of a partition's texts, a word perhaps several times. Words are kept in Latin-1, a byte a letter."""
    held: dict[bytes, int] = {}

    def out():
        rows = [pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(list(held.values()), pa.int64())]
        held.clear()
        return pa.RecordBatch.from_arrays(rows, names=["word", "n"])

    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = crc32(f"{'' if key is None else key}:".encode())
            for w, n in Counter((text or "").encode("latin-1", "replace").translate(_FOLD).split()).items():
                h = crc32(w if w.isascii() else w.decode("latin-1").encode(), own)
                if not h % TYPO:
                    at = h % len(w)
                    w = w[:at] + w[at + 1 :]
                if len(w) >= LETTERS:
                    held[w] = held.get(w, 0) + n
            if len(held) >= HELD:
                yield out()
    yield out()


def vocabulary(docs: DataFrame, times: int = TIMES) -> DataFrame:
    """word, n: words of ``LETTERS`` letters or more that occur at least ``times`` times in docs (doc_id, text)."""
    found = docs.select("doc_id", "text").mapInArrow(_counted, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= times)


def near(words: list[str]):
    """(i, [j]) for each of the distinct words with others at distance one: a trie's self-join, level by level."""
    kids: list[dict[str, int]] = [{}]
    end = [-1]
    for i, word in enumerate(words):
        at = 0
        for x in word:
            to = kids[at].get(x)
            if to is None:
                to = kids[at][x] = len(kids)
                kids.append({})
                end.append(-1)
            at = to
        end[at] = i
    level = [(0, set(kids[0].values()))]
    while level:
        below = []
        for node, active in level:
            if end[node] >= 0 and (found := [end[m] for m in active if end[m] >= 0]):
                yield end[node], found
            own = kids[node]
            for x, child in own.items():
                mine = {m[x] for a in active if x in (m := kids[a])}
                mine.update(own.values(), kids[child].values())
                mine.add(node)
                mine.discard(child)
                below.append((child, mine))
        level = below


def _groups(vocabulary: DataFrame) -> DataFrame:
    """side, least, key, word, n: the groups' members. side 0: words by prefix; 1: by suffix."""
    least = F.explode(F.array(F.length("word") - 1, F.length("word")))
    rows = vocabulary.select("word", "n", least.alias("least")).where(F.col("least") >= LETTERS)
    half = F.floor(F.col("least") / 2).cast("int")
    sides = F.array(F.struct(F.lit(0).alias("side"), F.substr("word", F.lit(1), half).alias("key")), F.struct(F.lit(1).alias("side"), F.right("word", F.col("least") - half).alias("key")))
    return rows.select("word", "n", "least", F.explode(sides).alias("s")).select("s.side", "least", "s.key", "word", "n")


def _members(batches):
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _joined(batches):
    """Pairs of one group and side: (side, least, key, [(word, n)], i, [j]). Suffix groups leave pairs that share the prefix too
    to their prefix group, and pairs of two longer words belong to the next length."""
    for (side, least, key), rows in groupby(_members(batches), itemgetter(0, 1, 2)):
        members = [(w, n) for *_, w, n in rows]
        if len(members) < 2:
            continue
        half, cut = least // 2, len(key)
        rests = [w[cut:] if side == 0 else w[:-cut][::-1] for w, _ in members]
        for i, others in near(rests):
            word = members[i][0]
            if len(word) > least:
                others = [j for j in others if len(members[j][0]) == least]
            if side:
                others = [j for j in others if members[j][0][:half] != word[:half]]
            if others:
                yield members, i, others


def _best(batches):
    """word, n_near, and the near word of largest count, least in order: of one group."""
    out: list[tuple] = []
    for members, i, others in _joined(batches):
        n, form = min((-members[j][1], members[j][0]) for j in others)
        out.append((members[i][0], len(others), -n, form))
        if len(out) >= 50_000:
            yield _batch(out, ("word", "n_near", "near_n", "near"))
            out = []
    if out:
        yield _batch(out, ("word", "n_near", "near_n", "near"))


def _pairs(batches):
    """a, b: pairs of one group, each once."""
    out: list[tuple] = []
    for members, i, others in _joined(batches):
        out += [(members[i][0], members[j][0]) for j in others if members[i][0] < members[j][0]]
        if len(out) >= 50_000:
            yield _batch(out, ("a", "b"))
            out = []
    if out:
        yield _batch(out, ("a", "b"))


def _batch(rows, names):
    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names)


def _dealt(vocabulary: DataFrame) -> DataFrame:
    key = ("side", "least", "key")
    return _groups(vocabulary).repartition(*key).sortWithinPartitions(*key)


def links(vocabulary: DataFrame) -> DataFrame:
    """a < b: all pairs of words of vocabulary (word, n) at distance one, each once."""
    return _dealt(vocabulary).mapInArrow(_pairs, "a string, b string")


def forms(vocabulary: DataFrame, factor: int = 2) -> DataFrame:
    """word, form, n, n_near, form_n for each word of vocabulary (word, n), its words distinct."""
    found = _dealt(vocabulary).mapInArrow(_best, "word string, n_near long, near_n long, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("order"), F.col("near").alias("form"), F.col("near_n").alias("form_n"))).alias("best")
    each = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    rows = vocabulary.join(each, "word", "left")
    taken = F.col("best.form_n") >= factor * F.col("n")
    return rows.select("word", F.when(taken, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(taken, F.col("best.form_n")).alias("form_n"))


def rooted(rows: DataFrame) -> DataFrame:
    """rows (word, form, ...) with root, the end of the word's chain of forms. Each round the chains that go on double their step;
    only words with a form that has one itself are carried on."""
    steps = written(rows.where("form IS NOT NULL").select("word", F.col("form").alias("to")), "steps")
    jump, k = steps, 0
    while True:
        on = jump.select(F.col("word").alias("to"), F.col("to").alias("further"))
        moved = written(jump.join(on, "to", "left").select("word", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("went")), f"jump{k}")
        if moved.where("went").isEmpty():
            break
        jump, k = moved.select("word", "to"), k + 1
    return rows.join(jump.withColumnRenamed("to", "root"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def grouped(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n for every frequent word of docs (doc_id, text)."""
    found = written(forms(written(vocabulary(docs), "vocabulary")), "forms")
    return rooted(found).select("word", "form", "root", "n", "n_near", "form_n")
