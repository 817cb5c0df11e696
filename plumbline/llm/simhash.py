"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at distance 2 or less have a common variant at distance 1 or less from both. Each distinct fingerprint
emits itself and its 64 one-bit variants; the shuffle on variants brings together at most 65 fingerprints, however many
documents share them. In a variant's group each fingerprint is linked to the one before it, the distance is verified, and
links found through several variants are dropped as repeats. Links of a group form a chain, which keeps its component; all
pairs within the radius are given by :func:`links`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import free, give_back, written
from .components import components

RADIUS = 2
SHINGLE = 3
SEED = 42
#: Shingles whose bits are counted at once, so that a long text needs no more memory than a short one.
CHUNK = 1 << 15


def fingerprint(text: str | None) -> int:
    """Unsigned; a bit is 1 if it is set in over half of the shingles' hashes. Zero for a null text or one without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and \\x20\\x09-\\x0D only
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(SHINGLE, n)
    first, last = starts[: n - k + 1].tolist(), ends[k - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    set_, total = np.zeros(64, np.int64), len(first)
    for i in range(0, total, CHUNK):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(first[i : i + CHUNK], last[i : i + CHUNK])], "<u8")
        set_ += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_ > total, bitorder="little").tobytes(), "little")


@F.pandas_udf(LongType())
def _fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for text in texts:
        yield pd.Series(np.array([fingerprint(t) for t in text], np.uint64).view(np.int64))
    give_back()


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs' doc_id, a hash of its text and its fingerprint as a signed long."""
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), _fingerprints("text").alias("fp"))


def _variants(fps: DataFrame) -> DataFrame:
    flips = F.array(F.lit(0).cast("long"), *[F.lit((1 << b) if b < 63 else -(1 << 63)).cast("long") for b in range(64)])
    return fps.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("variant"))


def _near(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= RADIUS


def chain(fps: DataFrame) -> DataFrame:
    """Verified edges (a, b) between distinct fingerprints that keep every component of the links."""
    order = Window.partitionBy("variant").orderBy("fp")
    return _variants(fps).select(F.lag("fp").over(order).alias("a"), F.col("fp").alias("b")).where(F.col("a").isNotNull() & _near("a", "b")).distinct()


def links(fps: DataFrame) -> DataFrame:
    """All pairs a < b of distinct fingerprints within the radius, each once: at most 2,080 for each fingerprint."""
    group = _variants(fps).groupBy("variant").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    pairs = group.select(F.explode("fps").alias("a"), "fps").select("a", F.explode("fps").alias("b")).where("a < b")
    return pairs.where(_near("a", "b")).distinct()


def groups(docs: DataFrame, name: str = "fingerprints") -> tuple[DataFrame, DataFrame]:
    """The documents' fingerprints, and (fp, root, component_id) for each distinct one, root being one fingerprint of the component.

    Null ids take part, and name a component only if it has no other id. Repeated rows share their component. An empty
    table gives empty results; other columns of docs are not read.
    """
    rows = written(fingerprints(docs), name)
    fps = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    roots = components(chain(fps.select("fp")))
    named = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id")).withColumnRenamed("root", "least_root")
    classes = named.join(least, F.col("root") + F.lit(0) == F.col("least_root") + F.lit(0)).select("fp", "root", "component_id")
    return rows, written(classes, "classes")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of docs (doc_id, text)."""
    rows, classes = groups(docs)
    return rows.join(classes.drop("root"), "fp", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: of its least id, one without an id only where none has; of texts that share the id
    that with the least hash, once.

    Texts stay where they are: the dropped rows' keys are anti-joined. Only rows that repeat the kept id and text are gathered,
    reduced where they stand before that."""
    rows, classes = groups(docs, "stage_fingerprints")
    placed = rows.join(classes.select("fp", "root"), "fp").select("root", "doc_id", "text_hash")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    several = placed.groupBy("root").agg(best.alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1").withColumnRenamed("root", "its_root")
    # joined by keys of their own, so that both sides are dealt anew and a large component can be split
    members = placed.join(several, F.col("root") + F.lit(0) == F.col("its_root") + F.lit(0))
    chosen = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_hash") == F.col("best.text_hash"))
    id_, hash_, kept, n = (free(c, docs) for c in ("__id", "__hash", "__kept", "__n"))
    marked = members.groupBy(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_), chosen.alias(kept)).agg(F.count(F.lit(1)).alias(n))
    marked = written(marked.where(~F.col(kept) | (F.col(n) > 1)), "dropped")
    mine = F.xxhash64("text")
    on = F.col("doc_id").eqNullSafe(F.col(id_)) & (mine == F.col(hash_))
    once = docs.join(marked.where(kept), on, "left_semi").withColumn(hash_, mine).dropDuplicates(["doc_id", hash_]).drop(hash_)
    return docs.join(marked, on, "left_anti").unionAll(once)
