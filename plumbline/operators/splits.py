"""Train/test splits by hashes, so that they depend on keys and a seed only, not on the order of rows.

Ranks within a task are counts of lower buckets plus a rank within the bucket: no task's rows pass through one sort.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..functions.stored import kept
from .order import ranks

SEEDS = (0, 1, 2, 3, 4)
BUCKETS = 8


def hash_unit(seed, *keys) -> Column:
    """A whole number below 2 ** 32 from the first eight hex digits of md5(seed|keys); seed is a number or a column's name."""
    first = F.col(seed).cast("string") if isinstance(seed, str) else F.lit(str(seed))
    return F.conv(F.substring(F.md5(F.concat_ws("|", first, *[F.col(k).cast("string") for k in keys])), 1, 8), 16, 10).cast("long")


def _taken(n: Column, share: float) -> Column:
    """Half to even, as the share of n to test."""
    return F.bround(n * share, 0).cast("long")


def ranked(rows: DataFrame, by: list[str], bucket: str, *order) -> DataFrame:
    """rows with __at, the place from 1 among their ``by`` in order of (bucket, order), and __n, how many there are."""
    w = Window.partitionBy(*by).orderBy(bucket)
    sizes = rows.groupBy(*by, bucket).agg(F.count(F.lit(1)).alias("__c"))
    below = F.coalesce(F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*by, bucket, below.alias("__below"), F.sum("__c").over(Window.partitionBy(*by)).alias("__n"))
    own = F.row_number().over(Window.partitionBy(*by, bucket).orderBy(*order))
    return rows.withColumn("__own", own).join(sizes, [*by, bucket]).withColumn("__at", F.col("__below") + F.col("__own")).drop("__own", "__below")


def seeded(e: DataFrame, seeds) -> DataFrame:
    return e.withColumn("seed", F.explode(F.array(*map(F.lit, seeds))))


def _cuts(e: DataFrame, seeds, share: float) -> DataFrame:
    """(task, seed, cut): hash and id of the last entity that goes to test. Only the bucket that the cut falls in is ranked."""
    rows = seeded(e.select("task", "mol_id"), seeds).withColumn("__h", hash_unit("seed", "task", "mol_id")).withColumn("__b", F.shiftright("__h", 32 - BUCKETS))
    sizes = rows.groupBy("task", "seed", "__b").agg(F.count(F.lit(1)).alias("__c"))
    run = Window.partitionBy("task", "seed")
    upto = F.sum("__c").over(run.orderBy("__b").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    sizes = sizes.withColumns({"__upto": upto, "__k": _taken(F.sum("__c").over(run), share)})
    at = kept(sizes.where("__k <= __upto AND __k > __upto - __c").select("task", "seed", "__b", (F.col("__k") - F.col("__upto") + F.col("__c")).alias("__k")), "cuts")
    inside = rows.join(at, ["task", "seed", "__b"]).withColumn("__at", F.row_number().over(run.orderBy("__h", "mol_id")))
    return kept(inside.where("__at = __k").select("task", "seed", F.struct("__h", "mol_id").alias("cut")), "cuts")


def random_splits(e: DataFrame, seeds=SEEDS, share: float = 0.2) -> DataFrame:
    """The entities of lowest hash are the test: those up to :func:`_cuts`, so that no entity is moved."""
    out = seeded(e, seeds).join(_cuts(e, seeds, share), ["task", "seed"], "left")
    part = F.when(F.struct(hash_unit("seed", "task", "mol_id").alias("__h"), "mol_id") <= F.col("cut"), "test").otherwise("train")
    return out.select(*e.columns, "seed", part.alias("part"))


def temporal_split(e: DataFrame, share: float = 0.2, stored: bool = False) -> DataFrame:
    """The latest entities are the test; ties by id. Nothing to take gives an empty test.

    Whole years are placed by their counts; only the year that the cut falls in is ranked, by :func:`ranks`, whose hot groups
    don't meet in one task (ids are numbers; others are ranked by a window)."""
    e = (e if stored else kept(e, "entities")).withColumn("__y", F.coalesce("first_year", F.lit(-1)))
    years = e.groupBy("task", "__y").agg(F.count(F.lit(1)).alias("__c"))
    upto = F.sum("__c").over(Window.partitionBy("task").orderBy("__y").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    years = years.select("task", "__y", (upto - F.col("__c")).alias("__below"), upto.alias("__upto"), F.sum("__c").over(Window.partitionBy("task")).alias("__n"))
    cut = F.col("__n") - _taken(F.col("__n"), share)
    years = years.withColumn("__place", F.when(F.col("__below") >= cut, "test").when(F.col("__upto") <= cut, "train")).withColumn("__cut", cut - F.col("__below"))
    placed = e.join(kept(years.select("task", "__y", "__place", "__cut"), "years"), ["task", "__y"])
    split = placed.where("__place IS NULL")
    if isinstance(e.schema["mol_id"].dataType, IntegralType):
        ranked_ = ranks(split, ["task"], {"__at": "mol_id"})
    else:
        ranked_ = split.withColumn("__at", F.row_number().over(Window.partitionBy("task").orderBy("mol_id")))
    split = ranked_.withColumn("__place", F.when(F.col("__at") > F.col("__cut"), "test").otherwise("train")).drop("__at")
    out = placed.where("__place IS NOT NULL").unionByName(split)
    return out.withColumn("part", F.col("__place")).drop("__y", "__place", "__cut")


def _prefixes(rows: DataFrame, by: list[str], bucket: Column, order: list[str], size: str) -> DataFrame:
    """rows with ``upto``, the sum of size over rows up to and with each in order of (bucket, order) within by: sums of lower buckets, and
    a running sum in the bucket."""
    rows = rows.withColumn("bucket", bucket)
    w = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = rows.groupBy(*by, "bucket").agg(F.sum(size).alias("all"))
    below = sums.select(*by, "bucket", (F.sum("all").over(w) - F.col("all")).alias("below"))
    own = F.sum(size).over(Window.partitionBy(*by, "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("own", own).join(below, [*by, "bucket"]).withColumn("upto", F.col("own") + F.col("below")).drop("bucket", "own", "below")


def _test_groups(e: DataFrame, group: str, seeds, share: float) -> DataFrame:
    """(task, group, seeds): the seeds whose test a group is in, of groups that are in any.

    In rounds for all tasks and seeds: groups larger than what is left can't fit any more and go; of the others the longest run from
    the start that fits is what a walk would take; it lessens what is left for those behind it. Sizes and prefix sums of groups
    are all that moves, and no task's groups meet in one place."""
    sizes = e.where(F.col(group).isNotNull()).groupBy("task", group).agg(F.count(F.lit(1)).alias("size"))
    total = e.groupBy("task").agg(_taken(F.count(F.lit(1)), share).alias("left"))
    rows = seeded(sizes.join(total, "task"), seeds).withColumn("at", hash_unit("seed", "task", group)).withColumnRenamed(group, "name")
    run, taken = ["task", "seed"], []
    while True:
        fitting = rows.where(F.col("size") <= F.col("left"))
        now = kept(_prefixes(fitting, run, F.shiftright("at", 20), ["at", "name"], "size"), "groups")
        if now.isEmpty():
            break
        first = now.where("upto <= left")
        taken.append(first.select(*run, "name"))
        used = first.groupBy(*run).agg(F.max("upto").alias("used"))
        rows = now.where("upto > left").join(used, run).select(*run, "name", "size", "at", (F.col("left") - F.col("used")).alias("left"))
    test = reduce(DataFrame.unionAll, taken) if taken else rows.where("false")
    return kept(test.groupBy("task", F.col("name").alias(group)).agg(F.collect_set("seed").alias("seeds")), "test_groups")


def group_splits(e: DataFrame, group: str, seeds=SEEDS, share: float = 0.2) -> DataFrame:
    """Whole groups, in hashed order, go to test while they fit what is left of its budget; entities without a group are train."""
    out = seeded(e.join(_test_groups(e, group, seeds, share), ["task", group], "left"), seeds)
    part = F.when(F.array_contains("seeds", F.col("seed")), "test").otherwise("train")
    return out.select(*e.columns, "seed", part.alias("part"))


def sample(e: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n rows, the least by hash."""
    return e.orderBy(hash_unit(seed, "task", "mol_id"), "task", "mol_id").limit(n)


SPLITS = {
    "random": lambda e, seed=0, share=0.2: random_splits(kept(e, "entities"), (seed,), share).drop("seed"),
    "scaffold": lambda e, seed=0, share=0.2: group_splits(e, "structure", (seed,), share).drop("seed"),
    "temporal": lambda e, seed=0, share=0.2: temporal_split(e, share),
}


def all_splits(e: DataFrame, group: str = "structure", seeds=SEEDS, share: float = 0.2) -> DataFrame:
    """e once for each split and seed, with split, seed and part. The temporal split is the same for every seed. What is written is a row
    for each entity with its sides; it is spread where it is read, so that an entity's value is one and the same in all splits, to
    the last digit, and no entity is moved for a split."""
    e = kept(e, "entities")
    cuts = kept(_cuts(e, seeds, share).groupBy("task").agg(F.map_from_entries(F.collect_list(F.struct("seed", "cut"))).alias("__cuts")), "cuts")
    late = temporal_split(e, share, stored=True).withColumnRenamed("part", "__late")
    rows = late.join(cuts, "task", "left").join(_test_groups(e, group, seeds, share).withColumnRenamed("seeds", "__seeds"), ["task", group], "left")
    sides = {
        "random": lambda s: F.struct(hash_unit(s, "task", "mol_id").alias("__h"), "mol_id") <= F.try_element_at("__cuts", F.lit(s)),
        "scaffold": lambda s: F.array_contains("__seeds", F.lit(s)),
    }

    def run(split, seed, test):
        return F.struct(F.lit(split).alias("split"), F.lit(seed).alias("seed"), F.when(test, "test").otherwise("train").alias("part"))

    runs = [run(n, s, of(s)) for n, of in sides.items() for s in seeds] + [run("temporal", s, F.col("__late") == "test") for s in seeds]
    # what follows is done where these rows are, many times what they are: dealt out to all tasks
    spark = e.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return kept(rows.select(*e.columns, F.array(*runs).alias("__runs")).repartition(tasks, "task", "mol_id"), "splits").select(*e.columns, F.inline("__runs"))
