"""Exact order statistics and ranks of groups of any size, without a sort or a buffer that holds a group.

A double has a whole number that orders alike, :func:`ordered`; its leading bits are a bucket. Histograms of buckets are partial
aggregates, with a row for each bucket and task. A quantile refines only the buckets that hold its order statistics, by some more
bits a round, until a bucket is one value or few enough to be listed; all groups, columns and probabilities share a round. Ranks
refine the buckets with many distinct values, so that every cell is small; a value's rank is what the cells below it hold and
what precedes it in its own. Ranks of rows come from a window for each group that one task sorts with ease, which is counted, not
assumed; larger groups are cut at quantiles of their values into ranges, each a window of its own.

Null and NaN values have no part: no quantile counts them and their rank is null. Groups with a null key are groups.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stored import kept

#: Low bits that are no part of a bucket, round by round.
SHIFTS = (48, 36, 24, 12, 0)
#: A group of either sign is two buckets.
WHOLE = 63
#: Rows of a bucket that are listed, distinct values of a cell, rows of a group that one sort takes, and ranges of a larger one at most.
LISTED = 2048
CELL = 100_000
GROUP = 1_000_000
RANGES = 1000


def ordered(x: Column) -> Column:
    """A long that orders as the double x does; zeros of either sign are equal. Exponent and mantissa come from exact steps by powers
    of two: the guess by a logarithm is put right, and numbers under 2 ** -1022 count in units of 2 ** -1074."""
    a = F.abs(x.cast("double"))
    guess = F.floor(F.log2(a)).cast("int")
    power = lambda e: F.pow(F.lit(2.0), e)
    e = F.when(a < power(guess), guess - 1).when((guess < 1023) & (a / 2 >= power(guess)), guess + 1).otherwise(guess)
    mantissa = (a / power(e) - 1) * float(1 << 52)
    unit = float(1 << 537)
    bits = (
        F.when(a == float("inf"), F.lit(0x7FF << 52).cast("long"))
        .when(a >= 2.0**-1022, (e.cast("long") + 1023) * F.lit(1 << 52).cast("long") + mantissa.cast("long"))
        .otherwise((a * unit * unit).cast("long"))
    )
    return F.when(x < 0, -bits).otherwise(bits)


def _bucket(shift: int) -> Column:
    return F.shiftright("k", shift)


def quantiles(df: DataFrame, by: list[str] | tuple[str, ...], wanted: dict[str, tuple]) -> DataFrame:
    """by and a column for each of wanted, name -> (column or its name, probability): the quantile interpolated between order statistics.
    A group without values of a column has null there, one without any values no row; without by there is always one row."""
    columns = {}
    for c, _ in wanted.values():
        columns.setdefault(str(c), (f"c{len(columns)}", F.col(c) if isinstance(c, str) else c))
    each = F.array(*[F.struct(F.lit(n).alias("c"), c.cast("double").alias("v")) for n, c in columns.values()])
    group = F.struct(*by) if by else F.struct(F.lit(0).alias("all"))
    rows = df.select(group.alias("g"), F.inline(each)).where("v IS NOT NULL AND NOT isnan(v)")
    rows = kept(rows.withColumn("k", ordered(F.col("v"))), "values")
    at = {n: sorted({p for c, p in wanted.values() if columns[str(c)][0] == n}) for n, _ in columns.values()}
    listed = reduce(lambda a, x: a.when(F.col("c") == x[0], F.array(*map(F.lit, x[1]))), at.items(), F.when(F.lit(False), F.array().cast("array<double>")))

    def counted(part: DataFrame, keys: list[str], shift: int) -> DataFrame:
        return part.groupBy(*keys, _bucket(shift).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))

    def located(counts: DataFrame, keys: list[str], ranks: DataFrame) -> DataFrame:
        """The bucket of each rank (counted from 0 within keys), and its place in the bucket."""
        before = F.sum("n").over(Window.partitionBy(*keys).orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
        placed = counts.withColumn("before", before)
        return placed.join(ranks, keys).where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n")))

    first = kept(counted(rows, ["g", "c"], SHIFTS[0]), "histogram")
    total = first.groupBy("g", "c").agg(F.sum("n").alias("total")).withColumn("p", F.explode(listed)).withColumn("h", F.col("p") * (F.col("total") - 1))
    total = total.withColumns({"low": F.floor("h"), "part": F.col("h") - F.floor("h")})
    ranks = total.select("g", "c", F.explode(F.array("low", F.least(F.col("low") + 1, F.col("total") - 1))).alias("rank")).distinct()
    now = located(first, ["g", "c"], ranks).select("g", "c", F.col("rank").alias("asked"), (F.col("rank") - F.col("before")).alias("rank"), "b", "n", "lo", "hi")
    found = []
    for shift, after in zip(SHIFTS, (*SHIFTS[1:], None)):
        now = kept(now, "located")
        found.append(now.where("lo = hi").select("g", "c", "asked", F.col("lo").alias("value")))
        open_ = now.where("lo < hi")
        most = open_.agg(F.max("n")).first()[0]
        if most is None:
            break
        inside = rows.withColumn("b", _bucket(shift)).join(open_.select("g", "c", "b").distinct(), ["g", "c", "b"], "left_semi")
        if most <= LISTED:
            lists = inside.groupBy("g", "c", "b").agg(F.sort_array(F.collect_list("v")).alias("all"))
            found.append(open_.join(lists, ["g", "c", "b"]).select("g", "c", "asked", F.get("all", F.col("rank").cast("int")).alias("value")))
            break
        keys = ["g", "c", "outer"]
        inner = counted(inside.withColumnRenamed("b", "outer"), keys, after)
        asked = open_.select("g", "c", F.col("b").alias("outer"), "asked", "rank")
        now = located(inner, keys, asked).select("g", "c", "asked", (F.col("rank") - F.col("before")).alias("rank"), "b", "n", "lo", "hi")
    values = reduce(DataFrame.unionAll, found)
    low, high = values.select("g", "c", F.col("asked").alias("low"), F.col("value").alias("v0")), values.select("g", "c", F.col("asked").alias("next"), F.col("value").alias("v1"))
    both = total.withColumn("next", F.least(F.col("low") + 1, F.col("total") - 1)).join(low, ["g", "c", "low"]).join(high, ["g", "c", "next"])
    # between equal values, infinite ones too, there is nothing to weigh
    both = both.withColumn("q", F.when((F.col("v0") == F.col("v1")) | (F.col("part") == 0), F.col("v0")).otherwise(F.col("v0") * (1 - F.col("part")) + F.col("v1") * F.col("part")))
    own = [F.max(F.when((F.col("c") == columns[str(c)][0]) & (F.col("p") == p), F.col("q"))).alias(name) for name, (c, p) in wanted.items()]
    return both.groupBy("g").agg(*own).select("g.*", *wanted) if by else both.agg(*own)


def _cells(values: DataFrame) -> DataFrame:
    """values (g, k, n, ...), a row for each distinct k of a group, with the first k of their cell: ranges of k with at most ``CELL`` of
    them, or one."""
    open_, out = values, []
    for shift in (WHOLE, *SHIFTS):
        size = open_.groupBy("g", _bucket(shift).alias("__b")).agg(F.count(F.lit(1)).alias("__size"))
        big = kept(size.where(F.col("__size") > CELL).select("g", "__b"), "big")
        none = shift == 0 or big.isEmpty()
        here = open_.withColumn("__b", _bucket(shift))
        small = here if none else here.join(big, ["g", "__b"], "left_anti")
        out.append(small.withColumn("cell", F.expr(f"shiftleft(__b, {shift})")).drop("__b"))
        if none:
            break
        open_ = here.join(big, ["g", "__b"], "left_semi").drop("__b")
    return reduce(lambda a, b: a.unionByName(b), out)


def cumulated(values: DataFrame, sums: list[str]) -> DataFrame:
    """values (g, k, sums), a row for each distinct k of a group, with upto_ columns: each sum over the k up to and with its own."""
    placed = _cells(values)
    names = {c: f"upto_{c}" for c in sums}
    upto = Window.partitionBy("g").orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = placed.groupBy("g", "cell").agg(*[F.sum(c).alias(c) for c in sums])
    below = whole.select("g", "cell", *[(F.sum(c).over(upto) - F.col(c)).alias(f"below_{c}") for c in sums])
    inner = Window.partitionBy("g", "cell").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = placed.withColumns({n: F.sum(c).over(inner) for c, n in names.items()}).join(below, ["g", "cell"])
    return out.withColumns({n: F.col(n) + F.col(f"below_{c}") for c, n in names.items()}).drop("cell", *[f"below_{c}" for c in sums])


def _group(by) -> Column:
    return F.struct(*[F.col(c).alias(f"g{i}") for i, c in enumerate(by)], F.lit(0).alias("all"))


def known(column: str) -> Column:
    """The column's place in order; null where it has none."""
    x = F.col(column).cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x), ordered(x))


def _real(column: str) -> Column:
    x = F.col(column)
    return F.when(x.isNotNull() & ~F.isnan(x), x)


def _place(x: Column, *by) -> Column:
    """The middle place of x among its peers, from one sort."""
    w = Window.partitionBy(*by).orderBy(x.asc_nulls_last())
    peers = F.count(F.lit(1)).over(w.rangeBetween(Window.currentRow, Window.currentRow))
    return F.when(x.isNotNull(), F.rank().over(w) + (peers - 1) / F.lit(2.0))


def ranks(df: DataFrame, by: list[str] | tuple[str, ...], columns: dict[str, str], stored: bool = False) -> DataFrame:
    """df with a column for each of columns, name of a rank -> column: from 1 within by, ties share the mean of theirs. Where a group has
    over ``GROUP`` rows, ranges of its values are sorted instead; the rows of one frequent value need no sort. df is written first
    unless it is ``stored``: values computed twice could differ in their last digit."""
    df = df if stored else kept(df, "ranked")
    most = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")).agg(F.max("__n")).first()[0] or 0
    if most > GROUP:
        return _ranged(df, by, columns, min(-(-most // GROUP) + 1, RANGES))
    return df.withColumns({name: _place(_real(column), *by) for name, column in columns.items()})


def _ranged(df: DataFrame, by, columns: dict[str, str], ranges: int) -> DataFrame:
    """The same by ranges of values: a value that quantiles name is a range of its own, so what is sorted are rows between two of them."""
    at = [i / ranges for i in range(1, ranges)]
    edges = df.groupBy(_group(by).alias("__g")).agg(*[F.array_distinct(F.percentile_approx(_real(c), at, 10_000)).alias(f"__e{i}") for i, c in enumerate(columns.values())])
    edges = kept(edges, "edges")

    def place(c: str, i: int) -> Column:
        x = _real(c)
        return F.when(x.isNotNull(), F.aggregate(f"__e{i}", F.lit(0), lambda n, e: n + F.when(e < x, 2).when(e == x, 1).otherwise(0)))

    places = {i: place(c, i) for i, c in enumerate(columns.values())}
    placed = df.join(edges, _group(by) == F.col("__g"))
    each = F.array(*[F.struct(F.lit(i).alias("__c"), b.alias("__b"), _real(columns[n]).cast("double").alias("__x")) for (i, b), n in zip(places.items(), columns)])
    sizes = placed.select("__g", F.inline(each)).where("__b IS NOT NULL").groupBy("__g", "__c", "__b").agg(F.count(F.lit(1)).alias("__n"), (F.min("__x") == F.max("__x")).alias("__flat"))
    below = F.sum("__n").over(Window.partitionBy("__g", "__c").orderBy("__b").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("__n")
    sizes = kept(sizes.withColumn("__below", below), "ranges")
    for i, (name, column) in enumerate(columns.items()):
        own = sizes.where(F.col("__c") == i).select(F.col("__g").alias("__of"), F.col("__b").alias("__range"), "__n", "__flat", "__below")
        df = df.join(edges.select("__g", f"__e{i}"), _group(by) == F.col("__g")).withColumn("__b", places[i])
        df = df.join(own, (F.col("__g") == F.col("__of")) & (F.col("__b") == F.col("__range")), "left")
        # rows that need no sort stay apart by where they are
        df = df.withColumn("__s", F.when(F.coalesce("__flat", F.lit(True)), F.spark_partition_id()).otherwise(-1))
        middle = F.when(F.col("__flat"), (F.col("__n") + 1) / F.lit(2.0)).otherwise(_place(_real(column), *by, "__b", "__s"))
        df = df.withColumn(name, F.col("__below") + middle).drop("__g", f"__e{i}", "__b", "__of", "__range", "__n", "__flat", "__below", "__s")
    return df
