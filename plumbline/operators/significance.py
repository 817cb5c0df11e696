"""Multiple comparisons, exact signed ranks, two-sample distances."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.stored import kept
from .order import cumulated, known


def adjusted(df: DataFrame, p: str, *by: str, unique: tuple[str, ...]) -> DataFrame:
    """df with p_holm and p_bh over each family ``by``; null p-values are in no family and stay null. ``unique`` settles ties."""
    known = F.col(p).isNotNull() & ~F.isnan(p)
    w = Window.partitionBy(*by, known.alias("known")).orderBy(p, *unique)
    m = F.count(F.lit(1)).over(Window.partitionBy(*by, known.alias("known")))
    i = F.row_number().over(w)
    out = df.withColumns({"__m": m, "__i": i, "__known": known})
    holm = F.max((F.col("__m") - F.col("__i") + 1) * F.col(p)).over(Window.partitionBy(*by, "__known").orderBy("__i").rowsBetween(Window.unboundedPreceding, 0))
    bh = F.min(F.col("__m") / F.col("__i") * F.col(p)).over(Window.partitionBy(*by, "__known").orderBy("__i").rowsBetween(0, Window.unboundedFollowing))
    out = out.withColumns({"p_holm": F.when(F.col("__known"), F.least(F.lit(1.0), holm)), "p_bh": F.when(F.col("__known"), F.least(F.lit(1.0), bh))})
    return out.drop("__m", "__i", "__known")


def signed_rank(differences) -> float | None:
    """Two-sided p-value of the signed-rank test: exact without ties or zeros, which go first, else normal with a correction for
    ties. None for fewer than six values or no difference at all."""
    x = [d for d in differences if d is not None and d == d and abs(d) != float("inf")]
    if len(x) < 6 or not any(x):
        return None
    zeros = any(d == 0 for d in x)
    x = [d for d in x if d != 0]
    n, size = len(x), sorted(abs(d) for d in x)
    place: dict[float, list[int]] = {}
    for i, v in enumerate(size, 1):
        place.setdefault(v, []).append(i)
    rank = {v: sum(at) / len(at) for v, at in place.items()}
    plus = sum(rank[abs(d)] for d in x if d > 0)
    low = min(plus, n * (n + 1) / 2 - plus)
    if not zeros and len(place) == n and n <= 50:
        ways = [1] + [0] * (n * (n + 1) // 2)
        for k in range(1, n + 1):
            for s in range(len(ways) - 1, k - 1, -1):
                ways[s] += ways[s - k]
        return min(1.0, 2 * sum(ways[: int(low) + 1]) / 2**n)
    from math import erfc, sqrt

    ties = sum(len(at) ** 3 - len(at) for at in place.values())
    var = n * (n + 1) * (2 * n + 1) / 24 - ties / 48
    return min(1.0, erfc(abs(low - n * (n + 1) / 4) / sqrt(2 * var))) if var > 0 else None


@F.pandas_udf(DoubleType())
def wilcoxon(d: pd.Series) -> pd.Series:
    """Of an array of differences, one for each task."""
    return pd.Series([signed_rank(list(x)) if x is not None else None for x in d], dtype="float64")


def paired_tests(tasks: DataFrame, baseline: str) -> DataFrame:
    """Signed-rank tests of every model's fractions against the baseline's over tasks, adjusted over all splits and models."""
    base = tasks.where(F.col("model") == baseline).select("task", "split", F.col("frac_ceiling").alias("base"))
    rows = tasks.where(F.col("model") != baseline).join(base, ["task", "split"]).groupBy("split", "model")
    tested = rows.agg(F.collect_list(F.col("frac_ceiling") - F.col("base")).alias("d"))
    # NaN, as Python gives a missing value, becomes null again
    out = tested.select("split", "model", F.size("d").alias("n_tasks"), F.nanvl(wilcoxon("d"), F.lit(None).cast("double")).alias("wilcoxon_p"))
    return adjusted(out, "wilcoxon_p", unique=("split", "model")).withColumn("inside_noise", ~F.coalesce(F.col("p_holm") < 0.05, F.lit(False)))


def ks(df: DataFrame, value: str, side: str, *by: str) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance of value between side true and false; null where a side is empty."""
    rows = df.select(F.struct(*by).alias("g"), known(value).alias("k"), F.col(side).alias("side")).where("k IS NOT NULL")
    counts = kept(rows.groupBy("g", "k").agg(F.count_if("side").alias("a"), F.count_if(~F.col("side")).alias("b")), "values")
    total = counts.groupBy("g").agg(F.sum("a").alias("all_a"), F.sum("b").alias("all_b"))
    none = F.lit(0)
    gap = F.abs(F.col("upto_a") / F.nullif("all_a", none) - F.col("upto_b") / F.nullif("all_b", none))
    return cumulated(counts, ["a", "b"]).join(total, "g").groupBy("g").agg(F.max(gap).alias("ks")).select("g.*", "ks")
