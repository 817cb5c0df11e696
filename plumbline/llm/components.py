"""Connected components of an edge table, by randomised contraction.

Each round every node takes the neighbour (or itself) with the least random priority, edges move to the nodes so taken and
loops go; in expectation a fixed part of the nodes goes each round, so a chain of any length takes a number of rounds
logarithmic in it. Rounds read and write tables in the shared folder, so nothing depends on earlier executors, and the
driver sees counts only. Groups are reduced by partial aggregates and met by shuffle joins that Spark can split, so a hub
needs no task of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b); root is one node of the component. Loops, repeated edges and either
    direction are allowed; edges with a null end are left out; no edges give no rows."""
    edges = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = written(edges, "edges")
    steps: list[DataFrame] = []
    while not edges.isEmpty():
        seed = F.lit(len(steps))
        both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b", seed).alias("p"), F.col("b").alias("n"))).alias("best"))
        own = F.struct(F.xxhash64("a", seed).alias("p"), F.col("a").alias("n"))
        step = written(near.select(F.col("a").alias("node"), F.least(own, "best").getField("n").alias("to")), f"step{len(steps)}")
        steps.append(step)
        moved = edges.join(step.select(F.col("node").alias("a"), F.col("to").alias("ta")), "a").join(step.select(F.col("node").alias("b"), F.col("to").alias("tb")), "b")
        moved = moved.where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"))
        edges = written(moved.distinct(), f"edges{len(steps)}")
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = steps[0].select("node", F.col("to").alias("root"))
    for k, step in enumerate(steps[1:]):
        nxt = step.select(F.col("node").alias("root"), "to")
        out = out.join(nxt, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        if k % 3 == 2:
            out = written(out, f"roots{k}")
    return written(out, "roots")
