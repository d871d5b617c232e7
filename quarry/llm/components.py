"""Connected components of a graph of edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import written

ROUNDS = 40


def _least(pairs: DataFrame) -> DataFrame:
    """u, v with the least of u and its neighbours as m. The minima are formed before the
    shuffle and written, so that the join back is one that Spark can split at a hot node."""
    least = written(pairs.groupBy("u").agg(F.min("v").alias("m")), "least")
    return pairs.join(least, "u").withColumn("m", F.least("u", "m"))


def _print(edges: DataFrame) -> tuple:
    """What tells most different sets of edges apart: their number and the sum of their hashes."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """node, component: a row for each node of the edges (u, v); the component is its least node.

    Every round hangs each node's larger neighbours, then its smaller ones, on the least it knows;
    the edges never grow in number, and rounds grow with the logarithm of the longest path. Each
    round's edges are a written table. Loops and repeated edges do no harm; nulls are left out."""
    now = written(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    told = _print(now)
    for _ in range(ROUNDS):
        if not told[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        small = _least(written(large, "large"))
        after = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        after = written(after, "edges")
        before, told = told, _print(after)
        if told == before and after.join(now, ["u", "v"], "left_anti").isEmpty():
            return after.select(F.col("u").alias("node"), F.col("v").alias("component")).union(after.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
        now = after
    raise RuntimeError(f"components are not settled after {ROUNDS} rounds")
