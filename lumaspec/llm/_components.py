"""Connected components of links too many for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import cut


def _stars(edges: DataFrame, mins: DataFrame) -> DataFrame:
    return edges.join(mins.withColumnRenamed("u", "u_"), F.col("u") == F.col("u_")).drop("u_")


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (its least node) for every node of ``links`` (a, b).

    Large and small stars in turn: each round hangs all that a node sees on the least of it. Rounds
    grow with the logarithm of a component's breadth; each round's edges are written, so a lost
    executor costs one round at most. The sums by node combine before they are shuffled.
    """
    edges = cut(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc-edges"
    )
    before = None
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        mins = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc-mins")
        large = _stars(both, mins).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large, "cc-large")
        mins = cut(large.groupBy("u").agg(F.min("v").alias("m")), "cc-mins")
        small = _stars(large, mins)
        small = small.select("u", F.col("m").alias("v")).unionAll(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        edges = cut(small, "cc-edges")
        mark = edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))), F.countDistinct("u")).first()
        if mark[0] == mark[2] and tuple(mark) == before or mark[0] == 0:
            break
        before = tuple(mark)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
