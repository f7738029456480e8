"""Connected components of a link table by alternating large-star and small-star rounds.

The smallest neighbours are pre-aggregated and stored before they are joined to the links, so both sides of the join
come from plain exchanges and adaptive execution can split the links of a node that has very many.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _large(edges: DataFrame, folder: str, name: str) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), folder, f"{name}-large")
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small(edges: DataFrame, folder: str, name: str) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = stored(down.groupBy("a").agg(F.min("b").alias("m")), folder, f"{name}-small")
    own = least.select("a", F.col("m").alias("b"))
    return down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(own).distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return row["n"], row["x"]


def components(links: DataFrame, folder: str, name: str) -> DataFrame:
    """Links (a, b) -> (node, label): the smallest node that each linked node reaches.

    Each round is written to the shared folder, so a lost executor costs one round at most; only
    a count and a checksum come to the driver. The label itself is not among the nodes.
    """
    edges = stored(links.select("a", "b").where("a <> b").distinct(), folder, f"{name}-0")
    mark, i = _mark(edges), 0
    while mark[0]:
        i += 1
        large = stored(_large(edges, folder, f"{name}-{i}"), folder, f"{name}-{i}-stars")
        edges = stored(_small(large, folder, f"{name}-{i}"), folder, f"{name}-{i}")
        before, mark = mark, _mark(edges)
        if before == mark:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
