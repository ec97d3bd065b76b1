"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import stored


def _nearest_root(pairs: DataFrame, towards: str, other: str) -> DataFrame:
    """The pairs with the smallest id among ``towards`` and all its partners."""
    least = pairs.groupBy(F.col(towards).alias("_t")).agg(F.min(other).alias("_m"))
    least = least.select("_t", F.least("_t", "_m").alias("_root"))
    return pairs.join(least, F.col(towards) == F.col("_t")).drop("_t")


def components(links: DataFrame, label: str = "links") -> DataFrame:
    """(node, root) for every node of the links (columns a, b): root is the smallest node reachable.

    Alternating large-star and small-star steps: every round hangs a node's partners on the smallest
    of them, so the number of links never grows and paths shorten fast.  A round is a few
    aggregations and joins; its result is written to the shared folder, and only a count and a
    checksum reach the driver to see whether anything changed.
    """
    edges = links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("u < v").distinct()
    state = None
    while True:
        edges = stored(edges, label)
        now = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.shiftright(F.xxhash64("v", "u"), 24))).first())
        if now == state:
            break
        state = now
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        # large star: partners larger than x go to the smallest partner of x (or x)
        large = _nearest_root(both, "u", "v").where("v > u").select("v", F.col("_root").alias("u")).where("u < v").distinct()
        # small star: x and its smaller partners go to the smallest of them
        small = _nearest_root(large, "v", "u")
        edges = (
            small.select(F.col("u").alias("v"), F.col("_root").alias("u"))
            .unionByName(small.select("v", F.col("_root").alias("u")))
            .where("u < v")
            .distinct()
        )
    roots = edges.groupBy("v").agg(F.min("u").alias("root")).withColumnRenamed("v", "node")
    return roots.unionByName(edges.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
