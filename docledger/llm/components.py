"""Connected components of a link table by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docledger.session import cut_lineage


def _large_star(links: DataFrame) -> DataFrame:
    """Every neighbour above a node points at the smallest of the node and its neighbours."""
    both = links.union(links.select("b", "a").toDF("a", "b"))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("top"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("top").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours point at the smallest of them; ``a`` > ``b`` on input."""
    least = links.groupBy("a").agg(F.min("b").alias("top"))
    joined = links.join(least, "a")
    onward = joined.where("b > top").select(F.col("b").alias("a"), F.col("top").alias("b"))
    return onward.union(least.select("a", F.col("top").alias("b"))).distinct()


def _mark(links: DataFrame) -> tuple[int, int]:
    row = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
    return row[0], row[1]


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected links (a, b); root is the smallest node reached.

    Links may repeat, be given in either direction or join a node to itself (ignored). No links give
    no rows. The links, never the nodes' neighbour lists, are moved; each round is checkpointed, and
    rounds end when the links no longer change (a few, as stars merge by doubling).
    """
    ordered = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = cut_lineage(ordered)
    before = None
    while before != (mark := _mark(now)):
        before = mark
        now = cut_lineage(_small_star(_large_star(now)))
    return now.toDF("node", "root")
