"""Connected components of a table of links, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm.rows import hold, release

FEW = 1_000_000  # links that one task can hold, all of one node's
HEAVY_NODES = 10_000  # nodes that may count as heavy


def _lowest(links: DataFrame, n: int) -> DataFrame:
    """Each of ``n`` links with the smallest of its first node and that node's neighbours.

    A node of very many links would be one key of the join. Where there are more than ``FEW``
    links, the nodes of more than one in ``HEAVY_NODES`` of them go to every task instead.
    """
    degrees = links.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("degree"))
    lowest = F.least("a", "low")
    if n <= FEW:
        return links.join(degrees.select("a", lowest.alias("low")), "a")
    is_heavy = F.col("degree") > n // HEAVY_NODES
    heavy = F.broadcast(degrees.where(is_heavy).select("a", lowest.alias("low")))
    marked = links.join(heavy, "a", "left")
    light = marked.where("low is null").drop("low").join(degrees.where(~is_heavy).select("a", lowest.alias("low")), "a")
    return marked.where("low is not null").unionByName(light)


def components(links: DataFrame) -> DataFrame:
    """(node, component) for each node of ``links`` (columns ``a``, ``b``), its smallest member.

    Large and small stars take turns until the links no longer change: neighbours above a
    node are tied to its smallest neighbour, then those below it. Tables stay linear in the
    links; nothing but a count and a checksum reaches the driver. Nulls and loops are no links.
    """
    links = hold(links.where("a <> b").select("a", "b"), "links")
    seen = _mark(links)
    while True:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _lowest(both, 2 * seen.n).where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        small = _lowest(large.where("b < a").distinct(), 2 * seen.n)
        tied = small.select(F.col("b").alias("a"), F.col("low").alias("b")).union(small.select("a", F.col("low").alias("b")))
        following = hold(tied.where("a <> b").distinct(), "links")
        release(links)
        links, mark = following, _mark(following)
        if seen == mark:
            break
        seen = mark
    ends = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return ends.union(links.select("b", "b")).distinct()


def _mark(links: DataFrame):
    return links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
