"""Connected components by contraction to stars, with the rows of a frequent node dealt to several tasks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Links of one node that stay in one task.
HUB = 100_000


def _with_least(links: DataFrame, hub: int, most: int) -> DataFrame:
    """Links (a, b) with ``m``, the least of a and its neighbours. The least is found by partial sums; of a node with more than ``hub`` links
    it is sent to as many pieces as its links are dealt in. ``most`` bounds the number of links: where no node can have that many, none is looked for."""
    stars = links.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
    if most <= hub or stars.filter(F.col("n") > hub).isEmpty():
        return links.join(stars.select("a", "m"), "a")
    pieces = F.ceil(F.col("n") / hub).cast("int")
    large = stars.filter(F.col("n") > hub).select("a", pieces.alias("_k"))
    dealt = links.join(large, "a", "left").withColumn("_p", F.pmod(F.xxhash64("b"), F.coalesce("_k", F.lit(1))).cast("int")).drop("_k")
    return dealt.join(stars.withColumn("_p", F.explode(F.sequence(F.lit(0), pieces - 1))).select("a", "_p", "m"), ["a", "_p"]).drop("_p")


def components(edges: DataFrame, save: Callable[[DataFrame], DataFrame], hub: int = HUB) -> DataFrame:
    """node, root (least node reachable) of links (a, b); nulls link nothing, a node linked to itself only is its own root.

    Each round ties the greater neighbours of every node to its least, then the smaller ones: paths halve, and in the end all nodes hang on
    their root. Links never grow in number; ``save`` writes a round away; rounds end when the links stay as they are.
    """
    given = save(edges.select("a", "b").filter("a is not null and b is not null"))
    nodes = save(given.select(F.col("a").alias("node")).union(given.select("b")).distinct())
    links = save(given.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = save(_with_least(both, hub, 2 * now[0]).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b"))
        small = _with_least(large, hub, 2 * now[0])
        tied = small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b")))
        links = save(tied.filter("a <> b").distinct())
    return nodes.join(links.withColumnRenamed("a", "node"), "node", "left").select("node", F.coalesce("b", "node").alias("root"))
