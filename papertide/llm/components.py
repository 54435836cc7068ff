"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papertide.llm.common import HOT_ROWS, split_join, written


def star_components(edges: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Links ``(a, b)`` of any orderable type -> ``(node, root)``, root being the least node
    reachable. Nodes without a link to another are absent; links that hold null count for nothing. The rounds
    stop when the links no longer change; each is written to the shared folder, links never reach the driver.
    A star of more than ``hot_rows`` links is split over several tasks.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    links = written(edges.filter("a <> b").select(high.alias("a"), low.alias("b")).distinct(), "links")
    before = None
    while True:
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
        both = links.union(links.select(F.col("b"), F.col("a")))
        keep = (lambda df, name: df) if 2 * now[0] <= hot_rows else written  # what is counted and joined is made once
        stars = keep(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n"), "stars")
        large = split_join(both.filter("b > a"), stars.select("a", "m"), ["a"], stars.select("a", "n"), hot_rows=hot_rows, total=2 * now[0])
        large = keep(large.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b"), "large-stars")
        least = keep(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "stars")
        small = split_join(large, least.select("a", "m"), ["a"], least.select("a", "n"), hot_rows=hot_rows, total=2 * now[0])
        small = small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = written(small.union(least.select("a", F.col("m").alias("b"))).distinct(), "links")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(links.select("b", "b").distinct())
