"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import materialise, temporary


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Every node's neighbours (large: the greater ones; small: the lesser ones) are linked with the least of them."""
    both = links.union(links.select(F.col("b"), F.col("a")).toDF("a", "b")) if large else links
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = both.join(least, "a")
    if large:
        moved = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.filter("a <> m").select("a", "m"))
    return moved.filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root: the least node that is reachable, for every node with a link. `links`: a and b, of one type that
    has an order. Links between equal nodes say nothing, nor do links with a null; without links there are no rows."""
    state, now = None, links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    with temporary(links.sparkSession) as keep:
        now = materialise(now, "links")
        while True:
            with temporary(links.sparkSession) as keep_next:
                now = keep_next(materialise(_star(_star(now, large=True), large=False), "links"))
            seen = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
            if tuple(seen) == state:
                keep(now)
                break
            state = tuple(seen)
    roots = now.groupBy("a").agg(F.min("b").alias("b"))
    return roots.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots.select(F.col("b"), F.col("b")).distinct())
