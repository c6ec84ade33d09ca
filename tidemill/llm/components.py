"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.session import checkpoint_folder


def _nearest(links: DataFrame) -> DataFrame:
    """Links with the least neighbour of their first end, itself included."""
    # The least is pre-aggregated and joined back: no task gathers the neighbours of a hub.
    least = links.groupBy("a").agg(F.min("b").alias("least"))
    return links.join(least.withColumn("least", F.least("a", "least")), "a")


def _star(links: DataFrame) -> DataFrame:
    both = links.union(links.select("b", "a")).distinct()
    large = _nearest(both).filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    down = large.filter("a > b").distinct()
    near = _nearest(down)
    small = near.filter("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return small.union(near.select("a", F.col("least").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node``, ``root``: the least node that each node of ``links`` (a, b) reaches; roots are left out.

    Each round hangs every node on the least one it sees and is checkpointed; the rounds end when no
    link changes, after about the logarithm of the longest chain.
    """
    checkpoint_folder(links.sparkSession)
    mark = F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))
    links = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    before = links.agg(F.count("*"), mark).first()
    while before[0]:
        links = _star(links).checkpoint()
        now = links.agg(F.count("*"), mark).first()
        if now == before:
            break
        before = now
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
