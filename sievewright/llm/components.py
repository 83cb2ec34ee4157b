"""Connected components of a graph given as links, without collecting any part of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, remove


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of the links (a, b): root is the smallest node of its component.

    Alternates large-star and small-star steps until the links no longer change. Each step takes the least neighbour
    by a partial aggregation and joins it back, which AQE can split where one node has very many links. Loops, repeated
    links and either direction are allowed; no links give no rows.
    """
    kind = links.schema["a"].dataType
    now = materialize(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = _mark(now)
    while mark[0]:
        after = materialize(_small_star(_large_star(now)), "links")
        remove(now)
        now, before, mark = after, mark, _mark(after)
        if mark == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").cast(kind).alias("node"), F.col("b").alias("root")).distinct())


def _mark(links: DataFrame) -> tuple:
    """The links' number and an order-free sum of them; equal sums mean that nothing changed."""
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
