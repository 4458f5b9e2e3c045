"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.tables import staged


def stars(edges: DataFrame) -> DataFrame:
    """Every node of ``edges(a, b)`` but the roots: ``node, root``.

    ``root`` is the least node of the component. Larger neighbours of a node, then
    smaller ones, are pointed at the least of its neighbourhood, until nothing
    changes; that takes a number of rounds logarithmic in the nodes. A round only
    aggregates and joins, so no neighbourhood is ever gathered.
    """
    pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    pairs = staged(pairs.filter("a <> b").distinct())
    before = None
    while True:
        pairs = staged(small_star(large_star(pairs)))
        now = tuple(
            pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        )
        if now == before or not now[0]:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


def large_star(pairs: DataFrame) -> DataFrame:
    both = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def small_star(pairs: DataFrame) -> DataFrame:
    """All pairs have ``a > b``."""
    least = pairs.groupBy("a").agg(F.min("b").alias("m"))
    moved = pairs.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select("a", F.col("m").alias("b"))).distinct()
