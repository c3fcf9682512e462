"""Connected components of links between ids, as joins and sums.

Each round every node takes the smallest id among itself and its neighbours (large star),
then the links are turned towards those (small star). All sums are combined before the
shuffle; a node with very many links is one key of a join whose large side Spark can
split. Rounds are few (the logarithm of the longest chain); each is written to the shared
folder, so that a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratelake.llm.rows import staged_rows


def components(links: DataFrame) -> DataFrame:
    """node and component (the smallest node it is linked with, itself included).

    links has columns a and b; nodes without links are not in the result. Repeated and
    looped links are allowed; an empty table gives no rows.
    """
    pairs = links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    pairs = staged_rows(pairs.distinct(), "links")
    sums = _sums(pairs)
    while True:
        # Large star: from each node to its larger neighbours, the smallest neighbour.
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = (
            both.join(least, "a")
            .where("b > a")
            .select(F.col("b").alias("a"), F.col("low").alias("b"))
            .where("a != b")
            .distinct()
        )
        large = staged_rows(large, "links")
        # Small star: from each node and its smaller neighbours, the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        turned = large.join(least, "a").where("b != low").select(F.col("b").alias("a"), "low")
        small = least.select("a", "low").unionByName(turned).toDF("a", "b").where("a != b")
        pairs = staged_rows(small.distinct(), "links")
        now = _sums(pairs)
        if now == sums:
            break
        sums = now
    return pairs.groupBy("a").agg(F.min("b").alias("b")).toDF("node", "component").unionByName(
        pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def _sums(pairs: DataFrame) -> tuple:
    """Tells two sets of links apart: their number and the sum of their hashes."""
    mark = F.xxhash64("a", "b").cast("decimal(20,0)")
    return tuple(pairs.agg(F.count("*"), F.sum(mark)).first())
