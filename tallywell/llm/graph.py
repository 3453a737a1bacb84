"""Connected components of a large graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywell.llm.common import shared_checkpoint


def connected_components(links: DataFrame) -> DataFrame:
    """`node` and `root`, the smallest node of its component, for each node of `links` (long columns a and b).

    Alternates large-star and small-star steps until the links are a star around each root. A step groups by node with a
    map-side minimum and joins that minimum back. The minima are dealt out anew before the join, so both its sides are plain
    shuffles and the engine can split the partition of a node with many links. Each round is checkpointed; only a count and a checksum of the links come to the driver.
    Loops (a = b) give a node of its own; repeated and null links change nothing.
    """
    stars = links.where("a is not null and b is not null").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    stars, seen = shared_checkpoint(stars), None
    n = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        now = tuple(stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
        # large-star: every larger neighbour of u goes to the least of u and its neighbours
        both = stars.select("u", "v").union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).repartition(n)
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.union(stars.where("u = v")).distinct()
        # small-star: u and its smaller neighbours go to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m")).repartition(n)
        moved = large.join(least, "u")
        small = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").union(least.select("u", F.col("m").alias("v")))
        stars = shared_checkpoint(small.distinct())
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).union(stars.select("v", "v")).groupBy("node").agg(F.min("root").alias("root"))
