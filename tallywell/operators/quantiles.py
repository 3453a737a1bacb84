"""Exact quantiles by distributed selection.

Rows are counted by value; the counts are summed over buckets of values (a value's high bits), and a running sum over a group's
buckets says which one holds each wanted rank. Only the counts of these buckets are then summed one by one, to the two values between
which a quantile lies. So no task sees all values of a group: a window holds a group's buckets, or the distinct values of one bucket,
whose numbers the range and the width of a bucket bound, however many rows there are.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Low bits of a value that a bucket spans; of microseconds, a bucket is about a second.
BITS = 20


def by_ranks(rows: DataFrame, value: str, shares: Sequence[float], by: Sequence[str] = (), bits: int = BITS) -> DataFrame:
    """For each group: `n` values, their `total`, and q0, q1, ... at the shares, interpolated between neighbours in rank.

    `value` is a whole number; null ones don't count. Without groups there is one row always, of which n is 0 and the rest null if there are no values.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("long").alias("v")).agg(F.count("*").alias("n"))
    counts = counts.withColumn("bucket", F.shiftright("v", bits))
    group = Window.partitionBy(*by)
    earlier = group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = counts.groupBy(*by, "bucket").agg(F.sum("n").alias("in_bucket"), F.sum(F.col("v") * F.col("n")).alias("sum"))
    summed = buckets.select("*", F.coalesce(F.sum("in_bucket").over(earlier), F.lit(0)).alias("below"), F.sum("in_bucket").over(group).alias("all"), F.sum("sum").over(group).alias("total"))
    lower = [F.floor((F.col("all") - 1) * F.lit(s)).cast("long") for s in shares]
    upper = [F.ceil((F.col("all") - 1) * F.lit(s)).cast("long") for s in shares]

    def holds(rank: Column, first: Column, n: Column) -> Column:
        return (rank >= first) & (rank < first + n)

    wanted = F.lit(False)
    for rank in (*lower, *upper):
        wanted = wanted | holds(rank, F.col("below"), F.col("in_bucket"))
    # null groups are groups; and a join that keeps nulls adds no filter to one side, so both read the counts' one shuffle
    keys = [*by, "bucket"]
    chosen = summed.where(wanted).select(*(F.col(c).alias(f"chosen_{c}") for c in keys), "below", "all", "total")
    within = Window.partitionBy(*by, "bucket").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"chosen_{c}")) for c in keys))
    ranked = counts.join(chosen, same).withColumn("first", F.col("below") + F.coalesce(F.sum("n").over(within), F.lit(0)))
    ends = [F.max(F.when(holds(r, F.col("first"), F.col("n")), F.col("v"))) for r in (*lower, *upper)]
    found = ranked.groupBy(*by).agg(F.coalesce(F.max("all"), F.lit(0)).alias("all"), F.max("total").alias("total"), *(e.alias(f"e{i}") for i, e in enumerate(ends)))
    out = []
    for i, s in enumerate(shares):
        low, high = F.col(f"e{i}"), F.col(f"e{i + len(shares)}")
        part = (F.col("all") - 1) * F.lit(s) - lower[i]
        out.append((low + (high - low) * part).alias(f"q{i}"))
    return found.select(*by, F.col("all").alias("n"), "total", *out)
