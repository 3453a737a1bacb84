"""Daily partials of the event log: bitmaps of users and counts, from which questions over days are answered without reading the log.

A partial has a row for each day and range of 32,768 user ids: the bitmap of the registered users that were there, and the number of
their events. Merging is exact: bitmaps are or-ed and events are added. A stream keeps them batch by batch (`keep_partials`), a batch that is
tried again in place of itself; `compacted` merges what has gathered. A question's whole days come from the partials, and the hours at its ends, if it
has any, from the log's rows of these two days. User ids are whole numbers.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywell.functions.expr import Period, day, ratio, registered, within
from tallywell.operators.analytics import between


def partials(log: DataFrame) -> DataFrame:
    """date, bucket, users (a bitmap) and events."""
    user = F.col("user_id").cast("long")
    own = log.where(registered() & F.col("created_at").isNotNull()).select(day().alias("date"), F.bitmap_bucket_number(user).alias("bucket"), F.bitmap_bit_position(user).alias("bit"))
    return own.groupBy("date", "bucket").agg(F.bitmap_construct_agg("bit").alias("users"), F.count("*").alias("events"))


def compacted(parts: DataFrame) -> DataFrame:
    """One row for each day and range of users."""
    return parts.groupBy("date", "bucket").agg(F.bitmap_or_agg("users").alias("users"), F.sum("events").alias("events"))


def keep_partials(path: str) -> Callable[[DataFrame, int], None]:
    """A batch function that keeps the partials of each batch of log rows; one that is tried again overwrites what it wrote before."""

    def write(batch: DataFrame, number: int) -> None:
        partials(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def kept_partials(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("batch")


def midnight(t: datetime) -> datetime:
    return t.replace(hour=0, minute=0, second=0, microsecond=0)


def covering(parts: DataFrame, log: DataFrame, since: datetime, until: datetime) -> DataFrame:
    """Partials of the events from `since` to before `until`: whole days as they were kept, the rest from the log."""
    first = since if since == midnight(since) else midnight(since) + timedelta(days=1)
    end = midnight(until)
    if first > end:
        return partials(between(log, since, until))
    whole = parts.where((F.col("date") >= F.lit(first.date())) & (F.col("date") < F.lit(end.date())))
    edges = [partials(between(log, a, b)) for a, b in ((since, first), (end, until)) if a < b]
    return reduce(DataFrame.unionByName, edges, whole)


def users_since(parts: DataFrame, log: DataFrame, now: datetime, since: dict[str, datetime]) -> DataFrame:
    """One row: how many users were there from each time on, to before `now`.

    One pass over the partials for all times, and one over the log's rows of the days that are asked for in part, if there are any.
    """
    end = midnight(now)
    first = {n: t if t == midnight(t) else midnight(t) + timedelta(days=1) for n, t in since.items()}
    whole = parts.where((F.col("date") >= F.lit(min(first.values()).date())) & (F.col("date") < F.lit(end.date())))
    rows = whole.select("bucket", "users", *((F.col("date") >= F.lit(first[n].date())).alias(n) for n in since))
    ranges = {n: [(a, b) for a, b in ([(t, first[n]), (end, now)] if first[n] <= end else [(t, now)]) if a < b] for n, t in since.items()}
    if any(ranges.values()):
        days = reduce(lambda x, y: x | y, (within("created_at", a, b) for a, b in {r for own in ranges.values() for r in own}))
        flags = {n: reduce(lambda x, y: x | y, (within("created_at", a, b) for a, b in own), F.lit(False)) for n, own in ranges.items()}
        user = F.col("user_id").cast("long")
        own = log.where(registered() & days).select(F.bitmap_bucket_number(user).alias("bucket"), F.bitmap_bit_position(user).alias("bit"), *(c.alias(n) for n, c in flags.items()))
        rows = rows.unionByName(own.groupBy("bucket", *since).agg(F.bitmap_construct_agg("bit").alias("users")))
    by_bucket = rows.groupBy("bucket").agg(*(F.bitmap_count(F.bitmap_or_agg(F.when(F.col(n), F.col("users")))).alias(n) for n in since))
    return by_bucket.agg(*(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in since))


def dau_wau_mau(parts: DataFrame, log: DataFrame, now: datetime) -> DataFrame:
    return users_since(parts, log, now, {"dau": midnight(now), "wau": now - timedelta(days=7), "mau": now - timedelta(days=30)})


def daily_users(parts: DataFrame, p: Period, log: DataFrame) -> DataFrame:
    """date, dau and events of each day of the period that has any."""
    own = compacted(covering(parts, log, p.since, p.now))
    return own.groupBy("date").agg(F.sum(F.bitmap_count("users")).alias("dau"), F.sum("events").alias("events"))


def stickiness(parts: DataFrame, log: DataFrame, p: Period) -> DataFrame:
    """Mean of the daily users over the days that have any, by the period's users."""
    own = compacted(covering(parts, log, p.since, p.now))
    by_day = own.groupBy("date").agg(F.sum(F.bitmap_count("users")).alias("dau")).agg(F.sum("dau").alias("user_days"), F.count("*").alias("days"))
    whole = own.groupBy("bucket").agg(F.bitmap_or_agg("users").alias("users")).agg(F.sum(F.bitmap_count("users")).alias("mau"))
    return by_day.crossJoin(F.broadcast(whole)).select(ratio(F.col("user_days"), F.col("days") * F.col("mau")).alias("stickiness"))  # one row each
