"""Columns that many queries use. All stay within Spark's own functions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Period:
    """The last `days` days before `now`, and the same length before that. Half-open: [since, now)."""

    now: datetime
    days: int = 30

    @property
    def since(self) -> datetime:
        return self.now - timedelta(days=self.days)

    @property
    def previous(self) -> datetime:
        return self.now - timedelta(days=2 * self.days)


def at(t: datetime) -> Column:
    """A literal that compares with a Parquet timestamp without time zone, so that the filter reaches the scan."""
    return F.lit(t.isoformat(sep=" ")).cast("timestamp_ntz")


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def free(name: str, taken: list[str]) -> str:
    """The name, with as many _ behind as it needs not to be taken."""
    known = {t.lower() for t in taken}
    while name.lower() in known:
        name += "_"
    return name


def within(ts: str | Column, start: datetime, end: datetime) -> Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    return (c >= at(start)) & (c < at(end))


def is_type(*kinds: str) -> Column:
    return F.col("event_type").isin(*kinds) if len(kinds) > 1 else F.col("event_type") == kinds[0]


def registered() -> Column:
    return F.col("user_id").isNotNull() & ~F.col("is_guest")


def count_of(condition: Column) -> Column:
    return F.count_if(condition)


def users_where(condition: Column) -> Column:
    return F.count_distinct(F.when(condition, F.col("user_id")))


def day(ts: str = "created_at") -> Column:
    return F.to_date(ts)


def ratio(num: Column, den: Column, digits: int = 6) -> Column:
    """num / den, or 0 where den isn't positive; rounded, so that the order of additions can't be seen."""
    return F.round(F.when(den > 0, num.cast("double") / den).otherwise(0.0), digits)


def seconds_between(start: str | Column, end: str | Column) -> Column:
    """Exact to the microsecond, also where negative."""
    a, b = (x if isinstance(x, str) else x._jc.toString() for x in (start, end))
    return F.expr(f"timestampdiff(MICROSECOND, {a}, {b})") / 1e6


# Media that count as paid, and search engines whose referrals are organic.
PAID_MEDIA = ("cpc", "ppc", "paid", "display", "paid_social")
SEARCH_ENGINES = r"(?i)(google|bing|duckduckgo|yahoo)\."


def channel(metadata: Column) -> Column:
    """Where a sign-up came from. A key that holds null is there: only its absence makes the channel unknown."""
    keys = F.json_object_keys(metadata)
    told = F.coalesce(F.array_contains(keys, "referrer") | F.array_contains(keys, "utmSource"), F.lit(False))
    text = lambda key: F.coalesce(F.get_json_object(metadata, f"$.{key}"), F.lit(""))
    return (
        F.when(~told, "unknown")
        .when(text("utmMedium").isin(*PAID_MEDIA), "paid")
        .when(text("utmSource") != "", "campaign")
        .when(text("referrer") == "", "direct")
        .when(text("referrer").rlike(SEARCH_ENGINES), "organic")
        .otherwise("referral")
    )


# Failure codes and the categories they belong to.
FAILURE_CATEGORIES = {
    "TIMEOUT": "timeout",
    "INVALID_PAYLOAD": "validation",
    "UNSUPPORTED_TOOL": "validation",
    "CONVERSION_FAILED": "processing",
    "OUTPUT_FAILED": "infrastructure",
}


def failure_category(metadata: Column) -> Column:
    code = F.regexp_extract(F.coalesce(F.get_json_object(metadata, "$.failureReason"), F.lit("")), r"^\[([A-Z_]+)\]", 1)
    out = F.lit("other")
    for c, category in FAILURE_CATEGORIES.items():
        out = F.when(code == c, category).otherwise(out)
    return out


# Upper bounds of the size buckets in bytes (exclusive).
SIZE_BUCKETS = [(1048576, "under_1mb"), (5242880, "1mb_5mb"), (10485760, "5mb_10mb"), (52428800, "10mb_50mb")]


def size_bucket(size: Column) -> Column:
    out = F.lit("over_50mb")
    for bound, name in reversed(SIZE_BUCKETS):
        out = F.when(size < bound, name).otherwise(out)
    return out


def price_of(plan: Column, prices: dict[str, float]) -> Column:
    """Monthly price of a plan; unknown plans cost nothing."""
    out = F.lit(0.0)
    for name, price in prices.items():
        out = F.when(plan == name, F.lit(float(price))).otherwise(out)
    return out
