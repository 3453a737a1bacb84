"""URL filter with a Bloom filter cascade, in DataFrame functions only.

Rules (a host and a path) come first: a rule fits its host and all subdomains where the url's path starts with the rule's;
the longest wins. Other urls are blocked if their host is on a list. The list is held as a cascade: level 1 is a Bloom
filter of the listed keys; level 2 of the keys of the corpus that pass level 1 without being listed; level 3 of the listed
keys that pass level 2; and so on until no key is wrong. As the levels are built over the complete key universe, the parity
of the first level that rejects a key says exactly whether it is listed, and no page is shuffled or joined to find out.

The filters are literals of a checked size. A list too long for MAX_BITS is looked up by a semi-join on the key instead,
with the same result. Defined results: a null url, or one without `://`, has an empty host and path, so no rule fits, and
is allowed; null or empty keys of the list list nothing; repeated rows are judged each for itself; an empty table gives an
empty table; columns besides the id and the url are not read.
"""

from __future__ import annotations

from functools import reduce
from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywell.llm.common import shared_checkpoint

#: Bits of all levels together that may travel with the plan (512 KiB).
MAX_BITS = 1 << 22
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"

Level = tuple[int, int, list[int]]  # bits, hash functions, words of 64 bits


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """A struct of the rule's text and verdict for the longest rule that fits, else null. Rules: verdict, host, path."""
    chosen: Column = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        chosen = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def positions(key: Column, level: int, bits: int, hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(level), F.lit(i), key), F.lit(bits)) for i in range(hashes)]


def passes(key: Column, level: int, made: Level) -> Column:
    bits, hashes, words = made
    array = F.lit(",".join(map(str, words)))
    array = F.split(array, ",").cast("array<bigint>")  # folded to a constant once, when the plan is made
    tests = [F.getbit(F.get(array, F.floor(p / 64).cast("int")), (p % 64).cast("int")) == 1 for p in positions(key, level, bits, hashes)]
    return reduce(lambda a, b: a & b, tests)


def filter_of(keys: DataFrame, level: int, n: int, rate: float) -> Level:
    """A Bloom filter of `key`, with about the given rate of false positives."""
    hashes = max(1, round(-log2(rate)))
    bits = max(64, 64 * ceil(n * hashes / 0.6931 / 64))
    at = keys.select(F.explode(F.array(*positions(F.col("key"), level, bits, hashes))).alias("p"))
    words = at.groupBy(F.floor(F.col("p") / 64).cast("long").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % 64).cast("int"))).alias("bits"))
    dense = [0] * (bits // 64)
    for word, value in words.collect():  # at most MAX_BITS / 64 rows
        dense[word] = value
    return bits, hashes, dense


def cascade(universe: DataFrame) -> list[Level] | None:
    """Levels over distinct rows of `key` and `listed`; None if they would need more than MAX_BITS."""
    universe = shared_checkpoint(universe)
    counts = {row["listed"]: row["count"] for row in universe.groupBy("listed").count().collect()}
    listed, others = counts.get(True, 0), counts.get(False, 0)
    inside, outside = universe.where("listed").select("key"), universe.where("not listed").select("key")
    levels: list[Level] = []
    n, used = listed, 0
    while n:
        rate = 0.5 if levels else min(0.5, max(2.0**-20, listed * 0.7 / max(1, others)))
        used += n * -log2(rate) / 0.6931
        if used > MAX_BITS:
            return None
        levels.append(filter_of(inside, len(levels), n, rate))
        inside, outside = outside.where(passes(F.col("key"), len(levels) - 1, levels[-1])), inside
        n = inside.count()
    return levels


def is_listed(key: Column, levels: list[Level]) -> Column:
    """Exact for every key of the universe that the levels were built over."""
    out = F.lit(len(levels) % 2 == 1)
    for i in reversed(range(len(levels))):
        out = F.when(~passes(key, i, levels[i]), F.lit(i % 2 == 1)).otherwise(out)
    return out


def judge(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]], key: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule and verdict of each page; `listed` has the blocked hosts in a column `key`."""
    parsed = pages.select(pages[key].cast("long").alias("page_id"), host_of(pages[url]).alias("host"), path_of(pages[url]).alias("path"))
    listed = listed.where("key <> ''").select("key").distinct()
    marked = parsed.select(F.col("host").alias("key"), F.lit(0).alias("l")).where("key <> ''").union(listed.select("key", F.lit(1)))
    universe = marked.groupBy("key").agg((F.max("l") == 1).alias("listed"))
    levels = cascade(universe)
    if levels is None:
        hit = listed.select(F.col("key").alias("host"), F.lit(True).alias("hit"))
        parsed = parsed.join(hit, "host", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    else:
        parsed = parsed.withColumn("hit", (F.col("host") != "") & is_listed(F.col("host"), levels))
    fit = parsed.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    return fit.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", F.when(F.col("hit"), "block").otherwise("allow")).alias("verdict"))


def tracking_hosts(pages: DataFrame, url: str = "url") -> DataFrame:
    """`key`: the hosts with a page whose query string holds a `utm_` parameter."""
    return pages.where(pages[url].rlike(r"^[^#?]*\?[^#]*utm_")).select(host_of(pages[url]).alias("key")).distinct()
