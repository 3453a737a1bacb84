"""What a host tells: container logs with their labels, captured procfs files, listings of objects, and gauges as text."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywell.functions.expr import at
from tallywell.functions.scalars import last_of_each


def labelled(lines: DataFrame) -> DataFrame:
    """container, service and line of log rows (name, service, line): a container's name loses its slash in front; a name without one gives no label."""
    name = F.regexp_extract(F.coalesce("name", F.lit("")), r"^/(.*)$", 1)
    return lines.select(F.when(name != "", name).alias("container"), "service", "line", *(c for c in lines.columns if c not in ("name", "service", "line", "container")))


def log_search(logs: DataFrame, service: str, search: str = "") -> DataFrame:
    """Lines of services whose whole name fits a pattern, that hold another pattern in any case; an empty search finds all lines."""
    return logs.where(F.col("service").rlike(f"^(?:{service})$") & F.col("line").rlike(f"(?i){search}"))


def log_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of JSON objects (name, service, line, ts) that arrive in a folder; what is no object has nulls."""
    read = spark.readStream.text(folder).select(F.from_json("value", "name string, service string, line string, ts timestamp").alias("r"))
    return labelled(read.select("r.*"))


def uptime_seconds(text: Column) -> Column:
    return F.regexp_extract(text, r"^\s*([0-9.]+)", 1).try_cast("double")


def load_averages(text: Column) -> Column:
    """The loads of one, five and fifteen minutes; null if there are fewer than three numbers."""
    parts = F.transform(F.slice(F.split(F.trim(text), r"\s+"), 1, 3), lambda p: p.try_cast("double"))
    return F.when((F.size(parts) == 3) & ~F.exists(parts, lambda v: v.isNull()), parts)


def cpu_counters(text: Column) -> Column:
    """idle and total ticks of the line of all processors; null without such a line or with fewer than four numbers."""
    line = F.regexp_extract(text, r"(?m)^cpu ([^\n]*)$", 1)
    ticks = F.transform(F.slice(F.filter(F.split(line, r"\s+"), lambda p: p != ""), 1, 10), lambda p: F.coalesce(p.try_cast("bigint"), F.lit(0).cast("bigint")))
    total = F.aggregate(ticks, F.lit(0).cast("bigint"), lambda a, v: a + v)
    return F.when(F.size(ticks) >= 4, F.struct(F.get(ticks, F.lit(3)).alias("idle"), total.alias("total")))


def memory(text: Column) -> Column:
    """total, used, free and available memory in MiB and the used share in percent; what isn't named counts as 0."""
    pairs = F.filter(F.transform(F.split(text, "\n"), lambda p: F.split(F.trim(p), r"\s+")), lambda p: F.size(p) >= 2)
    entry = lambda p: F.struct(F.regexp_replace(p[0], ":$", "").alias("key"), F.coalesce(p[1].try_cast("bigint"), F.lit(0).cast("bigint")).alias("value"))
    known = F.map_from_entries(last_of_each(F.transform(pairs, entry)))
    total, free, available = (F.coalesce(F.try_element_at(known, F.lit(n)), F.lit(0)) for n in ("MemTotal", "MemFree", "MemAvailable"))
    percent = F.when(total > 0, (total - available) * 100.0 / total).otherwise(F.lit(0.0))
    return F.struct((total / 1024).alias("total_mb"), ((total - available) / 1024).alias("used_mb"), (free / 1024).alias("free_mb"), (available / 1024).alias("available_mb"), percent.alias("used_percent"))


def disk(blocks: Column, block_size: Column, free: Column, available: Column) -> Column:
    """total, used and free GiB and the used share in percent, of a file system's counts of blocks: what is kept for the superuser is neither used nor free."""
    total, used = blocks * block_size, (blocks - free) * block_size
    gib = lambda c: c / float(1 << 30)
    return F.struct(gib(total).alias("total_gb"), gib(used).alias("used_gb"), gib(available * block_size).alias("free_gb"), F.when(total > 0, used * 100.0 / total).otherwise(F.lit(0.0)).alias("used_percent"))


def object_ranges(spark: SparkSession, folder: str, first: int, count: int, longest: int = 1 << 28) -> DataFrame:
    """path, length and `part`: so many bytes from an offset on (fewer at the end, none beyond it) of the files below a folder that aren't longer than `longest`.

    A file's bytes are read by one task and cut there; the filter on the length keeps longer files from being read at all.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).where(F.col("length") <= longest)
    return files.select("path", "length", F.substring("content", max(0, first) + 1, max(0, count)).alias("part"))


def objects(spark: SparkSession, folder: str) -> DataFrame:
    """path, length and modified of the files below a folder; the contents aren't read unless the column is asked for."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select("path", "length", F.col("modificationTime").alias("modified"))


def older_than(listing: DataFrame, now: datetime) -> DataFrame:
    return listing.where(F.col("modified") < at(now))


def gauge_lines(gauges: DataFrame) -> DataFrame:
    """Gauges (metric, labels as map<string,string>, value) as lines of the text format, labels by name; quotes, backslashes and line feeds are escaped."""
    escaped = lambda v: F.replace(F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    pairs = F.transform(F.array_sort(F.map_entries(F.coalesce("labels", F.create_map().cast("map<string,string>")))), lambda e: F.concat(e["key"], F.lit('="'), escaped(e["value"]), F.lit('"')))
    text = F.when(F.size(pairs) > 0, F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))).otherwise("")
    return gauges.select(F.concat("metric", text, F.lit(" "), F.col("value").cast("double").cast("string")).alias("value"))


def dependency_gauges(probes: DataFrame) -> DataFrame:
    """Probes (dependency, up) as gauges; a null `up` counts as down."""
    labels = F.create_map(F.lit("dependency"), F.col("dependency"))
    return probes.select(F.lit("dependency_up").alias("metric"), labels.alias("labels"), F.when(F.col("up"), 1.0).otherwise(0.0).alias("value"))
