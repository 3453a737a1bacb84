"""Scraped metrics in their text format, and monitoring documents of a message broker."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywell.functions.scalars import last_of_each

SAMPLE = r"^([a-zA-Z_:][a-zA-Z0-9_:]*)(?:\{(.*)\})?\s+(\S+)(?:\s+-?\d+)?\s*$"
LABEL = r'([a-zA-Z_][a-zA-Z0-9_]*)="((?:[^"\\]|\\.)*)"'

STREAMS = """account_details array<struct<stream_detail:array<struct<name:string,
  state:struct<messages:bigint,bytes:bigint,first_seq:bigint,last_seq:bigint,consumer_count:bigint>,
  consumer_detail:array<struct<name:string,num_ack_pending:bigint,num_redelivered:bigint,num_pending:bigint,num_waiting:bigint>>>>>>"""


SERVER = "server_id string, version string, connections int, total_connections bigint, mem bigint, cpu double, slow_consumers bigint, uptime string"


def samples(lines: DataFrame) -> DataFrame:
    """metric, labels and value of each sample line in the column `value`; comments, empty and malformed lines are left out; of a repeated label the last counts."""
    parts = lines.where(~F.col("value").startswith("#")).select(
        F.regexp_extract("value", SAMPLE, 1).alias("metric"), F.regexp_extract("value", SAMPLE, 2).alias("text"), F.regexp_extract("value", SAMPLE, 3).alias("number")
    )
    unescaped = lambda v: F.replace(F.replace(F.replace(v, F.lit(r'\"'), F.lit('"')), F.lit(r"\n"), F.lit("\n")), F.lit("\\\\"), F.lit("\\"))
    names, values = (F.regexp_extract_all("text", F.lit(LABEL), F.lit(i)) for i in (1, 2))
    number = F.when(F.col("number").isin("+Inf", "Inf"), float("inf")).when(F.col("number") == "-Inf", float("-inf")).otherwise(F.col("number").try_cast("double"))
    return parts.where("metric != ''").select("metric", F.map_from_entries(last_of_each(F.arrays_zip(names.alias("key"), F.transform(values, unescaped).alias("value")))).alias("labels"), number.alias("value")).where("value IS NOT NULL")


def gauge(found: DataFrame, metric: str) -> DataFrame:
    """The gauge's value, or 0 if it has no sample; of several the least by labels."""
    own = found.where(F.col("metric") == metric)
    return own.agg(F.coalesce(F.min_by("value", F.to_json("labels")), F.lit(0.0)).alias("value"))


def histogram(found: DataFrame, family: str) -> tuple[DataFrame, DataFrame]:
    """Buckets (method, path, status, le, n) and counts (method, path, status, n, total_seconds) of a request histogram."""
    key = [F.col("labels")["method"].alias("method"), F.col("labels")["path"].alias("path"), F.col("labels")["status"].cast("int").alias("status")]
    le = F.when(F.col("labels")["le"] == "+Inf", float("inf")).otherwise(F.col("labels")["le"].try_cast("double"))
    buckets = found.where(F.col("metric") == f"{family}_bucket").select(*key, le.alias("le"), F.col("value").alias("n"))
    both = found.where(F.col("metric").isin(f"{family}_count", f"{family}_sum"))
    sums = both.groupBy(*key).agg(*(F.coalesce(F.sum(F.when(F.col("metric") == f"{family}_{m}", F.col("value"))), F.lit(0.0)).alias(n) for m, n in (("count", "n"), ("sum", "total_seconds"))))
    return buckets, sums


def text_samples(spark: SparkSession, path: str) -> DataFrame:
    return samples(spark.read.text(path))


def broker_info(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STREAMS).json(path, multiLine=True)


def documents(lines: DataFrame, schema: str, text: str = "value") -> DataFrame:
    """The fields of a JSON document in each row's `text`, beside the row's other columns; malformed ones have nulls, and a field of another type is null."""
    rest = [c for c in lines.columns if c != text]
    return lines.select(*rest, F.from_json(text, schema).alias("document_")).select(*rest, "document_.*")


def server_info(spark: SparkSession, path: str) -> DataFrame:
    """The broker's document of itself."""
    return spark.read.schema(SERVER).json(path, multiLine=True)
