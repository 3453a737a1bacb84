"""The analytics event log, and how the raw event table is shaped into it.

Columns of the log: id, event_type, user_id, job_id, is_guest, tool_type ('' if none), plan_name ('' if none), file_size (0 if
none), metadata (JSON text), created_at, persisted_at. A table that is already in this shape (written by the ingest stream,
partitioned by date) can be given to every operator as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Tools by k % 5, sign-up metadata by k % 7, failure reasons by k % 6.
TOOLS = ["merge-pdf", "split-pdf", "compress-pdf", "ocr-pdf", "pdf-to-word"]
SIGNUP_METADATA = [
    None,
    '{"utmSource":"newsletter","utmMedium":"cpc","referrer":""}',
    '{"utmSource":"newsletter"}',
    '{"referrer":""}',
    '{"referrer":"https://www.Google.com/"}',
    '{"referrer":"https://blog.example.org/"}',
    '{"other":1}',
]
FAILURE_METADATA = [
    '{"failureReason":"[TIMEOUT] took too long"}',
    '{"failureReason":"[INVALID_PAYLOAD] bad options"}',
    '{"failureReason":"[CONVERSION_FAILED] exit status 1"}',
    '{"failureReason":"[OUTPUT_FAILED] no space"}',
    '{"failureReason":"something went wrong"}',
    None,
]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table by any path that Spark reads."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def chosen(index: Column, values: list[str | None]) -> Column:
    """The value at an index; null values stay null."""
    out = F.lit(None).cast("string")
    for i, v in enumerate(values):
        out = F.when(index == i, F.lit(v)).otherwise(out)
    return out


def shaped(raw: DataFrame) -> DataFrame:
    """The raw events (event_id, ts, user_id, event_type, value, props) as the analytics event log."""
    e = raw.withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    k, kind = F.col("k"), F.col("event_type")
    job = kind.isin("click", "purchase", "error")
    view = kind == "view"
    event_type = (
        F.when(kind == "signup", "user.signup")
        .when(kind == "click", "job.created")
        .when(kind == "purchase", "job.completed")
        .when(kind == "error", "job.failed")
        .when(view & (k < 60), "user.login")
        .when(view & (k < 80), "plan.changed")
        .when(view, "plan.limit_hit")
    )
    changed = F.when(k % 3 == 0, '{"oldPlan":"free","newPlan":"pro"}').otherwise('{"oldPlan":"pro","newPlan":"free"}')
    metadata = (
        F.when(kind == "signup", chosen(k % 7, SIGNUP_METADATA)).when(kind == "error", chosen(k % 6, FAILURE_METADATA)).when(view & (k >= 60) & (k < 80), changed)
    )
    return e.select(
        F.col("event_id").alias("id"),
        event_type.alias("event_type"),
        F.when(F.col("user_id") % 10 != 0, F.col("user_id")).alias("user_id"),
        F.when(job, F.col("user_id") * 100 + k).alias("job_id"),
        ((F.col("user_id") % 10 == 0) & kind.isin("click", "view")).alias("is_guest"),
        F.when(job, chosen(k % 5, TOOLS)).otherwise("").alias("tool_type"),
        F.when((kind == "signup") | (view & (k < 80)), F.when(k % 3 == 0, "pro").otherwise("free")).otherwise("").alias("plan_name"),
        F.when(kind.isin("click", "purchase"), F.floor(F.col("value") * 131072).cast("long")).otherwise(F.lit(0)).alias("file_size"),
        metadata.alias("metadata"),
        F.col("ts").alias("created_at"),
        (F.col("ts") + F.make_interval(secs=(k * 0.01).cast("decimal(18,6)"))).alias("persisted_at"),
    )


def event_log(spark: SparkSession, folder: str) -> DataFrame:
    return shaped(table(spark, folder, "events"))


def metric_samples(spark: SparkSession, folder: str) -> DataFrame:
    """sampled_at, counters and latencies in milliseconds of an API, one row for each scrape."""
    e = table(spark, folder, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    v = F.col("value")
    return e.select(
        F.col("ts").alias("sampled_at"),
        F.col("k").alias("requests"),
        (F.col("k") % 5).alias("client_errors"),
        (F.col("k") % 3).alias("server_errors"),
        (F.col("k") % 2).alias("timeouts"),
        v.alias("avg_ms"),
        (v * 0.5).alias("p50_ms"),
        (v * 2).alias("p95_ms"),
        (v * 4).alias("p99_ms"),
    )
