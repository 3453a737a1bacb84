"""Document-store tables as the driver's tables give them; tables already in this shape can be used as they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywell.sources.events import table


def minutes_after_base(n: str) -> Column:
    return F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.expr(f"make_dt_interval(0, 0, {n}, 0)")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """id, user_id, organization_id, folder, name, file_type, status, file_size, content, created_at, deleted_at."""
    d = table(spark, folder, "documents")
    rest = F.col("doc_id") % 10
    status = F.when(rest == 0, "failed").when(rest == 1, "processing").when(rest == 2, "uploaded").otherwise("ready")
    created = minutes_after_base("cast(doc_id as int)")
    return d.select(
        F.col("doc_id").alias("id"),
        (F.col("doc_id") % 50).alias("user_id"),
        F.when(F.col("doc_id") % 4 != 0, F.col("doc_id") % 4).alias("organization_id"),
        F.col("source").alias("folder"),
        F.concat(F.lit("doc "), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("name"),
        F.lit("pdf").alias("file_type"),
        status.alias("status"),
        F.col("n_chars").alias("file_size"),
        F.col("text").alias("content"),
        created.alias("created_at"),
        F.when(F.col("doc_id") % 11 == 0, created).alias("deleted_at"),
    )


def document_tags(spark: SparkSession, folder: str) -> DataFrame:
    """document_id and tag, once for each pair."""
    labels = table(spark, folder, "labels")
    tags = F.array_compact(F.array(F.when(F.col("quality") == 1, F.lit("quality")), F.when(F.col("toxic") == 1, F.lit("toxic"))))
    return labels.select(F.col("doc_id").alias("document_id"), F.explode(tags).alias("tag")).distinct()


def jobs(spark: SparkSession, folder: str) -> DataFrame:
    """id, user_id, tool_type, status, created_at, expires_at."""
    o = table(spark, folder, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "queued").otherwise("processing")
    user = F.when(F.col("o_custkey") % 10 != 0, F.col("o_custkey"))
    days = F.when(F.col("o_custkey") % 3 == 0, 30).otherwise(7)
    return o.select(
        F.col("o_orderkey").alias("id"),
        user.alias("user_id"),
        F.lower(F.substring("o_orderpriority", 3, 20)).alias("tool_type"),
        status.alias("status"),
        F.col("o_orderdate").alias("created_at"),
        F.when(user.isNotNull(), F.col("o_orderdate") + F.make_dt_interval(days.cast("int"))).otherwise(F.lit(None)).alias("expires_at"),
    )


def files(spark: SparkSession, folder: str) -> DataFrame:
    """job_id, kind, path. A few paths are of the old local kind, which begin with a slash."""
    line = table(spark, folder, "lineitem")
    kind = F.when(F.col("l_linenumber") % 2 == 0, "output").otherwise("input")
    key = F.concat_ws("/", kind, F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    return line.select(F.col("l_orderkey").alias("job_id"), kind.alias("kind"), F.when(F.col("l_suppkey") % 20 == 0, F.concat(F.lit("/"), key)).otherwise(key).alias("path")).distinct()


def notifications(spark: SparkSession, folder: str) -> DataFrame:
    """id, user_id, created_at, read_at."""
    c = table(spark, folder, "conversations")
    created = minutes_after_base("cast(conv_id * 10 + turn as int)")
    return c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("user_id"), created.alias("created_at"), F.when(F.col("turn") % 2 == 0, created).alias("read_at")
    )


def memberships(spark: SparkSession, folder: str) -> DataFrame:
    """organization_id, user_id, role."""
    c = table(spark, folder, "customer")
    role = F.element_at(F.array(*map(F.lit, ("viewer", "editor", "admin", "owner"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    return c.select(F.col("c_nationkey").alias("organization_id"), F.col("c_custkey").alias("user_id"), role.alias("role"))


def organizations(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
