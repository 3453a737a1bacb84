"""Event streams: parsing with dead letters, idempotent sinks, job states, and windows over event time.

Delivery is at least once: offsets stand in the checkpoint, so a batch may be written again after a failure. Sinks that must
not repeat rows compare with what is there by a key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.utils import AnalysisException

EVENT = "eventType string, jobId string, userId string, isGuest boolean, toolType string, planName string, fileSize bigint, metadata string, timestamp string"
JOB_EVENT = "eventType string, jobId string, userId string, toolType string, outputPath string, failureReason string, fileSize bigint, timestamp string"
UUID = "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"


def text_stream(spark: SparkSession, folder: str, files_at_once: int = 1000) -> DataFrame:
    """Lines of files that arrive in a folder, in a column `value`."""
    return spark.readStream.option("maxFilesPerTrigger", files_at_once).text(folder)


def parsed(lines: DataFrame, schema: str = EVENT) -> DataFrame:
    """`value` and the parsed `event`, which is null for malformed lines and for those without a type."""
    event = F.from_json("value", schema, {"mode": "PERMISSIVE"})
    return lines.select("value", event.alias("e")).select("value", F.when(F.col("e.eventType").isNotNull(), F.col("e")).alias("event"))


def well_formed(lines: DataFrame, schema: str = EVENT) -> DataFrame:
    return parsed(lines, schema).where("event IS NOT NULL").select("event.*")


def malformed(lines: DataFrame, schema: str = EVENT) -> DataFrame:
    return parsed(lines, schema).where("event IS NULL").select("value")


def as_uuid(column: str) -> Column:
    return F.when(F.col(column).rlike(UUID), F.lower(column))


def log_rows(events: DataFrame) -> DataFrame:
    """Rows of the analytics event log: bad ids are null, a missing time is now, absent texts are ''."""
    now = F.current_timestamp()
    return events.select(
        F.col("eventType").alias("event_type"),
        as_uuid("userId").alias("user_id"),
        as_uuid("jobId").alias("job_id"),
        F.coalesce("isGuest", F.lit(False)).alias("is_guest"),
        F.coalesce("toolType", F.lit("")).alias("tool_type"),
        F.coalesce("planName", F.lit("")).alias("plan_name"),
        F.coalesce("fileSize", F.lit(0).cast("long")).alias("file_size"),
        F.col("metadata"),
        F.coalesce(F.col("timestamp").try_cast("timestamp"), now).alias("created_at"),
        now.alias("persisted_at"),
    )


def job_log_rows(events: DataFrame) -> DataFrame:
    """Job events as rows of the log: completions and failures only, with what failed or was made as metadata."""
    kind = F.when(F.col("eventType") == "JobCompleted", "job.completed").when(F.col("eventType") == "JobFailed", "job.failed")
    own = events.withColumn("kind", kind).where("kind IS NOT NULL")
    metadata = F.to_json(F.struct(F.col("failureReason"), F.col("outputPath")))
    shaped = own.select(
        F.col("kind").alias("eventType"), "jobId", "userId", F.lit(False).alias("isGuest"), "toolType", F.lit("").alias("planName"), "fileSize", F.when(metadata != "{}", metadata).alias("metadata"), "timestamp"
    )
    return log_rows(shaped)


@contextmanager
def held(rows: DataFrame) -> Iterator[DataFrame]:
    """Rows that are worked out once, for all that is written of them."""
    kept = rows.persist()
    try:
        yield kept
    finally:
        kept.unpersist()


def append_to(path: str, dead_letters: str | None = None, schema: str = EVENT, rows: Callable[[DataFrame], DataFrame] = log_rows) -> Callable[[DataFrame, int], None]:
    """A batch function: well-formed lines go to the log, by day, and malformed ones to the dead letters.

    Each batch has a folder of its own and overwrites it, so a batch that is tried again leaves no row twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        with held(parsed(batch, schema)) as lines:
            good = rows(lines.where("event IS NOT NULL").select("event.*")).withColumn("event_date", F.to_date("created_at"))
            good.write.mode("overwrite").partitionBy("event_date").parquet(f"{path}/batch={number}")
            if dead_letters:
                lines.where("event IS NULL").select("value").write.mode("overwrite").parquet(f"{dead_letters}/batch={number}")

    return write


#: Folders of a sink that is written once by key.
BUCKETS = 256


def bucket_of(key: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def touched(batch: DataFrame, key: list[str], buckets: int) -> list[int]:
    """The folders that a batch's keys belong to; as many as there are folders at most."""
    return sorted(r[0] for r in batch.select(bucket_of(key, buckets)).distinct().collect())


def kept_in(spark: SparkSession, path: str, numbers: list[int]) -> DataFrame | None:
    """What a sink holds in some of its folders; others are neither read nor listed."""
    try:
        return spark.read.option("basePath", path).parquet(f"{path}/bucket={{{','.join(map(str, numbers))}}}")
    except AnalysisException:  # no such folder yet
        return None


def append_once(path: str, key: list[str], buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """A batch function that adds the rows whose key isn't there yet, one for each key; for finalized documents and notifications.

    The sink is parted by a hash of the key, so a batch is compared only with the folders of its own keys. For keys that repeat within a known time, see
    keyed.once_within, which keeps them as state. The names bucket and batch belong to the sink.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates(key).withColumn("bucket", bucket_of(key, buckets)).persist()
        try:
            numbers = touched(new, key, buckets)
            there = kept_in(spark, path, numbers) if numbers else None
            if there is not None:
                # what this very batch may have written before its failure is written again, so it doesn't count as there
                new = new.join(there.where(F.col("batch") != number).select("bucket", *key), ["bucket", *key], "left_anti")
            rows = new.withColumn("batch", F.lit(number)).repartition("bucket")
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(path)
        finally:
            new.unpersist()

    return write


def compact(spark: SparkSession, path: str, key: list[str], numbers: list[int]) -> None:
    """Merges the batches of some folders of a sink of append_once, each into its last one, with one row for each key; while no stream writes to it.

    The merged rows are put down beside the sink first, then in place of the last batch, and the older ones go at the end. If it is ended in between, rows may stand there
    twice until it is run again.
    """
    rows = kept_in(spark, path, numbers)
    if rows is None:
        return
    last = rows.groupBy("bucket").agg(F.max("batch").alias("last"))
    folders = rows.select("bucket", "batch").distinct().join(F.broadcast(last), "bucket").where(F.col("batch") < F.col("last")).collect()  # names of folders
    merged = rows.dropDuplicates(["bucket", *key]).drop("batch").join(F.broadcast(last.withColumnRenamed("last", "batch")), "bucket")
    beside = f"{path}/_merged"
    merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket", "batch").parquet(beside)
    spark.read.parquet(beside).repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(path)
    for gone in [f"{path}/bucket={r['bucket']}/batch={r['batch']}" for r in folders] + [beside]:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(gone)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def started(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> DataStreamWriter:
    """A writer that takes all that is there and ends; give it another trigger to run on."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def finalized_documents(events: DataFrame) -> DataFrame:
    """Documents of completed jobs that have a user: source_job_id, user_id, name, status."""
    name = F.regexp_extract(F.trim(F.coalesce("outputPath", F.lit(""))), r"([^/]+)/*$", 1)
    named = F.when(name != "", name).when(F.coalesce("toolType", F.lit("")) != "", F.concat("toolType", F.lit(" output"))).otherwise("Processed document")
    own = events.where((F.col("eventType") == "JobCompleted") & F.col("userId").rlike(UUID))
    return own.select(F.col("jobId").alias("source_job_id"), F.lower("userId").alias("user_id"), named.alias("name"), F.lit("ready").alias("status"))


def notices(events: DataFrame) -> DataFrame:
    """Notifications of finished jobs that have a user: source_job_id, user_id, kind."""
    own = events.where(F.col("eventType").isin("JobCompleted", "JobFailed") & F.col("userId").rlike(UUID))
    return own.select(F.col("jobId").alias("source_job_id"), F.lower("userId").alias("user_id"), F.when(F.col("eventType") == "JobCompleted", "completed").otherwise("failed").alias("kind"))


# State and progress that each event puts a job into.
STATES = {"JobCreated": ("queued", 0), "JobRetried": ("queued", 0), "JobStarted": ("processing", 20), "JobCompleted": ("completed", 100), "JobFailed": ("failed", 0)}


def job_states(events: DataFrame) -> DataFrame:
    """Latest state of each job by event time; once completed, a job stays so. A built-in aggregation, so the state store holds two rows' worth for each job,
    and holds them for good: for a stream without an end, or where events may be out of turn, see keyed.job_stream."""
    state, progress = F.lit(None).cast("string"), F.lit(None).cast("int")
    for kind, (name, done) in STATES.items():
        state, progress = F.when(F.col("eventType") == kind, name).otherwise(state), F.when(F.col("eventType") == kind, done).otherwise(progress)
    own = events.where(F.col("eventType").isin(*STATES)).select("jobId", F.struct(F.col("timestamp").try_cast("timestamp").alias("at"), progress.alias("progress"), state.alias("state")).alias("s"))
    latest = own.groupBy("jobId").agg(F.max("s").alias("last"), F.min(F.when(F.col("s.state") == "completed", F.col("s"))).alias("done"))
    return latest.select("jobId", F.coalesce("done", "last").alias("s")).select("jobId", "s.state", "s.progress", "s.at")


def windowed_counts(rows: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """An extension: events by type in windows of event time; what is later than `late` behind the newest is left out."""
    return rows.withWatermark("created_at", late).groupBy(F.window("created_at", width), "event_type").agg(F.count("*").alias("count"))


# Deliveries after which a message is dead.
MOST_DELIVERIES = 5


def delivered(done: str, again: str, dead: str, failed: Column, most: int = MOST_DELIVERIES) -> Callable[[DataFrame, int], None]:
    """A batch function for messages (value, deliveries before this one): those that don't fail are done, the others come again, and after `most` deliveries they are dead.

    The batch is worked out once. What comes again is written with its new count as JSON lines, for a stream of its own over the folder `again`, at once; for waits
    see keyed.redelivered. A batch that is tried again overwrites its files with new names, which a stream over `again` may read a second time: delivery is at least once.
    """
    bad = F.coalesce(failed, F.lit(True))

    def write(batch: DataFrame, number: int) -> None:
        counted = batch.withColumn("deliveries", F.coalesce("deliveries", F.lit(0)) + 1)
        place = F.when(~bad, "done").when(F.col("deliveries") < most, "again").otherwise("dead")
        with held(counted.withColumn("place", place)) as told:
            for name, folder in (("done", done), ("again", again), ("dead", dead)):
                told.where(F.col("place") == name).drop("place").write.mode("overwrite").json(f"{folder}/batch={number}")

    return write


def message_stream(spark: SparkSession, folder: str, files_at_once: int = 1000) -> DataFrame:
    """Messages (value, deliveries) of JSON lines in a folder and those below it; new messages have no count."""
    read = spark.readStream.schema("value string, deliveries int").option("maxFilesPerTrigger", files_at_once).option("recursiveFileLookup", True)
    return read.json(folder)


def write_together(folder: str, tables: dict[str, Callable[[DataFrame], DataFrame]]) -> Callable[[DataFrame, int], None]:
    """A batch function that writes several tables of one batch, all or none: a mark is set last, and read_together only takes marked batches."""

    def write(batch: DataFrame, number: int) -> None:
        for name, make in tables.items():
            make(batch).write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")
        batch.sparkSession.range(1).select(F.lit(number).cast("int").alias("done")).write.mode("overwrite").parquet(f"{folder}/marks/{number}")

    return write


def read_together(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The rows of a table that write_together has finished."""
    marks = spark.read.option("recursiveFileLookup", True).schema("done int").parquet(f"{folder}/marks")
    return spark.read.parquet(f"{folder}/{name}").join(marks.select(F.col("done").alias("batch")), "batch", "left_semi").drop("batch")


def polled(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, every: str = "20 seconds") -> DataStreamWriter:
    """A writer that looks for new rows again and again after so long."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(processingTime=every)
