"""Rules of the job queue: which failures are tried again, what a listener of a job hears, retention of message streams, circuit
breakers, and where a finished job's document is filed.

Every operator takes and gives DataFrames; keys may be as hot as they like, as none gathers a key's rows in one place but the
breaker, whose state depends on the call before: it passes a key's rows in order and holds three values.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from tallywell.functions.expr import at, free
from tallywell.functions.scalars import classify_error

# Seconds before each further try, and the deliveries after which a job is dead.
BACKOFF = (10, 30, 120)
DELIVERIES = 4


def recoverable(error: Column) -> Column:
    """Failures that another try may mend: answers of 5xx or 429, and time-outs. A null error isn't one."""
    return F.coalesce(error.rlike("status=5|status=429|(?i:timeout|deadline)"), F.lit(False))


def retry_seconds(delivery: Column) -> Column:
    """The wait after a delivery (counted from 1); later ones wait as long as the last."""
    return F.element_at(F.array(*map(F.lit, BACKOFF)), F.greatest(F.lit(1), F.least(F.lit(len(BACKOFF)), delivery)).cast("int"))


def after_failure(failures: DataFrame) -> DataFrame:
    """What becomes of each failed delivery (error, delivery): state, retry_seconds (null when there is no other try), the code of the failure (null while it is tried), and dead."""
    again = recoverable(F.col("error")) & (F.col("delivery") < DELIVERIES)
    return failures.select(
        "*",
        F.when(again, "queued").otherwise("failed").alias("state"),
        F.when(again, retry_seconds(F.col("delivery"))).alias("retry_seconds"),
        F.when(~again, classify_error(F.coalesce("error", F.lit("")))).alias("code"),
        (~again).alias("dead"),
    )


def job_updates(events: DataFrame, key: str = "job_id", order: tuple[str, ...] = ("created_at", "id"), kind: str = "event_type", ends: tuple[str, ...] = ("job.completed", "job.failed")) -> DataFrame:
    """What a listener of each job hears: its events up to and with the first that ends it; later ones are left out, jobs without an end are whole.

    `order` must name columns that tell a job's events apart. Events without a job are left out.
    """
    place = F.struct(*order)
    own = events.where(F.col(key).isNotNull())
    end = own.where(F.col(kind).isin(*ends)).groupBy(key).agg(F.min(place).alias("_end"))
    return own.join(end, key, "left").where(F.col("_end").isNull() | (place <= F.col("_end"))).drop("_end")


def filed(documents: DataFrame, hints: DataFrame) -> DataFrame:
    """Documents of finished jobs (source_job_id, user_id) with the organization that a hint (job_id, user_id, organization_id, at) names for them; null is personal.

    Of a job's hints the latest counts, whoever gave it, of several at the same time that of the largest user and organization; of
    another user than the document's it has no effect.
    """
    own = F.struct("user_id", "organization_id")
    latest = hints.groupBy("job_id").agg(F.max_by(own, F.struct("at", "user_id", "organization_id")).alias("h"))
    own = latest.select(F.col("job_id").alias("source_job_id"), F.col("h.user_id").alias("user_id"), F.col("h.organization_id").alias("organization_id"))
    return documents.join(own, ["source_job_id", "user_id"], "left")


def hints_left(hints: DataFrame, documents: DataFrame) -> DataFrame:
    """The hints after those of filed documents (with an organization) are used up."""
    used = documents.where(F.col("organization_id").isNotNull()).select(F.col("source_job_id").alias("job_id"))
    return hints.join(used, "job_id", "left_anti")


MIB = 1 << 20
# By stream the longest age in seconds, the most bytes, and the longest message in bytes.
RETENTION = {
    "JOBS_DISPATCH": (86_400, 1024 * MIB, 65_536),
    "JOBS_EVENTS": (3_600, 256 * MIB, None),
    "JOBS_DLQ": (604_800, 256 * MIB, None),
    "ANALYTICS": (86_400, 256 * MIB, None),
}


def retained(messages: DataFrame, now: datetime, limits: dict[str, tuple[int, int, int | None]] | None = None) -> DataFrame:
    """The messages (stream, at, seq, bytes) that a stream still holds: none too long or too old, and of these the newest that fit its bytes.

    Streams without limits hold all, also messages without a time, which a stream with an age drops and one with bytes alone counts as its oldest. Bytes
    are summed by minute first, so only a minute's messages are ever ordered together.
    """
    age, most, longest = F.lit(None).cast("bigint"), F.lit(None).cast("bigint"), F.lit(None).cast("bigint")
    for name, (seconds, size, message) in (RETENTION if limits is None else limits).items():
        own = F.col("stream") == name
        age, most = F.when(own, seconds).otherwise(age), F.when(own, size).otherwise(most)
        longest = F.when(own, F.lit(message).cast("bigint")).otherwise(longest)
    since = at(now) - F.expr("make_dt_interval(0, 0, 0, _age)")
    fresh = messages.select("*", age.alias("_age"), most.alias("_most"), longest.alias("_longest"))
    fresh = fresh.where((F.col("_age").isNull() | (F.col("at") >= since)) & (F.col("_longest").isNull() | (F.col("bytes") <= F.col("_longest"))))
    whole, limited = fresh.where(F.col("_most").isNull()), fresh.where(F.col("_most").isNotNull())
    limited = limited.withColumn("_minute", F.coalesce(F.unix_seconds(F.date_trunc("minute", F.col("at").cast("timestamp"))), F.lit(-(1 << 62)))).drop("_age", "_longest")
    newer = Window.partitionBy("stream").orderBy(F.desc("_minute")).rowsBetween(Window.unboundedPreceding, -1)
    minutes = limited.groupBy("stream", "_minute").agg(F.sum("bytes").alias("_bytes")).withColumn("_newer", F.coalesce(F.sum("_bytes").over(newer), F.lit(0)))
    within = Window.partitionBy("stream", "_minute").orderBy(F.desc("at"), F.desc("seq")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.col("_newer") + F.coalesce(F.sum("bytes").over(within), F.lit(0))
    kept = limited.join(minutes.select("stream", "_minute", "_newer"), ["stream", "_minute"]).withColumn("_total", total)
    return kept.where(F.col("_total") <= F.col("_most")).select(*messages.columns).unionByName(whole.select(*messages.columns))


def circuit_breaker(calls: DataFrame, key: str = "service", ts: str = "ts", ok: str = "ok", failures: int = 5, interval: timedelta = timedelta(seconds=60), pause: timedelta = timedelta(seconds=30)) -> DataFrame:
    """Each call with the breaker's `state` when it comes and whether it is `allowed` (with _ behind, where a name is taken); `ok` of calls that aren't allowed has no effect.

    Closed, it opens after so many failures in a row; counts start anew after each interval. Open, it lets a call through once
    more than the pause has passed: half-open, which closes it if that call succeeds and opens it again if not. A null `ok` is a
    failure. Calls at the same time count the failed ones first. Calls without a time pass no breaker: state and allowed are null. Null keys are a key.
    """
    state_name, allowed_name = free("state", calls.columns), free("allowed", calls.columns)
    schema = StructType([*calls.schema.fields, StructField(state_name, StringType()), StructField(allowed_name, BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, opened, bad, until = object(), False, 0, None
        for b in batches:
            states = []
            for k, t, good in zip(*(b.column(c).to_pylist() for c in (key, ts, ok))):
                if t is None:
                    states.append(None)
                    continue
                if k != now:
                    now, opened, bad, until = k, False, 0, t + interval
                if opened:
                    state = "half-open" if t > until else "open"
                    if state == "half-open":
                        opened, bad, until = not good, 0, t + (interval if good else pause)
                else:
                    state = "closed"
                    if t > until:
                        bad, until = 0, t + interval
                    bad = 0 if good else bad + 1
                    if bad >= failures:
                        opened, bad, until = True, 0, t + pause
                states.append(state)
            yield b.append_column(state_name, pa.array(states, pa.string())).append_column(allowed_name, pa.array([s and s != "open" for s in states], pa.bool_()))

    return calls.repartition(key).sortWithinPartitions(key, ts, F.asc_nulls_first(ok)).mapInArrow(run, schema)
