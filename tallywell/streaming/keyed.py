"""Streams with state by key: a job's state machine, redelivery after a wait, rows once for each key, and windows of event time.

State ends: a job's record some time after it is completed or was last heard of, a waiting message's with its release, a key's after the time
that repeats may come in. Times are event times; what is later than the watermark is left out, and timers run when the watermark passes them, also in a batch
without rows. Keys are dealt over all tasks; a task holds one key's record at a time besides the state store.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallywell.operators.jobs import BACKOFF, DELIVERIES, recoverable
from tallywell.operators.lifecycle import EVENTS, OUTCOME, Record, step

EPOCH = datetime(1970, 1, 1)


def millis(t: datetime | pd.Timestamp) -> int:
    return (pd.Timestamp(t).tz_localize(None) - pd.Timestamp(EPOCH)) // pd.Timedelta(milliseconds=1)


def micros(t: pd.Timestamp) -> int:
    return (pd.Timestamp(t).tz_localize(None) - pd.Timestamp(EPOCH)) // pd.Timedelta(microseconds=1)


def job_stream(events: DataFrame, late: str = "10 minutes", kept: timedelta = timedelta(hours=1), idle: timedelta = timedelta(days=7)) -> DataFrame:
    """Each event of a stream (job_id string, kind, at timestamp) with its outcome and the job's state after it.

    A completed job's record stays for `kept`, to know repeats by, any other's until nothing was heard for `idle`; then it goes, and a row with the outcome
    "ended" tells so. Events of a batch go in order of time; those at the same time in order of a job's life.
    """
    own = events.where(F.col("job_id").isNotNull() & F.col("at").isNotNull() & F.col("kind").isin(*EVENTS)).select("job_id", "kind", "at")
    place = {k: i for i, k in enumerate(EVENTS)}

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        record = Record(*state.get[:3], EPOCH + timedelta(microseconds=state.get[3])) if state.exists else Record()
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], None, None, "ended", record.state, record.progress, record.starts)], columns=NAMES)
            return
        rows = pd.concat(list(batches))
        rows = rows.assign(place=rows["kind"].map(place)).sort_values(["at", "place"], kind="stable")
        out = []
        for kind, at in zip(rows["kind"], rows["at"]):
            record, outcome = step(record, kind, at.to_pydatetime().replace(tzinfo=None))
            out.append((key[0], kind, at, outcome, record.state, record.progress, record.starts))
        if record.at is not None:  # else nothing has counted yet, and there is nothing to hold
            state.update((record.state, record.progress, record.starts, micros(record.at)))
            ends = record.at + (kept if record.state == "completed" else idle)
            state.setTimeoutTimestamp(max(millis(ends), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=NAMES)

    NAMES = ["job_id", "kind", "at", "outcome", "state", "progress", "starts"]
    schema = f"job_id string, kind string, at timestamp, {OUTCOME}"
    held = "state string, progress int, starts int, at bigint"
    return own.withWatermark("at", late).groupBy("job_id").applyInPandasWithState(run, schema, held, "append", GroupStateTimeout.EventTimeTimeout)


def redelivered(failures: DataFrame, late: str = "0 seconds", waits: tuple[int, ...] = BACKOFF, most: int = DELIVERIES) -> DataFrame:
    """What becomes of failed deliveries (id string, value, error, delivery from 1, at timestamp) of a stream.

    A failure that another try may mend is held as state and released, with its next delivery's number and the time it is due, once the watermark
    passes the wait; others, and the last one's, come out as "dead" at once. A failure that was told before (no later delivery than what waits or was released) changes nothing.
    """
    own = failures.where(F.col("id").isNotNull() & F.col("at").isNotNull()).select("id", "value", F.coalesce("delivery", F.lit(1)).cast("int").alias("delivery"), "at", recoverable(F.col("error")).alias("again"))

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        told, due, value = state.get if state.exists else (0, None, None)
        if state.hasTimedOut:
            if due is None:  # released before, and not failed again since
                state.remove()
                return
            state.update((told, None, None))
            state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + 1000 * max(waits))
            yield pd.DataFrame([(key[0], value, told + 1, pd.Timestamp(due, unit="us"), "released")], columns=NAMES)
            return
        rows = pd.concat(list(batches)).sort_values(["delivery", "at"])
        out = []
        for text, delivery, at, again in zip(rows["value"], rows["delivery"], rows["at"], rows["again"]):
            if delivery <= told:
                continue
            told = int(delivery)
            if again and told < most:
                due, value = micros(at) + 1_000_000 * waits[min(told, len(waits)) - 1], text
            else:
                due, value = None, None
                out.append((key[0], text, told, pd.Timestamp(at).tz_localize(None), "dead"))
        if told:
            state.update((told, due, value))
            wanted = -(-due // 1000) if due is not None else state.getCurrentWatermarkMs() + 1000 * max(waits)
            state.setTimeoutTimestamp(max(wanted, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=NAMES)

    NAMES = ["id", "value", "delivery", "at", "what"]
    schema = "id string, value string, delivery int, at timestamp, what string"
    held = "told int, due bigint, value string"
    return own.withWatermark("at", late).groupBy("id").applyInPandasWithState(run, schema, held, "append", GroupStateTimeout.EventTimeTimeout)


def once_within(rows: DataFrame, key: list[str], at: str, late: str = "1 hour") -> DataFrame:
    """The first row of each key; keys are forgotten once repeats of them would be later than the watermark. A built-in operator, so nothing else is held."""
    return rows.withWatermark(at, late).dropDuplicatesWithinWatermark(key)


def sessions(rows: DataFrame, gap: str = "30 minutes", by: tuple[str, ...] = ("user_id",), at: str = "created_at", late: str | None = None) -> DataFrame:
    """Spells of rows of a key that follow each other within the gap: when each began and when its last row came, and how many there were.

    On a stream (with `late`) a session comes out when the watermark has passed its end. On a table the same by a shuffle by key.
    """
    own = rows.where(F.col(at).isNotNull())
    own = own.withWatermark(at, late) if late else own
    found = own.groupBy(*by, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("events"), F.max(at).alias("last_at"))
    return found.select(*by, F.col("w.start").alias("first_at"), "last_at", "events")


def windowed(rows: DataFrame, width: str, slide: str | None = None, by: tuple[str, ...] = ("event_type",), at: str = "created_at", late: str | None = None, also: dict[str, Column] | None = None) -> DataFrame:
    """Rows of a key in windows of event time, beginning every `slide` (one after another without it); `also` names further aggregates."""
    own = rows.where(F.col(at).isNotNull())
    own = own.withWatermark(at, late) if late else own
    window = F.window(at, width, slide) if slide else F.window(at, width)
    found = own.groupBy(window.alias("w"), *by).agg(F.count("*").alias("count"), *(c.alias(n) for n, c in (also or {}).items()))
    return found.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "count", *(also or {}))
