"""The life of a job: which events move it from which state to which, and what is skipped.

A job begins queued; a start puts it to work, which ends completed or failed or, for another try, queued again. A failed one may be
started again (its dead letter was put back); a completed one is done. An event that would put a job where it is, or that comes again, is a duplicate; one that
its state doesn't allow, or that is older than the last one that counted, is out of turn. Neither changes anything.

`step` is the whole rule, a function of a job's record and one event. `job_machine` passes a table's events through it, each job's in
order of time, with one record held; `streaming.keyed.job_stream` keeps the records of a stream's jobs as state.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The state and progress that each event puts a job into, and the states it may come from.
EVENTS: dict[str, tuple[str, int, tuple[str, ...]]] = {
    "JobCreated": ("queued", 0, ("",)),
    "JobStarted": ("processing", 20, ("", "queued", "failed")),
    "JobRetried": ("queued", 0, ("processing",)),
    "JobCompleted": ("completed", 100, ("processing",)),
    "JobFailed": ("failed", 0, ("", "queued", "processing")),
}


class Record(NamedTuple):
    state: str = ""  # none yet
    progress: int = 0
    starts: int = 0
    at: datetime | None = None  # of the last event that counted


def step(record: Record, kind: str, at: datetime) -> tuple[Record, str]:
    """The record after an event, and whether it was "applied", a "duplicate" or "out of turn"."""
    state, progress, sources = EVENTS[kind]
    if record.at is not None and at < record.at:
        return record, "out of turn"
    if record.state == state:
        return record, "duplicate"
    if record.state not in sources:
        return record, "out of turn"
    return Record(state, progress, record.starts + (kind == "JobStarted"), at), "applied"


OUTCOME = "outcome string, state string, progress int, starts int"


def job_machine(events: DataFrame, key: str = "job_id", kind: str = "kind", at: str = "at", order: str = "id") -> DataFrame:
    """job_id, id, kind and at of each event with its outcome, and the job's state, progress and number of starts after it.

    Events at the same time go by `order`, which tells them apart. Events without a job or a time, and of other kinds, are left out.
    """
    own = events.where(F.col(key).isNotNull() & F.col(at).isNotNull() & F.col(kind).isin(*EVENTS))
    own = own.select(F.col(key).alias("job_id"), F.col(order).alias("id"), F.col(kind).alias("kind"), F.col(at).alias("at"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.schema) + f", {OUTCOME}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, record = object(), Record()
        for b in batches:
            out = []
            for job, k, t in zip(*(b.column(c).to_pylist() for c in ("job_id", "kind", "at"))):
                if job != now:
                    now, record = job, Record()
                record, outcome = step(record, k, t)
                out.append((outcome, record.state, record.progress, record.starts))
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int32())
            cols = [pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 4, kinds)]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*b.schema.names, "outcome", "state", "progress", "starts"])

    return own.repartition("job_id").sortWithinPartitions("job_id", "at", "id").mapInArrow(run, schema)


def last_states(outcomes: DataFrame) -> DataFrame:
    """The state of each job after its last event that counted, and how many were duplicates or out of turn."""
    last = F.max_by(F.struct("state", "progress", "starts"), F.struct("at", "id")).alias("last")
    found = outcomes.groupBy("job_id").agg(last, *(F.count_if(F.col("outcome") == o).alias(n) for o, n in (("applied", "applied"), ("duplicate", "duplicates"), ("out of turn", "out_of_turn"))))
    return found.select("job_id", "last.state", "last.progress", "last.starts", "applied", "duplicates", "out_of_turn")
