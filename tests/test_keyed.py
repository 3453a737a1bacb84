"""Streams with state by key: repeats, late and out-of-turn events, restarts, waits and sessions."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

import pytest

from tallywell.operators import lifecycle as L
from tallywell.streaming import ingest, keyed

START = datetime(2024, 1, 1)


def t(seconds: float) -> datetime:
    return START + timedelta(seconds=seconds)


class Feed:
    """A folder that a stream reads; each `run` starts it anew from its checkpoint, takes all that has come, and gives the rows that came out."""

    def __init__(self, spark, tmp_path, schema: str, make):
        self.spark, self.at, self.n = spark, tmp_path, 0
        (tmp_path / "in").mkdir()
        self.stream = make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")))

    def run(self, *batches: list[dict]) -> list:
        for rows in batches:
            self.n += 1
            (self.at / "in" / f"{self.n:04}.json").write_text("\n".join(json.dumps({k: v.isoformat() + "Z" if isinstance(v, datetime) else v for k, v in r.items()}) for r in rows))
        seen = []
        query = self.stream.writeStream.foreachBatch(lambda b, i: seen.extend(b.collect())).option("checkpointLocation", str(self.at / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
        self.kept = sum(s.numRowsTotal for s in query.lastProgress.stateOperators) if query.lastProgress else None
        return seen


def event(job, kind, at):
    return {"job_id": job, "kind": kind, "at": t(at)}


def test_job_stream_skips_repeats_and_what_is_out_of_turn(spark, tmp_path):
    feed = Feed(spark, tmp_path, "job_id string, kind string, at timestamp", lambda s: keyed.job_stream(s, late="60 seconds", kept=timedelta(minutes=5)))
    first = feed.run([event("a", "JobStarted", 10), event("a", "JobCreated", 0), event("a", "JobStarted", 11)], [event("a", "JobCreated", 12), event("b", "JobCompleted", 5), event("b", "JobFailed", 6), event(None, "JobFailed", 6), event("b", "Unknown", 6)])
    assert [(r.job_id, r.kind, r.outcome, r.state) for r in sorted(first, key=lambda r: (r.job_id, r["at"]))] == [
        ("a", "JobCreated", "applied", "queued"), ("a", "JobStarted", "applied", "processing"), ("a", "JobStarted", "duplicate", "processing"), ("a", "JobCreated", "out of turn", "processing"),
        ("b", "JobCompleted", "out of turn", ""), ("b", "JobFailed", "applied", "failed"),
    ]
    # the state outlives the query; a retry begins a second start, and an older event is out of turn
    again = feed.run([event("a", "JobRetried", 20), event("a", "JobStarted", 30), event("a", "JobFailed", 25), event("a", "JobCompleted", 40), event("a", "JobCompleted", 41)])
    assert [(r.outcome, r.state, r.starts) for r in sorted(again, key=lambda r: r["at"])] == [("applied", "queued", 1), ("applied", "failed", 1), ("applied", "processing", 2), ("applied", "completed", 2), ("duplicate", "completed", 2)]
    # behind the watermark: left out; past the time that a completed job is kept: its state ends
    ended = feed.run([event("c", "JobCreated", 1000)])
    assert [(r.job_id, r.outcome, r.state) for r in ended if r.job_id == "a"] == [("a", "ended", "completed")]
    late = feed.run([event("a", "JobFailed", 100), event("c", "JobStarted", 1001), event("d", "JobCompleted", 1002)])
    assert sorted((r.job_id, r.outcome, r.state) for r in late) == [("c", "applied", "processing"), ("d", "out of turn", "")]  # of d nothing is held
    assert feed.kept == 2  # b and c


def test_step_allows_what_the_table_of_events_says():
    allowed = {(s, k) for s in ("", "queued", "processing", "completed", "failed") for k in L.EVENTS if L.step(L.Record(s, 0, 0, t(0)), k, t(1))[1] == "applied"}
    assert allowed == {("", "JobCreated"), ("", "JobStarted"), ("queued", "JobStarted"), ("failed", "JobStarted"), ("processing", "JobRetried"), ("processing", "JobCompleted"), ("", "JobFailed"), ("queued", "JobFailed"), ("processing", "JobFailed")}
    assert L.step(L.Record("processing", 20, 1, t(5)), "JobFailed", t(4)) == (L.Record("processing", 20, 1, t(5)), "out of turn")


def test_job_machine_and_stream_agree(spark, tmp_path):
    rows = [(f"j{i % 7}", list(L.EVENTS)[(i * i + i // 3) % 5], t(i), i) for i in range(120)]
    table = spark.createDataFrame([*rows, (None, "JobFailed", t(1), 900), ("j1", "JobFailed", None, 901), ("j1", None, t(1), 902)], "job_id string, kind string, at timestamp, id int")
    batch = {(r.job_id, r["at"]): (r.outcome, r.state, r.starts) for r in L.job_machine(table).collect()}
    feed = Feed(spark, tmp_path, "job_id string, kind string, at timestamp", keyed.job_stream)
    cut = [[event(j, k, i) for j, k, _, i in rows[a : a + 40]] for a in (0, 40, 80)]
    stream = {(r.job_id, r["at"]): (r.outcome, r.state, r.starts) for r in feed.run(*cut)}
    assert stream == batch and len(batch) == 120
    ends = {r.job_id: r for r in L.last_states(L.job_machine(table)).collect()}
    assert sum(r.applied + r.duplicates + r.out_of_turn for r in ends.values()) == 120
    assert all(ends[j].state == batch[j, max(a for k, a in batch if k == j)][1] for j in ends)


def test_message_comes_back_after_its_waits_and_dies_after_the_fourth(spark, tmp_path):
    feed = Feed(spark, tmp_path, "id string, value string, error string, delivery int, at timestamp", keyed.redelivered)
    fail = lambda i, n, at, error="status=503": {"id": i, "value": f"v{i}", "error": error, "delivery": n, "at": t(at)}
    tick = lambda at: fail("clock", None, at, "bad input")
    out = lambda rows: [(r.id, r.value, r.delivery, (r["at"] - START).total_seconds(), r.what) for r in rows if r.id != "clock"]
    assert out(feed.run([fail("m", 1, 0), fail("n", 1, 0, "status=404")])) == [("n", "vn", 1, 0, "dead")]
    assert out(feed.run([tick(9)])) == []
    assert out(feed.run([tick(11)])) == [("m", "vm", 2, 10, "released")]
    # the second delivery fails, told twice; then a restart of the stream, and the wait of 30 s
    assert out(feed.run([fail("m", 2, 12), fail("m", 2, 12)], [fail("m", 1, 13)])) == []
    assert out(feed.run([tick(41)])) == []
    assert out(feed.run([tick(43)])) == [("m", "vm", 3, 42, "released")]
    assert out(feed.run([fail("m", 3, 50)], [tick(169)])) == []
    assert out(feed.run([tick(171)])) == [("m", "vm", 4, 170, "released")]
    assert out(feed.run([fail("m", 4, 180)])) == [("m", "vm", 4, 180, "dead")]
    feed.run([tick(400)], [tick(800)])
    assert feed.kept <= 1  # nothing of m or n is held on


def test_sessions_of_a_stream_leave_out_what_is_late(spark, tmp_path):
    feed = Feed(spark, tmp_path, "user_id string, created_at timestamp", lambda s: keyed.sessions(s, "30 seconds", late="20 seconds"))
    row = lambda u, at: {"user_id": u, "created_at": t(at)}
    got = lambda rows: sorted((r.user_id, (r.first_at - START).total_seconds(), (r.last_at - START).total_seconds(), r.events) for r in rows)
    assert got(feed.run([row("u", 0), row("u", 29), row("v", 5)], [row("u", 50)])) == []
    # an event within the watermark joins two spells; later ones end them
    assert got(feed.run([row("u", 40), row("v", 61)])) == [("v", 5, 5, 1)]
    assert got(feed.run([row("w", 200)])) == [("u", 0, 50, 4), ("v", 61, 61, 1)]
    assert got(feed.run([row("u", 60), row("w", 201)])) == []
    assert feed.kept == 1


def test_sliding_windows_of_a_stream(spark, tmp_path):
    feed = Feed(spark, tmp_path, "event_type string, created_at timestamp", lambda s: keyed.windowed(s, "20 seconds", "10 seconds", late="5 seconds"))
    row = lambda at: {"event_type": "e", "created_at": t(at)}
    rows = feed.run([row(5), row(12), row(19)], [row(31)]) + feed.run([row(3), row(60)])
    assert sorted(((r.start - START).total_seconds(), (r.end - START).total_seconds(), r["count"]) for r in rows) == [(-10, 10, 1), (0, 20, 3), (10, 30, 2), (20, 40, 1), (30, 50, 1)]


def test_once_within_forgets_keys(spark, tmp_path):
    feed = Feed(spark, tmp_path, "k string, at timestamp", lambda s: keyed.once_within(s, ["k"], "at", "10 seconds"))
    row = lambda k, at: {"k": k, "at": t(at)}
    assert sorted(r.k for r in feed.run([row("a", 0), row("a", 1), row("b", 2)], [row("a", 3)])) == ["a", "b"]
    assert sorted(r.k for r in feed.run([row("c", 100)], [row("c", 101)])) == ["c"]
    assert feed.kept == 1


@pytest.mark.parametrize("retry", [False, True])
def test_a_sink_of_many_partitions_is_read_where_a_batch_touches_it(spark, tmp_path, retry):
    path = str(tmp_path / "sink")
    write = ingest.append_once(path, ["k"], buckets=1000)
    write(spark.range(5000).selectExpr("id AS k", "'old' AS v"), 0)
    assert len(list((tmp_path / "sink").glob("bucket=*"))) > 950
    batch = spark.createDataFrame([(k, "new") for k in (1, 2, 3, 4, 5, 5001, 5002, 5003, 5004, 5004)], "k bigint, v string")
    read = ingest.kept_in(spark, path, ingest.touched(batch, ["k"], 1000))
    assert 0 < len(read.inputFiles()) <= 9
    for _ in range(1 + retry):  # a batch that is tried again leaves nothing twice
        write(batch, 1)
    found = spark.read.parquet(path)
    assert found.count() == 5004 and found.where("v = 'new'").count() == 4 and found.select("k").distinct().count() == 5004


def test_batches_of_a_sink_are_merged(spark, tmp_path):
    path = str(tmp_path / "sink")
    write = ingest.append_once(path, ["k"], buckets=4)
    for number in range(5):
        write(spark.range(10 * number, 10 * number + 15).selectExpr("id AS k", f"{number} AS v"), number)
    before = sorted(map(tuple, spark.read.parquet(path).select("k", "v").collect()))
    assert len(before) == 55 and len(list((tmp_path / "sink").glob("bucket=*/batch=*"))) > 12
    for _ in range(2):  # merging again changes nothing
        ingest.compact(spark, path, ["k"], [0, 1, 3])
        assert sorted(map(tuple, spark.read.parquet(path).select("k", "v").collect())) == before
        assert [len(list((tmp_path / "sink" / f"bucket={b}").glob("batch=*"))) for b in (0, 1, 3)] == [1, 1, 1]
    assert len(list((tmp_path / "sink" / "bucket=2").glob("batch=*"))) > 1
    write(spark.range(0, 60).selectExpr("id AS k", "9 AS v"), 9)
    assert spark.read.parquet(path).count() == 60
    ingest.compact(spark, str(tmp_path / "none"), ["k"], [0])
