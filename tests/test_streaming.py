from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tallywell.streaming import ingest as I

USER = "0189aaaa-0000-7000-8000-000000000001"


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))


def test_lines_are_logged_or_dead(spark, tmp_path):
    put(tmp_path / "in", "a.json", [{"eventType": "user.login", "userId": USER, "timestamp": "2024-01-02T03:04:05Z"}, "{broken", {"userId": USER}, {"eventType": "user.signup", "userId": "nobody"}])
    stream = I.text_stream(spark, str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        I.started(stream, I.append_to(str(tmp_path / "log"), str(tmp_path / "dead")), str(tmp_path / "c")).start().awaitTermination()
    log = {r.event_type: r for r in spark.read.parquet(str(tmp_path / "log")).collect()}
    assert log.keys() == {"user.login", "user.signup"}
    assert log["user.login"].user_id == USER and log["user.login"].created_at.year == 2024 and log["user.signup"].user_id is None
    assert spark.read.parquet(str(tmp_path / "dead")).count() == 2


def test_finished_jobs_make_one_document_and_one_notice(spark, tmp_path):
    done = {"eventType": "JobCompleted", "jobId": "j1", "userId": USER, "toolType": "merge-pdf", "outputPath": "out/j1/x.pdf"}
    for name, rows in (("a.json", [done, done, {"eventType": "JobStarted", "jobId": "j2", "userId": USER}]), ("b.json", [done, {"eventType": "JobFailed", "jobId": "j2", "userId": USER}])):
        put(tmp_path / "in", name, rows)
        events = I.well_formed(I.text_stream(spark, str(tmp_path / "in")), I.JOB_EVENT)
        for make, to in ((I.finalized_documents, "documents"), (I.notices, "notices")):
            I.started(make(events), I.append_once(str(tmp_path / to), ["user_id", "source_job_id"]), str(tmp_path / f"c-{to}")).start().awaitTermination()
    assert [r.name for r in spark.read.parquet(str(tmp_path / "documents")).collect()] == ["x.pdf"]
    assert sorted(r.kind for r in spark.read.parquet(str(tmp_path / "notices")).collect()) == ["completed", "failed"]


def test_a_batch_that_is_tried_again_repeats_nothing(spark, tmp_path):
    write = I.append_once(str(tmp_path / "t"), ["k"])
    batch = spark.createDataFrame([(1,), (2,), (2,)], "k int")
    write(batch, 0)
    write(batch, 0)
    write(spark.createDataFrame([(2,), (3,)], "k int"), 1)
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [1, 2, 3]


def test_job_states(spark, tmp_path):
    steps = [("JobCreated", 1), ("JobStarted", 2), ("JobCompleted", 9), ("JobStarted", 4)]
    put(tmp_path / "in", "a.json", [{"eventType": e, "jobId": "j", "timestamp": f"2024-01-01T00:00:0{t}Z"} for e, t in steps])
    states = I.job_states(I.well_formed(I.text_stream(spark, str(tmp_path / "in")), I.JOB_EVENT))
    states.writeStream.outputMode("complete").format("memory").queryName("states").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert [(r.state, r.progress) for r in spark.table("states").collect()] == [("completed", 100)]


def test_job_events_become_log_rows(spark):
    rows = spark.createDataFrame([('{"eventType":"JobFailed","jobId":"x","failureReason":"[TIMEOUT] late"}',), ('{"eventType":"JobStarted"}',)], "value string")
    (row,) = I.job_log_rows(I.well_formed(rows, I.JOB_EVENT)).collect()
    assert row.event_type == "job.failed" and "TIMEOUT" in row.metadata


def test_a_message_is_dead_after_its_deliveries(spark, tmp_path):
    put(tmp_path / "in", "a.json", [{"value": "good"}, {"value": "bad"}, {"value": "worse"}])
    done, again, dead = (str(tmp_path / n) for n in ("done", "again", "dead"))
    I.started(I.message_stream(spark, str(tmp_path / "in")), I.delivered(done, again, dead, F.col("value") != "good", most=3), str(tmp_path / "c1")).start().awaitTermination()
    write = I.delivered(f"{tmp_path}/done2", again + "/late", dead, F.col("value") == "worse", most=3)
    I.started(I.message_stream(spark, again), write, str(tmp_path / "c2")).start().awaitTermination()
    first = {(r.value, r.deliveries) for r in spark.read.json(done).collect()}
    assert first == {("good", 1)} and [(r.value, r.deliveries) for r in spark.read.json(f"{tmp_path}/done2").collect()] == [("bad", 2)]
    I.started(I.message_stream(spark, again), write, str(tmp_path / "c2")).start().awaitTermination()  # the third delivery
    assert [(r.value, r.deliveries) for r in spark.read.option("recursiveFileLookup", True).json(dead).collect()] == [("worse", 3)]


def test_tables_of_a_batch_appear_together(spark, tmp_path):
    def broken(b):
        raise ValueError

    folder, batch = str(tmp_path / "t"), spark.createDataFrame([(1, "a"), (2, "b")], "id int, path string")
    jobs, files = (lambda b: b.select("id")), (lambda b: b.select("id", "path"))
    I.write_together(folder, {"jobs": jobs, "files": files})(batch, 0)
    with pytest.raises(ValueError):
        I.write_together(folder, {"jobs": jobs, "files": broken})(batch, 1)
    for name in ("jobs", "files"):
        assert sorted(r.id for r in I.read_together(spark, folder, name).collect()) == [1, 2]


def test_a_poller_takes_what_arrives(spark, tmp_path):
    put(tmp_path / "in", "a.json", ["x"])
    query = I.polled(I.text_stream(spark, str(tmp_path / "in")), lambda b, n: b.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={n}"), str(tmp_path / "c"), "1 second").start()
    query.processAllAvailable()
    put(tmp_path / "in", "b.json", ["y"])
    query.processAllAvailable()
    query.stop()
    assert sorted(r.value for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["x", "y"]


def test_late_events_stay_out_of_closed_windows(spark, tmp_path):
    event = lambda hour: {"eventType": "user.login", "userId": USER, "timestamp": f"2024-01-01T{hour:02}:30:00Z"}
    for name, hours in (("a.json", [1, 1, 9]), ("b.json", [1, 9, 12])):
        put(tmp_path / "in", name, [event(h) for h in hours])
        counts = I.windowed_counts(I.log_rows(I.well_formed(I.text_stream(spark, str(tmp_path / "in")))))
        counts.select("window.start", "count").writeStream.outputMode("append").format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.start.hour, r["count"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, 2), (9, 2)]


def test_a_completed_job_stays_completed(spark):
    steps = [("a", "JobCompleted", 3), ("a", "JobFailed", 5), ("b", "JobStarted", 1), ("b", "JobFailed", 2), ("b", "Other", 9)]
    rows = spark.createDataFrame([(e, j, f"2024-01-01T00:00:0{t}Z") for j, e, t in steps], "eventType string, jobId string, timestamp string")
    assert sorted((r.jobId, r.state, r.progress) for r in I.job_states(rows).collect()) == [("a", "completed", 100), ("b", "failed", 0)]
