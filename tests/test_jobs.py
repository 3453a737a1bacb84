from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tallywell.operators import jobs as B
from tallywell.operators import metrics as M
from tallywell.sources import host, monitoring

START = datetime(2024, 1, 1)


def seconds(n):
    return START + timedelta(seconds=n)


def test_breaker_opens_probes_and_closes(spark):
    bad, good = False, True
    steps = [(0, bad), (1, bad), (2, good), (3, bad), (4, bad), (5, bad), (6, bad), (7, bad), (8, good), (37, good), (38, bad), (69, good), (70, bad)]
    rows = spark.createDataFrame([("s", seconds(t), ok) for t, ok in steps], "service string, ts timestamp_ntz, ok boolean")
    states = [r.state for r in B.circuit_breaker(rows).orderBy("ts").collect()]
    assert states == ["closed"] * 8 + ["open", "open", "half-open", "half-open", "closed"]


def test_breaker_counts_anew_after_its_interval(spark):
    rows = spark.createDataFrame([("s", seconds(t), None) for t in (0, 1, 2, 3, 61, 62)], "service string, ts timestamp_ntz, ok boolean")
    assert {r.state for r in B.circuit_breaker(rows).collect()} == {"closed"}
    assert B.circuit_breaker(rows.limit(0)).collect() == []


def test_retention_drops_the_oldest_beyond_the_bytes(spark):
    rows = spark.createDataFrame([("A", seconds(t), t, b) for t, b in ((0, 5), (59, 5), (60, 5), (61, 50), (200, 5))] + [("B", seconds(0), 9, 99)], "stream string, at timestamp_ntz, seq bigint, bytes bigint")
    kept = B.retained(rows, seconds(230), {"A": (200, 12, 20)})
    assert sorted((r.stream, r.seq) for r in kept.collect()) == [("A", 60), ("A", 200), ("B", 9)]


def test_failures(spark):
    rows = spark.createDataFrame([("HTTP status=502", 1), ("Deadline", 3), ("status=502", 4), ("status=404", 1), (None, 1)], "error string, delivery int")
    assert [(r.state, r.retry_seconds, r.code) for r in B.after_failure(rows).collect()] == [("queued", 10, None), ("queued", 120, None), ("failed", None, "CONVERSION_FAILED"), ("failed", None, "CONVERSION_FAILED"), ("failed", None, "CONVERSION_FAILED")]


def test_extrapolated_growth_by_hand(spark):
    # samples every 10 s, 4 a step; in a window of 60 s before the last: 10 .. 60, growth 20 over 50 s, stretched to the edge 10 s before
    rows = spark.createDataFrame([("a", seconds(10 * i), 100.0 + 4 * i) for i in range(7)], "k string, ts timestamp_ntz, value double")
    last = {r.ts: r.increase for r in M.extrapolated(rows, ["k"], 60).collect()}
    assert last[seconds(60)] == 24.0 and last[START] is None
    # near zero: no further back than where the counter began
    rows = spark.createDataFrame([("a", seconds(10 * i + 100), 1.0 + 4 * i) for i in range(3)], "k string, ts timestamp_ntz, value double")
    assert {r.ts: r.increase for r in M.extrapolated(rows, ["k"], 60).collect()}[seconds(120)] == 9.0


def test_gauges_survive_their_text(spark):
    rows = spark.createDataFrame([("up", {"b": 'x"y\\z', "a": "line\nfeed"}, 1.5), ("plain", None, 2.0)], "metric string, labels map<string,string>, value double")
    found = {r.metric: r for r in monitoring.samples(host.gauge_lines(rows)).collect()}
    assert found["up"].labels == {"b": 'x"y\\z', "a": "line\nfeed"} and found["up"].value == 1.5 and found["plain"].value == 2.0


def test_broken_readings_are_null(spark):
    r = spark.range(1).select(host.cpu_counters(F.lit("cpu 1 2 3")).alias("c"), host.cpu_counters(F.lit("intr 4")).alias("n"), host.load_averages(F.lit("0.1 x 2")).alias("l"), host.uptime_seconds(F.lit("")).alias("u"), host.memory(F.lit("")).alias("m")).first()
    assert (r.c, r.n, r.l, r.u) == (None, None, None, None) and r.m.used_percent == 0


def test_objects_and_log_lines(spark, tmp_path):
    (tmp_path / "o").mkdir()
    (tmp_path / "o" / "x.pdf").write_bytes(b"12345")
    (row,) = host.objects(spark, str(tmp_path / "o")).collect()
    assert row.path.endswith("x.pdf") and row.length == 5
    parts = [bytes(host.object_ranges(spark, str(tmp_path / "o"), a, n).first().part) for a, n in ((0, 2), (3, 9), (5, 1), (1, 0))]
    assert parts == [b"12", b"45", b"", b""] and host.object_ranges(spark, str(tmp_path / "o"), 0, 2, longest=4).count() == 0
    assert host.older_than(host.objects(spark, str(tmp_path / "o")), datetime(2000, 1, 1)).count() == 0
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "a.json").write_text('{"name":"/web-1","service":"web","line":"Fatal: x"}\n{"name":"job","service":"worker","line":"fatal"}\nnot json\n')
    host.log_stream(spark, str(tmp_path / "l")).writeStream.format("memory").queryName("loglines").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert [(r.container, r.line) for r in host.log_search(spark.table("loglines"), "web|api", "FATAL").collect()] == [("web-1", "Fatal: x")]
