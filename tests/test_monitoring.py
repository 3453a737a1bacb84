from __future__ import annotations

import json

from tallywell.operators import metrics as M
from tallywell.sources import monitoring as S

FAMILY = "http_request_duration_seconds"


def test_text_format(spark, tmp_path):
    bucket = lambda m, p, s, le, n: f'{FAMILY}_bucket{{method="{m}",path="{p}",status="{s}",le="{le}"}} {n}'
    rest = lambda m, p, s, total, n: [f'{FAMILY}_sum{{method="{m}",path="{p}",status="{s}"}} {total}', f'{FAMILY}_count{{method="{m}",path="{p}",status="{s}"}} {n}']
    lines = [f"# TYPE {FAMILY} histogram", "", "broken line {", r'up{job="a\"b,c=\\d"} 1 1700000000', "plain +Inf"]
    lines += [bucket("PUT", "/upload", 201, "0.1", 2), bucket("PUT", "/upload", 201, "0.4", 8), bucket("PUT", "/upload", 201, "+Inf", 8), *rest("PUT", "/upload", 201, 1.6, 8)]
    lines += [bucket("GET", "/list", 403, "0.1", 5), bucket("GET", "/list", 403, "+Inf", 5), *rest("GET", "/list", 403, 0.2, 5)]
    (tmp_path / "m.txt").write_text("\n".join(lines))
    found = S.text_samples(spark, str(tmp_path / "m.txt"))
    rows = {r.metric: r for r in found.collect()}
    assert rows["up"].labels == {"job": 'a"b,c=\\d'} and rows["plain"].value == float("inf")
    assert S.gauge(found, "up").first().value == 1 and S.gauge(found, "none").first().value == 0
    got = M.hist_aggregate(*S.histogram(found, FAMILY)).first()
    assert (got.requests, got.client_errors) == (13, 5) and 0 < got.p50_ms <= got.p95_ms


def test_broker_documents(spark, tmp_path):
    """Three streams in two accounts; results are worked out by hand."""
    stream = lambda name, n, *consumers: {"name": name, "state": {"messages": n, "bytes": 10 * n, "first_seq": 4, "last_seq": 4 + n, "consumer_count": len(consumers)}, "consumer_detail": list(consumers)}
    reader = lambda name, ack, again, pending: {"name": name, "num_ack_pending": ack, "num_redelivered": again, "num_pending": pending, "num_waiting": 6}
    info = {
        "streams": 3,
        "account_details": [
            {"name": "left", "stream_detail": [stream("ANALYTICS", 40, reader("slow", 11, 0, 25), reader("fast", 1, 1, 0)), stream("JOBS_DLQ", 9)]},
            {"name": "right", "stream_detail": [stream("JOBS_DISPATCH", 16, reader("optimize", 4, 2, 12))]},
        ],
    }
    (tmp_path / "j.json").write_text(json.dumps(info))
    found = S.broker_info(spark, str(tmp_path / "j.json"))
    assert [(r.stream, r.bytes, r.consumer_count) for r in M.nats_streams(found).collect()] == [("ANALYTICS", 400, 2), ("JOBS_DISPATCH", 160, 1), ("JOBS_DLQ", 90, 0)]
    assert tuple(M.nats_summary(found).first()) == (3, 65, 9)
    assert [(r.stream, r.pending, r.ack_pending, r.redelivered) for r in sorted(M.queue_snapshot(found).collect())] == [("ANALYTICS", 25, 12, 1), ("JOBS_DISPATCH", 12, 4, 2)]
    assert [(r.stream, r.consumer) for r in M.nats_consumers(found).collect()] == [("ANALYTICS", "fast"), ("ANALYTICS", "slow"), ("JOBS_DISPATCH", "optimize")]
    assert [tuple(r) for r in M.dispatch_consumers(found).collect()] == [("optimize", 12, 4, 2)]
    assert M.queue_health(found).first().asDict() == {"dead_letters": 9, "analytics_pending": 25, "analytics_ack_pending": 12, "job_events_pending": 0, "job_events_ack_pending": 0}


def test_queue_health_of_empty_documents(spark):
    texts = spark.createDataFrame([(1, "{}"), (2, "no json"), (3, '{"account_details":[{"stream_detail":[{"name":"JOBS_EVENTS","consumer_detail":[{"num_pending":7},{"num_ack_pending":2}]}]}]}'), (4, None)], "scrape int, value string")
    found = {r.scrape: tuple(r)[1:] for r in M.queue_health(S.documents(texts, S.STREAMS)).collect()}
    assert found == {1: (0, 0, 0, 0, 0), 2: (0, 0, 0, 0, 0), 3: (0, 0, 0, 7, 2), 4: (0, 0, 0, 0, 0)}


def test_server_document(spark, tmp_path):
    (tmp_path / "v.json").write_text('{"server_id": "NX",\n "mem": 5000000000, "cpu": 2, "gateway": {}}')
    r = S.server_info(spark, str(tmp_path / "v.json")).first()
    assert (r.server_id, r.mem, r.cpu, r.uptime) == ("NX", 5_000_000_000, 2.0, None)
