"""Results that can be worked out by hand."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tallywell import plans
from tallywell.functions import scalars as S
from tallywell.operators import metrics as M
from tallywell.operators import store as O
from tallywell.sources import monitoring

INF = float("inf")


def test_histogram_of_three_endpoints(spark):
    """Half of the 8 uploads took up to 0.2 s: 4 of the 6 between 0.1 s and 0.4 s are needed after the 2 before them."""
    b = spark.createDataFrame(
        [("PUT", "/upload", 201, 0.1, 2), ("PUT", "/upload", 201, 0.4, 8), ("PUT", "/upload", 201, INF, 8), ("GET", "/list", 403, 0.1, 5), ("GET", "/list", 403, INF, 5), ("GET", "/slow", 504, 0.4, 0), ("GET", "/slow", 504, INF, 2)],
        "method string, path string, status int, le double, n long",
    )
    c = spark.createDataFrame([("PUT", "/upload", 201, 8, 1.6), ("GET", "/list", 403, 5, 0.2), ("GET", "/slow", 504, 2, 60.0)], "method string, path string, status int, n long, total_seconds double")
    got = M.hist_aggregate(b, c).first()
    assert (got.requests, got.client_errors, got.server_errors, got.timeouts) == (15, 5, 0, 2)
    by_path = {r.path: r for r in M.hist_endpoint_stats(b, c).collect()}
    assert by_path["/upload"].p50_ms == 200.0 and by_path["/list"].p50_ms == 50.0 and by_path["/list"].errors == 5


def test_quantiles_of_an_empty_and_an_endless_histogram(spark):
    b = spark.createDataFrame([("none", 0.1, 0), ("none", INF, 0), ("endless", INF, 7), ("flat", 0.1, 5), ("flat", 0.2, 5), ("flat", INF, 10)], "k string, le double, n long")
    got = {r.k: r.q for r in M.hist_quantiles(b, ["k"], {"q": 0.9}).collect()}
    assert got == {"none": 0.0, "endless": 0.0, "flat": 0.2}


def test_counter_that_is_reset(spark):
    rows = spark.createDataFrame([("a", 1, 100), ("a", 2, 130), ("b", 1, 1000), ("b", 2, 12)], "s string, t int, requests long")
    assert {r.s: r.requests_delta for r in M.counter_delta(rows, ["requests"], ["s"], "t").collect()} == {"a": 30, "b": 12}


def test_throttle(spark):
    start = datetime(2024, 1, 1)
    at = [(0, True), (10, True), (70, True), (80, False), (90, False), (95, True)]
    rows = spark.createDataFrame([("x", start + timedelta(minutes=m), f) for m, f in at], "fingerprint string, ts timestamp_ntz, firing boolean")
    got = [r.notify for r in M.alert_throttle(rows, timedelta(hours=1)).orderBy("ts").collect()]
    assert got == [True, False, True, True, False, True]


def test_page_ranges(spark):
    row = spark.range(1).select(
        S.parse_page_range(F.lit("5, 1-3,2,9-7,x,0"), F.lit(6)).alias("a"), S.parse_page_range(F.lit("all"), F.lit(3)).alias("b"), S.page_range_groups(F.lit("3-4,1,x"), F.lit(6)).alias("c"), S.split_equal(F.lit(7), F.lit(3)).alias("d"), S.split_span(F.lit(5), F.lit(2)).alias("e")
    ).first()
    assert row.a == [1, 2, 3, 5] and row.b == [1, 2, 3] and row.c == [[3, 4], [1]] and row.d == [[1, 2, 3], [4, 5], [6, 7]] and row.e == [[1, 2], [3, 4], [5]]


def test_names_and_values(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(S.plan_prices(F.lit("free=0, pro=12,bad,x=y"))) == {"free": 0.0, "pro": 12.0}
    assert one(S.document_name(F.lit("outputs/1/report.pdf"), F.lit("merge-pdf"))) == "report.pdf"
    assert one(S.document_name(F.lit(""), F.lit("merge-pdf"))) == "merge-pdf output"
    assert one(S.ocr_language(F.lit("de"))) == "deu" and one(S.ocr_language(F.lit("xx; rm"))) == "eng"
    assert one(S.format_duration(F.lit(93780))) == "1d 2h 3m"
    assert one(S.compression_ratio(F.lit(200), F.lit(150))) == "25.00%"
    assert one(S.valid_file(F.lit("word-to-pdf"), F.lit("a.DOCX"))) and not one(S.valid_file(F.lit("merge-pdf"), F.lit("a.png")))
    assert one(S.part_numbers(F.lit("1,2,9"), F.lit(3))) is None and one(S.part_numbers(F.lit("1, 3"), F.lit(3))) == [1, 3]
    assert one(S.classify_error(F.lit("context Deadline exceeded"))) == "TIMEOUT"
    assert one(S.quad_area([F.lit(float(v)) for v in (0, 2, 2, 0)], [F.lit(float(v)) for v in (0, 0, 3, 3)])) == 6.0


def test_upsert_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "k int, v string")
    changes = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "k int, v string, at int")
    assert [tuple(r) for r in O.upserted(empty, changes, ["k"], "at").collect()] == [(1, "b")]


def test_repeated_labels_and_plans(spark):
    lines = spark.createDataFrame([('up{a="1",a="2",b="x"} 3',), ("up 4 5 6",)], "value string")
    got = monitoring.samples(lines).collect()
    assert [(r.metric, r.labels, r.value) for r in got] == [("up", {"a": "2", "b": "x"}, 3.0)]


def test_metadata_keeps_the_kinds_of_its_values(spark):
    row = spark.range(1).select(O.merged_metadata(F.lit('{"a":5,"c":{"x":[1,2]}}'), F.lit('{"b":true,"c":null}')).alias("x"), O.merged_metadata(F.lit(None).cast("string"), F.lit('{"b":"y"}')).alias("y")).first()
    assert json.loads(row.x) == {"a": 5, "b": True, "c": None} and json.loads(row.y) == {"b": "y"}


def test_distinct_counts_multiply_no_rows(spark, data):
    for key in ("dau_wau_mau", "funnel", "exec_active_users", "exec_total_users", "mrr"):
        plan = plans.queries()[key](spark, data)._jdf.queryExecution().executedPlan().toString()
        assert "Expand" not in plan and "Window" not in plan and plan.count("FileScan") == 1, key


def test_quads(spark):
    c = lambda *v: [F.lit(float(x)) for x in v]
    square, bow, flat = (c(0, 1, 1, 0), c(0, 0, 1, 1)), (c(0, 1, 0, 1), c(0, 1, 1, 0)), (c(0, 0.5, 1, 0), c(0, 0, 0, 1))
    row = spark.range(1).select(*(f(*q).alias(f"{n}{i}") for n, f in (("c", S.quad_convex), ("u", S.quad_usable)) for i, q in enumerate((square, bow, flat)))).first()
    assert tuple(row) == (True, False, False, True, False, False)
    points = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((9, 9), (0, 1), (10, 0), (1, 8))))
    got = spark.range(1).select(S.ordered_corners(points).alias("q")).first().q
    assert [tuple(got[k]) for k in ("tl", "tr", "br", "bl")] == [(0, 1), (10, 0), (9, 9), (1, 8)]
