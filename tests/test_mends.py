"""Rows with nulls, repeated keys, ties and clashing names that were lost or stopped a job before."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

import duckdb
from pyspark.sql import functions as F

from tallywell.operators import jobs as B
from tallywell.operators import metrics as M
from tallywell.operators import store as O

START = datetime(2024, 1, 1)


def at(n):
    return START + timedelta(seconds=n)


def test_files_without_a_kind_stay(spark):
    files = spark.createDataFrame([(1, None, "p"), (1, "output", "q"), (2, "input", "r"), (2, "output", "s"), (None, "output", "t")], "job_id int, kind string, path string")
    outputs = spark.createDataFrame([(1, "new"), (2, ""), (3, None)], "job_id int, path string")
    found = {tuple(r) for r in O.replaced_outputs(files, outputs).collect()}
    assert found == {(1, None, "p"), (1, "output", "new"), (2, "input", "r"), (2, "output", "s"), (None, "output", "t")}


def test_metadata_with_repeated_keys(spark):
    rows = spark.createDataFrame([('{"a":1,"a":2,"b":3}', '{"b":4,"b":{"c":null},"d":1}'), (None, '{"a":1,"a":2}'), ('{"x":1,"x":[2]}', None), ("[1]", "no json"), ("{}", "{}")], "o string, n string")
    found = [json.loads(r.m) for r in rows.select(O.merged_metadata(F.col("o"), F.col("n")).alias("m")).collect()]
    assert found == [{"a": 2, "b": {"c": None}, "d": 1}, {"a": 2}, {"x": [2]}, {}, {}]


def test_breaker_with_nulls_and_taken_names(spark):
    rows = spark.createDataFrame([("s", None, True, "x", 1)] + [("s", at(i), None, "x", 1) for i in range(6)] + [(None, at(0), False, None, None)], "service string, ts timestamp_ntz, ok boolean, state string, Allowed int")
    found = B.circuit_breaker(rows).collect()
    assert B.circuit_breaker(rows).columns == ["service", "ts", "ok", "state", "Allowed", "state_", "allowed_"]
    assert [(r.state_, r.allowed_) for r in sorted(found, key=lambda r: (r.service or "", r.ts is not None, r.ts or START))] == [("closed", True), (None, None)] + [("closed", True)] * 5 + [("open", False)]


def test_throttle_with_nulls_and_a_taken_name(spark):
    rows = spark.createDataFrame([("k", None, True, 9), ("k", at(0), True, 9), ("k", at(5), True, 9), ("k", at(6), None, 9), ("k", at(7), False, 9), (None, at(0), True, 9)], "fingerprint string, ts timestamp_ntz, firing boolean, notify int")
    found = M.alert_throttle(rows, timedelta(seconds=60))
    assert found.columns[-1] == "notify_"
    assert [r.notify_ for r in sorted(found.collect(), key=lambda r: (r.fingerprint or "", r.ts is not None, r.ts or START))] == [True, False, True, False, True, False]


def test_retention_of_messages_without_a_time(spark):
    rows = spark.createDataFrame([("free", None, 1, 5), ("free", at(0), 2, 5), ("aged", None, 3, 5), ("aged", at(9), 4, 5), ("full", None, 5, 5), ("full", at(9), 6, 8), (None, None, 7, None)], "stream string, at timestamp_ntz, seq int, bytes bigint")
    limits = {"aged": (60, 1000, None), "full": (10**6, 10, None)}
    assert sorted(r.seq for r in B.retained(rows, at(10), limits).collect()) == [1, 2, 4, 6, 7]


def test_hints_at_the_same_time_have_one_winner(spark):
    docs = spark.createDataFrame([(1, "u"), (2, "u")], "source_job_id int, user_id string")
    hints = [(1, "u", o, at(5)) for o in (3, 9, 4)] + [(2, "u", 1, None), (2, "u", None, at(1))]
    for order in (hints, hints[::-1]):
        found = B.filed(docs, spark.createDataFrame(order, "job_id int, user_id string, organization_id int, at timestamp_ntz"))
        assert {r.source_job_id: r.organization_id for r in found.collect()} == {1: 9, 2: None}


def test_dead_letters_are_put_back_once(spark, tmp_path):
    rows = [(i, "organize-pdf" if i % 3 else "analytics", f"p{i}") for i in range(1, 13)] + [(13, None, "x")]
    letters = spark.createDataFrame(rows[::-1], "seq int, service string, payload string")
    for _ in range(2):  # tried again, it changes nothing
        assert O.put_back(letters, str(tmp_path / "d"), 7) == {"redriven": 5, "skipped": 2}
        assert sorted(r.seq for r in spark.read.parquet(str(tmp_path / "d")).collect()) == [1, 2, 4, 5, 7]
    left = O.letters_left(letters, 7)
    assert sorted(r.seq for r in left.collect()) == [3, 6, 8, 9, 10, 11, 12, 13]
    assert O.put_back(left.where("seq in (3, 6, 13)"), str(tmp_path / "d"), 0) == {"redriven": 0, "skipped": 3}
    assert O.put_back(letters.limit(0), str(tmp_path / "e")) == {"redriven": 0, "skipped": 0}


def test_arguments(spark):
    from tallywell.functions.arguments import count_argument, count_column

    given = {"7": 7, "007": 7, "0": 50, "": 50, None: 50, "-3": 50, "+3": 50, "3.0": 50, " 3": 50, "3\n": 50, "\u0663": 50, "999": 200, "2147483647": 200, "2147483648": 50, "9" * 40: 50}
    assert {t: count_argument({"n": t} if t is not None else {}, "n", 50, 200) for t in given} == given
    rows = spark.createDataFrame([(t,) for t in given], "t string").select("t", count_column(F.col("t"), 50, 200).alias("n")).collect()
    assert {r.t: r.n for r in rows} == given


def test_the_last_of_many_entries_with_a_key(spark):
    """In the order they came, also thousands of them."""
    from tallywell.functions.scalars import last_of_each, plan_prices

    rows = [[("b", 1), ("a", 2), ("b", 3), ("c", 4), ("a", 5)], [], None, [(None, 1), ("x", 2), (None, 3)], [(f"k{i % 1000}", i) for i in range(20_000)]]
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, e array<struct<key:string,value:int>>")
    found = {r.i: r.e and [tuple(x) for x in r.e] for r in frame.select("i", last_of_each(F.col("e")).alias("e")).collect()}
    assert found == {0: [("b", 3), ("c", 4), ("a", 5)], 1: [], 2: None, 3: [("x", 2), (None, 3)], 4: [(f"k{i}", 19_000 + i) for i in range(1000)]}
    text = ",".join(f"p{i % 700}={i}" for i in range(7000))
    (prices,) = spark.range(1).select(plan_prices(F.lit(text))).first()
    assert prices == {f"p{i}": 6300.0 + i for i in range(700)}


def many_documents(spark):
    docs = spark.range(50_003).selectExpr("id", "concat('d', id, '.pdf') AS name", "id AS file_size", "'ready' AS status", "timestamp_ntz '2024-01-01 00:00:00' AS created_at")
    return docs, spark.createDataFrame([(0, "b"), (0, "a"), (50_002, "c")], "document_id bigint, tag string")


def test_csv_export_is_whole(spark):
    docs, tags = many_documents(spark)
    out = O.export_csv(docs, tags)
    assert out.count() == 50_003 and {r.Name: r.Tags for r in out.where("Tags <> ''").collect()} == {"d0.pdf": "a; b", "d50002.pdf": "c"}
    assert [r.Name for r in O.export_csv(docs, tags, 2).orderBy("Name").collect()] == ["d50001.pdf", "d50002.pdf"]


def test_json_export_is_whole(spark):
    docs, tags = many_documents(spark)
    out = O.export_json(docs, tags)
    assert out.count() == 50_003 and len([r for r in out.where("json NOT LIKE '%\"tags\":[]%'").collect()]) == 2
    assert O.export_json(docs, tags, 2).count() == 2


def test_exports_of_rows_with_missing_values(spark, tmp_path):
    """As their SQL has them: a JSON object names its missing values, and a document without an id has a file type."""
    import pyarrow as pa
    import pyarrow.parquet as pq
    from oracle import same

    from tallywell.plans import store

    made = {
        "documents": {"doc_id": pa.array([4, 5, None, 11, 7], pa.int64()), "text": ["a", None, "c", "d", "e"], "lang": ["en"] * 5, "source": ["s", None, "s", "s", "s"], "n_chars": pa.array([1, None, 1, 1, None], pa.int64())},
        "labels": {"doc_id": pa.array([4, 5, 5, None, 9], pa.int64()), "quality": pa.array([1, None, 1, 1, 1], pa.int64()), "toxic": pa.array([1, 1, None, 0, 1], pa.int64())},
    }
    con = duckdb.connect()
    for name, columns in made.items():
        pq.write_table(pa.table(columns), str(tmp_path / f"{name}.parquet"))
        con.register(name, pa.table(columns))
    for key in ("sink_export_json", "sink_export_csv"):
        assert same(store.queries()[key](spark, str(tmp_path)), con, store.oracle_sql()[key]) == 4
