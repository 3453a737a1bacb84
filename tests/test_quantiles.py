"""Exact quantiles by ranks, and plans without a buffer or a multiplied row for each distinct count."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pytest

from tallywell import plans
from tallywell.functions.expr import Period
from tallywell.operators import analytics as A
from tallywell.operators.quantiles import by_ranks

START = datetime(2024, 1, 1)


def plan_of(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("bits", [0, 3, 20])
def test_quantiles_equal_those_of_sorted_values(spark, bits):
    rng = np.random.default_rng(3)
    groups = {"a": rng.integers(-(10**9), 10**9, 501), "b": rng.integers(-5, 5, 400), "c": np.array([7]), "d": np.array([1, 2]), "e": np.full(1000, -3), None: np.arange(4)}
    shares = (0.0, 0.25, 0.5, 0.95, 1.0)
    rows = spark.createDataFrame([(g, int(v)) for g, vs in groups.items() for v in vs] + [("a", None), ("none", None)], "g string, v bigint")
    found = {r.g: r for r in by_ranks(rows, "v", shares, ["g"], bits).collect()}
    assert found.keys() == groups.keys()
    for g, vs in groups.items():
        assert (found[g].n, found[g].total) == (len(vs), vs.sum())
        assert np.allclose([found[g][f"q{i}"] for i in range(len(shares))], np.quantile(vs, shares), rtol=0, atol=1e-6)


def test_quantiles_of_nothing(spark):
    rows = spark.createDataFrame([], "g string, v bigint")
    assert by_ranks(rows, "v", (0.5,), ["g"]).collect() == []
    assert [tuple(r) for r in by_ranks(rows, "v", (0.5,)).collect()] == [(0, None, None)]


def test_no_percentile_and_no_expand(spark, data):
    for key in ("processing_time", "processing_time_trend", "processing_time_within", "stickiness", "activation"):
        plan = plan_of(plans.queries()[key](spark, data))
        assert "percentile" not in plan and "Expand" not in plan, key


def test_a_value_of_each_row_is_counted_before_it_is_shuffled(spark):
    plan = plan_of(by_ranks(spark.range(100).selectExpr("id % 3 AS v"), "v", (0.5,)))
    assert "partial_count" in plan and "SinglePartition" in plan  # the windows of the buckets, not the rows


def test_bounded_completions_prune_days(spark, tmp_path):
    rows = [(i, kind, 7 * i, START + timedelta(days=d, hours=i)) for i in range(3) for kind, d in (("job.created", 10), ("job.completed", 10 + i), ("job.completed", 300))]
    log = spark.createDataFrame(rows, "id int, event_type string, job_id int, created_at timestamp_ntz").selectExpr("*", "to_date(created_at) AS event_date")
    log.write.partitionBy("event_date").parquet(str(tmp_path / "log"))
    p = Period(START + timedelta(days=20), 20)
    log = spark.read.parquet(str(tmp_path / "log"))
    own = A.durations(log, p, timedelta(days=1))
    assert sorted(r.us for r in own.collect()) == [0, 86_400_000_000]
    assert len(A.durations(log, p).collect()) == 6
    assert plan_of(own).split("Initial Plan")[0].count("PartitionFilters: [isnotnull(event_date") == 2  # both scans are bounded


def test_stickiness_over_more_days_than_a_word_has_bits(spark):
    rows = [(u, False, START + timedelta(days=d)) for u, days in ((1, range(0, 150, 3)), (2, (1, 149)), (3, (60, 61, 120))) for d in days] + [(None, False, START), (4, True, START)]
    log = spark.createDataFrame(rows, "user_id int, is_guest boolean, created_at timestamp_ntz")
    (r,) = A.stickiness(log, Period(START + timedelta(days=150), 150)).collect()
    days = {d for ds in (range(0, 150, 3), (1, 149), (60, 61, 120)) for d in ds}
    assert r.stickiness == round((50 + 2 + 3) / (len(days) * 3), 6)


def test_retention_after_the_end_and_over_many_words(spark):
    day = lambda d, h=1: START + timedelta(days=d, hours=h)
    rows = [(1, "user.signup", False, day(0)), (1, "user.login", False, day(1)), (1, "x", False, day(30)), (2, "user.signup", False, day(99)), (2, "user.signup", False, day(80, 23)), (2, "x", False, day(81)), (2, "x", False, day(110)), (2, "x", True, day(87))]
    rows += [(3, "user.signup", True, day(99)), (3, "x", False, day(106)), (3, "x", False, day(129)), (4, "x", False, day(50)), (4, "user.signup", False, day(100)), (None, "user.signup", False, day(5)), (5, "user.signup", None, day(99)), (5, "x", None, day(100))]
    log = spark.createDataFrame(rows, "user_id int, event_type string, is_guest boolean, created_at timestamp_ntz")
    found = {r.cohort_date.toordinal() - START.toordinal(): tuple(r)[1:] for r in A.retention_cohorts(log, Period(day(100, 0), 100)).collect()}
    assert found == {0: (1, 1, 0, 1), 80: (1, 1, 0, 1), 99: (2, 0, 1, 1)}
    assert "collect_set" not in plan_of(A.retention_cohorts(log, Period(day(100, 0), 100)))
