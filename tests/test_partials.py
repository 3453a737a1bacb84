"""Daily partials answer as the log does, also after a batch was tried again."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest

from tallywell.functions.expr import Period
from tallywell.operators import analytics as A
from tallywell.operators import partials as P
from tallywell.sources.events import event_log

END = datetime(2024, 1, 31)


@pytest.fixture(scope="module")
def kept(spark, data, tmp_path_factory):
    """Partials of three batches, of which one was written twice."""
    path, log = str(tmp_path_factory.mktemp("partials") / "p"), event_log(spark, data)
    write = P.keep_partials(path)
    for number, share in enumerate(("id % 3 = 0", "id % 3 = 1", "id % 3 = 2")):
        write(log.where(share), number)
    write(log.where("id % 3 = 1"), 1)
    return P.kept_partials(spark, path), log


@pytest.mark.parametrize("now", [END, END - timedelta(hours=7, minutes=3), END - timedelta(days=4, seconds=1)])
def test_active_users(kept, now):
    parts, log = kept
    assert P.dau_wau_mau(parts, log, now).first() == A.dau_wau_mau(log.where(log.created_at < now), now).first()


@pytest.mark.parametrize("p", [Period(END, 30), Period(END - timedelta(hours=5), 7), Period(END - timedelta(hours=5), 0)])
def test_stickiness_and_daily_users(kept, p):
    parts, log = kept
    assert P.stickiness(parts, log, p).first() == A.stickiness(log, p).first()
    want = {r.date: r.dau for r in A.dau_trend(log, p).collect()}
    for rows in (parts, P.compacted(parts)):
        found = {r.date: (r.dau, r.events) for r in P.daily_users(rows, p, log).collect()}
        assert {d: n for d, (n, _) in found.items()} == want
        assert sum(n for _, n in found.values()) == log.where("user_id is not null and not is_guest").where(log.created_at.between(p.since, p.now)).count()


def test_whole_days_do_not_read_the_log(spark, kept):
    parts, log = kept
    p = Period(END, 7)
    plan = P.stickiness(parts, log, p)._jdf.queryExecution().executedPlan().toString()
    assert "events.parquet" not in plan and "Expand" not in plan


def test_ids_of_any_size(spark):
    rows = [(u, False, datetime(2024, 1, 2, 3)) for u in (0, 1, 32_767, 32_768, 32_769, -5, 10**12, 10**12)] + [(None, False, datetime(2024, 1, 2)), (9, True, datetime(2024, 1, 2)), (9, False, None)]
    log = spark.createDataFrame(rows, "user_id bigint, is_guest boolean, created_at timestamp_ntz")
    (r,) = P.daily_users(P.partials(log), Period(datetime(2024, 1, 3), 1), log).collect()
    assert (r.dau, r.events) == (7, 8)
