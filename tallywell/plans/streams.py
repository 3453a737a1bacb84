"""Query keys of what streams keep by key, over tables: the job's state machine, sessions and sliding windows, and daily partials; each with DuckDB SQL of its own."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywell.functions.expr import Period
from tallywell.operators import lifecycle, partials
from tallywell.sources.events import event_log, table
from tallywell.streaming import keyed

NOON = datetime(2024, 1, 30, 12)
PERIOD = Period(NOON, 20)
KINDS = {"click": "JobCreated", "view": "JobStarted", "signup": "JobRetried", "purchase": "JobCompleted", "error": "JobFailed"}


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as those of a job for each user, in any order of kinds: many repeat or are out of turn."""
    kind = F.lit("Unknown")
    for ours, theirs in KINDS.items():
        kind = F.when(F.col("event_type") == ours, theirs).otherwise(kind)
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.when(F.col("user_id") % 17 != 0, F.col("user_id")).alias("job_id"), kind.alias("kind"), F.date_trunc("hour", "ts").alias("at"))


MACHINE = """WITH RECURSIVE e AS (
  SELECT event_id AS id, user_id AS job_id, date_trunc('hour', ts) AS "at", k.kind, k.target, k.sources, row_number() OVER (PARTITION BY user_id ORDER BY date_trunc('hour', ts), event_id) AS n
  FROM events JOIN (VALUES ('click', 'JobCreated', 'queued', ['']), ('view', 'JobStarted', 'processing', ['', 'queued', 'failed']), ('signup', 'JobRetried', 'queued', ['processing']),
    ('purchase', 'JobCompleted', 'completed', ['processing']), ('error', 'JobFailed', 'failed', ['', 'queued', 'processing'])) AS k(event_type, kind, target, sources) USING (event_type) WHERE user_id % 17 <> 0
), m AS (
  SELECT job_id, 0::BIGINT AS n, 0::BIGINT AS id, NULL::VARCHAR AS kind, NULL::TIMESTAMP AS "at", NULL::VARCHAR AS outcome, '' AS state, 0 AS starts FROM e WHERE n = 1
  UNION ALL
  SELECT e.job_id, e.n, e.id, e.kind, e."at", CASE WHEN m.state = e.target THEN 'duplicate' WHEN list_contains(e.sources, m.state) THEN 'applied' ELSE 'out of turn' END,
    CASE WHEN list_contains(e.sources, m.state) THEN e.target ELSE m.state END, m.starts + CASE WHEN e.kind = 'JobStarted' AND list_contains(e.sources, m.state) THEN 1 ELSE 0 END
  FROM m JOIN e ON e.job_id = m.job_id AND e.n = m.n + 1
), o AS (SELECT *, CAST(CASE state WHEN 'processing' THEN 20 WHEN 'completed' THEN 100 ELSE 0 END AS INTEGER) AS progress FROM m WHERE n > 0)"""

SPELLS = """WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 18 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)
), g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, new DESC ROWS UNBOUNDED PRECEDING) AS spell FROM s)
SELECT user_id, min(ts) AS first_at, max(ts) AS last_at, count(*) AS events FROM g GROUP BY user_id, spell"""

#: u: registered users' events; questions end at noon, so a part of two days comes from the log.
U = """WITH u AS (SELECT user_id, ts FROM events WHERE user_id % 10 <> 0 AND ts < TIMESTAMP '2024-01-30 12:00:00')"""


def kept(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Partials of two halves of the log, as batches of a stream leave them, and the log."""
    log = event_log(spark, sf_dir)
    return partials.partials(log.where("id % 2 = 0")).unionByName(partials.partials(log.where("id % 2 = 1"))), log


KEYS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "job_machine": (lambda s, d: lifecycle.job_machine(job_events(s, d)), f'{MACHINE} SELECT job_id, id, kind, "at", outcome, state, progress, CAST(starts AS INTEGER) AS starts FROM o'),
    "job_machine_states": (
        lambda s, d: lifecycle.last_states(lifecycle.job_machine(job_events(s, d))),
        f"""{MACHINE} SELECT job_id, arg_max(state, n) AS state, arg_max(progress, n) AS progress, CAST(arg_max(starts, n) AS INTEGER) AS starts,
  count(*) FILTER (WHERE outcome = 'applied') AS applied, count(*) FILTER (WHERE outcome = 'duplicate') AS duplicates, count(*) FILTER (WHERE outcome = 'out of turn') AS out_of_turn FROM o GROUP BY job_id""",
    ),
    "st_sessions": (lambda s, d: keyed.sessions(table(s, d, "events"), "18 hours", at="ts"), SPELLS),
    "st_sliding": (
        lambda s, d: keyed.windowed(table(s, d, "events"), "6 hours", "2 hours", at="ts", also={"most": F.max("value")}),
        """WITH w AS (SELECT event_type, value, time_bucket(INTERVAL 2 HOUR, ts) - to_hours(2 * i) AS start FROM events, (VALUES (0), (1), (2)) AS n(i))
SELECT start, start + INTERVAL 6 HOUR AS "end", event_type, count(*) AS count, max(value) AS most FROM w GROUP BY start, event_type""",
    ),
    "cached_dau_wau_mau": (
        lambda s, d: partials.dau_wau_mau(*kept(s, d), NOON),
        f"""{U} SELECT count(DISTINCT user_id) FILTER (WHERE ts >= TIMESTAMP '2024-01-30') AS dau, count(DISTINCT user_id) FILTER (WHERE ts >= TIMESTAMP '2024-01-23 12:00:00') AS wau,
  count(DISTINCT user_id) FILTER (WHERE ts >= TIMESTAMP '2023-12-31 12:00:00') AS mau FROM u""",
    ),
    "cached_daily_users": (
        lambda s, d: (lambda parts, log: partials.daily_users(parts, PERIOD, log))(*kept(s, d)),
        f"{U} SELECT CAST(ts AS DATE) AS date, count(DISTINCT user_id) AS dau, count(*) AS events FROM u WHERE ts >= TIMESTAMP '2024-01-10 12:00:00' GROUP BY 1",
    ),
    "cached_stickiness": (
        lambda s, d: partials.stickiness(*kept(s, d), PERIOD),
        f"""{U}, d AS (SELECT CAST(ts AS DATE) AS date, user_id FROM u WHERE ts >= TIMESTAMP '2024-01-10 12:00:00')
SELECT round(count(DISTINCT (date, user_id)) / (count(DISTINCT date) * count(DISTINCT user_id)), 6) AS stickiness FROM d""",
    ),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: run for k, (run, _) in KEYS.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in KEYS.items()}
