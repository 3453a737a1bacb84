"""Query keys of the product analytics, each with DuckDB SQL that says the same independently."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession

from tallywell.functions.expr import Period
from tallywell.operators import analytics as A
from tallywell.sources.events import event_log

#: The last moment of the test data's last full day; the clock of every query here.
AS_OF = datetime(2024, 1, 30, 23, 59, 59)
MONTH, WEEK = Period(AS_OF, 30), Period(AS_OF, 7)
USER = 7

NOW, SINCE, PREV = (f"TIMESTAMP '{t}'" for t in (AS_OF, MONTH.since, MONTH.previous))
W_SINCE, W_PREV = (f"TIMESTAMP '{t}'" for t in (WEEK.since, WEEK.previous))

AE = r"""
WITH raw AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
ae AS (
  SELECT event_id AS id,
    CASE event_type WHEN 'signup' THEN 'user.signup' WHEN 'click' THEN 'job.created' WHEN 'purchase' THEN 'job.completed' WHEN 'error' THEN 'job.failed'
      WHEN 'view' THEN CASE WHEN k < 60 THEN 'user.login' WHEN k < 80 THEN 'plan.changed' ELSE 'plan.limit_hit' END END AS event_type,
    CASE WHEN user_id % 10 = 0 THEN NULL ELSE user_id END AS user_id,
    CASE WHEN event_type IN ('click', 'purchase', 'error') THEN user_id * 100 + k END AS job_id,
    user_id % 10 = 0 AND event_type IN ('click', 'view') AS is_guest,
    CASE WHEN event_type IN ('click', 'purchase', 'error') THEN CASE k % 5 WHEN 0 THEN 'merge-pdf' WHEN 1 THEN 'split-pdf' WHEN 2 THEN 'compress-pdf' WHEN 3 THEN 'ocr-pdf' ELSE 'pdf-to-word' END ELSE '' END AS tool_type,
    CASE WHEN event_type = 'signup' OR (event_type = 'view' AND k < 80) THEN CASE WHEN k % 3 = 0 THEN 'pro' ELSE 'free' END ELSE '' END AS plan_name,
    CASE WHEN event_type IN ('click', 'purchase') THEN CAST(floor(value * 131072) AS BIGINT) ELSE 0 END AS file_size,
    CASE WHEN event_type = 'signup' THEN CASE k % 7 WHEN 0 THEN NULL WHEN 1 THEN '{"utmSource":"newsletter","utmMedium":"cpc","referrer":""}' WHEN 2 THEN '{"utmSource":"newsletter"}'
        WHEN 3 THEN '{"referrer":""}' WHEN 4 THEN '{"referrer":"https://www.Google.com/"}' WHEN 5 THEN '{"referrer":"https://blog.example.org/"}' ELSE '{"other":1}' END
      WHEN event_type = 'error' THEN CASE k % 6 WHEN 0 THEN '{"failureReason":"[TIMEOUT] took too long"}' WHEN 1 THEN '{"failureReason":"[INVALID_PAYLOAD] bad options"}'
        WHEN 2 THEN '{"failureReason":"[CONVERSION_FAILED] exit status 1"}' WHEN 3 THEN '{"failureReason":"[OUTPUT_FAILED] no space"}' WHEN 4 THEN '{"failureReason":"something went wrong"}' END
      WHEN event_type = 'view' AND k >= 60 AND k < 80 THEN CASE WHEN k % 3 = 0 THEN '{"oldPlan":"free","newPlan":"pro"}' ELSE '{"oldPlan":"pro","newPlan":"free"}' END END AS metadata,
    ts AS created_at, ts + to_microseconds(k * 10000) AS persisted_at
  FROM raw
)
"""
REG = "user_id IS NOT NULL AND NOT is_guest"
IN = f"created_at >= {SINCE} AND created_at < {NOW}"
W_IN = f"created_at >= {W_SINCE} AND created_at < {NOW}"
TODAY = "created_at >= TIMESTAMP '2024-01-30' AND created_at < TIMESTAMP '2024-01-31'"
CNT = lambda kind, name: f"count(*) FILTER (WHERE event_type = '{kind}') AS {name}"
DAU = f"count(DISTINCT user_id) FILTER (WHERE {REG})"
DAY_COUNTERS = ", ".join(
    [CNT("user.signup", "signups"), CNT("user.login", "logins"), CNT("job.created", "jobs_created"), CNT("job.completed", "jobs_completed"), CNT("job.failed", "jobs_failed"), f"{DAU} AS dau", "count(DISTINCT coalesce(job_id, id)) FILTER (WHERE is_guest) AS guest_sessions"]
)
TOOLS = f"SELECT tool_type, {CNT('job.created', 'count')}, {CNT('job.completed', 'completed')}, {CNT('job.failed', 'failed')} FROM ae WHERE event_type IN ('job.created', 'job.completed', 'job.failed') AND tool_type <> ''"
CHANNEL = r"""CASE
  WHEN metadata IS NULL OR NOT (list_contains(json_keys(metadata), 'referrer') OR list_contains(json_keys(metadata), 'utmSource')) THEN 'unknown'
  WHEN coalesce(json_extract_string(metadata, '$.utmMedium'), '') IN ('cpc', 'ppc', 'paid', 'display', 'paid_social') THEN 'paid'
  WHEN coalesce(json_extract_string(metadata, '$.utmSource'), '') <> '' THEN 'campaign'
  WHEN coalesce(json_extract_string(metadata, '$.referrer'), '') = '' THEN 'direct'
  WHEN regexp_matches(json_extract_string(metadata, '$.referrer'), '(?i)(google|bing|duckduckgo|yahoo)\.') THEN 'organic'
  ELSE 'referral' END"""
DURATIONS = f"""d AS (
  SELECT c.created_at, epoch_us(f.created_at) - epoch_us(c.created_at) AS us FROM ae c JOIN ae f ON f.job_id = c.job_id
  WHERE c.event_type = 'job.created' AND f.event_type = 'job.completed' AND c.created_at >= {SINCE} AND c.created_at < {NOW}
)"""
WITHIN = f"{DURATIONS}, w AS (SELECT * FROM d WHERE us BETWEEN 0 AND 172800000000)"
EXEC_DAILY = f"""x AS (
  SELECT CAST(created_at AS DATE) AS date, {CNT("user.signup", "signups")}, {CNT("job.created", "jobs_created")}, {CNT("job.completed", "jobs_completed")}, {CNT("job.failed", "jobs_failed")}, {DAU} AS dau
  FROM ae WHERE created_at >= {W_PREV} AND created_at < {NOW} GROUP BY 1
)"""
PLAN_AT = "SELECT plan_name, count(*) AS users FROM (SELECT DISTINCT ON (user_id) user_id, plan_name FROM ae WHERE {reg} AND plan_name <> '' AND created_at < {t} ORDER BY user_id, created_at DESC, id DESC) GROUP BY plan_name"
PRICE = "CASE WHEN {c} = 'pro' THEN 12.0::DOUBLE ELSE 0.0::DOUBLE END"
CHANGES = f"SELECT CAST(created_at AS DATE) AS date, json_extract_string(metadata, '$.oldPlan') AS old_plan, json_extract_string(metadata, '$.newPlan') AS new_plan, count(*) AS count FROM ae WHERE event_type = 'plan.changed' AND {IN} GROUP BY ALL"

Run = Callable[[DataFrame], DataFrame]

KEYS: dict[str, tuple[Run, str]] = {
    "retention_cohorts": (
        lambda e: A.retention_cohorts(e, MONTH),
        f""", c AS (SELECT user_id, CAST(min(created_at) AS DATE) AS d FROM ae WHERE event_type = 'user.signup' AND user_id IS NOT NULL AND {IN} GROUP BY user_id),
a AS (SELECT DISTINCT user_id, CAST(created_at AS DATE) AS d FROM ae WHERE {REG} AND created_at >= {SINCE})
SELECT c.d AS cohort_date, count(DISTINCT c.user_id) AS cohort_size, count(DISTINCT CASE WHEN a.d = c.d + 1 THEN c.user_id END) AS d1,
  count(DISTINCT CASE WHEN a.d = c.d + 7 THEN c.user_id END) AS d7, count(DISTINCT CASE WHEN a.d = c.d + 30 THEN c.user_id END) AS d30
FROM c LEFT JOIN a ON a.user_id = c.user_id GROUP BY c.d""",
    ),
    "fixture_events": (lambda e: e, "SELECT * FROM ae"),
    "overview_today": (lambda e: A.overview_today(e, AS_OF), f"SELECT DATE '2024-01-30' AS date, {DAY_COUNTERS}, {CNT('plan.limit_hit', 'plan_limit_hits')} FROM ae WHERE {TODAY}"),
    "admin_dashboard_today": (lambda e: A.admin_dashboard_today(e, AS_OF), f"SELECT {DAY_COUNTERS} FROM ae WHERE {TODAY}"),
    "daily_counts": (
        lambda e: A.daily_counts(e, datetime(2024, 1, 1), datetime(2024, 1, 30)),
        "SELECT CAST(created_at AS DATE) AS date, event_type, count(*) AS count FROM ae WHERE created_at >= TIMESTAMP '2024-01-01' AND created_at < TIMESTAMP '2024-01-31' GROUP BY 1, 2",
    ),
    "tool_usage": (lambda e: A.tool_usage(e, MONTH), f"{TOOLS} AND {IN} GROUP BY tool_type"),
    "admin_tools_top10": (lambda e: A.admin_tools_top10(e, MONTH), f"{TOOLS} AND {IN} GROUP BY tool_type ORDER BY count DESC, tool_type LIMIT 10"),
    "user_growth": (lambda e: A.user_growth(e, MONTH), f"SELECT CAST(created_at AS DATE) AS date, {CNT('user.signup', 'signups')}, {DAU} AS dau FROM ae WHERE {IN} GROUP BY 1"),
    "plan_distribution": (
        lambda e: A.plan_distribution(e, MONTH),
        f"SELECT plan_name, count(DISTINCT user_id) AS users, {CNT('job.created', 'jobs')}, {CNT('plan.limit_hit', 'limit_hits')} FROM ae WHERE plan_name <> '' AND {IN} GROUP BY plan_name",
    ),
    "admin_plan_mix": (lambda e: A.admin_plan_mix(e, MONTH), f"SELECT plan_name, count(DISTINCT user_id) AS users, {CNT('job.created', 'jobs')} FROM ae WHERE plan_name <> '' AND {IN} GROUP BY plan_name"),
    "realtime_hour": (lambda e: A.realtime_hour(e, AS_OF), f"SELECT event_type, count(*) AS count FROM ae WHERE created_at >= {NOW} - INTERVAL 1 HOUR GROUP BY event_type"),
    "events_by_type_1h": (lambda e: A.realtime_hour(e, AS_OF), f"SELECT event_type, count(*) AS count FROM ae WHERE created_at >= {NOW} - INTERVAL 1 HOUR GROUP BY event_type ORDER BY count DESC"),
    "admin_total_users": (lambda e: A.admin_total_users(e, MONTH), f"SELECT {DAU} AS total_users FROM ae WHERE {IN}"),
    "user_dash_counts": (
        lambda e: A.user_dash_counts(e, USER),
        f"SELECT {CNT('job.created', 'created')}, {CNT('job.completed', 'completed')}, {CNT('job.failed', 'failed')} FROM ae WHERE user_id = {USER}",
    ),
    "user_dash_bytes": (lambda e: A.user_dash_bytes(e, USER), f"SELECT CAST(coalesce(sum(file_size), 0) AS BIGINT) AS bytes FROM ae WHERE user_id = {USER}"),
    "user_dash_tools": (lambda e: A.user_dash_tools(e, USER, MONTH), f"{TOOLS} AND {IN} AND user_id = {USER} GROUP BY tool_type"),
    "user_dash_activity": (lambda e: A.user_dash_activity(e, USER, MONTH), f"SELECT CAST(created_at AS DATE) AS date, count(*) AS count FROM ae WHERE user_id = {USER} AND {IN} GROUP BY 1"),
    "user_dash_plan": (lambda e: A.user_dash_plan(e, USER), f"SELECT plan_name FROM ae WHERE user_id = {USER} AND plan_name <> '' ORDER BY created_at DESC, id DESC LIMIT 1"),
    "user_dash_member_since": (lambda e: A.user_dash_member_since(e, USER), f"SELECT min(created_at) AS member_since FROM ae WHERE user_id = {USER}"),
    "signups_daily": (lambda e: A.signups_daily(e, MONTH), f"SELECT CAST(created_at AS DATE) AS date, count(*) AS signups FROM ae WHERE event_type = 'user.signup' AND {IN} GROUP BY 1"),
    "signups_total": (lambda e: A.signups_total(e, MONTH), f"SELECT count(*) AS signups FROM ae WHERE event_type = 'user.signup' AND {IN}"),
    "plan_users_daily": (lambda e: A.plan_users_daily(e, MONTH), f"SELECT CAST(created_at AS DATE) AS date, plan_name, count(DISTINCT user_id) AS users FROM ae WHERE plan_name <> '' AND {IN} GROUP BY 1, 2"),
    "plan_changes_daily": (lambda e: A.plan_changes_daily(e, MONTH), CHANGES),
    "conversion_rate": (
        lambda e: A.conversion_rate(e, MONTH),
        f""", t AS (SELECT {CNT("plan.changed", "total_changes")}, count(*) FILTER (WHERE event_type = 'plan.changed' AND json_extract_string(metadata, '$.oldPlan') = 'free') AS free_upgrades, {CNT("user.signup", "n")} FROM ae WHERE {IN})
SELECT total_changes, free_upgrades, round(CASE WHEN n > 0 THEN free_upgrades / n ELSE 0 END, 6) AS conversion_rate FROM t""",
    ),
    "churn": (
        lambda e: A.churn(e, datetime(2024, 1, 30), datetime(2024, 1, 31), 28),
        f""", t AS (SELECT count(DISTINCT user_id) AS n, count(DISTINCT user_id) FILTER (WHERE user_id NOT IN (SELECT user_id FROM ae WHERE {REG} AND created_at >= TIMESTAMP '2024-01-30' AND created_at < TIMESTAMP '2024-01-31')) AS churned
  FROM ae WHERE {REG} AND created_at >= TIMESTAMP '2024-01-02' AND created_at < TIMESTAMP '2024-01-30')
SELECT churned AS churned_users, n AS previous_active, round(CASE WHEN n > 0 THEN churned / n ELSE 0 END, 6) AS churn_rate FROM t""",
    ),
    "dau_trend": (lambda e: A.dau_trend(e, MONTH), f"SELECT CAST(created_at AS DATE) AS date, count(DISTINCT user_id) AS dau FROM ae WHERE {REG} AND {IN} GROUP BY 1"),
    "dau_wau_mau": (
        lambda e: A.dau_wau_mau(e, AS_OF),
        f"SELECT count(DISTINCT user_id) FILTER (WHERE created_at >= TIMESTAMP '2024-01-30') AS dau, count(DISTINCT user_id) FILTER (WHERE created_at >= {W_SINCE}) AS wau, count(DISTINCT user_id) FILTER (WHERE created_at >= {SINCE}) AS mau FROM ae WHERE {REG}",
    ),
    "stickiness": (
        lambda e: A.stickiness(e, MONTH),
        f""", d AS (SELECT CAST(created_at AS DATE) AS date, count(DISTINCT user_id) AS dau FROM ae WHERE {REG} AND {IN} GROUP BY 1), m AS (SELECT count(DISTINCT user_id) AS mau FROM ae WHERE {REG} AND {IN})
SELECT round(CASE WHEN max(mau) > 0 THEN avg(dau) / max(mau) ELSE 0 END, 6) AS stickiness FROM d, m""",
    ),
    "activation": (
        lambda e: A.activation(e, WEEK),
        f""", t AS (SELECT count(DISTINCT s.user_id) AS total_signups, count(DISTINCT j.user_id) AS activated FROM ae s
  LEFT JOIN ae j ON j.user_id = s.user_id AND j.event_type = 'job.created' AND j.created_at >= s.created_at AND j.created_at <= s.created_at + INTERVAL 24 HOURS
  WHERE s.event_type = 'user.signup' AND s.created_at >= {W_SINCE} AND s.created_at < {NOW} AND s.user_id IS NOT NULL)
SELECT total_signups, activated, round(CASE WHEN total_signups > 0 THEN activated / total_signups ELSE 0 END, 6) AS activation_rate FROM t""",
    ),
    "funnel": (
        lambda e: A.funnel(e, MONTH),
        f"SELECT count(DISTINCT CASE WHEN event_type = 'user.signup' THEN user_id END) AS signed_up, count(DISTINCT CASE WHEN event_type = 'job.created' THEN user_id END) AS created_job, count(DISTINCT CASE WHEN event_type = 'job.completed' THEN user_id END) AS completed_job FROM ae WHERE user_id IS NOT NULL AND {IN}",
    ),
    "repeat_users": (
        lambda e: A.repeat_users(e, MONTH),
        f"SELECT count(*) AS repeat_users FROM (SELECT user_id FROM ae WHERE event_type = 'job.completed' AND user_id IS NOT NULL AND {IN} GROUP BY user_id HAVING count(*) >= 2)",
    ),
    "exec_daily": (lambda e: A.exec_daily(e, WEEK), f", {EXEC_DAILY} SELECT * FROM x"),
    "exec_period_totals": (
        lambda e: A.exec_period_totals(e, WEEK),
        f", {EXEC_DAILY} SELECT "
        + ", ".join(
            f"CAST(coalesce(sum({c}) FILTER (WHERE date {op} CAST({W_SINCE} AS DATE)), 0) AS BIGINT) AS {p}_{n}"
            for p, op in (("cur", ">="), ("prev", "<"))
            for n, c in (("signups", "signups"), ("jobs", "jobs_created"), ("completed", "jobs_completed"), ("failed", "jobs_failed"))
        )
        + " FROM x",
    ),
    "exec_success_spark": (
        lambda e: A.exec_success_spark(e, WEEK),
        f", {EXEC_DAILY} SELECT date, round(CASE WHEN jobs_completed + jobs_failed > 0 THEN jobs_completed / (jobs_completed + jobs_failed) ELSE 0 END, 6) AS success_rate FROM x WHERE date >= CAST({W_SINCE} AS DATE)",
    ),
    "exec_active_users": (
        lambda e: A.exec_active_users(e, WEEK),
        f"SELECT count(DISTINCT user_id) FILTER (WHERE created_at >= {W_SINCE} AND created_at < {NOW}) AS current, count(DISTINCT user_id) FILTER (WHERE created_at >= {W_PREV} AND created_at < {W_SINCE}) AS previous FROM ae WHERE {REG}",
    ),
    "exec_total_users": (
        lambda e: A.exec_total_users(e, WEEK),
        f"SELECT count(DISTINCT user_id) FILTER (WHERE created_at < {NOW}) AS current, count(DISTINCT user_id) FILTER (WHERE created_at < {W_SINCE}) AS previous FROM ae WHERE event_type = 'user.signup'",
    ),
    "exec_total_spark": (
        lambda e: A.exec_total_spark(e, WEEK),
        f""", {EXEC_DAILY}, b AS (SELECT count(DISTINCT user_id) AS n FROM ae WHERE event_type = 'user.signup' AND created_at < {W_SINCE})
SELECT date, CAST(sum(signups) OVER (ORDER BY date) + n AS BIGINT) AS total_users FROM x, b WHERE date >= CAST({W_SINCE} AS DATE)""",
    ),
    "tool_trend_daily": (lambda e: A.tool_trend_daily(e, MONTH), f"SELECT CAST(created_at AS DATE) AS date, tool_type, count(*) AS count FROM ae WHERE event_type = 'job.created' AND tool_type <> '' AND {IN} GROUP BY 1, 2"),
    "jobs_per_user": (
        lambda e: A.jobs_per_user(e, MONTH),
        f"SELECT round(coalesce(avg(n), 0), 6) AS average, round(coalesce(quantile_cont(n, 0.5), 0), 6) AS median FROM (SELECT user_id, count(*) AS n FROM ae WHERE event_type = 'job.created' AND user_id IS NOT NULL AND {IN} GROUP BY user_id)",
    ),
    "file_size_hist": (
        lambda e: A.file_size_hist(e, MONTH),
        f"SELECT CASE WHEN file_size < 1048576 THEN 'under_1mb' WHEN file_size < 5242880 THEN '1mb_5mb' WHEN file_size < 10485760 THEN '5mb_10mb' WHEN file_size < 52428800 THEN '10mb_50mb' ELSE 'over_50mb' END AS bucket, count(*) AS count FROM ae WHERE file_size > 0 AND {IN} GROUP BY 1",
    ),
    "guest_vs_registered": (
        lambda e: A.guest_vs_registered(e, MONTH),
        f""", t AS (SELECT count(*) FILTER (WHERE is_guest) AS g, count(*) FILTER (WHERE {REG}) AS r, {DAU} AS u FROM ae WHERE {IN})
SELECT g AS guest_events, r AS registered_events, u AS unique_registered, round(CASE WHEN g + r > 0 THEN g / (g + r) ELSE 0 END, 6) AS guest_ratio FROM t""",
    ),
    "power_users": (
        lambda e: A.power_users(e, MONTH),
        f"SELECT user_id, count(*) AS job_count FROM ae WHERE event_type IN ('job.created', 'job.completed') AND user_id IS NOT NULL AND {IN} GROUP BY user_id ORDER BY job_count DESC, user_id LIMIT 20",
    ),
    "job_success_rate": (
        lambda e: A.job_success_rate(e, MONTH),
        f""", t AS (SELECT {CNT("job.completed", "c")}, {CNT("job.failed", "f")} FROM ae WHERE {IN})
SELECT c AS completed, f AS failed, c + f AS total, round(CASE WHEN c + f > 0 THEN c / (c + f) ELSE 0 END, 6) AS success_rate FROM t""",
    ),
    "error_trend": (
        lambda e: A.error_trend(e, MONTH),
        f"SELECT CAST(created_at AS DATE) AS date, {CNT('job.failed', 'failures')}, count(*) AS total FROM ae WHERE event_type IN ('job.completed', 'job.failed') AND {IN} GROUP BY 1",
    ),
    "processing_time": (
        lambda e: A.processing_time(e, MONTH),
        f", {DURATIONS} SELECT round(coalesce(CAST(sum(us) AS DOUBLE) / count(*) / 1e6, 0), 6) AS avg_seconds, round(coalesce(quantile_cont(us, 0.5) / 1e6, 0), 6) AS p50_seconds, round(coalesce(quantile_cont(us, 0.95) / 1e6, 0), 6) AS p95_seconds FROM d",
    ),
    "processing_time_trend": (
        lambda e: A.processing_time_trend(e, MONTH),
        f", {DURATIONS} SELECT CAST(created_at AS DATE) AS date, " + ", ".join(f"round(quantile_cont(us, {q}) / 1e6, 6) AS {n}" for q, n in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"))) + " FROM d GROUP BY 1",
    ),
    "processing_time_within": (
        lambda e: A.processing_time(e, MONTH, timedelta(days=2)),
        f", {WITHIN} SELECT round(coalesce(CAST(sum(us) AS DOUBLE) / count(*) / 1e6, 0), 6) AS avg_seconds, round(coalesce(quantile_cont(us, 0.5) / 1e6, 0), 6) AS p50_seconds, round(coalesce(quantile_cont(us, 0.95) / 1e6, 0), 6) AS p95_seconds FROM w",
    ),
    "processing_time_trend_within": (
        lambda e: A.processing_time_trend(e, MONTH, timedelta(days=2)),
        f", {WITHIN} SELECT CAST(created_at AS DATE) AS date, " + ", ".join(f"round(quantile_cont(us, {q}) / 1e6, 6) AS {n}" for q, n in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"))) + " FROM w GROUP BY 1",
    ),
    "tool_errors": (
        lambda e: A.tool_errors(e, MONTH),
        f"SELECT tool_type, {CNT('job.completed', 'completed')}, {CNT('job.failed', 'failed')} FROM ae WHERE event_type IN ('job.completed', 'job.failed') AND tool_type <> '' AND {IN} GROUP BY tool_type ORDER BY failed DESC",
    ),
    "failure_categories": (
        lambda e: A.failure_categories(e, MONTH),
        rf"""SELECT CAST(created_at AS DATE) AS date, CASE regexp_extract(coalesce(json_extract_string(metadata, '$.failureReason'), ''), '^\[([A-Z_]+)\]', 1)
  WHEN 'TIMEOUT' THEN 'timeout' WHEN 'INVALID_PAYLOAD' THEN 'validation' WHEN 'UNSUPPORTED_TOOL' THEN 'validation' WHEN 'CONVERSION_FAILED' THEN 'processing' WHEN 'OUTPUT_FAILED' THEN 'infrastructure' ELSE 'other' END AS category, count(*) AS count
FROM ae WHERE event_type = 'job.failed' AND {IN} GROUP BY 1, 2""",
    ),
    "limit_hits_daily": (lambda e: A.limit_hits_daily(e, MONTH), f"SELECT CAST(created_at AS DATE) AS date, plan_name, count(*) AS hits FROM ae WHERE event_type = 'plan.limit_hit' AND {IN} GROUP BY 1, 2"),
    "agg_plan_at": (lambda e: A.agg_plan_at(e, AS_OF), PLAN_AT.format(reg=REG, t=NOW)),
    "mrr": (
        lambda e: A.mrr(e, WEEK),
        f""", a AS (SELECT coalesce(sum(users * {PRICE.format(c="plan_name")}), 0) AS m FROM ({PLAN_AT.format(reg=REG, t=NOW)})), b AS (SELECT coalesce(sum(users * {PRICE.format(c="plan_name")}), 0) AS p FROM ({PLAN_AT.format(reg=REG, t=W_SINCE)}))
SELECT m AS mrr, m * 12 AS arr, p AS previous_mrr FROM a, b""",
    ),
    "mrr_trend": (
        lambda e: A.mrr_trend(e, MONTH),
        f""", days AS (SELECT CAST(unnest(generate_series(CAST({SINCE} AS DATE), CAST({NOW} AS DATE), INTERVAL 1 DAY)) AS DATE) AS date),
told AS (SELECT date, user_id, arg_max(plan_name, (created_at, id)) AS plan_name FROM days JOIN ae ON ae.created_at < date + INTERVAL 1 DAY WHERE {REG} AND plan_name <> '' GROUP BY date, user_id)
SELECT days.date, coalesce(sum({PRICE.format(c="plan_name")}), 0) AS mrr FROM days LEFT JOIN told USING (date) GROUP BY days.date""",
    ),
    "plan_change_direction": (
        lambda e: A.plan_change_direction(e, MONTH),
        f", c AS ({CHANGES}) SELECT date, CAST(sum(CASE WHEN up THEN count ELSE 0 END) AS BIGINT) AS upgrades, CAST(sum(CASE WHEN up THEN 0 ELSE count END) AS BIGINT) AS downgrades FROM (SELECT *, {PRICE.format(c='new_plan')} >= {PRICE.format(c='old_plan')} AS up FROM c) GROUP BY date",
    ),
    "channel_daily": (lambda e: A.channel_daily(e, MONTH), f"SELECT CAST(created_at AS DATE) AS date, {CHANNEL} AS channel, count(*) AS signups FROM ae WHERE event_type = 'user.signup' AND {IN} GROUP BY 1, 2"),
    "channel_totals": (
        lambda e: A.channel_totals(e, MONTH),
        f", t AS (SELECT {CHANNEL} AS channel, count(*) AS signups FROM ae WHERE event_type = 'user.signup' AND {IN} GROUP BY 1) SELECT channel, signups, round(signups * 100 / sum(signups) OVER (), 6) AS percent FROM t",
    ),
    "channel_previous": (lambda e: A.channel_previous(e, WEEK), f"SELECT {CHANNEL} AS channel, count(*) AS signups FROM ae WHERE event_type = 'user.signup' AND created_at >= {W_PREV} AND created_at < {W_SINCE} GROUP BY 1"),
    "top_referrers": (
        lambda e: A.top_referrers(e, MONTH),
        f"SELECT json_extract_string(metadata, '$.referrer') AS referrer, count(*) AS signups FROM ae WHERE event_type = 'user.signup' AND {IN} AND coalesce(json_extract_string(metadata, '$.referrer'), '') <> '' GROUP BY 1 ORDER BY signups DESC, referrer LIMIT 10",
    ),
    "ingestion_hourly": (lambda e: A.ingestion_hourly(e, AS_OF), f"SELECT date_trunc('hour', created_at) AS hour, count(*) AS count FROM ae WHERE created_at >= {NOW} - INTERVAL 24 HOURS GROUP BY 1"),
    "queue_throughput": (
        lambda e: A.queue_throughput(e, AS_OF),
        f"SELECT date_trunc('hour', created_at) AS time, count(*) AS processed, {CNT('job.failed', 'failed')}, CAST(0 AS BIGINT) AS queued FROM ae WHERE created_at >= {NOW} - INTERVAL 24 HOURS GROUP BY 1",
    ),
    "system_counters": (
        lambda e: A.system_counters(e, AS_OF),
        f"SELECT count(*) FILTER (WHERE created_at >= {NOW} - INTERVAL 24 HOURS) AS events_24h, count(*) FILTER (WHERE created_at >= {NOW} - INTERVAL 1 HOUR) AS events_1h, count(DISTINCT user_id) FILTER (WHERE {REG} AND created_at >= {NOW} - INTERVAL 5 MINUTES) AS active_5m, count(*) AS total FROM ae",
    ),
    "processing_lag": (
        lambda e: A.processing_lag(e, AS_OF),
        f"SELECT round(coalesce(CAST(sum(us) AS DOUBLE) / count(*) / 1e6, 0), 6) AS avg_lag_seconds, coalesce(max(us) / 1e6, 0) AS max_lag_seconds FROM (SELECT epoch_us(persisted_at) - epoch_us(created_at) AS us FROM ae WHERE created_at >= {NOW} - INTERVAL 1 HOUR AND persisted_at IS NOT NULL)",
    ),
    "page_events": (lambda e: A.page_events(e, "job.created", page=2), "SELECT * FROM ae WHERE event_type = 'job.created' ORDER BY created_at DESC, id DESC LIMIT 50 OFFSET 50"),
    "count_page_total": (lambda e: A.count_page_total(e, "job.created"), "SELECT count(*) AS total FROM ae WHERE event_type = 'job.created'"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {key: (lambda spark, sf_dir, run=run: run(event_log(spark, sf_dir))) for key, (run, _) in KEYS.items()}


def oracle_sql() -> dict[str, str]:
    return {key: AE.strip() + "\n" + sql for key, (_, sql) in KEYS.items()}
