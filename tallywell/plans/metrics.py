"""Query keys of the metrics analytics, each with DuckDB SQL that says the same independently."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywell.functions.expr import Period
from tallywell.operators import metrics as M
from tallywell.sources.events import metric_samples, table

AS_OF = datetime(2024, 1, 30, 23, 59, 59)
BOUNDS = [0.01, 0.02, 0.04, 0.06, 0.08, float("inf")]

SAMPLES = """WITH s AS (
  SELECT ts AS sampled_at, k AS requests, k % 5 AS client_errors, k % 3 AS server_errors, k % 2 AS timeouts, value AS avg_ms, value * 0.5 AS p50_ms, value * 2 AS p95_ms, value * 4 AS p99_ms
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
)"""
TREND = """, t AS (
  SELECT date_trunc('{unit}', sampled_at) AS time, {sums}, {means}
  FROM s WHERE sampled_at >= TIMESTAMP '{since}' AND sampled_at < TIMESTAMP '{now}' GROUP BY 1
), r AS (SELECT *, client_errors + server_errors + timeouts AS errors, round(CASE WHEN requests > 0 THEN (client_errors + server_errors + timeouts) / requests ELSE 0 END, 6) AS error_rate FROM t)"""
SUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in M.COUNTERS)
MEANS = ", ".join(f"round(avg({c}), 6) AS {c}" for c in M.LATENCIES)


def trend(p: Period) -> str:
    return SAMPLES + TREND.format(unit="hour" if p.days <= 2 else "day", sums=SUMS, means=MEANS, since=p.since, now=p.now)


def latencies(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Line items as requests: endpoint by flag and status, HTTP status by line number, discount as seconds."""
    line = table(spark, sf_dir, "lineitem")
    status = F.when(F.col("l_linenumber") == 1, 504).when(F.col("l_linenumber") == 2, 500).when(F.col("l_linenumber") == 3, 404).otherwise(200)
    rows = line.select(F.col("l_returnflag").alias("method"), F.col("l_linestatus").alias("path"), status.alias("status"), F.col("l_discount").alias("seconds"))
    own = rows.groupBy("method", "path", "status", "seconds").agg(F.count("*").alias("n"))  # map-side sums before the bounds multiply rows
    bounds = F.explode(F.filter(F.array(*map(F.lit, BOUNDS)), lambda b: F.col("seconds") <= b)).alias("le")
    buckets = own.select("method", "path", "status", bounds, "n").groupBy("method", "path", "status", "le").agg(F.sum("n").alias("n"))
    counts = own.groupBy("method", "path", "status").agg(F.sum("n").alias("n"), F.round(F.sum(F.col("seconds") * F.col("n")), 6).alias("total_seconds"))
    return buckets, counts


HIST = """WITH l AS (
  SELECT l_returnflag AS method, l_linestatus AS path, CASE l_linenumber WHEN 1 THEN 504 WHEN 2 THEN 500 WHEN 3 THEN 404 ELSE 200 END AS status, l_discount AS seconds FROM lineitem
), b AS (SELECT method, path, le, count(*) AS n FROM l, (SELECT unnest([0.01, 0.02, 0.04, 0.06, 0.08, 'inf'::DOUBLE]) AS le) WHERE seconds <= le GROUP BY ALL
), bounds AS (SELECT unnest([0.01, 0.02, 0.04, 0.06, 0.08, 'inf'::DOUBLE]) AS le
), q AS (SELECT unnest([0.5, 0.95, 0.99]) AS q)"""


def quantile_sql(by: str) -> str:
    """x: le by key with cumulative counts; first finite bucket that reaches the target."""
    keys = f"{by}, " if by else ""
    part = f"PARTITION BY {by} ORDER BY le" if by else "ORDER BY le"
    group = f"GROUP BY {by}" if by else ""
    source = f"(SELECT {keys}le, sum(n) AS n FROM b GROUP BY {keys}le)"
    whole = f"OVER (PARTITION BY {by})" if by else "OVER ()"
    value = lambda q: (
        f"coalesce(arg_min(CASE WHEN n = n0 THEN le ELSE le0 + ({q} * total - n0) / (n - n0) * (le - le0) END, le) FILTER (WHERE le < 'inf'::DOUBLE AND n >= {q} * total), max(le) FILTER (WHERE le < 'inf'::DOUBLE))"
    )
    cols = ", ".join(f"round(round({value(q)}, 9) * 1000, 6) AS {n}_ms" for n, q in M.QUANTILES.items())
    return f", x AS (SELECT {keys}le, n, coalesce(lag(le) OVER ({part}), 0) AS le0, coalesce(lag(n) OVER ({part}), 0) AS n0, max(n) {whole} AS total FROM {source}), z AS (SELECT {keys}{cols} FROM x {group})"


STATS = HIST + quantile_sql("method, path") + """, stats AS (
  SELECT method, path, count(*) AS requests, count(*) FILTER (WHERE status >= 400) AS errors, round(sum(seconds) * 1000 / count(*), 6) AS avg_ms FROM l GROUP BY method, path
), e AS (SELECT stats.*, p50_ms, p95_ms, p99_ms FROM stats JOIN z USING (method, path))"""


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.hist_endpoint_stats(*latencies(spark, sf_dir))


def per_user_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k as a counter of each user, which falls now and then as after a restart."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("ts"), "user_id", F.get_json_object("props", "$.k").cast("double").alias("value"))


COUNTER = "WITH c AS (SELECT event_id, ts, user_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS value FROM events)"
STEPS = f"{COUNTER}, s AS (SELECT *, CASE WHEN prev IS NULL THEN 0 WHEN value < prev THEN value ELSE value - prev END AS step FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM c))"
INCREASE = "sum(step) OVER w - first(step) OVER w"
FRAME = "WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL {s} SECONDS PRECEDING AND CURRENT ROW)"


def alert_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest dead-letter depth and others as each user's events tell them."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    metric = F.when(F.col("event_type") == "error", "dlq_pending").when(F.col("event_type") == "view", "server_error_ratio").otherwise("db_pool_share")
    value = F.when(F.col("event_type") == "error", F.greatest(F.lit(0.0), k - 20)).when(F.col("event_type") == "view", k / 400).otherwise(k / 100 + 0.5)
    return e.select("ts", metric.alias("metric"), F.col("user_id").alias("instance"), value.alias("value"))


ALERTS = """WITH a AS (
  SELECT ts, user_id AS instance, event_type, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events
), j AS (
  SELECT ts, instance, 300 AS hold, CASE event_type WHEN 'error' THEN 'DLQBacklog' WHEN 'view' THEN 'HighServerErrorRate' ELSE 'DBPoolNearExhaustion' END AS alert,
    CASE event_type WHEN 'error' THEN k > 20 WHEN 'view' THEN k / 400 > 0.05 ELSE k / 100 + 0.5 > 0.9 END AS firing FROM a
), g AS (
  SELECT *, row_number() OVER (PARTITION BY alert, instance ORDER BY ts) - row_number() OVER (PARTITION BY alert, instance, firing ORDER BY ts) AS island FROM j
)
SELECT alert, instance, min(ts) AS start, max(ts) AS last, min(ts) + to_seconds(any_value(hold)) AS firing_since
FROM g WHERE firing GROUP BY alert, instance, island HAVING max(ts) >= min(ts) + to_seconds(any_value(hold))"""


def throttled(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    rows = e.select("event_id", "ts", F.col("user_id").cast("string").alias("fingerprint"), (F.col("event_type") != "signup").alias("firing"))
    return M.alert_throttle(rows, timedelta(days=1))


THROTTLE = """WITH RECURSIVE e AS (
  SELECT event_id, ts, CAST(user_id AS VARCHAR) AS fingerprint, event_type <> 'signup' AS firing, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events
), f AS (
  SELECT event_id, ts, fingerprint, firing, n, firing AS notify, CASE WHEN firing THEN ts END AS last FROM e WHERE n = 1
  UNION ALL
  SELECT e.event_id, e.ts, e.fingerprint, e.firing, e.n,
    CASE WHEN e.firing THEN f.last IS NULL OR e.ts - f.last >= INTERVAL 1 DAY ELSE f.firing END,
    CASE WHEN NOT e.firing THEN NULL WHEN f.last IS NULL OR e.ts - f.last >= INTERVAL 1 DAY THEN e.ts ELSE f.last END
  FROM f JOIN e ON e.fingerprint = f.fingerprint AND e.n = f.n + 1
) SELECT event_id, ts, fingerprint, firing, notify FROM f"""

D30, D2 = Period(AS_OF, 30), Period(AS_OF, 2)
W = Period(AS_OF, 7)

KEYS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "api_trends": (lambda s, d: M.api_trends(metric_samples(s, d), D30), trend(D30) + " SELECT * FROM r"),
    "api_trends_hourly": (lambda s, d: M.api_trends(metric_samples(s, d), D2), trend(D2) + " SELECT * FROM r"),
    "api_trends_totals": (
        lambda s, d: M.api_trends_totals(metric_samples(s, d), D30),
        trend(D30) + " SELECT CAST(sum(requests) AS BIGINT) AS requests, CAST(sum(errors) AS BIGINT) AS errors, round(avg(avg_ms), 4) AS avg_ms, round(sum(errors) / sum(requests), 6) AS error_rate FROM r",
    ),
    "api_trends_previous": (
        lambda s, d: M.api_trends_previous(metric_samples(s, d), W),
        SAMPLES
        + f" SELECT CAST(sum(requests) AS BIGINT) AS requests, CAST(sum(client_errors + server_errors + timeouts) AS BIGINT) AS errors, round(avg(avg_ms), 6) AS avg_ms, round(sum(client_errors + server_errors + timeouts) / sum(requests), 6) AS error_rate FROM s WHERE sampled_at >= TIMESTAMP '{W.previous}' AND sampled_at < TIMESTAMP '{W.since}'",
    ),
    "api_sampled_since": (lambda s, d: M.api_sampled_since(metric_samples(s, d)), SAMPLES + " SELECT min(sampled_at) AS sampled_since FROM s"),
    "sampler_retention": (
        lambda s, d: M.sampler_retention(metric_samples(s, d), AS_OF, 7).agg(F.count("*").alias("kept"), F.min("sampled_at").alias("oldest")),
        SAMPLES + f" SELECT count(*) AS kept, min(sampled_at) AS oldest FROM s WHERE sampled_at >= TIMESTAMP '{W.since}'",
    ),
    "hist_endpoint_stats": (stats, STATS + " SELECT * FROM e"),
    "hist_aggregate": (
        lambda s, d: M.hist_aggregate(*latencies(s, d)),
        HIST
        + quantile_sql("")
        + ", a AS (SELECT count(*) AS requests, count(*) FILTER (WHERE status BETWEEN 400 AND 499) AS client_errors, count(*) FILTER (WHERE status >= 500 AND status <> 504) AS server_errors, count(*) FILTER (WHERE status = 504) AS timeouts, round(sum(seconds) * 1000 / count(*), 6) AS avg_ms FROM l) SELECT * FROM a, z",
    ),
    "hist_quantile": (
        lambda s, d: M.hist_quantiles(latencies(s, d)[0], ["method", "path"], M.QUANTILES).select("method", "path", *(F.round(F.col(n) * 1000, 6).alias(f"{n}_ms") for n in M.QUANTILES)),
        HIST + quantile_sql("method, path") + " SELECT * FROM z",
    ),
    "promql_hist_quantile": (
        lambda s, d: M.hist_quantiles(latencies(s, d)[0], ["path"], {"p95": 0.95}).select("path", F.round(F.col("p95") * 1000, 6).alias("p95_ms")),
        HIST + quantile_sql("path") + " SELECT path, p95_ms FROM z",
    ),
    "promql_error_ratio": (
        lambda s, d: M.error_ratio(latencies(s, d)[1], ["path"], value="n"),
        HIST + " SELECT path, round(count(*) FILTER (WHERE status BETWEEN 500 AND 599) / count(*), 6) AS error_ratio FROM l GROUP BY path",
    ),
    "api_perf_summary": (
        lambda s, d: M.api_perf_summary(stats(s, d)),
        STATS + " SELECT CAST(sum(requests) AS BIGINT) AS requests, CAST(sum(errors) AS BIGINT) AS errors, " + ", ".join(f"round(round(sum({n}_ms * requests) / sum(requests), 9), 6) AS {n}_ms" for n in M.QUANTILES) + " FROM e",
    ),
    "api_perf_slowest5": (lambda s, d: M.api_perf_slowest5(stats(s, d)), STATS + " SELECT * FROM e ORDER BY p95_ms DESC, method, path LIMIT 5"),
    "api_perf_errors5": (lambda s, d: M.api_perf_errors5(stats(s, d)), STATS + " SELECT *, round(errors / requests, 6) AS error_rate FROM e WHERE requests >= 10 ORDER BY error_rate DESC, method, path LIMIT 5"),
    "api_perf_page": (lambda s, d: M.api_perf_page(stats(s, d), search="o", sort_by="avg_ms", limit=2), STATS + " SELECT * FROM e WHERE contains(lower(path), 'o') ORDER BY avg_ms DESC, method, path LIMIT 2"),
    "counter_delta": (
        lambda s, d: M.counter_delta(per_user_counter(s, d), ["value"], ["user_id"], "ts"),
        COUNTER + ", p AS (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM c) SELECT event_id, ts, user_id, value, CASE WHEN value < prev THEN value ELSE value - prev END AS value_delta FROM p WHERE prev IS NOT NULL",
    ),
    "promql_increase": (
        lambda s, d: M.increase(per_user_counter(s, d), ["user_id"], 86400).select("event_id", "increase"),
        STEPS + f" SELECT event_id, round({INCREASE}, 6) AS increase FROM s " + FRAME.format(s=86400),
    ),
    "promql_rate": (
        lambda s, d: M.rate(per_user_counter(s, d), ["user_id"], 86400).select("event_id", "rate"),
        STEPS + f" SELECT event_id, round(round({INCREASE}, 6) / 86400, 9) AS rate FROM s " + FRAME.format(s=86400),
    ),
    "alert_rules": (lambda s, d: M.alerts(alert_samples(s, d), ["instance"]), ALERTS),
    "alert_throttle": (throttled, THROTTLE),
    "alert_fingerprint": (
        lambda s, d: table(s, d, "nation").select("n_nationkey", M.alert_fingerprint(F.create_map(F.lit("nation"), F.col("n_name"), F.lit("job"), F.lit("a"))).alias("fingerprint")),
        "SELECT n_nationkey, sha256('job=a' || chr(0) || 'nation=' || n_name || chr(0)) AS fingerprint FROM nation",
    ),
    "cpu_usage_delta": (
        lambda s, d: M.cpu_usage(per_user_counter(s, d).select("event_id", "ts", "user_id", (F.col("event_id") * 0.4 + F.col("value") * 0.0).alias("idle"), F.col("event_id").cast("double").alias("total")), ["user_id"]).select("event_id", "cpu_percent"),
        "WITH c AS (SELECT event_id, event_id * 0.4::DOUBLE AS idle, event_id::DOUBLE AS total, user_id, ts FROM events), p AS (SELECT *, idle - lag(idle) OVER w AS i, total - lag(total) OVER w AS t FROM c WINDOW w AS (PARTITION BY user_id ORDER BY ts)) SELECT event_id, round(CASE WHEN t = 0 THEN 0 ELSE (1 - i / t) * 100 END, 6) AS cpu_percent FROM p WHERE t IS NOT NULL",
    ),
    "service_availability": (
        lambda s, d: M.service_availability(table(s, d, "supplier").select("s_suppkey", (F.col("s_acctbal") > 0).alias("healthy"))),
        "SELECT count(*) FILTER (WHERE s_acctbal > 0) AS healthy, count(*) AS total, round(count(*) FILTER (WHERE s_acctbal > 0) * 100 / count(*), 6) AS percent FROM supplier",
    ),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: run for k, (run, _) in KEYS.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in KEYS.items()}
