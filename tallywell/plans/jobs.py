"""Query keys of the job queue's rules, logs, host readings and extrapolated rates, each with DuckDB SQL of its own."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywell.operators import jobs as B
from tallywell.operators import metrics as M
from tallywell.plans.metrics import STEPS, per_user_counter
from tallywell.sources import host, monitoring
from tallywell.sources.events import event_log, table
from tallywell.streaming import ingest

NOW = datetime(2024, 1, 31)
KINDS = {"job.created": "JobCreated", "job.completed": "JobCompleted", "job.failed": "JobFailed"}
LIMITS = {"JOBS_DISPATCH": (1_728_000, 20_000, 180), "JOBS_EVENTS": (864_000, 3_000, None), "JOBS_DLQ": (2_592_000, 9_000, None)}

#: job events: id, job_id, user_id (null for guests), kind, created_at
E = """WITH e AS (
  SELECT event_id AS id, user_id * 100 + CAST(json_extract_string(props, '$.k') AS BIGINT) AS job_id, CASE WHEN user_id % 10 <> 0 THEN user_id END AS user_id,
    CASE event_type WHEN 'click' THEN 'job.created' WHEN 'purchase' THEN 'job.completed' ELSE 'job.failed' END AS kind, ts AS created_at
  FROM events WHERE event_type IN ('click', 'purchase', 'error')
)"""


def pick(n: Column, values: list) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as failed deliveries of a job."""
    error = pick(F.col("o_orderkey"), ["upload: status=503", "read: i/o timeout", "status=404", "bad page range", "status=429", None])
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), error.alias("error"), (F.col("o_custkey") % 5 + 1).cast("int").alias("delivery"))


def state_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.lit(None).cast("string")
    for ours, theirs in KINDS.items():
        kind = F.when(F.col("event_type") == ours, theirs).otherwise(kind)
    log = event_log(spark, sf_dir).where("job_id IS NOT NULL")
    return log.select(kind.alias("eventType"), F.col("job_id").alias("jobId"), F.col("created_at").cast("string").alias("timestamp"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as messages of four streams, of which one has no limits."""
    e = table(spark, sf_dir, "events")
    stream = pick(F.col("event_id"), ["JOBS_DISPATCH", "JOBS_EVENTS", "JOBS_DLQ", "OTHER"])
    return e.select(stream.alias("stream"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), F.floor("value").cast("bigint").alias("bytes"))


RETAINED = """WITH m AS (SELECT (['JOBS_DISPATCH', 'JOBS_EVENTS', 'JOBS_DLQ', 'OTHER'])[event_id % 4 + 1] AS stream, ts AS "at", event_id AS seq, CAST(floor(value) AS BIGINT) AS bytes FROM events
), f AS (SELECT * FROM m WHERE CASE stream WHEN 'JOBS_DISPATCH' THEN "at" >= TIMESTAMP '2024-01-11' AND bytes <= 180 WHEN 'JOBS_EVENTS' THEN "at" >= TIMESTAMP '2024-01-21' WHEN 'JOBS_DLQ' THEN "at" >= TIMESTAMP '2024-01-01' ELSE true END
), r AS (SELECT *, sum(bytes) OVER (PARTITION BY stream ORDER BY "at" DESC, seq DESC ROWS UNBOUNDED PRECEDING) AS total FROM f)
SELECT stream, "at", seq, bytes FROM r WHERE total <= CASE stream WHEN 'JOBS_DISPATCH' THEN 20000 WHEN 'JOBS_EVENTS' THEN 3000 WHEN 'JOBS_DLQ' THEN 9000 ELSE 1e18 END"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("user_id").alias("service"), "ts", (F.col("event_type") == "purchase").alias("ok"))


BREAKER = """WITH RECURSIVE e AS (
  SELECT event_id, user_id AS service, ts, event_type = 'purchase' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_type = 'purchase') AS n FROM events
), f AS (
  SELECT *, 'closed' AS state, false AS opened, CASE WHEN ok THEN 0 ELSE 1 END AS bad, ts + INTERVAL 4 DAY AS until FROM e WHERE n = 1
  UNION ALL
  SELECT event_id, service, ts, ok, n, now,
    CASE now WHEN 'open' THEN true WHEN 'half-open' THEN NOT ok ELSE b >= 5 END,
    CASE WHEN now = 'closed' AND b < 5 THEN b ELSE 0 END,
    CASE WHEN now = 'open' THEN u WHEN now = 'half-open' AND ok THEN ts + INTERVAL 4 DAY WHEN now = 'half-open' OR b >= 5 THEN ts + INTERVAL 1 DAY WHEN ts > u THEN ts + INTERVAL 4 DAY ELSE u END
  FROM (
    SELECT e.*, f.until AS u, CASE WHEN NOT f.opened THEN 'closed' WHEN e.ts > f.until THEN 'half-open' ELSE 'open' END AS now,
      CASE WHEN e.ok THEN 0 WHEN e.ts > f.until THEN 1 ELSE f.bad + 1 END AS b
    FROM f JOIN e ON e.service = f.service AND e.n = f.n + 1)
) SELECT event_id, service, ts, ok, state, state <> 'open' AS allowed FROM f"""


def finished(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = event_log(spark, sf_dir).where("event_type = 'job.completed' AND user_id IS NOT NULL")
    return own.select(F.col("job_id").alias("source_job_id"), "user_id").distinct()


def hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job's creations as hints; every seventh is another user's."""
    own = event_log(spark, sf_dir).where("event_type = 'job.created' AND user_id IS NOT NULL AND job_id % 3 <> 0")
    return own.select("job_id", (F.col("user_id") + F.when(F.col("id") % 7 == 0, 1).otherwise(0)).alias("user_id"), (F.col("id") % 5).alias("organization_id"), F.col("created_at").alias("at"))


FILED = f"""{E}, h AS (SELECT job_id, user_id + CASE WHEN id % 7 = 0 THEN 1 ELSE 0 END AS user_id, id % 5 AS organization_id FROM e WHERE kind = 'job.created' AND user_id IS NOT NULL AND job_id % 3 <> 0
  QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY created_at DESC) = 1), d AS (SELECT DISTINCT job_id AS source_job_id, user_id FROM e WHERE kind = 'job.completed' AND user_id IS NOT NULL)
SELECT d.source_job_id, d.user_id, h.organization_id FROM d LEFT JOIN h ON h.job_id = d.source_job_id AND h.user_id = d.user_id"""


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("user_id") % 6
    service = F.concat(F.lit("svc-"), k.cast("string"))
    name = F.concat(F.when(k == 2, "").otherwise("/"), service, F.lit("-1"))
    return host.labelled(table(spark, sf_dir, "events").select("event_id", name.alias("name"), service.alias("service"), F.concat(F.upper("event_type"), F.lit(" "), F.col("props")).alias("line")))


def captured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as captured files of hosts."""
    n, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    stat = F.concat(F.lit("cpu  "), n, F.lit(" 1 2 "), size, F.lit(" 3 0 0 4 5 6 1000\ncpu0 9 9 9 9\nintr 5"))
    meminfo = F.concat(F.lit("MemTotal:  "), (F.col("p_partkey") * 2048).cast("string"), F.lit(" kB\nMemFree: 512 kB\nbroken\nMemAvailable: "), (F.col("p_partkey") * 1024).cast("string"), F.lit(" kB\n"))
    return table(spark, sf_dir, "part").select("p_partkey", stat.alias("stat"), meminfo.alias("meminfo"), F.concat(n, F.lit(".5 1.0\n")).alias("uptime"), F.concat(F.lit("0.5 "), size, F.lit(".25 2 1/99 7")).alias("loadavg"))


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = captured(spark, sf_dir)
    cpu, mem, load = host.cpu_counters(F.col("stat")), host.memory(F.col("meminfo")), host.load_averages(F.col("loadavg"))
    r = c.select("p_partkey", cpu.alias("c"), mem.alias("m"), load.alias("l"), host.uptime_seconds(F.col("uptime")).alias("uptime"))
    return r.select("p_partkey", "c.idle", "c.total", F.col("m.total_mb").alias("total_mb"), F.col("m.used_mb").alias("used_mb"), F.col("m.free_mb").alias("free_mb"), F.round("m.used_percent", 6).alias("used_percent"), F.col("l")[1].alias("load5"), "uptime")


def gauge_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    probes = host.dependency_gauges(s.select(F.concat(F.lit('de"p'), F.col("s_suppkey").cast("string")).alias("dependency"), F.when(F.col("s_suppkey") % 4 != 0, F.col("s_acctbal") > 0).alias("up")))
    return host.gauge_lines(probes)


LINES = """SELECT 'dependency_up{dependency="de\\"p' || s_suppkey || '"} ' || CASE WHEN s_suppkey % 4 <> 0 AND s_acctbal > 0 THEN '1.0' ELSE '0.0' END AS value FROM supplier"""

X = f"""{STEPS}, w AS (
  SELECT event_id, epoch_us(ts) AS t, first(epoch_us(ts)) OVER w AS t0, first(value) OVER w AS v0, count(*) OVER w AS n, sum(step) OVER w - first(step) OVER w AS g FROM s
  WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 172799999999 MICROSECONDS PRECEDING AND CURRENT ROW)
), z AS (SELECT event_id, n, g, v0, (t - t0) / 1e6 AS span, 172800 - (t - t0) / 1e6 AS edge FROM w
), y AS (SELECT *, least(CASE WHEN edge >= span / (n - 1) * 1.1 THEN span / (n - 1) / 2 ELSE edge END, CASE WHEN g > 0 AND v0 >= 0 THEN span * v0 / g ELSE edge END) AS reach FROM z WHERE n > 1
) SELECT event_id, round(g * (span + reach) / span, 6) AS increase, round(g * (span + reach) / span / 172800, 9) AS rate FROM y UNION ALL SELECT event_id, NULL, NULL FROM z WHERE n = 1"""

KEYS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "st_retry_backoff": (
        lambda s, d: B.after_failure(failures(s, d)),
        """WITH x AS (SELECT o_orderkey AS job_id, (['upload: status=503', 'read: i/o timeout', 'status=404', 'bad page range', 'status=429', NULL])[o_orderkey % 6 + 1] AS error, CAST(o_custkey % 5 + 1 AS INTEGER) AS delivery FROM orders
), y AS (SELECT *, job_id % 6 IN (0, 1, 4) AND delivery < 4 AS again FROM x)
SELECT job_id, error, delivery, CASE WHEN again THEN 'queued' ELSE 'failed' END AS state, CASE WHEN again THEN CASE delivery WHEN 1 THEN 10 WHEN 2 THEN 30 ELSE 120 END END AS retry_seconds,
  CASE WHEN NOT again THEN CASE WHEN job_id % 6 = 1 THEN 'TIMEOUT' ELSE 'CONVERSION_FAILED' END END AS code, NOT again AS dead FROM y""",
    ),
    "st_job_state": (
        lambda s, d: ingest.job_states(state_rows(s, d)).select("jobId", "state", "progress"),
        f"""{E} SELECT job_id AS "jobId", CASE k WHEN 'job.created' THEN 'queued' WHEN 'job.completed' THEN 'completed' ELSE 'failed' END AS state, CASE k WHEN 'job.completed' THEN 100 ELSE 0 END AS progress
FROM (SELECT job_id, CASE WHEN bool_or(kind = 'job.completed') THEN 'job.completed' ELSE arg_max(kind, created_at) END AS k FROM e GROUP BY job_id)""",
    ),
    "st_job_sse": (
        lambda s, d: B.job_updates(event_log(s, d)).select("id", "job_id", F.col("event_type").alias("kind")),
        f"{E}, x AS (SELECT *, count(*) FILTER (WHERE kind <> 'job.created') OVER (PARTITION BY job_id ORDER BY created_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ended FROM e) SELECT id, job_id, kind FROM x WHERE ended = 0",
    ),
    "join_hint": (lambda s, d: B.filed(finished(s, d), hints(s, d)), FILED),
    "hints_left": (
        lambda s, d: B.hints_left(hints(s, d), B.filed(finished(s, d), hints(s, d))).select("job_id", "at"),
        f"SELECT id_.job_id, id_.created_at AS at FROM ({E} SELECT * FROM e WHERE kind = 'job.created' AND user_id IS NOT NULL AND job_id % 3 <> 0) id_ WHERE job_id NOT IN (SELECT source_job_id FROM ({FILED}) WHERE organization_id IS NOT NULL)",
    ),
    "st_retention": (lambda s, d: B.retained(messages(s, d), NOW, LIMITS), RETAINED),
    "st_circuit_breaker": (lambda s, d: B.circuit_breaker(calls(s, d), interval=timedelta(days=4), pause=timedelta(days=1)), BREAKER),
    "src_logs": (
        lambda s, d: logs(s, d).select("event_id", "container", "service"),
        "SELECT event_id, CASE WHEN user_id % 6 <> 2 THEN 'svc-' || user_id % 6 || '-1' END AS container, 'svc-' || user_id % 6 AS service FROM events",
    ),
    "log_search": (
        lambda s, d: host.log_search(logs(s, d), "svc-[12]|svc-5", r"error|\"k\": 7").select("event_id", "line"),
        """SELECT event_id, upper(event_type) || ' ' || props AS line FROM events WHERE user_id % 6 IN (1, 2, 5) AND (event_type = 'error' OR contains(props, '"k": 7'))""",
    ),
    "src_proc": (
        readings,
        """SELECT p_partkey, p_size::BIGINT AS idle, p_partkey + p_size + 21 AS total, p_partkey * 2.0::DOUBLE AS total_mb, p_partkey * 1.0::DOUBLE AS used_mb, 0.5::DOUBLE AS free_mb, CASE WHEN p_partkey > 0 THEN 50.0::DOUBLE ELSE 0.0::DOUBLE END AS used_percent, p_size + 0.25::DOUBLE AS load5, p_partkey + 0.5::DOUBLE AS uptime FROM part""",
    ),
    "src_statfs": (
        lambda s, d: table(s, d, "part").select("p_partkey", host.disk(F.col("p_partkey") * 1000, F.lit(4096), F.col("p_partkey") * F.col("p_size"), F.col("p_partkey") * 7).alias("d")).select("p_partkey", *(F.round(f"d.{n}", 9).alias(n) for n in ("total_gb", "used_gb", "free_gb", "used_percent"))),
        """SELECT p_partkey, round(p_partkey * 4096000 / 1073741824.0::DOUBLE, 9) AS total_gb, round(p_partkey * (1000 - p_size) * 4096 / 1073741824.0::DOUBLE, 9) AS used_gb, round(p_partkey * 28672 / 1073741824.0::DOUBLE, 9) AS free_gb,
  CASE WHEN p_partkey > 0 THEN round((1000 - p_size) / 10.0::DOUBLE, 9) ELSE 0.0::DOUBLE END AS used_percent FROM part""",
    ),
    "sink_gauge": (gauge_rows, LINES),
    "src_prom_gauge": (
        lambda s, d: monitoring.gauge(monitoring.samples(gauge_rows(s, d)), "dependency_up"),
        "SELECT coalesce(arg_min(CASE WHEN s_suppkey % 4 <> 0 AND s_acctbal > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END, CAST(s_suppkey AS VARCHAR) || '\"'), 0) AS value FROM supplier",
    ),
    "exec_servers": (
        lambda s, d: M.server_list(table(s, d, "supplier").select(F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 4 != 0, F.col("s_acctbal") > 0).alias("healthy"))),
        "SELECT s_name AS name, CASE WHEN s_suppkey % 4 <> 0 AND s_acctbal > 0 THEN 'healthy' ELSE 'unhealthy' END AS status FROM supplier",
    ),
    "promql_extrapolated": (lambda s, d: M.extrapolated(per_user_counter(s, d), ["user_id"], 172_800).select("event_id", "increase", "rate"), X),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: run for k, (run, _) in KEYS.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in KEYS.items()}
