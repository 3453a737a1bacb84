"""Metrics analytics: histogram quantiles, counter deltas, bucketed trends, rates, alert rules and their throttling.

Samples of a metric are rows of (ts, metric, labels, le, value); histograms have cumulative counts by upper bound `le`, with
+Inf last. Every operator is a window or an aggregation by the series' own key.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from tallywell.functions.expr import Period, at, free, ratio, within

INF = float("inf")


def hist_quantiles(buckets: DataFrame, by: list[str], shares: dict[str, float], le: str = "le", count: str = "n") -> DataFrame:
    """One row for each key with the quantiles named in `shares`.

    Linear within the first finite bucket whose cumulative count reaches share x total, from (0, 0); beyond the finite buckets
    the last finite bound; 0 for an empty histogram; a flat bucket gives its bound. The total is the largest count.
    """
    merged = buckets.groupBy(*by, le).agg(F.sum(count).alias("n"))
    order = Window.partitionBy(*by).orderBy(le)
    key = Window.partitionBy(*by)
    rows = merged.select(
        *by,
        F.col(le).alias("le"),
        F.col("n").cast("double").alias("n"),
        F.lag(le, 1, 0.0).over(order).cast("double").alias("le0"),
        F.lag("n", 1, 0.0).over(order).cast("double").alias("n0"),
        F.max("n").over(key).cast("double").alias("total"),
    )
    finite = F.col("le") < INF

    def quantile(share: float) -> Column:
        target = F.col("total") * share
        inside = F.when(F.col("n") == F.col("n0"), F.col("le")).otherwise(F.col("le0") + (target - F.col("n0")) / (F.col("n") - F.col("n0")) * (F.col("le") - F.col("le0")))
        first = F.min(F.when(finite & (F.col("n") >= target), F.struct("le", inside.alias("v"))))["v"]
        return F.round(F.when(F.max("total") > 0, F.coalesce(first, F.max(F.when(finite, F.col("le"))))).otherwise(0.0), 9)

    return rows.groupBy(*by).agg(*(F.coalesce(quantile(s), F.lit(0.0)).alias(n) for n, s in shares.items()))


QUANTILES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def hist_endpoint_stats(buckets: DataFrame, counts: DataFrame) -> DataFrame:
    """By method and path: requests, errors (4xx and 5xx), mean and quantiles in milliseconds, over all statuses.

    buckets: method, path, status, le, n; counts: method, path, status, n, total_seconds.
    """
    stats = counts.groupBy("method", "path").agg(
        F.sum("n").alias("requests"),
        F.sum(F.when(F.col("status") >= 400, F.col("n")).otherwise(0)).alias("errors"),
        ratio(F.sum("total_seconds") * 1000, F.sum("n")).alias("avg_ms"),
    )
    q = hist_quantiles(buckets, ["method", "path"], QUANTILES)
    return stats.join(q, ["method", "path"]).select("method", "path", "requests", "errors", "avg_ms", *(F.round(F.col(n) * 1000, 6).alias(f"{n}_ms") for n in QUANTILES))


def hist_aggregate(buckets: DataFrame, counts: DataFrame) -> DataFrame:
    """All endpoints as one: client errors 4xx, timeouts 504, server errors the other 5xx, quantiles of the merged histogram."""
    s, n = F.col("status"), F.col("n")
    one = lambda c: F.coalesce(F.sum(F.when(c, n).otherwise(0)), F.lit(0))
    totals = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("requests"),
        one((s >= 400) & (s < 500)).alias("client_errors"),
        one((s >= 500) & (s != 504)).alias("server_errors"),
        one(s == 504).alias("timeouts"),
        ratio(F.sum("total_seconds") * 1000, F.sum("n")).alias("avg_ms"),
    )
    q = hist_quantiles(buckets.withColumn("all", F.lit(1)), ["all"], QUANTILES).select(*(F.round(F.col(n) * 1000, 6).alias(f"{n}_ms") for n in QUANTILES))
    return totals.join(F.broadcast(q), how="left")


def counter_delta(samples: DataFrame, counters: list[str], key: list[str], ts: str) -> DataFrame:
    """Each sample with the growth of its counters since the one before; a counter that fell was reset and counts whole.

    The first sample of a series has no delta and is left out. Other columns are snapshots and stay.
    """
    order = Window.partitionBy(*key).orderBy(ts)
    out = samples.withColumn("_seen", F.row_number().over(order))
    for c in counters:
        before = F.lag(c).over(order)
        out = out.withColumn(f"{c}_delta", F.when(F.col(c) < before, F.col(c)).otherwise(F.col(c) - before))
    return out.where("_seen > 1").drop("_seen")


COUNTERS = ["requests", "client_errors", "server_errors", "timeouts"]
LATENCIES = ["avg_ms", "p50_ms", "p95_ms", "p99_ms"]


def api_trends(samples: DataFrame, p: Period) -> DataFrame:
    """By hour for up to two days, else by day: sums of the counters, means of the latencies, and the share of errors."""
    unit = "hour" if p.days <= 2 else "day"
    own = samples.where(within("sampled_at", p.since, p.now)).groupBy(F.date_trunc(unit, "sampled_at").cast("timestamp_ntz").alias("time"))
    found = own.agg(*(F.sum(c).alias(c) for c in COUNTERS), *(F.round(F.avg(c), 6).alias(c) for c in LATENCIES))
    errors = F.col("client_errors") + F.col("server_errors") + F.col("timeouts")
    return found.withColumn("errors", errors).withColumn("error_rate", ratio(errors, F.col("requests")))


def api_trends_totals(samples: DataFrame, p: Period) -> DataFrame:
    """Sums over the buckets, and the mean of the buckets' mean latencies."""
    found = api_trends(samples, p).agg(F.coalesce(F.sum("requests"), F.lit(0)).alias("requests"), F.coalesce(F.sum("errors"), F.lit(0)).alias("errors"), F.round(F.coalesce(F.avg("avg_ms"), F.lit(0.0)), 4).alias("avg_ms"))
    return found.withColumn("error_rate", ratio(F.col("errors"), F.col("requests")))


def api_trends_previous(samples: DataFrame, p: Period) -> DataFrame:
    own = samples.where(within("sampled_at", p.previous, p.since))
    errors = F.col("client_errors") + F.col("server_errors") + F.col("timeouts")
    found = own.agg(F.coalesce(F.sum("requests"), F.lit(0)).alias("requests"), F.coalesce(F.sum(errors), F.lit(0)).alias("errors"), F.round(F.coalesce(F.avg("avg_ms"), F.lit(0.0)), 6).alias("avg_ms"))
    return found.withColumn("error_rate", ratio(F.col("errors"), F.col("requests")))


def api_sampled_since(samples: DataFrame) -> DataFrame:
    return samples.agg(F.min("sampled_at").alias("sampled_since"))


def sampler_retention(samples: DataFrame, now: datetime, days: int = 30) -> DataFrame:
    """The samples that a retention sweep leaves."""
    return samples.where(F.col("sampled_at") >= at(now - timedelta(days=days)))


def api_perf_summary(stats: DataFrame) -> DataFrame:
    """Totals, and the endpoints' quantiles weighted by their requests (not the quantile of the merged histogram)."""
    w = F.col("requests")
    weighted = [F.round(ratio(F.sum(F.col(f"{n}_ms") * w), F.sum(w), 9), 6).alias(f"{n}_ms") for n in QUANTILES]
    return stats.agg(F.coalesce(F.sum("requests"), F.lit(0)).alias("requests"), F.coalesce(F.sum("errors"), F.lit(0)).alias("errors"), *weighted)


def api_perf_slowest5(stats: DataFrame) -> DataFrame:
    return stats.orderBy(F.desc("p95_ms"), "method", "path").limit(5)


def api_perf_errors5(stats: DataFrame, least_requests: int = 10) -> DataFrame:
    rated = stats.where(F.col("requests") >= least_requests).withColumn("error_rate", ratio(F.col("errors"), F.col("requests")))
    return rated.orderBy(F.desc("error_rate"), "method", "path").limit(5)


SORTABLE = ("path", "method", "requests", "errors", "avg_ms", "p50_ms", "p95_ms", "p99_ms")


def api_perf_page(stats: DataFrame, search: str = "", method: str = "", sort_by: str = "requests", descending: bool = True, page: int = 1, limit: int = 50) -> DataFrame:
    """A page of endpoints: part of the path in any case, exact method; an unknown column sorts by requests; ties by method and path."""
    out = stats
    if search:
        out = out.where(F.contains(F.lower("path"), F.lit(search.lower())))
    if method:
        out = out.where(F.col("method") == method.upper())
    column = F.col(sort_by if sort_by in SORTABLE else "requests")
    limit, page = min(max(1, limit), 200), max(1, page)
    return out.orderBy(column.desc() if descending else column.asc(), "method", "path").offset((page - 1) * limit).limit(limit)


def increase(samples: DataFrame, key: list[str], seconds: int, ts: str = "ts", value: str = "value") -> DataFrame:
    """Each sample with the growth of its counter over the last `seconds`, resets counted, without extrapolation to the window's edges."""
    order = Window.partitionBy(*key).orderBy(ts)
    before = F.lag(value).over(order)
    step = F.when(before.isNull(), 0.0).when(F.col(value) < before, F.col(value)).otherwise(F.col(value) - before)
    # the sample that opens the window brings no growth of its own
    micros = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01', {ts})")
    frame = Window.partitionBy(*key).orderBy("_us").rangeBetween(-seconds * 1_000_000, Window.currentRow)
    out = samples.withColumn("_step", step).withColumn("_us", micros)
    out = out.withColumn("increase", F.round(F.sum("_step").over(frame) - F.first("_step").over(frame), 6))
    return out.drop("_step", "_us")


def rate(samples: DataFrame, key: list[str], seconds: int, ts: str = "ts", value: str = "value") -> DataFrame:
    return increase(samples, key, seconds, ts, value).withColumn("rate", F.round(F.col("increase") / seconds, 9))


def extrapolated(samples: DataFrame, key: list[str], seconds: int, ts: str = "ts", value: str = "value") -> DataFrame:
    """Each sample with `increase` and `rate` of its counter over the `seconds` that end with it, stretched to the window's beginning.

    The growth between the first and the last sample of the window is stretched by the mean distance of samples: to the window's
    edge if the first is nearer to it than 1.1 distances, else by half of one, and never past where the counter would be 0.
    The window's beginning itself is outside. Null where the window has one sample only, or none at another time.
    """
    order = Window.partitionBy(*key).orderBy(ts)
    before = F.lag(value).over(order)
    step = F.when(before.isNull(), 0.0).when(F.col(value) < before, F.col(value)).otherwise(F.col(value) - before)
    frame = Window.partitionBy(*key).orderBy("_us").rangeBetween(1 - seconds * 1_000_000, Window.currentRow)
    out = samples.withColumn("_step", step).withColumn("_us", F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01', {ts})"))
    out = out.select(
        "*", (F.sum("_step").over(frame) - F.first("_step").over(frame)).alias("_grown"), F.first("_us").over(frame).alias("_us0"), F.first(value).over(frame).alias("_v0"), F.count("*").over(frame).alias("_n")
    )
    span = (F.col("_us") - F.col("_us0")) / 1e6
    distance, edge = span / (F.col("_n") - 1), seconds - span
    reach = F.when(edge >= distance * 1.1, distance / 2).otherwise(edge)
    zero = F.when((F.col("_grown") > 0) & (F.col("_v0") >= 0), span * F.col("_v0") / F.col("_grown"))
    grown = F.when((F.col("_n") > 1) & (span > 0), F.col("_grown") * (span + F.least(reach, zero)) / span)
    out = out.withColumn("increase", F.round(grown, 6)).withColumn("rate", F.round(grown / seconds, 9))
    return out.drop("_step", "_us", "_grown", "_us0", "_v0", "_n")


def error_ratio(samples: DataFrame, by: list[str], status: str = "status", value: str = "value") -> DataFrame:
    """Share of 5xx by key; 0 where there is none."""
    bad = F.sum(F.when(F.col(status).cast("string").rlike("^5..$"), F.col(value)).otherwise(0))
    return samples.groupBy(*by).agg(ratio(bad, F.sum(value)).alias("error_ratio"))


def held(conditions: DataFrame, key: list[str], hold: timedelta, ts: str = "ts", condition: str = "firing") -> DataFrame:
    """Stretches in which a condition was true at every sample for at least `hold`: key, start, last, and since when it fires."""
    order = Window.partitionBy(*key).orderBy(ts)
    edge = F.when(F.col(condition) != F.coalesce(F.lag(condition).over(order), F.lit(False)), 1).otherwise(0)
    island = F.sum("_edge").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    runs = conditions.withColumn("_edge", edge).withColumn("_island", island).where(F.col(condition))
    found = runs.groupBy(*key, "_island").agg(F.min(ts).alias("start"), F.max(ts).alias("last")).drop("_island")
    wait = F.expr(f"make_dt_interval(0, 0, 0, {hold.total_seconds()})")
    return found.withColumn("firing_since", F.col("start") + wait).where("last >= firing_since")


# Alert rules by name: metric, comparison, threshold, and how long the condition must hold in minutes.
RULES = {
    "ServiceDown": ("up", "==", 0.0, 1),
    "CollectorDown": ("collector_up", "==", 0.0, 2),
    "HighServerErrorRate": ("server_error_ratio", ">", 0.05, 5),
    "HighRequestLatencyP95": ("request_p95_seconds", ">", 2.0, 10),
    "HighJobFailureRate": ("job_failure_rate", ">", 0.2, 10),
    "DLQBacklog": ("dlq_pending", ">", 0.0, 5),
    "DependencyDown": ("dependency_up", "==", 0.0, 2),
    "DBPoolNearExhaustion": ("db_pool_share", ">", 0.9, 5),
}


def alerts(samples: DataFrame, key: list[str], rules: dict[str, tuple[str, str, float, int]] | None = None) -> DataFrame:
    """alert, key, start, last, firing_since of samples (ts, metric, key, value). All rules share one pass over the samples."""
    rules = RULES if rules is None else rules
    firing, hold = F.lit(None).cast("boolean"), F.lit(0)
    names = F.lit(None).cast("string")
    for name, (metric, op, threshold, minutes) in rules.items():
        own = F.col("metric") == metric
        test = F.col("value") == threshold if op == "==" else F.col("value") > threshold
        firing, hold, names = F.when(own, test).otherwise(firing), F.when(own, minutes * 60).otherwise(hold), F.when(own, F.lit(name)).otherwise(names)
    judged = samples.withColumn("alert", names).where("alert IS NOT NULL").withColumn("firing", F.coalesce(firing, F.lit(False))).withColumn("hold", hold)
    runs = held(judged, ["alert", "hold", *key], timedelta(0)).drop("firing_since")
    since = F.col("start") + F.expr("make_dt_interval(0, 0, 0, hold)")
    return runs.withColumn("firing_since", since).where("last >= firing_since").drop("hold")


def alert_fingerprint(labels: Column) -> Column:
    """SHA-256 of the labels in order of their names, each as name=value and a zero byte; labels: map<string,string>."""
    pairs = F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit("="), e["value"], F.decode(F.unhex(F.lit("00")), "UTF-8")))
    return F.sha2(F.array_join(pairs, ""), 256)


def alert_throttle(alerts: DataFrame, repeat: timedelta, key: str = "fingerprint", ts: str = "ts", firing: str = "firing") -> DataFrame:
    """Each arrival with `notify`: the first of a firing spell, then whenever `repeat` has passed since the last notice, and the first resolution of a spell.

    The repeats depend on the notice before, so each key's rows pass in order of time, and only its last notice is held. The column is called
    notify_ where there is a `notify`; an arrival without a time gives none and changes nothing; a null `firing` is resolved.
    """
    least = repeat.total_seconds()
    name = free("notify", alerts.columns)
    schema = StructType([*alerts.schema.fields, StructField(name, BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last, before = object(), None, False
        for b in batches:
            out = []
            for k, t, f in zip(*(b.column(c).to_pylist() for c in (key, ts, firing))):
                if t is None:
                    out.append(False)
                    continue
                if k != now:
                    now, last, before = k, None, False
                if f and not before:
                    last = None
                tell = (last is None or (t - last).total_seconds() >= least) if f else before
                last, before = (t if tell else last) if f else last, bool(f)
                out.append(tell)
            yield b.append_column(name, pa.array(out, pa.bool_()))

    return alerts.repartition(key).sortWithinPartitions(key, ts, F.desc(firing)).mapInArrow(run, schema)


def cpu_usage(samples: DataFrame, key: list[str], ts: str = "ts") -> DataFrame:
    """Busy share in percent between samples of the counters `idle` and `total`; 0 where the total stood still."""
    order = Window.partitionBy(*key).orderBy(ts)
    idle, total = (F.col(c) - F.lag(c).over(order) for c in ("idle", "total"))
    out = samples.withColumn("_i", idle).withColumn("_t", total).where("_t IS NOT NULL")
    return out.withColumn("cpu_percent", F.round(F.when(F.col("_t") == 0, 0.0).otherwise((1 - F.col("_i") / F.col("_t")) * 100), 6)).drop("_i", "_t")


def service_availability(health: DataFrame) -> DataFrame:
    """Healthy services, all, and their share in percent, of rows (service, healthy)."""
    return health.agg(F.count_if("healthy").alias("healthy"), F.count("*").alias("total"), ratio(F.count_if("healthy") * 100, F.count("*")).alias("percent"))


def server_list(health: DataFrame) -> DataFrame:
    """name and status of each service, by name; a null `healthy` is unhealthy."""
    return health.select("name", F.when(F.col("healthy"), "healthy").otherwise("unhealthy").alias("status")).orderBy("name")


def broker_streams(info: DataFrame) -> DataFrame:
    """A row for each stream `s` of the accounts of each monitoring document, beside the document's other columns (such as the scrape it is of)."""
    by = [c for c in info.columns if c != "account_details"]
    return info.select(*by, F.explode("account_details").alias("a")).select(*by, F.explode("a.stream_detail").alias("s"))


def nats_consumers(info: DataFrame) -> DataFrame:
    """A row for each consumer of a document's streams; streams without consumers have none."""
    by = [c for c in info.columns if c != "account_details"]
    c = broker_streams(info).select(*by, F.col("s.name").alias("stream"), F.explode("s.consumer_detail").alias("c"))
    fields = ("num_ack_pending", "num_redelivered", "num_pending", "num_waiting")
    return c.select(*by, "stream", F.col("c.name").alias("consumer"), *(F.col(f"c.{f}").alias(f) for f in fields)).orderBy(*by, "stream", "consumer")


def nats_streams(info: DataFrame) -> DataFrame:
    by = [c for c in info.columns if c != "account_details"]
    fields = ("messages", "bytes", "first_seq", "last_seq", "consumer_count")
    return broker_streams(info).select(*by, F.col("s.name").alias("stream"), *(F.col(f"s.state.{f}").alias(f) for f in fields)).orderBy(*by, "stream")


# The streams of the job queue.
DISPATCH, EVENTS, DEAD_LETTERS, ANALYTICS = "JOBS_DISPATCH", "JOBS_EVENTS", "JOBS_DLQ", "ANALYTICS"


def nats_summary(info: DataFrame, dead_letters: str = DEAD_LETTERS) -> DataFrame:
    """Streams, messages and dead letters of each document."""
    by = [c for c in info.columns if c != "account_details"]
    dlq = F.coalesce(F.sum(F.when(F.col("stream") == dead_letters, F.col("messages"))), F.lit(0))
    return nats_streams(info).groupBy(*by).agg(F.count("*").alias("total_streams"), F.coalesce(F.sum("messages"), F.lit(0)).alias("total_messages"), dlq.alias("dlq_depth"))


def queue_snapshot(info: DataFrame) -> DataFrame:
    """Pending, unacknowledged and redelivered messages by stream of each document."""
    by = [c for c in info.columns if c != "account_details"]
    return nats_consumers(info).groupBy(*by, "stream").agg(*(F.sum(f"num_{n}").alias(n) for n in ("pending", "ack_pending", "redelivered")))


def dispatch_consumers(info: DataFrame) -> DataFrame:
    """The consumers that hand jobs to workers, of each document, by name."""
    by = [c for c in info.columns if c != "account_details"]
    own = nats_consumers(info).where(F.col("stream") == DISPATCH)
    return own.select(*by, F.col("consumer").alias("name"), *(F.col(f"num_{n}").alias(n) for n in ("pending", "ack_pending", "redelivered"))).orderBy(*by, "name")


def queue_health(info: DataFrame) -> DataFrame:
    """Dead letters, and how far the readers of analytics and of job events are behind, of each document; zeros where it has none of them.

    One pass over the documents' streams: a stream's consumers are summed within its row.
    """
    by = [c for c in info.columns if c != "account_details"]

    def of(stream: str, field: str) -> Column:
        total = F.aggregate("s.consumer_detail", F.lit(0).cast("bigint"), lambda a, c: a + F.coalesce(c[field], F.lit(0)))
        return F.coalesce(F.sum(F.when(F.col("s.name") == stream, total)), F.lit(0))

    # of a stream that several accounts have, the one with most messages is told
    dead = F.coalesce(F.max(F.when(F.col("s.name") == DEAD_LETTERS, F.col("s.state.messages"))), F.lit(0))
    lag = {f"{n}_{f}": of(s, f"num_{f}") for n, s in (("analytics", ANALYTICS), ("job_events", EVENTS)) for f in ("pending", "ack_pending")}
    streams = info.select(*by, F.explode_outer("account_details").alias("a")).select(*by, F.explode_outer("a.stream_detail").alias("s"))
    return streams.groupBy(*by).agg(dead.alias("dead_letters"), *(c.alias(n) for n, c in lag.items()))
