"""Product analytics over one event log: activity, growth, retention, funnels, churn, revenue, acquisition, reliability.

Each function takes the event log and a Period (or its end) and gives one DataFrame. Scalars that belong together are one
aggregation over one scan. Filters on time and type are plain comparisons on columns, so they reach the Parquet scan.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywell.functions.expr import (
    Period,
    at,
    channel,
    count_of,
    day,
    failure_category,
    is_type,
    price_of,
    ratio,
    registered,
    size_bucket,
    users_where,
    within,
)
from tallywell.operators.quantiles import by_ranks

# Monthly prices in US dollars.
PRICES = {"guest": 0, "free": 0, "pro": 12}


def between(log: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """The rows from start to before end. Of a log that is partitioned by `event_date`, only the folders of these days are read, and a day before and after, as it may have been written in another time zone."""
    if "event_date" in log.columns:
        log = log.where(F.col("event_date").between(F.lit(start.date() - timedelta(days=1)), F.lit(end.date() + timedelta(days=1))))
    return log.where(within("created_at", start, end))


def in_period(log: DataFrame, p: Period) -> DataFrame:
    return between(log, p.since, p.now)


def today(log: DataFrame, now: datetime) -> DataFrame:
    start = now.replace(hour=0, minute=0, second=0, microsecond=0)
    return log.where(within("created_at", start, start + timedelta(days=1)))


def day_counters() -> list[Column]:
    kinds = {"signups": "user.signup", "logins": "user.login", "jobs_created": "job.created", "jobs_completed": "job.completed", "jobs_failed": "job.failed"}
    guests = F.count_distinct(F.when(F.col("is_guest"), F.coalesce(F.col("job_id"), F.col("id"))))
    return [*(count_of(is_type(t)).alias(n) for n, t in kinds.items()), users_where(registered()).alias("dau"), guests.alias("guest_sessions")]


def overview_today(log: DataFrame, now: datetime) -> DataFrame:
    found = today(log, now).agg(*day_counters(), count_of(is_type("plan.limit_hit")).alias("plan_limit_hits"))
    return found.select(F.lit(now.date()).alias("date"), "*")


def admin_dashboard_today(log: DataFrame, now: datetime) -> DataFrame:
    return today(log, now).agg(*day_counters())


def daily_counts(log: DataFrame, start: datetime, last: datetime) -> DataFrame:
    """`last` is a day, inclusive."""
    return log.where(within("created_at", start, last + timedelta(days=1))).groupBy(day().alias("date"), "event_type").agg(F.count("*").alias("count"))


def tool_usage(log: DataFrame, p: Period) -> DataFrame:
    own = in_period(log, p).where(is_type("job.created", "job.completed", "job.failed") & (F.col("tool_type") != ""))
    return own.groupBy("tool_type").agg(
        count_of(is_type("job.created")).alias("count"), count_of(is_type("job.completed")).alias("completed"), count_of(is_type("job.failed")).alias("failed")
    )


def admin_tools_top10(log: DataFrame, p: Period) -> DataFrame:
    return tool_usage(log, p).orderBy(F.desc("count"), "tool_type").limit(10)


def user_growth(log: DataFrame, p: Period) -> DataFrame:
    return in_period(log, p).groupBy(day().alias("date")).agg(count_of(is_type("user.signup")).alias("signups"), users_where(registered()).alias("dau"))


def plan_distribution(log: DataFrame, p: Period) -> DataFrame:
    """Users include guests that have an id."""
    own = in_period(log, p).where("plan_name != ''")
    return own.groupBy("plan_name").agg(
        F.count_distinct("user_id").alias("users"), count_of(is_type("job.created")).alias("jobs"), count_of(is_type("plan.limit_hit")).alias("limit_hits")
    )


def admin_plan_mix(log: DataFrame, p: Period) -> DataFrame:
    return plan_distribution(log, p).drop("limit_hits")


def realtime_hour(log: DataFrame, now: datetime) -> DataFrame:
    return log.where(F.col("created_at") >= at(now - timedelta(hours=1))).groupBy("event_type").agg(F.count("*").alias("count"))


def admin_total_users(log: DataFrame, p: Period) -> DataFrame:
    return in_period(log, p).agg(users_where(registered()).alias("total_users"))


def of_user(log: DataFrame, user: int) -> DataFrame:
    return log.where(F.col("user_id") == user)


def user_dash_counts(log: DataFrame, user: int) -> DataFrame:
    return of_user(log, user).agg(
        count_of(is_type("job.created")).alias("created"), count_of(is_type("job.completed")).alias("completed"), count_of(is_type("job.failed")).alias("failed")
    )


def user_dash_bytes(log: DataFrame, user: int) -> DataFrame:
    return of_user(log, user).agg(F.coalesce(F.sum("file_size"), F.lit(0)).alias("bytes"))


def user_dash_tools(log: DataFrame, user: int, p: Period) -> DataFrame:
    return tool_usage(of_user(log, user), p)


def user_dash_activity(log: DataFrame, user: int, p: Period) -> DataFrame:
    return in_period(of_user(log, user), p).groupBy(day().alias("date")).agg(F.count("*").alias("count"))


def user_dash_plan(log: DataFrame, user: int) -> DataFrame:
    """The latest plan that is told; of events at one time, that of the larger id."""
    return of_user(log, user).where("plan_name != ''").orderBy(F.desc("created_at"), F.desc("id")).limit(1).select("plan_name")


def user_dash_member_since(log: DataFrame, user: int) -> DataFrame:
    return of_user(log, user).agg(F.min("created_at").alias("member_since"))


def signups_daily(log: DataFrame, p: Period) -> DataFrame:
    return in_period(log, p).where(is_type("user.signup")).groupBy(day().alias("date")).agg(F.count("*").alias("signups"))


def signups_total(log: DataFrame, p: Period) -> DataFrame:
    return signups_daily(log, p).agg(F.coalesce(F.sum("signups"), F.lit(0)).alias("signups"))


def plan_users_daily(log: DataFrame, p: Period) -> DataFrame:
    return in_period(log, p).where("plan_name != ''").groupBy(day().alias("date"), "plan_name").agg(F.count_distinct("user_id").alias("users"))


def plan_changes_daily(log: DataFrame, p: Period) -> DataFrame:
    own = in_period(log, p).where(is_type("plan.changed"))
    old, new = (F.get_json_object("metadata", f"$.{k}").alias(n) for k, n in (("oldPlan", "old_plan"), ("newPlan", "new_plan")))
    return own.groupBy(day().alias("date"), old, new).agg(F.count("*").alias("count"))


def conversion_rate(log: DataFrame, p: Period) -> DataFrame:
    """Changes away from the free plan by sign-up; not a subset of the sign-ups, so it may pass 1."""
    free = is_type("plan.changed") & (F.get_json_object("metadata", "$.oldPlan") == "free")
    found = in_period(log, p).agg(count_of(is_type("plan.changed")).alias("total_changes"), count_of(free).alias("free_upgrades"), count_of(is_type("user.signup")).alias("signups"))
    return found.select("total_changes", "free_upgrades", ratio(F.col("free_upgrades"), F.col("signups")).alias("conversion_rate"))


def churn(log: DataFrame, since: datetime, end: datetime, inactive_days: int) -> DataFrame:
    """Registered users active in the days before `since` and not from then on.

    One aggregation by user tells both periods, so nothing is joined.
    """
    start = since - timedelta(days=inactive_days)
    own = log.where(registered() & within("created_at", start, end))
    by_user = own.groupBy("user_id").agg(F.max(F.col("created_at") < at(since)).alias("before"), F.max(F.col("created_at") >= at(since)).alias("after"))
    found = by_user.agg(count_of(F.col("before") & ~F.col("after")).alias("churned_users"), count_of(F.col("before")).alias("previous_active"))
    return found.withColumn("churn_rate", ratio(F.col("churned_users"), F.col("previous_active")))


def dau_trend(log: DataFrame, p: Period) -> DataFrame:
    return in_period(log, p).where(registered()).groupBy(day().alias("date")).agg(F.count_distinct("user_id").alias("dau"))


def users_by(log: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """How many users have a row for which each condition holds: one aggregation by user with a flag each, so no row is multiplied."""
    flags = log.groupBy("user_id").agg(*(F.max(F.coalesce(c, F.lit(False))).alias(n) for n, c in conditions.items()))
    return flags.agg(*(count_of(F.col(n)).alias(n) for n in conditions))


def dau_wau_mau(log: DataFrame, now: datetime) -> DataFrame:
    start = now.replace(hour=0, minute=0, second=0, microsecond=0)
    t = F.col("created_at")
    since = {"dau": start, "wau": now - timedelta(days=7), "mau": now - timedelta(days=30)}
    return users_by(log.where(registered() & (t >= at(now - timedelta(days=30)))), {n: t >= at(s) for n, s in since.items()})


#: Days that one word of a set of days holds.
WORD_DAYS = 60


def day_words(since: date, days: int, condition: Column | None = None) -> list[Column]:
    """Aggregates: the days (from `since` to so many days later) of a group's rows for which the condition holds, as bits of a few words w0, w1, ..."""
    off = F.datediff("created_at", F.lit(since))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(off, F.lit(WORD_DAYS)).cast("int"))
    held = condition if condition is not None else F.lit(True)
    return [F.bit_or(F.when(held & (F.floor(off / WORD_DAYS) == w), bit).otherwise(F.lit(0).cast("long"))).alias(f"w{w}") for w in range(days // WORD_DAYS + 1)]


def on_day(off: Column, days: int) -> Column:
    """Whether the words that day_words made hold the day that is `off` days after the first."""
    words = range(days // WORD_DAYS + 1)
    return reduce(lambda a, b: a | b, ((F.floor(off / WORD_DAYS) == w) & (F.getbit(F.col(f"w{w}"), F.pmod(off, F.lit(WORD_DAYS)).cast("int")) == 1) for w in words))


def stickiness(log: DataFrame, p: Period) -> DataFrame:
    """Mean of the daily users over the days that have any, by the month's users.

    A user's days are bits of a few words, so one aggregation by user tells its days, and their union tells the period's.
    """
    words = day_words(p.since.date(), p.days)
    names = [f"w{i}" for i in range(len(words))]
    per_user = in_period(log, p).where(registered()).groupBy("user_id").agg(*words)
    own = reduce(lambda a, b: a + b, (F.bit_count(n) for n in names))
    found = per_user.agg(F.sum(own).alias("user_days"), F.count("*").alias("mau"), *(F.bit_or(n).alias(n) for n in names))
    return found.select(ratio(F.col("user_days"), own * F.col("mau")).alias("stickiness"))


def activation(log: DataFrame, p: Period) -> DataFrame:
    """Signed-up users with a job within 24 hours of a sign-up.

    Every (sign-up, job) pair of a user would be joined; a user's next job after each sign-up is enough, and a window finds it
    with one shuffle by user.
    """
    own = log.where(F.col("user_id").isNotNull() & is_type("user.signup", "job.created") & (F.col("created_at") >= at(p.since)) & (F.col("created_at") <= at(p.now + timedelta(hours=24))))
    ahead = Window.partitionBy("user_id").orderBy("created_at").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    job = F.when(is_type("job.created"), F.col("created_at"))
    marked = own.withColumn("next_job", F.min(job).over(ahead)).where(is_type("user.signup") & (F.col("created_at") < at(p.now)))
    soon = F.col("next_job") <= F.col("created_at") + F.expr("INTERVAL 24 HOURS")
    by_user = marked.groupBy("user_id").agg(F.max(F.coalesce(soon, F.lit(False))).alias("soon"))  # where the window has put a user's rows
    found = by_user.agg(F.count("*").alias("total_signups"), count_of(F.col("soon")).alias("activated"))
    return found.withColumn("activation_rate", ratio(F.col("activated"), F.col("total_signups")))


RETENTION = (1, 7, 30)


def retention_cohorts(log: DataFrame, p: Period) -> DataFrame:
    """By day of the first sign-up in the period: how many of its users were active 1, 7 and 30 days later, also after the period's end.

    Each user is in one cohort, so the users of a day are counted after one aggregation by user, which holds a user's days as bits.
    """
    since, days = p.since.date(), p.days + max(RETENTION)
    own = between(log, p.since, p.now + timedelta(days=max(RETENTION) + 1)).where(F.col("user_id").isNotNull() & (is_type("user.signup") | ~F.col("is_guest")))
    first = F.min(F.when(is_type("user.signup") & (F.col("created_at") < at(p.now)), F.col("created_at")))
    by_user = own.groupBy("user_id").agg(F.to_date(first).alias("cohort_date"), *day_words(since, days, ~F.col("is_guest"))).where("cohort_date IS NOT NULL")
    off = F.datediff("cohort_date", F.lit(since))
    return by_user.groupBy("cohort_date").agg(F.count("*").alias("cohort_size"), *(count_of(on_day(off + n, days)).alias(f"d{n}") for n in RETENTION))


def funnel(log: DataFrame, p: Period) -> DataFrame:
    own = in_period(log, p).where("user_id IS NOT NULL")
    steps = {"signed_up": "user.signup", "created_job": "job.created", "completed_job": "job.completed"}
    return users_by(own, {n: is_type(t) for n, t in steps.items()})


def repeat_users(log: DataFrame, p: Period) -> DataFrame:
    own = in_period(log, p).where(is_type("job.completed") & F.col("user_id").isNotNull())
    return own.groupBy("user_id").count().where("count >= 2").agg(F.count("*").alias("repeat_users"))


def exec_daily(log: DataFrame, p: Period) -> DataFrame:
    """Over both the period and the one before."""
    kinds = {"signups": "user.signup", "jobs_created": "job.created", "jobs_completed": "job.completed", "jobs_failed": "job.failed"}
    own = log.where(within("created_at", p.previous, p.now))
    return own.groupBy(day().alias("date")).agg(*(count_of(is_type(t)).alias(n) for n, t in kinds.items()), users_where(registered()).alias("dau"))


def current_days(log: DataFrame, p: Period) -> DataFrame:
    """exec_daily with `current`: the boundary day counts whole as current."""
    return exec_daily(log, p).withColumn("current", F.col("date") >= F.lit(p.since.date()))


def exec_period_totals(log: DataFrame, p: Period) -> DataFrame:
    def totals(prefix: str, own: Column) -> list[Column]:
        names = {"signups": "signups", "jobs": "jobs_created", "completed": "jobs_completed", "failed": "jobs_failed"}
        return [F.coalesce(F.sum(F.when(own, F.col(c))), F.lit(0)).alias(f"{prefix}_{n}") for n, c in names.items()]

    return current_days(log, p).agg(*totals("cur", F.col("current")), *totals("prev", ~F.col("current")))


def exec_success_spark(log: DataFrame, p: Period) -> DataFrame:
    done, failed = F.col("jobs_completed"), F.col("jobs_failed")
    return current_days(log, p).where("current").select("date", ratio(done, done + failed).alias("success_rate"))


def exec_active_users(log: DataFrame, p: Period) -> DataFrame:
    own = log.where(registered() & within("created_at", p.previous, p.now))
    return users_by(own, {"current": F.col("created_at") >= at(p.since), "previous": F.col("created_at") < at(p.since)})


def exec_total_users(log: DataFrame, p: Period) -> DataFrame:
    own = log.where(is_type("user.signup") & F.col("user_id").isNotNull() & (F.col("created_at") < at(p.now)))
    return users_by(own, {"current": F.lit(True), "previous": F.col("created_at") < at(p.since)})


def exec_total_spark(log: DataFrame, p: Period) -> DataFrame:
    """Running total of the sign-ups by day, from the users there were before. The window's rows are days, so few."""
    days = current_days(log, p).where("current").select("date", "signups")
    before = exec_total_users(log, p).select("previous")
    running = F.sum("signups").over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return days.withColumn("running", running).join(F.broadcast(before)).select("date", (F.col("running") + F.col("previous")).alias("total_users"))


def tool_trend_daily(log: DataFrame, p: Period) -> DataFrame:
    own = in_period(log, p).where(is_type("job.created") & (F.col("tool_type") != ""))
    return own.groupBy(day().alias("date"), "tool_type").agg(F.count("*").alias("count"))


def jobs_per_user(log: DataFrame, p: Period) -> DataFrame:
    """The users' job counts are counted first, so that the exact median needs no user's row in one place."""
    own = in_period(log, p).where(is_type("job.created") & F.col("user_id").isNotNull())
    counts = own.groupBy("user_id").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("users"))
    median = F.expr("percentile(n, 0.5, users)")
    mean = ratio(F.sum(F.col("n") * F.col("users")), F.sum("users"))
    return counts.agg(F.coalesce(mean, F.lit(0.0)).alias("average"), F.coalesce(F.round(median, 6), F.lit(0.0)).alias("median"))


def file_size_hist(log: DataFrame, p: Period) -> DataFrame:
    own = in_period(log, p).where("file_size > 0")
    return own.groupBy(size_bucket(F.col("file_size")).alias("bucket")).agg(F.count("*").alias("count"), F.min("file_size").alias("least")).orderBy("least").drop("least")


def guest_vs_registered(log: DataFrame, p: Period) -> DataFrame:
    found = in_period(log, p).agg(count_of(F.col("is_guest")).alias("guest_events"), count_of(registered()).alias("registered_events"), users_where(registered()).alias("unique_registered"))
    return found.withColumn("guest_ratio", ratio(F.col("guest_events"), F.col("guest_events") + F.col("registered_events")))


def power_users(log: DataFrame, p: Period) -> DataFrame:
    own = in_period(log, p).where(is_type("job.created", "job.completed") & F.col("user_id").isNotNull())
    return own.groupBy("user_id").agg(F.count("*").alias("job_count")).orderBy(F.desc("job_count"), "user_id").limit(20)


def job_success_rate(log: DataFrame, p: Period) -> DataFrame:
    found = in_period(log, p).where(is_type("job.completed", "job.failed")).agg(count_of(is_type("job.completed")).alias("completed"), count_of(is_type("job.failed")).alias("failed"))
    total = F.col("completed") + F.col("failed")
    return found.select("completed", "failed", total.alias("total"), ratio(F.col("completed"), total).alias("success_rate"))


def error_trend(log: DataFrame, p: Period) -> DataFrame:
    own = in_period(log, p).where(is_type("job.completed", "job.failed"))
    return own.groupBy(day().alias("date")).agg(count_of(is_type("job.failed")).alias("failures"), F.count("*").alias("total"))


def durations(log: DataFrame, p: Period, longest: timedelta | None = None) -> DataFrame:
    """created_at and microseconds of each created job with each completion of it; negative ones stay.

    With `longest`, only completions from a job's creation to so long after it count. They lie between the period's beginning and
    so long after its end, so the scan of a log that is partitioned by day reads these days only; without it, all of the log's.
    """
    jobs = log.where("job_id IS NOT NULL")
    made = in_period(jobs, p).where(is_type("job.created")).select("job_id", "created_at")
    done = jobs.where(is_type("job.completed"))
    if longest is not None:
        done = between(done, p.since, p.now + longest)
    done = done.select("job_id", F.col("created_at").alias("completed_at"))
    found = made.join(done, "job_id").select("created_at", F.expr("timestampdiff(MICROSECOND, created_at, completed_at)").alias("us"))
    return found if longest is None else found.where(F.col("us").between(0, longest // timedelta(microseconds=1)))


def seconds(us: Column) -> Column:
    return F.coalesce(F.round(us / 1e6, 6), F.lit(0.0))


def processing_time(log: DataFrame, p: Period, longest: timedelta | None = None) -> DataFrame:
    found = by_ranks(durations(log, p, longest), "us", (0.5, 0.95))
    mean = F.col("total").cast("double") / F.when(F.col("n") > 0, F.col("n"))
    return found.select(seconds(mean).alias("avg_seconds"), seconds(F.col("q0")).alias("p50_seconds"), seconds(F.col("q1")).alias("p95_seconds"))


def processing_time_trend(log: DataFrame, p: Period, longest: timedelta | None = None) -> DataFrame:
    """By the day the job was created on."""
    by_day = durations(log, p, longest).select(day().alias("date"), "us")
    return by_ranks(by_day, "us", (0.5, 0.95, 0.99), ["date"]).select("date", *(seconds(F.col(f"q{i}")).alias(n) for i, n in enumerate(("p50", "p95", "p99"))))


def tool_errors(log: DataFrame, p: Period) -> DataFrame:
    own = in_period(log, p).where(is_type("job.completed", "job.failed") & (F.col("tool_type") != ""))
    return own.groupBy("tool_type").agg(count_of(is_type("job.completed")).alias("completed"), count_of(is_type("job.failed")).alias("failed"))


def failure_categories(log: DataFrame, p: Period) -> DataFrame:
    own = in_period(log, p).where(is_type("job.failed"))
    return own.groupBy(day().alias("date"), failure_category(F.col("metadata")).alias("category")).agg(F.count("*").alias("count"))


def limit_hits_daily(log: DataFrame, p: Period) -> DataFrame:
    return in_period(log, p).where(is_type("plan.limit_hit")).groupBy(day().alias("date"), "plan_name").agg(F.count("*").alias("hits"))


def plans_told(log: DataFrame) -> DataFrame:
    return log.where(registered() & (F.col("plan_name") != ""))


def agg_plan_at(log: DataFrame, cutoff: datetime) -> DataFrame:
    """Users by the latest plan told before a time; the window keeps one row of a user before its shuffle."""
    latest = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("id"))
    own = plans_told(log).where(F.col("created_at") < at(cutoff)).withColumn("n", F.row_number().over(latest)).where("n = 1")
    return own.groupBy("plan_name").agg(F.count("*").alias("users"))


def mrr(log: DataFrame, p: Period, prices: dict[str, float] | None = None) -> DataFrame:
    """Revenue of a month and a year at the plans' prices, now and before the period."""
    prices = PRICES if prices is None else prices
    order = F.struct("created_at", "id")
    # each user's latest plan at both times, from one scan and one shuffle by user
    early = F.col("created_at") < at(p.since)
    plans = plans_told(log).where(F.col("created_at") < at(p.now)).groupBy("user_id").agg(F.max_by("plan_name", order).alias("now"), F.max_by("plan_name", F.when(early, order)).alias("before"))
    total = lambda c: F.coalesce(F.sum(price_of(F.col(c), prices)), F.lit(0.0))
    return plans.agg(total("now").alias("mrr"), (total("now") * 12).alias("arr"), total("before").alias("previous_mrr"))


def mrr_trend(log: DataFrame, p: Period, prices: dict[str, float] | None = None) -> DataFrame:
    """Revenue at the end of each day of the period, both its first and last included.

    A user's plan holds from one change to the next; that interval gives a gain where it begins and a loss where it ends, and
    a running sum over the days gives each day's level. No day is joined with the log.
    """
    prices = PRICES if prices is None else prices
    first, last = p.since.date(), p.now.date()
    order = Window.partitionBy("user_id").orderBy("created_at", "id")
    told = plans_told(log).where(F.col("created_at") < at(datetime.combine(last, datetime.min.time()) + timedelta(days=1)))
    price = price_of(F.col("plan_name"), prices)
    step = price - F.coalesce(F.lag(price).over(order), F.lit(0.0))
    deltas = told.select(F.greatest(day(), F.lit(first)).alias("date"), step.alias("step")).groupBy("date").agg(F.sum("step").alias("step"))
    days = log.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last))).alias("date"))
    running = F.sum(F.coalesce("step", F.lit(0.0))).over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return days.join(deltas, "date", "left").select("date", running.alias("mrr"))


def plan_change_direction(log: DataFrame, p: Period, prices: dict[str, float] | None = None) -> DataFrame:
    """A change to a plan of the same price counts as an upgrade."""
    prices = PRICES if prices is None else prices
    changes = plan_changes_daily(log, p)
    up = price_of(F.col("new_plan"), prices) >= price_of(F.col("old_plan"), prices)
    return changes.groupBy("date").agg(F.sum(F.when(up, F.col("count")).otherwise(0)).alias("upgrades"), F.sum(F.when(up, 0).otherwise(F.col("count"))).alias("downgrades"))


def signup_channels(log: DataFrame, start: datetime, end: datetime) -> DataFrame:
    return log.where(is_type("user.signup") & within("created_at", start, end)).select(day().alias("date"), channel(F.col("metadata")).alias("channel"))


def channel_daily(log: DataFrame, p: Period) -> DataFrame:
    return signup_channels(log, p.since, p.now).groupBy("date", "channel").agg(F.count("*").alias("signups"))


def channel_totals(log: DataFrame, p: Period) -> DataFrame:
    """The window's rows are channels, six at most."""
    totals = signup_channels(log, p.since, p.now).groupBy("channel").agg(F.count("*").alias("signups"))
    whole = F.sum("signups").over(Window.partitionBy())
    return totals.select("channel", "signups", ratio(F.col("signups") * 100, whole).alias("percent"))


def channel_previous(log: DataFrame, p: Period) -> DataFrame:
    return signup_channels(log, p.previous, p.since).groupBy("channel").agg(F.count("*").alias("signups"))


def top_referrers(log: DataFrame, p: Period) -> DataFrame:
    referrer = F.get_json_object("metadata", "$.referrer")
    own = in_period(log, p).where(is_type("user.signup") & (F.coalesce(referrer, F.lit("")) != ""))
    return own.groupBy(referrer.alias("referrer")).agg(F.count("*").alias("signups")).orderBy(F.desc("signups"), "referrer").limit(10)


def ingestion_hourly(log: DataFrame, now: datetime) -> DataFrame:
    own = log.where(F.col("created_at") >= at(now - timedelta(hours=24)))
    return own.groupBy(F.date_trunc("hour", "created_at").cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("count"))


def queue_throughput(log: DataFrame, now: datetime) -> DataFrame:
    own = log.where(F.col("created_at") >= at(now - timedelta(hours=24)))
    hours = own.groupBy(F.date_trunc("hour", "created_at").cast("timestamp_ntz").alias("time"))
    return hours.agg(F.count("*").alias("processed"), count_of(is_type("job.failed")).alias("failed")).withColumn("queued", F.lit(0).cast("long"))


def system_counters(log: DataFrame, now: datetime) -> DataFrame:
    t = F.col("created_at")
    return log.agg(
        count_of(t >= at(now - timedelta(hours=24))).alias("events_24h"),
        count_of(t >= at(now - timedelta(hours=1))).alias("events_1h"),
        users_where(registered() & (t >= at(now - timedelta(minutes=5)))).alias("active_5m"),
        F.count("*").alias("total"),
    )


def processing_lag(log: DataFrame, now: datetime) -> DataFrame:
    """Seconds between an event and its row; a year-one timestamp stands for none."""
    own = log.where((F.col("created_at") >= at(now - timedelta(hours=1))) & F.col("persisted_at").isNotNull() & (F.col("persisted_at") > at(datetime(1, 1, 1))))
    us = own.select(F.expr("timestampdiff(MICROSECOND, created_at, persisted_at)").alias("us"))
    mean = F.round(F.sum("us").cast("double") / F.count("*") / 1e6, 6)
    return us.agg(F.coalesce(mean, F.lit(0.0)).alias("avg_lag_seconds"), F.coalesce(F.max("us") / 1e6, F.lit(0.0)).alias("max_lag_seconds"))


def page_events(log: DataFrame, kind: str | None = None, page: int = 1, limit: int = 50) -> DataFrame:
    """Newest first; pages from 1, at most 200 rows each."""
    limit, page = min(max(1, limit), 200), max(1, page)
    own = log.where(is_type(kind)) if kind else log
    return own.orderBy(F.desc("created_at"), F.desc("id")).offset((page - 1) * limit).limit(limit)


def count_page_total(log: DataFrame, kind: str | None = None) -> DataFrame:
    return (log.where(is_type(kind)) if kind else log).agg(F.count("*").alias("total"))
