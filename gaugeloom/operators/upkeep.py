"""Upkeep of what is stored: lifecycles, retention, size budgets, orphans, delivery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugeloom.functions.scalar import during, severity_name

DAY = 86400
#: Seconds that rows are kept: of durable series, of others.
KEEP = {"raw": (2 * DAY, 2 * DAY), "5m": (30 * DAY, 7 * DAY), "1h": (400 * DAY, 90 * DAY), "events": (30 * DAY, 30 * DAY)}
#: Seconds of raw samples (step 1) and events (step 2) that a tight budget leaves alone.
GUARDS = {1: DAY, 2: 7 * DAY}
RETRY = (30, 120, 600, 3600, 21600)
LIFETIME = DAY
HISTORY_MOST, HISTORY_FOLD = 500, 100


def prune(rows: DataFrame, kind: str, now: int, ts: str = "ts", durable: Column | None = None) -> DataFrame:
    """Rows young enough for their retention class."""
    long, short = KEEP[kind]
    keep = F.when(durable, F.lit(long)).otherwise(F.lit(short)) if durable is not None else F.lit(short)
    return rows.where(F.col(ts) >= F.lit(now) - keep)


def lifecycle(samples: DataFrame, now: int, grace: int = 300) -> DataFrame:
    """first_seen, last_seen and gone_ts of each entity; gone_ts is null while it is present."""
    rows = samples.groupBy("monitor", "entity_id").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    return rows.withColumn("gone_ts", F.when(F.lit(now) - F.col("last_seen") > grace, F.col("last_seen") + grace + 1))


def reap(entities: DataFrame, observations: DataFrame, incidents: DataFrame) -> DataFrame:
    """Gone entities without any observation left and without an incident that isn't cleared."""
    live = incidents.where("state <> 'cleared'")
    key = ["monitor", "entity_id"]
    return entities.where("gone_ts is not null").join(observations, key, "left_anti").join(live, key, "left_anti")


def orphans(child: DataFrame, parent: DataFrame, on: list[str]) -> DataFrame:
    return child.join(parent, on, "left_anti")


def attribution(entities: DataFrame, series: DataFrame) -> DataFrame:
    """Per monitor of either table, entities present and gone, and series; with the number of monitors."""
    names = entities.select("monitor").union(series.select("monitor")).distinct()
    e = entities.groupBy("monitor").agg(F.count_if(F.col("gone_ts").isNull()).alias("present"), F.count_if(F.col("gone_ts").isNotNull()).alias("gone"))
    s = series.groupBy("monitor").agg(F.count("*").alias("series"))
    rows = names.join(e, "monitor", "left").join(s, "monitor", "left").na.fill(0, ["present", "gone", "series"])
    return rows.withColumn("monitors", F.count("*").over(W.partitionBy()))


def health(state: Column, problem: Column, unknown: Column, disabled: Column) -> Column:
    """A monitor's state: config-error, unknown, disabled, error, warning or clear, the first that holds. state: greatest open severity, null without open incidents."""
    return F.when(problem, "config-error").when(unknown, "unknown").when(disabled, "disabled").when(state >= 3, "error").when(state.isNotNull(), "warning").otherwise("clear")


def fold_history(history: DataFrame, keys: list[str], most: int = HISTORY_MOST, fold: int = HISTORY_FOLD) -> DataFrame:
    """Histories longer than ``most`` have their oldest ``fold`` rows made one: kind 'collapsed', count, ts range, severity range."""
    order = W.partitionBy(*keys).orderBy("seq")
    rows = history.withColumn("_nth", F.row_number().over(order)).withColumn("_n", F.count("*").over(W.partitionBy(*keys)))
    old = (F.col("_n") > most) & (F.col("_nth") <= fold)
    one = rows.where(old).groupBy(*keys).agg(F.min("seq").alias("seq"), F.min("ts").alias("ts"), F.max("ts").alias("last_ts"), F.count("*").alias("count"), F.min("severity").alias("severity_min"), F.max("severity").alias("severity"))
    rest = rows.where(~old).select(*keys, "seq", "ts", F.col("ts").alias("last_ts"), F.lit(1).cast("long").alias("count"), F.col("severity").alias("severity_min"), "severity", "kind")
    return rest.unionByName(one.withColumn("kind", F.lit("collapsed")))


def degrade(days: DataFrame, budget: int, now: int | None = None) -> DataFrame:
    """days: (step, day, bytes), what may go, by step then day. Marks ``dropped`` the least that brings the total under the budget.

    With ``now``, steps are 1 raw samples, 2 events, 3 five-minute and 4 hourly rows, and days of the first two stay whole
    that reach into the last 24 hours or 7 days (GUARDS); their bytes count all the same.
    """
    may = F.lit(True)
    if now is not None:
        guard = F.when(F.col("step") == 1, GUARDS[1]).when(F.col("step") == 2, GUARDS[2])
        may = guard.isNull() | ((F.col("day") + 1) * DAY <= F.lit(now) - guard)
    order = W.orderBy("step", "day")  # a row a table and day
    over = F.sum("bytes").over(W.partitionBy()) - budget
    freed = F.when(may, F.col("bytes")).otherwise(0)
    return days.withColumn("dropped", may & F.coalesce(F.sum(freed).over(order) - freed < over, F.lit(False)))


def fan_out(notifications: DataFrame, channels: DataFrame) -> DataFrame:
    """A delivery for each notification and channel that takes its severity; 'file' takes all. Channels are a small configured table."""
    small = F.broadcast(channels) if channels.count() <= 1000 else channels
    return notifications.join(small, (F.col("severity") >= F.col("min_severity")) | (F.col("channel") == "file")).select("notification_id", "ts", "severity", "title", "channel")


def next_attempt(ts: Column, attempts: Column, retry_after: Column, created: Column) -> Column:
    """When to try again: a step of the schedule, or later if the receiver says so; null past the lifetime."""
    wait = F.element_at(F.array(*map(F.lit, RETRY)), F.least(F.greatest(attempts, F.lit(1)), F.lit(len(RETRY))).cast("int"))
    at = ts + F.greatest(wait, F.coalesce(retry_after, F.lit(0)))
    return F.when(at - created <= LIFETIME, at)


def quiet(ts: Column, window: str) -> Column:
    return during(ts, window)


#: Characters of a notification's body.
BODY = 200


def digest(deliveries: DataFrame, window: str) -> DataFrame:
    """deliveries: (channel, notification_id, ts, severity, title). One digest a night (by the day on which its quiet hours begin)
    of what they hold back, severities up to warning, for all channels that any of it is for: day, n (notifications, each once),
    severity (the worst), title, body (the worst severity's name and the titles by time, cut like any body), channels.
    """
    held = deliveries.where(quiet(F.col("ts"), window) & (F.col("severity") <= 2))
    begins = (int(window[:2]) * 60 + int(window[3:5])) * 60
    held = held.withColumn("day", F.floor((F.col("ts") - begins) / DAY))
    notes = held.groupBy("day", "notification_id").agg(F.min("ts").alias("ts"), F.max("severity").alias("severity"), F.min("title").alias("title"))
    nights = notes.groupBy("day").agg(F.count("*").alias("n"), F.max("severity").alias("severity"))
    # each title takes two characters of the body at least, so later ones can't stand in it
    nth = F.row_number().over(W.partitionBy("day").orderBy("ts", "notification_id"))
    first = notes.withColumn("_nth", nth).where(F.col("_nth") <= BODY // 2)
    titles = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_nth", "title"))), lambda x: x["title"]), "; ")
    shown = first.groupBy("day").agg(titles.alias("_titles"))
    asked = held.groupBy("day").agg(F.array_sort(F.collect_set("channel")).alias("channels"))
    rows = nights.join(shown, "day").join(asked, "day")
    title = F.concat(F.col("n").cast("string"), F.lit(" notification(s) held during quiet hours"))
    body = F.substring(F.concat(F.lit("worst: "), severity_name(F.col("severity")), F.lit(" — "), F.col("_titles")), 1, BODY)
    return rows.select("day", "n", "severity", title.alias("title"), body.alias("body"), "channels")


def backlog(deliveries: DataFrame, now: int, window: str) -> DataFrame:
    """deliveries: (channel, state, next_ts, severity, ts). Per channel: pending, due, quiet_held, failed, oldest_age."""
    pending = F.col("state") == "pending"
    held = pending & quiet(F.lit(now), window) & (F.col("severity") <= 2)
    return deliveries.groupBy("channel").agg(
        F.count_if(pending).alias("pending"), F.count_if(pending & ~held & (F.col("next_ts") <= now)).alias("due"), F.count_if(held).alias("quiet_held"),
        F.count_if(F.col("state") == "failed").alias("failed"), F.max(F.when(pending, F.lit(now) - F.col("ts"))).alias("oldest_age"),
    )
