"""Lists, searches and summaries over what is stored."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Seconds between two runs of an action.
ACTION_EVERY = 600
#: The order of tiles by state.
TILE_ORDER = ["error", "warning", "unknown", "config-error", "disabled", "clear"]


def find_entities(entities: DataFrame, text: str, n: int = 20) -> DataFrame:
    """Entities 'name:pid:start' by pid, where the text is digits, else by part of the name; the newest n."""
    wanted = F.col("entity_id").contains(f":{text}:") if text.isdigit() else F.contains(F.lower("entity_id"), F.lit(text.lower()))
    return entities.where(wanted).orderBy(F.desc("last_seen"), "entity_id").limit(n)


def list_events(log: DataFrame, start: int, end: int, least_severity: int = 0, provider: str | None = None, n: int = 200) -> DataFrame:
    """The newest n events of a range."""
    rows = log.where(F.col("ts").between(start, end) & (F.col("severity") >= least_severity))
    rows = rows if provider is None else rows.where(F.col("provider") == provider)
    return rows.orderBy(F.desc("ts"), F.desc("id")).limit(n)


def list_incidents(incidents: DataFrame, state: str | None = None, monitor: str | None = None, since: int | None = None) -> DataFrame:
    if state is not None:
        incidents = incidents.where(F.col("state") == state)
    if monitor is not None:
        incidents = incidents.where(F.col("monitor") == monitor)
    if since is not None:
        incidents = incidents.where(F.col("last_change_ts") >= since)
    return incidents


def overlapping(incidents: DataFrame, start: int, end: int) -> DataFrame:
    """Incidents that were open at some time of the range."""
    return incidents.where((F.col("cleared_ts").isNull() | (F.col("cleared_ts") >= start)) & (F.col("opened_ts") <= end))


def list_entities(entities: DataFrame, alive_only: bool = False, seen_since: int | None = None) -> DataFrame:
    rows = entities.where("gone_ts is null") if alive_only else entities
    return rows if seen_since is None else rows.where(F.col("last_seen") >= seen_since)


def cohort(series: DataFrame, monitor: str, metric: str) -> DataFrame:
    """One row: how many series a monitor's metric has, and whether all are durable (null for none)."""
    return series.where((F.col("monitor") == monitor) & (F.col("metric") == metric)).agg(F.count("*").alias("series"), F.min("durable").alias("durable"))


def point_counts(samples: DataFrame, start: int, end: int, most: int) -> DataFrame:
    """Points of each entity in a range, counted up to ``most``."""
    rows = samples.where(F.col("ts").between(start, end)).groupBy("entity_id").agg(F.count("*").alias("n"))
    return rows.select("entity_id", F.least("n", F.lit(most)).alias("points"))


def y_domain(points: DataFrame, keys: list[str], pad: float = 0.05) -> DataFrame:
    """Least and greatest value with a margin; 1 where all are equal."""
    rows = points.groupBy(*keys).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    margin = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) * pad).otherwise(1.0)
    return rows.select(*keys, (F.col("lo") - margin).alias("lo"), (F.col("hi") + margin).alias("hi"))


def status(samples: DataFrame, incidents: DataFrame, now: int) -> DataFrame:
    """One row: age of the last tick, samples, open incidents, and the exit code that their severities ask for."""
    ticks = samples.agg((F.lit(now) - F.max("ts")).alias("tick_age"), F.count("*").alias("samples"))
    live = incidents.where("state = 'open'").agg(F.count("*").alias("open_incidents"), F.coalesce(F.max("peak_severity"), F.lit(-1)).alias("_worst"))
    code = F.when(F.col("_worst") >= 3, 2).when(F.col("_worst") >= 0, 1).otherwise(0)
    return ticks.withColumn("_k", F.lit(1)).join(live.withColumn("_k", F.lit(1)), "_k").withColumn("exit_code", code).drop("_k", "_worst")


def dashboard(health: DataFrame) -> DataFrame:
    """One row over (monitor, health): attention, clear, disabled."""
    state = F.col("health")
    return health.agg(F.count_if(state.isin("error", "warning", "unknown", "config-error")).alias("attention"), F.count_if(state == "clear").alias("clear"), F.count_if(state == "disabled").alias("disabled"))


def tiles(health: DataFrame) -> DataFrame:
    """Monitors in the order of their tiles: place, monitor, health."""
    rank = F.array_position(F.array(*map(F.lit, TILE_ORDER)), F.col("health"))
    return health.withColumn("place", F.row_number().over(W.orderBy(rank, "monitor")))  # a row a monitor


def thin(points: DataFrame, every: int, keys: list[str]) -> DataFrame:
    """Each ``every``-th point, with both ends and the points beside a change between null and not."""
    order = W.partitionBy(*keys).orderBy("ts")
    null = F.col("value").isNull()
    edge = F.coalesce(null != F.lag(null).over(order), F.lit(True)) | F.coalesce(null != F.lead(null).over(order), F.lit(True))
    rows = points.withColumn("_keep", edge | ((F.row_number().over(order) - 1) % every == 0))
    return rows.where("_keep").drop("_keep")


def sparse(samples: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Keys with fewer points than they should have."""
    return samples.groupBy(*keys).agg(F.count("*").alias("points")).where(F.col("points") < least)


def expire_gone(hours: DataFrame, entities: DataFrame, now: int, after: int = 7 * 86400) -> DataFrame:
    """Hourly rows without those of entities gone for longer than ``after``."""
    gone = entities.where(F.col("gone_ts") < now - after)
    return hours.join(gone, ["monitor", "entity_id"], "left_anti")


def overflow_episodes(dropped: DataFrame, keys: list[str]) -> DataFrame:
    """dropped: (keys, ts, dropped: a growing count). Runs of ticks in which it grew: start, end, and how many were lost."""
    order = W.partitionBy(*keys).orderBy("ts")
    rows = dropped.withColumn("lost", F.col("dropped") - F.coalesce(F.lag("dropped").over(order), F.lit(0)))
    rows = rows.withColumn("_calm", F.sum((F.col("lost") <= 0).cast("int")).over(order)).where("lost > 0")
    return rows.groupBy(*keys, "_calm").agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.sum("lost").alias("lost")).drop("_calm")


def empty_reason(known: Column, has_data: Column, kept: Column) -> Column:
    """Why a response has no rows; null where it has."""
    return F.when(~known, "unknown_metric").when(~has_data, "no_data_in_range").when(~kept, "filtered_out")


def payload(kind: Column, monitor: Column, entity: Column, severity: Column, title: Column, ts: Column) -> Column:
    """A notification as the JSON text that a web hook gets."""
    return F.to_json(F.struct(kind.alias("kind"), monitor.alias("monitor"), entity.alias("entity"), severity.alias("severity"), title.alias("title"), ts.alias("ts")))


def recovery(log: DataFrame, samples: DataFrame) -> DataFrame:
    """One row: oldest sample, last degradation, and degradations after it began to be kept."""
    oldest = samples.agg(F.min("ts").alias("oldest"))
    told = log.where(F.col("message").like("degraded:%")).agg(F.max("ts").alias("last_degraded"), F.count("*").alias("degradations"))
    return oldest.withColumn("_k", F.lit(1)).join(told.withColumn("_k", F.lit(1)), "_k").drop("_k")


def action_step(last: int | None, ts: int, every: int = ACTION_EVERY) -> tuple[int, bool]:
    """Whether an action may run at ``ts``, and its last run after that."""
    runs = last is None or ts - last >= every
    return (ts if runs else last), runs


def action_runs(asked: DataFrame, every: int = ACTION_EVERY) -> DataFrame:
    """asked: (action, ts). Adds ``ran``: each action at most once in ``every`` seconds; folded as rows stream by."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        action, last = None, None
        for pdf in batches:
            ran = []
            for r in pdf.itertuples(index=False):
                if r.action != action:
                    action, last = r.action, None
                last, ok = action_step(last, r.ts, every)
                ran.append(ok)
            yield pdf.assign(ran=ran)

    dealt = asked.select("action", "ts").repartition("action").sortWithinPartitions("action", "ts")
    return dealt.mapInPandas(work, "action string, ts long, ran boolean")
