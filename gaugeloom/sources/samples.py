"""Samples: tall rows (monitor, entity_id, metric, ts, value), and how tables become samples."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_SCHEMA = "monitor string, entity_id string, metric string, ts long, value double"


@dataclass(frozen=True)
class Source:
    """What a source of samples declares: its entities' kind, metrics with kind (gauge or counter) and unit, attributes."""

    name: str
    entity_kind: str
    metrics: dict[str, tuple[str, str]]
    attrs: tuple[str, ...] = ()


def _gauges(unit: str, *names: str) -> dict[str, tuple[str, str]]:
    return {n: ("gauge", unit) for n in names}


#: The data contract of each source.
SOURCES = {
    s.name: s
    for s in (
        Source("process", "process", _gauges("percent", "cpu_pct") | _gauges("bytes", "rss_bytes") | _gauges("count", "num_fds", "fd_limit_soft", "num_threads") | {"io_read_bytes": ("counter", "bytes"), "io_write_bytes": ("counter", "bytes")}, ("name", "cmdline", "username", "exe", "exe_base", "display", "cmd_hint")),
        Source("disk", "mount", _gauges("bytes", "total_bytes", "used_bytes", "free_bytes") | _gauges("percent", "used_pct", "inode_used_pct"), ("fstype", "device", "mountpoint", "readonly", "mount_options")),
        Source("system", "host", _gauges("load", "load1", "load5", "load15") | _gauges("percent", "cpu_pct", "swap_used_pct", "psi_some_cpu", "psi_some_mem", "psi_some_io") | _gauges("bytes", "mem_total_bytes", "mem_used_bytes", "mem_available_bytes"), ("hostname",)),
        Source("net", "endpoint", _gauges("count", "present", "conn_total", "conn_established", "conn_time_wait", "conn_listen"), ("proto", "port")),
        Source("unit", "unit", _gauges("count", "present") | {"restarts": ("counter", "count")}, ("unit", "kind")),
        Source("external", "check", _gauges("count", "plugin_state", "plugin_ok") | _gauges("seconds", "duration_s"), ("plugin_message",)),
        Source("events", "event", _gauges("count", "severity"), ("provider", "event_id", "message", "source")),
    )
}


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))


def last_write(samples: DataFrame, order: str) -> DataFrame:
    """One row a (monitor, entity_id, metric, ts): the value of the greatest ``order``."""
    return samples.groupBy("monitor", "entity_id", "metric", "ts").agg(F.max_by("value", order).alias("value"))


def epoch(ts: Column) -> Column:
    """Whole seconds; the session's time zone must be UTC for timestamps without zone."""
    return F.unix_seconds(ts.cast("timestamp"))


def deal(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` by ``keys`` over all shuffle partitions. Left to itself, Spark joins partitions by their packed size, and what a task
    then sorts or groups in memory is many times that."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def samples_from_events(events: DataFrame, entity: str = "event_type", dealt: bool = False) -> DataFrame:
    """Event values as samples of monitor 'events', an entity for each ``entity``; values that aren't finite are left out.

    dealt: rows go by entity to all shuffle partitions first and stay there, so that windows by entity need no further shuffle, and no task
    groups more than its part. For many entities.
    """
    rows = events.where(finite(F.col("value"))).select(
        F.lit("events").alias("monitor"), F.col(entity).cast("string").alias("entity_id"), F.lit("value").alias("metric"), epoch(F.col("ts")).alias("ts"), F.col("value"), F.col("event_id").alias("seq")
    )
    return last_write(deal(rows, "entity_id") if dealt else rows, "seq")


def log_from_events(events: DataFrame) -> DataFrame:
    """Event rows as log events: (id, ts, source, provider, event_id, severity, message)."""
    severity = F.when(F.col("event_type") == "error", 3).when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "signup", 1).otherwise(0)
    message = F.concat(F.col("event_type"), F.lit(" by user "), F.col("user_id").cast("string"), F.lit(" "), F.col("props"))
    return events.select(
        F.col("event_id").alias("id"), epoch(F.col("ts")).alias("ts"), F.lit("app").alias("source"), F.col("event_type").alias("provider"),
        F.when(F.col("event_type") == "error", F.lit("E1")).alias("event_id"), severity.alias("severity"), message.alias("message"),
    )


def series_of(samples: DataFrame, durable_monitors: tuple[str, ...] = ("system", "disk", "self")) -> DataFrame:
    """A row for each series: its id, key, and whether its history is kept long."""
    keys = samples.select("monitor", "entity_id", "metric").distinct()
    return keys.select(F.xxhash64("monitor", "entity_id", "metric").alias("series_id"), "monitor", "entity_id", "metric", F.col("monitor").isin(*durable_monitors).alias("durable"))


def watch(expected: DataFrame, observed: DataFrame, on: list[str]) -> DataFrame:
    """Each expected target with present = 1 where it was observed at its tick, else 0."""
    seen = observed.select(*on).distinct().withColumn("_seen", F.lit(1.0))
    return expected.join(seen, on, "left").withColumn("present", F.coalesce("_seen", F.lit(0.0))).drop("_seen")


def connection_counts(connections: DataFrame, keys: list[str]) -> DataFrame:
    """Per key, connections by state."""
    state = F.col("status")
    return connections.groupBy(*keys).agg(F.count("*").alias("conn_total"), F.count_if(state == "ESTABLISHED").alias("conn_established"), F.count_if(state == "TIME_WAIT").alias("conn_time_wait"), F.count_if(state == "LISTEN").alias("conn_listen"))


def state_in_force(ticks: DataFrame, lines: DataFrame, keys: list[str], payload: str) -> DataFrame:
    """As-of: for each tick (keys, ts) the payload of the key's last line with at <= ts; null before the first.

    One sort of both together, so a line that holds for very many ticks isn't joined with each.
    """
    from pyspark.sql import Window as W

    null = F.lit(None).cast(lines.schema[payload].dataType)
    both = lines.select(*keys, F.col("at").alias("ts"), F.col(payload), F.lit(0).alias("_tick")).unionByName(ticks.select(*keys, "ts", null.alias(payload), F.lit(1).alias("_tick")))
    order = W.partitionBy(*keys).orderBy("ts", "_tick").rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn(payload, F.last(payload, ignorenulls=True).over(order)).where("_tick = 1").drop("_tick")
