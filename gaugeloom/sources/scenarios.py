"""Scenario streams: JSON lines of states in force and of events; and generators of test scenarios."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINE = "at double, source string, entities array<struct<entity_id:string,attrs:map<string,string>,metrics:map<string,double>>>, event struct<source:string,provider:string,event_id:string,severity:int,message:string>"


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(states, events) of a scenario; a line without ``at``, or with neither shape, is an error."""
    lines = spark.read.schema(LINE).json(path)
    wrong = F.col("at").isNull() | (F.col("entities").isNull() & F.col("event").isNull())
    checked = lines.withColumn("at", F.when(wrong, F.raise_error(F.lit("a scenario line has 'at' and a state or an event"))).otherwise(F.col("at")))
    return checked.where("entities is not null").select("at", "source", "entities"), checked.where("event is not null").select("at", "event.*")


def samples_at(states: DataFrame, ticks: DataFrame) -> DataFrame:
    """States in force at ticks (source, ts) as samples (source, ts, entity_id, metric, value)."""
    from gaugeloom.sources.samples import state_in_force

    held = state_in_force(ticks, states, ["source"], "entities")
    each = held.select("source", "ts", F.explode("entities").alias("e"))
    return each.select("source", "ts", "e.entity_id", F.explode("e.metrics").alias("metric", "value"))


def ramp(spark: SparkSession, monitor: str, entity: str, metric: str, ticks: int, interval: int, start: float, per_tick: float) -> DataFrame:
    """A steadily rising metric."""
    i = F.col("id")
    return spark.range(ticks).select(F.lit(monitor).alias("monitor"), F.lit(entity).alias("entity_id"), F.lit(metric).alias("metric"), (i * interval).alias("ts"), (F.lit(start) + i * per_tick).alias("value"))


def sawtooth(spark: SparkSession, monitor: str, entity: str, metric: str, ticks: int, interval: int, start: float, per_tick: float, period: int) -> DataFrame:
    """A metric that rises and falls back each ``period`` ticks."""
    return ramp(spark, monitor, entity, metric, ticks, interval, start, per_tick).withColumn("value", F.lit(start) + F.floor(F.col("ts") / interval) % period * per_tick)


def churn(spark: SparkSession, monitor: str, ticks: int, interval: int, stay: int, change: int) -> DataFrame:
    """Ticks with ``stay`` entities that last and ``change`` that are new at each."""
    tick = spark.range(ticks).select((F.col("id") * interval).alias("ts"))
    lasting = tick.select("ts", F.explode(F.sequence(F.lit(1), F.lit(stay))).alias("n")).select("ts", F.concat(F.lit("stay:"), F.col("n").cast("string")).alias("entity_id"))
    passing = tick.select("ts", F.explode(F.sequence(F.lit(1), F.lit(change))).alias("n")).select("ts", F.concat(F.lit("new:"), F.col("ts").cast("string"), F.lit(":"), F.col("n").cast("string")).alias("entity_id"))
    return lasting.union(passing).select(F.lit(monitor).alias("monitor"), "entity_id", F.lit("cpu_pct").alias("metric"), "ts", F.lit(1.0).alias("value"))
