"""Rollups and learned baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SERIES = ["monitor", "entity_id", "metric"]
FIVE, HOUR, SLACK = 300, 3600, 30
#: A baseline's half-life, and the updates from which it counts as learned.
HALF_LIFE, READY = 3 * 86400.0, 240


def bucket(ts: Column, width: int) -> Column:
    return F.floor(ts / width) * width


def rollup_5m(samples: DataFrame, now: int | None = None) -> DataFrame:
    """avg, min, max, last and cnt of each series and five minutes; with ``now``, of complete buckets only."""
    rows = samples.withColumn("bucket", bucket(F.col("ts"), FIVE))
    if now is not None:
        rows = rows.where(F.col("bucket") < (now - SLACK) // FIVE * FIVE)
    return rows.groupBy(*SERIES, "bucket").agg(F.avg("value").alias("avg"), F.min("value").alias("min"), F.max("value").alias("max"), F.max_by("value", "ts").alias("last"), F.count("*").alias("cnt"))


def rollup_1h(fives: DataFrame) -> DataFrame:
    """Hours from five-minute rows: the mean is weighted by their counts, the last is the last bucket's."""
    rows = fives.withColumn("hour", bucket(F.col("bucket"), HOUR))
    return rows.groupBy(*SERIES, "hour").agg(
        (F.sum(F.col("avg") * F.col("cnt")) / F.sum("cnt")).alias("avg"), F.min("min").alias("min"), F.max("max").alias("max"), F.max_by("last", "bucket").alias("last"), F.sum("cnt").alias("cnt")
    ).withColumnRenamed("hour", "bucket")


def baselines(fives: DataFrame, half_life: float = HALF_LIFE) -> DataFrame:
    """The exponentially weighted level after each present bucket: rows with level, updates and ready.

    The first mean seeds it; then level += a * (mean - level), a = 1 - 2 ** (-300 / half_life). As a closed form,
    level_n = q ** n * sum of mean_k * w_k with q = 1 - a: a running sum. Weights are taken relative to blocks of
    1024 half-life-scaled steps, so that they stay within doubles however long the series is.
    """
    q = 2.0 ** (-FIVE / half_life)
    order = W.partitionBy(*SERIES).orderBy("bucket")
    steps = max(1, int(512 * half_life / FIVE))  # weights within a block reach 2 ** 512 at most
    rows = fives.select(*SERIES, "bucket", "avg", F.row_number().over(order).alias("updates"))
    rows = rows.withColumn("_block", F.floor((F.col("updates") - 1) / steps)).withColumn("_at", (F.col("updates") - 1) % steps + 1)
    weight = F.when(F.col("updates") == 1, F.pow(F.lit(q), F.lit(-1.0))).otherwise((1 - q) * F.pow(F.lit(q), -F.col("_at").cast("double")))
    within = W.partitionBy(*SERIES, "_block").orderBy("bucket")
    rows = rows.withColumn("_own", F.pow(F.lit(q), F.col("_at").cast("double")) * F.sum(F.col("avg") * weight).over(within))
    # what earlier blocks leave: each block's end, faded by the blocks after it; but the last, all are under 2 ** -512
    ends = rows.where(F.col("_at") == steps).select(*SERIES, (F.col("_block") + 1).alias("_block"), F.col("_own").alias("_carried"))
    rows = rows.join(ends, [*SERIES, "_block"], "left")
    level = F.col("_own") + F.coalesce(F.col("_carried") * F.pow(F.lit(q), F.col("_at").cast("double")), F.lit(0.0))
    return rows.select(*SERIES, "bucket", "avg", level.alias("level"), "updates", (F.col("updates") >= READY).alias("ready"), F.least(F.col("updates") / READY, F.lit(1.0)).alias("coverage"))


def latest_baselines(history: DataFrame) -> DataFrame:
    """The newest row of each series."""
    newest = F.max_by(F.struct("bucket", "level", "updates", "ready", "coverage"), "bucket").alias("b")
    return history.groupBy(*SERIES).agg(newest).select(*SERIES, "b.*")


def with_baseline(samples: DataFrame, history: DataFrame) -> DataFrame:
    """Samples with the ready level of the latest bucket that was complete at their time, else null."""
    level = F.when(F.col("ready"), F.col("level"))
    known = history.select(*SERIES, (F.col("bucket") + FIVE).alias("ts"), F.struct(level.alias("level")).alias("_b"), F.lit(None).cast("double").alias("value"), F.lit(0).alias("_sample"))
    rows = samples.select(*SERIES, "ts", F.lit(None).cast(known.schema["_b"].dataType).alias("_b"), "value", F.lit(1).alias("_sample"))
    order = W.partitionBy(*SERIES).orderBy("ts", "_sample").rowsBetween(W.unboundedPreceding, 0)
    both = known.unionByName(rows).withColumn("baseline", F.last("_b", ignorenulls=True).over(order)["level"])
    return both.where("_sample = 1").select(*SERIES, "ts", "value", "baseline")


def baselines_back(current: DataFrame, fives: DataFrame, start: int, end: int) -> DataFrame:
    """Earlier levels of baselines from the present ones, by the recurrence turned round: level before = (level - a * mean) / (1 - a).

    current: (series, bucket, level, updates, half_life), the present state of each; fives: the five-minute rows that are
    kept. Rows (series, bucket, level, truncated) with start <= bucket <= end; truncated where the rows don't reach back to
    ``start`` and not to the first update either. Without the present bucket's row only the present state is known.

    With q = 1 - a, the level k buckets back is q ** -k * (level - a * sum of mean_j * q ** j for j < k): a running sum from the newest back.
    """
    q = F.pow(F.lit(2.0), -F.lit(float(FIVE)) / F.col("half_life"))
    own = current.select(*SERIES, F.col("bucket").alias("_now"), F.col("level").alias("_level"), "updates", "half_life")
    kept = fives.select(*SERIES, "bucket", "avg").join(own, SERIES, "right").where(F.col("bucket").isNull() | (F.col("bucket") <= F.col("_now")))
    # the present state is a row even where its bucket's mean is gone
    absent = own.join(fives.select(*SERIES, F.col("bucket").alias("_now")), [*SERIES, "_now"], "left_anti")
    held = kept.where("bucket is not null").join(absent.select(*SERIES), SERIES, "left_anti")
    alone = absent.select(*SERIES, F.col("_now").alias("bucket"), F.lit(None).cast("double").alias("avg"), "_now", "_level", "updates", "half_life")
    back = W.partitionBy(*SERIES).orderBy(F.desc("bucket"))
    rows = held.unionByName(alone).withColumn("_k", F.row_number().over(back) - 1).where(F.col("_k") < F.greatest("updates", F.lit(1)))
    weighted = F.col("avg") * F.pow(q, F.col("_k").cast("double"))
    before = F.coalesce(F.sum(weighted).over(back.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rows = rows.withColumn("level", F.when(F.col("_k") == 0, F.col("_level")).otherwise((F.col("_level") - (1 - q) * before) / F.pow(q, F.col("_k").cast("double"))))
    every = W.partitionBy(*SERIES)
    seed = F.max("_k").over(every) + 1 >= F.col("updates")
    first = -(-start // FIVE) * FIVE
    rows = rows.withColumn("truncated", (F.min("bucket").over(every) > first) & ~seed)
    return rows.where(F.col("bucket").between(start, end)).select(*SERIES, "bucket", "level", "truncated")
