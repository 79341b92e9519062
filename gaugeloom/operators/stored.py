"""Tables that are kept up in place: rollups that catch up with new samples, and pruning that leaves other files alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeloom.operators import rollup
from gaugeloom.operators.upkeep import DAY, KEEP

HOUR = rollup.HOUR


def _path(spark: SparkSession, text: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(text)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, text: str) -> bool:
    where, fs = _path(spark, text)
    return fs.exists(where)


def _put(rows: DataFrame, path: str, by: str) -> None:
    """Write the partitions that ``rows`` has, and leave all others as they are."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def cursor(spark: SparkSession, root: str) -> int:
    """The last ``seq`` that the rollups under ``root`` have taken; -1 before the first."""
    if not _exists(spark, f"{root}/cursor"):
        return -1
    return spark.read.parquet(f"{root}/cursor").agg(F.max("seq")).first()[0]


def catch_up(samples: DataFrame, root: str) -> int:
    """Bring the rollups under ``root`` (5m and 1h, partitioned by hour) up to the samples that came since the last call.

    samples: all that are kept, (monitor, entity_id, metric, ts, value, seq), seq growing with each write. Only hours that a
    new sample falls into are made anew, from all their samples, so late samples count too; of a sample written twice the
    last counts. The cursor table is appended to last: a call that failed before is done again by the next, to the same
    result. Returns the number of hours that changed.
    """
    spark = samples.sparkSession
    done = cursor(spark, root)
    fresh = samples.where(F.col("seq") > done)
    hour = rollup.bucket(F.col("ts"), HOUR)
    changed = fresh.groupBy(hour.alias("hour")).agg(F.max("seq").alias("seq"))
    hours = [(r["hour"], r["seq"]) for r in changed.collect()]  # a row an hour
    if not hours:
        return 0
    upto = max(s for _, s in hours)
    touched = spark.createDataFrame(hours, "hour long, seq long").select("hour")
    # the greatest and least hour cut the scan; what came after the cursor's new place waits for the next call
    span = samples.where((F.col("ts") >= min(h for h, _ in hours)) & (F.col("ts") < max(h for h, _ in hours) + HOUR) & (F.col("seq") <= upto))
    rows = span.withColumn("hour", hour).join(F.broadcast(touched) if len(hours) <= 10_000 else touched, "hour", "left_semi")
    once = rows.groupBy(*rollup.SERIES, "ts").agg(F.max_by("value", "seq").alias("value"))
    fives = rollup.rollup_5m(once)
    _put(fives.withColumn("hour", rollup.bucket(F.col("bucket"), HOUR)), f"{root}/5m", "hour")
    made = spark.read.parquet(f"{root}/5m").where(F.col("hour").isin([h for h, _ in hours])).drop("hour")
    _put(rollup.rollup_1h(made).withColumn("hour", F.col("bucket")), f"{root}/1h", "hour")
    spark.createDataFrame([(upto,)], "seq long").coalesce(1).write.mode("append").parquet(f"{root}/cursor")
    return len(hours)


def keep_by_class(rows: DataFrame, series: DataFrame, kind: str, now: int, ts: str = "ts") -> DataFrame:
    """Rows young enough for the class of their series. series: (series_id, durable); a series that isn't there isn't durable."""
    long, short = KEEP[kind]
    young = rows.where(F.col(ts) >= now - short)
    old = rows.where((F.col(ts) < now - short) & (F.col(ts) >= now - long))
    return young.unionByName(old.join(series.where("durable").select("series_id"), "series_id", "left_semi").select(*rows.columns))


def prune_days(spark: SparkSession, path: str, series: DataFrame, kind: str, now: int, ts: str = "ts") -> dict[str, list[int]]:
    """Prune a table of rows (series_id, ts, ...) that is partitioned by ``day``, by the class of the series.

    Days past the longest time go as folders. Of days between, those that still hold a row of another class, or one past
    its time, are written anew; the others keep their files. Returns the days dropped and rewritten.
    """
    long, short = KEEP[kind]
    table = spark.read.parquet(path)
    days = sorted(r["day"] for r in table.select("day").distinct().collect())  # folders
    dropped = [d for d in days if (d + 1) * DAY <= now - long]
    between = [d for d in days if d not in dropped and d * DAY < now - short]
    where, fs = _path(spark, path)
    for d in dropped:
        fs.delete(_path(spark, f"{path}/day={d}")[0], True)
    if not between:
        return {"dropped": dropped, "rewritten": []}
    part = table.where(F.col("day").isin(between))
    stay = F.col("_durable") & (F.col(ts) >= now - long) | (F.col(ts) >= now - short)
    classed = part.join(series.where("durable").select("series_id", F.lit(True).alias("_durable")), "series_id", "left").na.fill(False, ["_durable"])
    over = [r["day"] for r in classed.where(~stay).select("day").distinct().collect()]
    if over:
        # a day can lose all its rows: then its folder goes
        left = classed.where(F.col("day").isin(over) & stay).select(*table.columns)
        kept = {r["day"] for r in left.select("day").distinct().collect()}
        if kept:
            fresh = f"{path}_pruning"
            left.write.mode("overwrite").partitionBy("day").parquet(fresh)
            _put(spark.read.parquet(fresh), path, "day")
            fs.delete(_path(spark, fresh)[0], True)
        for d in set(over) - kept:
            fs.delete(_path(spark, f"{path}/day={d}")[0], True)
    return {"dropped": dropped, "rewritten": sorted(over)}
