"""Reading what is stored: tiers, series, downsampling, trends, tops, glances, catalogs, pages."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugeloom.plans.definitions import Trend

SERIES = ["monitor", "entity_id", "metric"]
DAY = 86400
MAX_ENTITIES, MAX_POINTS, MAX_TOTAL = 50, 2000, 10_000


def tier(start: int, end: int, now: int, durable: bool | None) -> str:
    """The finest table that still holds the whole range. durable: whether all series of the cohort are; None for an empty one."""
    if start >= now - 2 * DAY and end - start <= DAY // 2:
        return "raw"
    return "5m" if start >= now - (30 if durable else 7) * DAY else "1h"


def series(samples: DataFrame, fives: DataFrame, hours: DataFrame, monitor: str, metric: str, start: int, end: int, now: int, durable: bool | None, statistic: str = "avg") -> DataFrame:
    """(entity_id, ts, value) of a metric over a range, from the tier that holds it."""
    which = tier(start, end, now, durable)
    if which == "raw":
        rows = samples.withColumn("v", F.col("value"))
    else:
        rows = (fives if which == "5m" else hours).withColumn("ts", F.col("bucket")).withColumn("v", F.col(statistic))
    rows = rows.where((F.col("monitor") == monitor) & (F.col("metric") == metric) & F.col("ts").between(start, end))
    return rows.select("entity_id", "ts", F.col("v").alias("value"), F.lit(which).alias("tier"))


def answer(
    samples: DataFrame, fives: DataFrame, hours: DataFrame, monitor: str, metric: str, start: int, end: int, now: int, durable: bool | None, statistic: str = "avg", max_points: int = 2000
) -> DataFrame:
    """A metric over a range as a chart needs it: (entity_id, tier, ts, value, lower, upper, downsampled).

    Points come from the tier that holds the range. Entities with more than ``max_points`` are downsampled by the chosen statistic;
    lower and upper are the tier's extremes at the points that are left.
    """
    if statistic not in ("avg", "min", "max", "last"):
        raise ValueError("statistic must be avg, min, max or last")
    line = series(samples, fives, hours, monitor, metric, start, end, now, durable, statistic).where("value is not null")
    which = tier(start, end, now, durable)
    held = samples.select("monitor", "entity_id", "metric", "ts", F.col("value").alias("lower"), F.col("value").alias("upper"))
    if which != "raw":
        held = (fives if which == "5m" else hours).select("monitor", "entity_id", "metric", F.col("bucket").alias("ts"), F.col("min").alias("lower"), F.col("max").alias("upper"))
    held = held.where((F.col("monitor") == monitor) & (F.col("metric") == metric) & F.col("ts").between(start, end)).drop("monitor", "metric")
    many = line.groupBy("entity_id").agg((F.count("*") > max_points).alias("downsampled"))
    line = line.join(many, "entity_id")
    cut = downsample(line.where("downsampled").select("entity_id", "ts", "value"), max_points).withColumn("downsampled", F.lit(True))
    shown = line.where("not downsampled").select("entity_id", "ts", "value", "downsampled").unionByName(cut)
    return shown.join(held, ["entity_id", "ts"], "left").select("entity_id", F.lit(which).alias("tier"), "ts", "value", "lower", "upper", "downsampled")


def trend(
    samples: DataFrame, fives: DataFrame, hours: DataFrame, monitor: str, profile: Trend, start: int, end: int, now: int, durable: bool | None, max_points: int = 2000
) -> DataFrame:
    """A declared trend's panels in one table: (entity_id, panel, tier, ts, value, lower, upper, downsampled), panel 'value', 'rate',
    'confidence', 'remaining' or 'projection'.

    The projection is hours until what remains is used up, from all points of rate and remaining (not the downsampled ones), null
    where the rate isn't above 0 or the confidence is below the trend's least.
    """
    part = lambda metric: series(samples, fives, hours, monitor, metric, start, end, now, durable)
    panels = [(n, m) for n, m in (("value", profile.value), ("rate", profile.rate), ("confidence", profile.confidence), ("remaining", profile.remaining)) if m]
    made = [answer(samples, fives, hours, monitor, m, start, end, now, durable, max_points=max_points).withColumn("panel", F.lit(n)) for n, m in panels]
    if profile.rate and profile.remaining:
        hours_left = projection(part(profile.rate), part(profile.remaining), part(profile.confidence) if profile.confidence else None, profile.least_confidence)
        line = hours_left.select("entity_id", F.lit(tier(start, end, now, durable)).alias("tier"), "ts", F.col("hours").alias("value"))
        none = F.lit(None).cast("double")
        made.append(line.select("*", none.alias("lower"), none.alias("upper"), F.lit(False).alias("downsampled"), F.lit("projection").alias("panel")))
    out = made[0]
    for rows in made[1:]:
        out = out.unionByName(rows)
    return out.select("entity_id", "panel", "tier", "ts", "value", "lower", "upper", "downsampled")


def lttb(ts: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """The places of the n points kept by largest-triangle downsampling; both ends are."""
    size = len(ts)
    if n >= size:
        return np.arange(size)
    if n <= 2:
        return np.array([0, size - 1])[: max(n, 0)]
    step = (size - 2) / (n - 2)
    edges = np.floor(np.arange(n - 1) * step).astype(int) + 1
    kept = [0]
    for i in range(n - 2):
        s, e = edges[i], edges[i + 1]
        nxt = slice(e, min(int(np.floor((i + 2) * step)) + 1, size)) if e < size - 1 else slice(size - 1, size)
        mx, my = ts[nxt].mean(), value[nxt].mean()
        a = kept[-1]
        area = np.abs((ts[a] - mx) * (value[s:e] - value[a]) - (ts[a] - ts[s:e]) * (my - value[a]))
        kept.append(s + int(np.argmax(area)))
    return np.array([*kept, size - 1])


def downsample(points: DataFrame, n: int, keys: Sequence[str] = ("entity_id",)) -> DataFrame:
    """At most n points (ts, value) of each key. A key's points are those of one bounded query range."""
    names = [*keys, "ts", "value"]

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts")
        return pdf.iloc[lttb(pdf["ts"].to_numpy(float), pdf["value"].to_numpy(float), n)][names]

    rows = points.select(*names)
    return rows.groupBy(*keys).applyInPandas(work, rows.schema)


def latest(samples: DataFrame) -> DataFrame:
    """The newest point of each series."""
    return samples.groupBy(*SERIES).agg(F.max("ts").alias("ts"), F.max_by("value", "ts").alias("value"))


def summary(points: DataFrame, keys: Sequence[str] = ("entity_id",)) -> DataFrame:
    """Current value, change, least, greatest and direction of each key's points."""
    first, last = F.min_by("value", "ts"), F.max_by("value", "ts")
    rows = points.groupBy(*keys).agg(last.alias("current"), (last - first).alias("change"), F.min("value").alias("min"), F.max("value").alias("max"))
    return rows.withColumn("direction", F.when(F.col("change") > 0, "rising").when(F.col("change") < 0, "falling").otherwise("steady"))


def top_consumers(samples: DataFrame, metric: str, start: int, end: int, n: int, spread: bool = False) -> DataFrame:
    """The n entities of the greatest mean (for counters, spread: greatest less least) over a range."""
    rows = samples.where((F.col("metric") == metric) & F.col("ts").between(start, end))
    used = F.max("value") - F.min("value") if spread else F.avg("value")
    each = rows.groupBy("monitor", "entity_id").agg(used.alias("used"))
    return each.groupBy("entity_id").agg(F.max("used").alias("used")).orderBy(F.desc("used"), "entity_id").limit(n)


def glance(newest: DataFrame, now: int, fresh: int) -> DataFrame:
    """Each monitor's greatest fresh value; of ties the newest, then the lesser entity_id."""
    order = W.partitionBy("monitor").orderBy(F.desc("value"), F.desc("ts"), "entity_id")
    return newest.where(F.col("ts") >= now - fresh).withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth")


def page(rows: DataFrame, after: tuple[str, str, str] | None, limit: int) -> DataFrame:
    """The next ``limit`` rows by (monitor, entity_id, metric) behind a key: a filter, not an offset."""
    if not 1 <= limit <= 500:
        raise ValueError("a page has from 1 to 500 rows")
    key = F.struct(*SERIES)
    rows = rows if after is None else rows.where(key > F.struct(*(F.lit(x).alias(c) for x, c in zip(after, SERIES, strict=True))))
    return rows.orderBy(*SERIES).limit(limit)


def keep_last(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    nth = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_nth", nth).where(F.col("_nth") <= n).drop("_nth")


def bounded(counts: DataFrame, max_entities: int = MAX_ENTITIES, max_points: int = MAX_POINTS, max_total: int = MAX_TOTAL) -> DataFrame:
    """counts: (entity_id, points). What a response of bounded size may take of each: entity, points, budget, truncated."""
    order = W.orderBy("entity_id")  # a row an entity, of which max_entities stay
    first = counts.orderBy("entity_id").limit(max_entities)
    rows = first.withColumn("wanted", F.least("points", F.lit(max_points)))
    upto = F.sum("wanted").over(order)
    budget = F.greatest(F.lit(0), F.least(F.col("wanted"), F.lit(max_total) - (upto - F.col("wanted"))))
    return rows.select("entity_id", "points", budget.cast("long").alias("budget"), (budget < F.col("points")).alias("truncated"))


def observed(samples: DataFrame, catalog: DataFrame, start: int, end: int) -> DataFrame:
    """Catalog series that have a sample in the range."""
    return catalog.join(samples.where(F.col("ts").between(start, end)), SERIES, "left_semi")


def gaps(points: DataFrame, step: int, keys: Sequence[str] = ("entity_id",)) -> DataFrame:
    """Points, with a null one put after each that is followed by a gap over 1.5 steps."""
    ahead = F.lead("ts").over(W.partitionBy(*keys).orderBy("ts"))
    null = F.struct((F.col("ts") + step).alias("ts"), F.lit(None).cast("double").alias("value"))
    both = F.when(ahead - F.col("ts") > 1.5 * step, F.array(F.struct("ts", "value"), null)).otherwise(F.array(F.struct("ts", "value")))
    return points.withColumn("_p", both).select(*keys, F.explode("_p").alias("p")).select(*keys, "p.ts", "p.value")


def runs(points: DataFrame, step: int, keys: Sequence[str] = ("entity_id",)) -> DataFrame:
    """Stretches of points exactly a step apart: (keys, run, first_ts, last_ts, points)."""
    order = W.partitionBy(*keys).orderBy("ts")
    start = F.when(F.col("ts") - F.lag("ts").over(order) == step, 0).otherwise(1)
    rows = points.withColumn("_start", start).withColumn("run", F.sum("_start").over(order))
    return rows.groupBy(*keys, "run").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("points"))


def projection(rate: DataFrame, remaining: DataFrame, confidence: DataFrame | None = None, least: float = 0.0) -> DataFrame:
    """(entity_id, ts, hours, limit_ts) where rate (a bucket-hour) and remaining have a point at the same ts.

    Null where the rate isn't above 0 or the confidence is too low.
    """
    rows = rate.select("entity_id", "ts", F.col("value").alias("rate")).join(remaining.select("entity_id", "ts", F.col("value").alias("remaining")), ["entity_id", "ts"])
    sure = F.lit(True)
    if confidence is not None:
        rows = rows.join(confidence.select("entity_id", "ts", F.col("value").alias("confidence")), ["entity_id", "ts"])
        sure = F.col("confidence") >= least
    hours = F.when((F.col("rate") > 0) & sure, F.try_divide("remaining", "rate"))
    return rows.select("entity_id", "ts", hours.alias("hours"), (F.col("ts") + hours * 3600).alias("limit_ts"))


def envelope(points: DataFrame, shown: DataFrame, keys: Sequence[str] = ("entity_id",)) -> DataFrame:
    """The rollup's min and max at the timestamps that a downsampled line still shows."""
    return points.join(shown.select(*keys, "ts"), [*keys, "ts"], "left_semi")


def context(incidents: DataFrame, log: DataFrame, span: int = 600) -> DataFrame:
    """Events within ``span`` seconds of an incident's opening.

    An equi-join on the span's bucket and its neighbours, then the exact distance.
    """
    near = incidents.withColumn("_b", F.explode(F.array(*(F.floor(F.col("opened_ts") / span) + d for d in (-1, 0, 1)))))
    rows = near.join(log.withColumn("_b", F.floor(F.col("ts") / span)), "_b").drop("_b")
    return rows.where(F.abs(F.col("ts") - F.col("opened_ts")) <= span)


def stage_rates(counters: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Each counter's rise a second between the first and last ts that all of an entity's counters share; null after a reset."""
    rows = counters.where(F.col("metric").isin(*metrics))
    shared = rows.groupBy("entity_id", "ts").agg(F.count_distinct("metric").alias("n")).where(F.col("n") == len(metrics))
    common = rows.join(shared.select("entity_id", "ts"), ["entity_id", "ts"], "left_semi")
    made = common.groupBy("entity_id", "metric").agg((F.max_by("value", "ts") - F.min_by("value", "ts")).alias("rise"), (F.max("ts") - F.min("ts")).alias("elapsed"))
    return made.select("entity_id", "metric", F.when((F.col("elapsed") > 0) & (F.col("rise") >= 0), F.col("rise") / F.col("elapsed")).alias("rate"))


def nearest_rank(rows: DataFrame, key: str, value: str, shares: Sequence[int] = (50, 95, 100)) -> DataFrame:
    """Nearest-rank percentiles: the value at place round(p / 100 * (n - 1)), halves to even.

    Ranks within a key come from counts by distinct value, so a hot key isn't sorted row by row in one task.
    """
    counts = rows.groupBy(key, value).agg(F.count("*").alias("n"))
    w = W.partitionBy(key).orderBy(value)
    placed = counts.withColumn("upto", F.sum("n").over(w)).withColumn("total", F.sum("n").over(W.partitionBy(key)))
    at = [F.bround(F.lit(p / 100.0) * (F.col("total") - 1), 0) for p in shares]
    holds = [F.max(F.when((a >= F.col("upto") - F.col("n")) & (a < F.col("upto")), F.col(value))).alias(f"p{p}") for a, p in zip(at, shares, strict=True)]
    return placed.groupBy(key).agg(*holds)
