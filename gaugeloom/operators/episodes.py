"""Log events: filters, coalescing, storms, quiet-period sessions and the episode fold."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugeloom.functions import scalar

SAME = ["source", "provider", "event_id", "severity", "message"]
STORM = 100


def store_filter(log: DataFrame, matched: Column, least_severity: int = 1) -> DataFrame:
    """Events to keep: severe enough, matched by a rule, or the engine's own."""
    return log.where((F.col("severity") >= least_severity) | F.coalesce(matched, F.lit(False)) | (F.col("source") == "self"))


def coalesce_repeats(log: DataFrame, span: int = 100_000) -> DataFrame:
    """Neighbours (by ingest order, within a source) that say the same become one row: repeat_count, first_ts, last_ts.

    A source is cut into ranges of ``span`` ids, each of which is looked at alone; then the first row of a range is held
    against the last one of the range before, and runs are numbered on from range to range.
    """
    part = ["source", "_range"]
    order = W.partitionBy(*part).orderBy("id")
    what = F.struct(*SAME[1:])
    rows = log.select("source", "id", "ts", *(c for c in SAME if c != "source")).withColumn("_range", F.floor(F.col("id") / span))
    rows = rows.withColumns({"_what": what, "_before": F.lag(what).over(order), "_nth": F.row_number().over(order)})
    own = F.when((F.col("_nth") > 1) & F.col("_what").eqNullSafe(F.col("_before")), 0).when(F.col("_nth") > 1, 1)
    rows = rows.withColumn("_new", own)
    # a row a range: how many runs begin in it, and whether its first row goes on with the run before it
    each = rows.groupBy(*part).agg(F.sum(F.coalesce("_new", F.lit(0))).alias("_runs"), F.min_by("_what", "id").alias("_head"), F.max_by("_what", "id").alias("_tail"))
    ranges = W.partitionBy("source").orderBy("_range")
    tail = F.lag(F.struct("_tail")).over(ranges)
    each = each.withColumn("_starts", F.when(tail.isNotNull() & F.col("_head").eqNullSafe(tail["_tail"]), 0).otherwise(1))
    upto = F.sum(F.col("_runs") + F.col("_starts")).over(ranges)
    each = each.select(*part, "_starts", (upto - F.col("_runs") - F.col("_starts")).alias("_so_far"))
    numbered = rows.join(each, part).withColumn("_run", F.col("_so_far") + F.sum(F.coalesce("_new", F.col("_starts"))).over(order))
    firsts = [F.first(c).alias(c) for c in SAME[1:]]  # alike in a run
    return numbered.groupBy("source", "_run").agg(F.min("id").alias("id"), *firsts, F.count("*").alias("repeat_count"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).drop("_run")


def storm_guard(log: DataFrame, limit: int = STORM) -> DataFrame:
    """Marks ``stored`` the first ``limit`` events of each source, provider and minute."""
    minute = F.floor(F.col("ts") / 60) * 60
    nth = F.row_number().over(W.partitionBy("source", "provider", "minute").orderBy("id"))
    return log.withColumn("minute", minute).withColumn("stored", nth <= limit)


def storms(log: DataFrame, limit: int = STORM) -> DataFrame:
    """Storms: runs of minutes of a provider over the limit, with the events collapsed."""
    per = log.groupBy("source", "provider", (F.floor(F.col("ts") / 60) * 60).alias("minute")).agg(F.count("*").alias("n")).where(F.col("n") > limit)
    order = W.partitionBy("source", "provider").orderBy("minute")
    start = F.when(F.col("minute") - F.lag("minute").over(order) == 60, 0).otherwise(1)
    rows = per.withColumn("_start", start).withColumn("storm", F.sum("_start").over(order))
    return rows.groupBy("source", "provider", "storm").agg(F.min("minute").alias("start_ts"), (F.max("minute") + 60).alias("end_ts"), F.sum(F.col("n") - limit).alias("collapsed"))


def arrival_rate(log: DataFrame, span: int = 60, keys: tuple[str, ...] = ("provider",)) -> DataFrame:
    """Adds ``rate_per_s`` over the last ``span`` seconds; a row with a ``repeat_count`` counts as often."""
    window = W.partitionBy(*keys).orderBy("ts").rangeBetween(-span + 1, 0)
    times = F.coalesce("repeat_count", F.lit(1)) if "repeat_count" in log.columns else F.lit(1)
    return log.withColumn("rate_per_s", F.sum(times).over(window) / span)


def sessions(log: DataFrame, quiet: int) -> DataFrame:
    """Episodes of a key: events whose gaps are at most ``quiet`` seconds."""
    key = scalar.episode_key(F.col("provider"), F.col("event_id"), F.col("message"))
    order = W.partitionBy("key").orderBy("ts", "id")
    rows = log.withColumn("key", key)
    rows = rows.withColumn("_start", F.when(F.col("ts") - F.lag("ts").over(order) <= quiet, 0).otherwise(1)).withColumn("episode", F.sum("_start").over(order))
    return rows.groupBy("key", "episode").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("occurrences"), F.max("severity").alias("severity"))


def step_episode(state: dict, ts: int, count: int, confirm: int, confirm_span: int, cooldown: int, clear_after: int, acked: bool = False) -> list[tuple[str, int]]:
    """One match of an episode's key at ``ts``: events (kind, ts). Pure; ``state`` is empty before the first match.

    It opens once ``confirm`` matches lie within ``confirm_span``; a quiet time over ``clear_after`` clears it at
    its end; while open it notifies again each ``cooldown``, four times as long while it flaps, until it is acknowledged
    (``acked``: since the match before). ``pending`` holds no more than ``confirm`` times, however often a match repeats.
    """
    out: list[tuple[str, int]] = []
    if state.get("open") and ts - state["last"] > clear_after:
        out.append(("clear", state["last"] + clear_after))
        state["clears"] = [*state.get("clears", []), state["last"] + clear_after][-5:]
        state.update(open=False, pending=[])
    state["last"] = ts
    if state.get("open"):
        state["occurrences"] += count
        state["acked"] = state.get("acked", False) or acked
        if not state["acked"] and ts - state["notified"] >= state["cooldown"]:
            state["notified"] = ts
            out.append(("renotify", ts))
        return out
    pending = [t for t in state.get("pending", []) if ts - t <= confirm_span] + [ts] * min(count, confirm)
    state["pending"] = pending[-confirm:]
    if len(pending) >= confirm:
        flapping = sum(ts - t <= 600 for t in state.get("clears", [])) >= 3
        state.update(open=True, acked=False, occurrences=len(pending), notified=ts, cooldown=cooldown * (4 if flapping else 1), pending=[])
        out.append(("open", ts))
    return out


def end_episode(state: dict, now: int, clear_after: int) -> list[tuple[str, int]]:
    """The clear of an episode that has been quiet for longer than ``clear_after`` at ``now``."""
    return [("clear", state["last"] + clear_after)] if state.get("open") and now - state["last"] > clear_after else []


def episodes(matches: DataFrame, confirm: int = 1, confirm_span: int = 3600, cooldown: int = 3600, clear_after: int = 1800, now: int | None = None, acks: DataFrame | None = None) -> DataFrame:
    """matches: (key, ts, count), with ``id`` where ingest order isn't that of ts. The episodes' events (key, kind, ts), keys
    folded as they stream by; those quiet for long enough at ``now`` are cleared. acks: (key, ts); one silences the episode that
    is open at the next match at or after it."""
    order = ["id"] if "id" in matches.columns else ["ts"]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, {}
        ended = lambda: [(key, *e) for e in end_episode(state, now, clear_after)] if now is not None else []
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if r.key != key:
                    out += ended()
                    key, state = r.key, {}
                out += [(key, *e) for e in step_episode(state, r.ts, r.n, confirm, confirm_span, cooldown, clear_after, r.acked)]
            yield pd.DataFrame(out, columns=["key", "kind", "ts"])
        if last := ended():
            yield pd.DataFrame(last, columns=["key", "kind", "ts"])

    rows = matches.select("key", "ts", F.col("count").alias("n"), *(c for c in order if c != "ts")).withColumn("acked", F.lit(False))
    if acks is not None:
        given = acks.select("key", "ts").withColumn("acked", F.lit(True))
        by_time = W.partitionBy("key").orderBy("ts", F.col("n").isNotNull(), *(c for c in order if c != "ts"))
        both = rows.unionByName(given, allowMissingColumns=True)
        both = both.withColumn("_acks", F.count_if("acked").over(by_time.rowsBetween(W.unboundedPreceding, 0)))
        ticks = both.where("n is not null")
        rows = ticks.withColumn("acked", F.col("_acks") > F.coalesce(F.lag("_acks").over(by_time), F.lit(0))).drop("_acks")
    dealt = rows.repartition("key").sortWithinPartitions("key", *order)
    return dealt.mapInPandas(work, "key string, kind string, ts long")
