"""Event storms that last over minutes: collapsed until the rate drops; in batch by windows, in a stream by a small state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Events of a source and provider that a minute stores; seconds of a minute and between ticks.
LIMIT, MINUTE, TICK = 100, 60, 5
KEYS = ["source", "provider"]


def tick_of(ts: Column, tick: int) -> Column:
    """The tick that takes an event."""
    return F.ceil(ts / tick) * tick


def _with_runs(log: DataFrame, limit: int, minute: int, tick: int) -> tuple[DataFrame, DataFrame]:
    """Events with their tick, minute and place in it; and minutes with the run they belong to and the run's first over the limit.

    A minute goes on from the one before if its first tick has an event; else a storm ends there.
    """
    rows = log.withColumn("_tick", tick_of(F.col("ts"), tick)).withColumn("_minute", F.floor(F.col("_tick") / minute) * minute)
    per = rows.groupBy(*KEYS, "_minute").agg(F.count("*").alias("_n"), F.max(F.col("_tick") == F.col("_minute")).alias("_first"))
    order = W.partitionBy(*KEYS).orderBy("_minute")
    goes_on = F.col("_first") & (F.col("_minute") - F.lag("_minute").over(order) == minute)
    per = per.withColumn("_new", F.when(goes_on, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(order))
    run = W.partitionBy(*KEYS, "_run")
    per = per.withColumns({"_hot": F.min(F.when(F.col("_n") > limit, F.col("_minute"))).over(run), "_last": F.max("_minute").over(run)})
    nth = F.row_number().over(W.partitionBy(*KEYS, "_minute").orderBy("_tick", "id"))
    return rows.withColumn("_nth", nth), per.select(*KEYS, "_minute", "_run", "_hot", "_last")


def guard(log: DataFrame, limit: int = LIMIT, minute: int = MINUTE, tick: int = TICK) -> DataFrame:
    """log: (id, ts, source, provider, ...). Adds ``stored``: false for events that a storm of their source and provider collapses.

    A storm starts with the event after the ``limit``-th of a minute. It goes on over the turn of the minute if the first tick
    of the next minute has an event, else it ends at that tick. While it lasts nothing is stored; after it a minute counts from 0.
    """
    rows, per = _with_runs(log, limit, minute, tick)
    both = rows.join(per, [*KEYS, "_minute"])
    stored = F.col("_hot").isNull() | (F.col("_minute") < F.col("_hot")) | ((F.col("_minute") == F.col("_hot")) & (F.col("_nth") <= limit))
    return both.select(*log.columns, stored.alias("stored"))


def storms(log: DataFrame, limit: int = LIMIT, minute: int = MINUTE, tick: int = TICK, now: int | None = None) -> DataFrame:
    """A row a storm: source, provider, start_ts (the tick of the event that was too many), end_ts (null while it lasts at ``now``), collapsed."""
    rows, per = _with_runs(log, limit, minute, tick)
    over = rows.join(per.where("_hot is not null"), [*KEYS, "_minute"]).where((F.col("_minute") > F.col("_hot")) | ((F.col("_minute") == F.col("_hot")) & (F.col("_nth") > limit)))
    made = over.groupBy(*KEYS, "_run").agg(F.min("_tick").alias("start_ts"), (F.max("_last") + minute).alias("end_ts"), F.count("*").alias("collapsed"))
    ended = F.col("end_ts") <= now if now is not None else F.lit(True)
    return made.select(*KEYS, "start_ts", F.when(ended, F.col("end_ts")).alias("end_ts"), "collapsed")


def step(state: dict, now: int, limit: int, minute: int, events: int = 1) -> list[tuple[str, int, int]]:
    """One event of a source and provider taken at the tick ``now`` (with ``events`` 0: only the time): (kind, ts, collapsed), kind 'over', 'start',
    'stored' or 'collapsed'. ``state`` is empty at first."""
    out = []
    at = now // minute * minute
    if state and at > state["minute"]:
        if state["active"] and (at - state["minute"] > minute or now > at or not events):
            out.append(("over", state["minute"] + minute, state["collapsed"]))
            state["active"] = False
        state.update(minute=at, stored=0) if events else None
    if not events:
        return out
    if not state:
        state.update(minute=at, stored=0, active=False, collapsed=0)
    if not state["active"]:
        state["stored"] += 1
        if state["stored"] <= limit:
            return [*out, ("stored", now, 0)]
        state.update(active=True, collapsed=0)
        out.append(("start", now, 0))
    state["collapsed"] += 1
    return [*out, ("collapsed", now, 0)]


def guard_stream(log: DataFrame, limit: int = LIMIT, minute: int = MINUTE, tick: int = TICK, late: str = "30 seconds") -> DataFrame:
    """As :func:`guard` and :func:`storms` for a stream of (id, ts, source, provider): rows (source, provider, kind, ts, id, collapsed), with the id
    of events of kind 'stored', and the starts and ends of storms ('start', 'over').

    Events are taken in the order of their tick and id within a micro-batch; of a provider that falls silent the storm ends
    when the watermark has passed the next minute's first tick. The state is four numbers.
    """

    def work(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = dict(zip(("minute", "stored", "active", "collapsed"), held.get, strict=True)) if held.exists else {}
        out = []
        if held.hasTimedOut:
            out += [(*key, kind, ts, None, n) for kind, ts, n in step(state, state["minute"] + minute, limit, minute, 0)]
        else:
            rows = pd.concat(list(batches)).sort_values(["tick", "id"])
            for r in rows.itertuples(index=False):
                out += [(*key, kind, ts, r.id if kind == "stored" else None, n) for kind, ts, n in step(state, int(r.tick), limit, minute) if kind != "collapsed"]
        if state:
            held.update((state["minute"], state["stored"], state["active"], state["collapsed"]))
            if state["active"]:
                held.setTimeoutTimestamp(max((state["minute"] + minute) * 1000 + 1, held.getCurrentWatermarkMs() + 1))
        made = pd.DataFrame(out, columns=[*KEYS, "kind", "ts", "id", "collapsed"])
        yield made.astype({"id": "Int64"})

    timed = log.select("id", "ts", *KEYS, tick_of(F.col("ts"), tick).alias("tick")).withColumn("at", F.timestamp_seconds("tick")).withWatermark("at", late)
    return timed.groupBy(*KEYS).applyInPandasWithState(work, "source string, provider string, kind string, ts long, id long, collapsed long", "minute long, stored long, active boolean, collapsed long", "append", GroupStateTimeout.EventTimeTimeout)
