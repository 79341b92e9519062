"""Incidents: confirmation, ladders and flapping as windows; backoff of notifications as a fold."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugeloom.sources.samples import deal

RULE = ["monitor", "entity_id", "rule"]
GROUP = ["monitor", "entity_id", "grp"]
#: Seconds between notifications of an open incident; the last repeats.
BACKOFF = (300, 900, 3600, 21600)
FLAP_SPAN, FLAP_CLEARS, GONE_AFTER = 600, 3, 300
SUPERSEDED = "superseded"


def confirmed(outcomes: DataFrame, keys: Sequence[str] = RULE, ended: Column | None = None) -> DataFrame:
    """Adds ``confirmed``: whether the rule has been true for ``confirm`` ticks and not since false for ``clear``.

    Unknown ticks freeze both counts. True and false ones fall into runs; from the confirm-th of a true run on the
    rule is confirmed, from the clear-th of a false run on it isn't, and other ticks keep what was. A row that is ``ended``
    resets both counts and what was; it comes before a tick of its second.
    """
    # every window has the keys and the order, so one sort serves them all
    order = W.partitionBy(*keys).orderBy("ts", *([] if ended is None else [ended.desc()]))
    known = F.when(F.col("outcome") != "unknown", F.col("outcome"))
    if ended is not None:
        known = F.when(ended, "ended").otherwise(known)
    before = F.last(known, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1))
    rows = outcomes.withColumn("_starts", known.isNotNull() & (before.isNull() | (before != known))).withColumn("_n", F.count(known).over(order))
    run = F.col("_n") - F.last(F.when(F.col("_starts"), F.col("_n") - 1), ignorenulls=True).over(order)
    rows = rows.withColumn("_run", run)
    mark = F.when((known == "true") & (F.col("_run") >= F.col("confirm")), True).when((known == "false") & (F.col("_run") >= F.col("clear")), False).when(known == "ended", False)
    rows = rows.withColumn("_mark", mark)
    return rows.withColumn("confirmed", F.coalesce(F.last("_mark", ignorenulls=True).over(order), F.lit(False))).drop("_starts", "_n", "_run", "_mark")


def with_ends(outcomes: DataFrame, ends: DataFrame) -> DataFrame:
    """``confirmed`` outcomes in which an end resets all counts and clears: an entity that is gone, a definition that was replaced.

    ends: (monitor, entity_id, ts, reason), at most one an entity and second. Each adds a row with its reason for every
    rule of the entity, so the ladder clears there; ticks have a null reason. An end at the second of a tick counts
    before it, and takes the tick's place where the rule isn't true again at once.
    """
    held = [c for c in ("grp", "severity", "confirm", "clear", "notify_recovery") if c in outcomes.columns]
    kinds = outcomes.select(*RULE, *held).distinct().dropDuplicates(RULE)  # the first takes most away without a sort
    rows = kinds.join(ends.select("monitor", "entity_id", "ts", "reason"), ["monitor", "entity_id"]).withColumn("outcome", F.lit("unknown"))
    both = outcomes.withColumn("reason", F.lit(None).cast("string")).unionByName(rows)
    return confirmed(both, ended=F.col("reason").isNotNull())


def gone_ends(samples: DataFrame, now: int, grace: int = GONE_AFTER) -> DataFrame:
    """The ends that absences longer than the grace are."""
    return gone(samples, now, grace).where(F.col("gone_ts") <= now).select("monitor", "entity_id", F.col("gone_ts").alias("ts"), F.lit("entity_gone").alias("reason"))


def superseded_ends(entities: DataFrame, versions: DataFrame) -> DataFrame:
    """versions: (monitor, ts, content_hash), what was loaded when; a null hash stands for a definition taken away. An end for
    each entity of the monitor where the hash changes."""
    order = W.partitionBy("monitor").orderBy("ts")
    rows = versions.withColumn("_was", F.lag("content_hash").over(order)).withColumn("_nth", F.row_number().over(order))
    changes = rows.where((F.col("_nth") > 1) & ~F.col("content_hash").eqNullSafe(F.col("_was"))).select("monitor", "ts")
    return entities.select("monitor", "entity_id").distinct().join(changes, "monitor").select("monitor", "entity_id", "ts", F.lit(SUPERSEDED).alias("reason"))


def cleared_by(transitions: DataFrame, ends: DataFrame) -> DataFrame:
    """Adds ``reason`` to clears: that of the end at their second, else 'recovered'; null for other transitions. Clears by a
    replaced definition are silent, others tell of the recovery."""
    rows = transitions.join(ends.select("monitor", "entity_id", "ts", F.col("reason").alias("_end")), ["monitor", "entity_id", "ts"], "left")
    return rows.withColumn("reason", F.when(F.col("kind") == "clear", F.coalesce("_end", F.lit("recovered")))).drop("_end")


def acknowledged(transitions: DataFrame, acks: DataFrame) -> DataFrame:
    """Transitions with those acknowledgements (monitor, entity_id, grp, ts, by) that count, as rows of kind 'acked'.

    One counts where its group's incident is open and not acked yet; an escalation makes it open again. A transition
    at the same second comes first.
    """
    null = F.lit(None)
    both = transitions.select(*GROUP, "ts", "kind", "severity", "incident", null.cast("string").alias("by")).unionByName(
        acks.select(*GROUP, "ts", F.lit("acked").alias("kind"), null.cast("int").alias("severity"), null.cast("long").alias("incident"), "by")
    )
    is_ack = F.col("kind") == "acked"
    order = W.partitionBy(*GROUP).orderBy("ts", is_ack, "by")
    so_far = order.rowsBetween(W.unboundedPreceding, 0)
    rows = both.withColumns({
        "severity": F.last("severity", ignorenulls=True).over(so_far),
        "incident": F.last("incident", ignorenulls=True).over(so_far),
        "_stage": F.count(F.when(F.col("kind").isin("open", "escalate"), 1)).over(so_far),
        "_state": F.last(F.when(~is_ack, F.col("kind")), ignorenulls=True).over(so_far),
    })
    first = F.row_number().over(W.partitionBy(*GROUP, "_stage", is_ack).orderBy("ts", "by")) == 1
    return rows.withColumn("_first", first).where(~is_ack | (F.col("_first") & F.col("_state").isNotNull() & (F.col("_state") != "clear"))).drop("_stage", "_state", "_first")


def _a_row_a_tick(states: DataFrame, **aggs: Column) -> DataFrame:
    """The aggregates of a group's rows of each ts, sorted as the windows that follow need it: one sort and no table of all ticks in a task's memory."""
    order = W.partitionBy(*GROUP).orderBy("ts")
    rows = states.withColumns({f"_{k}": a.over(order.rangeBetween(0, 0)) for k, a in aggs.items()} | {"_nth": F.row_number().over(order), "_till": F.count(F.lit(1)).over(order)})
    return rows.where("_nth = _till").select(*GROUP, "ts", *(F.col(f"_{k}").alias(k) for k in aggs))


def ladder(states: DataFrame) -> DataFrame:
    """Rows (group, ts, kind, severity, incident) where a group's greatest confirmed severity changes.

    kind is open, escalate, downgrade or clear; incident counts a group's opens.
    """
    level = _a_row_a_tick(states, severity=F.max(F.when(F.col("confirmed"), F.col("severity")))).withColumn("severity", F.coalesce("severity", F.lit(-1)))
    order = W.partitionBy(*GROUP).orderBy("ts")
    rows = level.withColumn("was", F.coalesce(F.lag("severity").over(order), F.lit(-1)))
    kind = F.when((F.col("was") < 0) & (F.col("severity") >= 0), "open").when((F.col("was") >= 0) & (F.col("severity") < 0), "clear").when(F.col("severity") > F.col("was"), "escalate").when(F.col("severity") < F.col("was"), "downgrade")
    rows = rows.withColumn("kind", kind).where(F.col("kind").isNotNull())
    return rows.withColumn("incident", F.sum((F.col("kind") == "open").cast("long")).over(order))


def flapping(transitions: DataFrame) -> DataFrame:
    """Opens, and whether the group was cleared three times or more in the 600 s up to then."""
    span = W.partitionBy(*GROUP).orderBy("ts").rangeBetween(-FLAP_SPAN, 0)
    rows = transitions.withColumn("clears", F.sum((F.col("kind") == "clear").cast("long")).over(span))
    return rows.where("kind = 'open'").select(*GROUP, "ts", "incident", "clears", (F.col("clears") >= FLAP_CLEARS).alias("flapping"))


def gone(samples: DataFrame, now: int, grace: int = GONE_AFTER) -> DataFrame:
    """Entities' absences longer than the grace: (monitor, entity_id, last_seen, gone_ts, back_ts)."""
    order = W.partitionBy("monitor", "entity_id").orderBy("ts")
    rows = samples.select("monitor", "entity_id", "ts").distinct().withColumn("back_ts", F.lead("ts").over(order))
    late = F.coalesce("back_ts", F.lit(now)) - F.col("ts") > grace
    return rows.where(late).select("monitor", "entity_id", F.col("ts").alias("last_seen"), (F.col("ts") + grace + 1).alias("gone_ts"), "back_ts")


def step(state: dict, now: int, severity: int, owner_true: bool, acked: bool = False, reason: str | None = None, tells: bool = True) -> list[tuple[str, int]]:
    """One tick of a group: notifications (kind, severity). ``severity`` is the greatest confirmed one, -1 for none.

    A clear tells of the recovery, unless its ``reason`` is that the definition was replaced, or the rule that owned the
    incident doesn't tell (``tells``: the owner's notify_recovery). ``state`` is empty before the first tick. Pure: no
    clock, so batch and streaming share it.
    """
    out: list[tuple[str, int]] = []
    opened = state.get("severity", -1)
    if opened < 0 <= severity:
        recent = [t for t in state.get("clears", []) if now - FLAP_SPAN <= t]
        flaps = len(recent) >= FLAP_CLEARS  # then it starts with the longest wait
        state.update(severity=severity, peak=severity, last=now, tier=len(BACKOFF) - 1 if flaps else 0, flapping=flaps, acked=False, opened=now)
        out.append(("open", severity))
    elif opened >= 0 > severity:
        state["clears"] = [*state.get("clears", []), now][-5:]
        state["severity"] = -1
        if reason != SUPERSEDED and state.get("tells", True):
            out.append(("recover", 0))
    elif opened >= 0:
        state["acked"] = state["acked"] or acked
        if severity > opened:
            state.update(severity=severity, peak=max(severity, state["peak"]), last=now, tier=0, acked=False)
            out.append(("escalate", severity))
        elif severity < opened:
            state["severity"] = severity  # a downgrade is silent
        else:
            wait = BACKOFF[min(state["tier"], len(BACKOFF) - 1)]
            if owner_true and not state["acked"] and max(0, now - state["last"]) >= wait:
                state.update(last=now, tier=state["tier"] + 1)
                out.append(("renotify", severity))
    if severity >= 0:
        state["tells"] = tells
    return out


def notifications(levels: DataFrame, acks: DataFrame | None = None) -> DataFrame:
    """levels: (monitor, entity_id, grp, ts, severity, owner_true), a row a tick; of clears the reason, of levels whether their
    rule tells of a recovery (tells), where they have these columns. Notifications with backoff.

    acks: (monitor, entity_id, grp, ts); one takes effect at the first tick at or after it, if an incident is open then.

    A group's state is a few numbers. Groups arrive sorted and are folded as they stream through a task, so a
    long one is never held whole.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, {}
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if (r.monitor, r.entity_id, r.grp) != key:
                    key, state = (r.monitor, r.entity_id, r.grp), {}
                out += [(*key, r.ts, *n) for n in step(state, r.ts, r.severity, r.owner_true, r.acked, r.reason, r.tells)]
            yield pd.DataFrame(out, columns=[*GROUP, "ts", "kind", "severity"])

    rows = with_defaults(levels).withColumn("acked", F.lit(False))
    if acks is not None:
        null = F.lit(None)
        given = acks.select(*GROUP, "ts", null.cast("int").alias("severity"), null.cast("boolean").alias("owner_true"), null.cast("string").alias("reason"), F.lit(True).alias("tells"), F.lit(True).alias("acked"))
        order = W.partitionBy(*GROUP).orderBy("ts", F.col("severity").isNotNull())
        both = rows.unionByName(given).withColumn("_acks", F.count_if("acked").over(order.rowsBetween(W.unboundedPreceding, 0)))
        ticks = both.where("severity is not null")
        rows = ticks.withColumn("acked", F.col("_acks") > F.coalesce(F.lag("_acks").over(order), F.lit(0))).drop("_acks")
    dealt = deal(rows, *GROUP).sortWithinPartitions(*GROUP, "ts")
    return dealt.mapInPandas(work, "monitor string, entity_id string, grp string, ts long, kind string, severity int")


def with_defaults(levels: DataFrame) -> DataFrame:
    """The columns of levels, those of clears and recoveries too."""
    own = {"reason": F.lit(None).cast("string"), "tells": F.lit(True)}
    return levels.select(*GROUP, "ts", "severity", "owner_true", *(F.col(c) if c in levels.columns else d.alias(c) for c, d in own.items()))


def levels(states: DataFrame) -> DataFrame:
    """The tick-wise greatest confirmed severity of each group, whether a rule of that severity is true now, why the group ended
    there (the reason of :func:`with_ends`, else null) and whether its rule tells of a recovery (column notify_recovery, else true)."""
    tells = F.col("notify_recovery") if "notify_recovery" in states.columns else F.lit(True)
    top = F.max(F.when(F.col("confirmed"), F.struct("severity", (F.col("outcome") == "true").alias("true"), tells.alias("tells"))))
    rows = _a_row_a_tick(states, t=top, **({"reason": F.max("reason")} if "reason" in states.columns else {}))
    rows = rows if "reason" in rows.columns else rows.withColumn("reason", F.lit(None).cast("string"))
    return rows.select(*GROUP, "ts", F.coalesce("t.severity", F.lit(-1)).alias("severity"), F.coalesce("t.true", F.lit(False)).alias("owner_true"), "reason", F.coalesce("t.tells", F.lit(True)).alias("tells"))


def histories(transitions: DataFrame) -> DataFrame:
    """History rows with a running number in each incident."""
    order = W.partitionBy(*GROUP, "incident").orderBy("ts")
    return transitions.withColumn("seq", F.row_number().over(order))


def summary(transitions: DataFrame) -> DataFrame:
    """A row for each incident: opened_ts, last_change_ts, cleared_ts, peak severity and state."""
    rows = transitions.groupBy(*GROUP, "incident").agg(
        F.min("ts").alias("opened_ts"), F.max("ts").alias("last_change_ts"), F.max(F.when(F.col("kind") == "clear", F.col("ts"))).alias("cleared_ts"), F.max("severity").alias("peak_severity"), F.count("*").alias("changes")
    )
    return rows.withColumn("state", F.when(F.col("cleared_ts").isNull(), "open").otherwise("cleared"))
