"""Rules over samples: wide ticks, derived metrics, exemption, outcomes, selection and promotion."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugeloom.functions import scalar, series
from gaugeloom.operators import rollup
from gaugeloom.plans.definitions import Definition
from gaugeloom.plans.expression import Names, compile_expression

MAX_PROMOTED, DEMOTE_AFTER = 10, 1800


def widen(samples: DataFrame, metrics: list[str]) -> DataFrame:
    """A row for each (monitor, entity_id, ts) with a column a metric, null where the tick lacks it."""
    return samples.groupBy("monitor", "entity_id", "ts").pivot("metric", sorted(metrics)).agg(F.last("value"))


def with_baselines(ticks: DataFrame, history: DataFrame, metrics: Iterable[str]) -> DataFrame:
    """``ticks`` with a column ``_baseline_METRIC`` for each metric: the ready level of the last bucket complete by then."""
    for metric in sorted(metrics):
        known = history.where(F.col("metric") == metric)
        own = ticks.select("monitor", "entity_id", F.lit(metric).alias("metric"), "ts", F.col(f"`{metric}`").cast("double").alias("value"))
        level = rollup.with_baseline(own, known).select("monitor", "entity_id", "ts", F.col("baseline").alias(f"_baseline_{metric}"))
        ticks = ticks.join(level, ["monitor", "entity_id", "ts"], "left")
    return ticks


def evaluate(ticks: DataFrame, definition: Definition, history: DataFrame | None = None) -> DataFrame:
    """``ticks`` (wide) with the derived metrics, ``exempt`` and a column ``rule:NAME`` for each rule.

    Outcomes are 'true', 'false' or 'unknown'. Metrics that the ticks lack are null. Expressions that use
    ``baseline`` read the learned levels of ``history`` (rows of :func:`rollup.baselines`), or columns ``_baseline_METRIC``
    that are there already; without either they are null. Exempt rows stay marked: leave them
    out before anything is stored.
    """
    for name in sorted(definition.metrics - {n for n, _ in definition.derived}):
        if name not in ticks.columns:
            ticks = ticks.withColumn(name, F.lit(None).cast("double"))
    for name in sorted(definition.attrs):
        if name not in ticks.columns:
            ticks = ticks.withColumn(name, F.lit(None).cast("string"))
    names = Names(definition.metrics, definition.attrs, definition.params)

    def prepared(df: DataFrame, needs) -> DataFrame:
        for metric in sorted(needs.rises):
            if f"_rises_{metric}" not in df.columns:
                df = df.withColumn(f"_rises_{metric}", series.rises(F.col(f"`{metric}`")))
        lacking = [m for m in sorted(needs.baselines) if f"_baseline_{m}" not in df.columns]
        if history is not None:
            return with_baselines(df, history, lacking)
        for metric in lacking:
            df = df.withColumn(f"_baseline_{metric}", F.lit(None).cast("double"))
        return df

    for name, text in definition.derived:
        made = compile_expression(text, names)
        ticks = prepared(ticks, made).withColumn(name, scalar.clean(made.column.cast("double")))
    exempt = F.lit(False)
    for text in definition.exempt:
        made = compile_expression(text, names)
        ticks = prepared(ticks, made)
        exempt = exempt | F.coalesce(made.column, F.lit(False))
    rules = [(r, compile_expression(r.when, names)) for r in definition.rules]
    for _, made in rules:
        ticks = prepared(ticks, made)
    out = ticks.withColumns({"exempt": exempt, **{f"rule:{r.name}": made.outcome() for r, made in rules}})
    return out.drop(*(c for c in out.columns if c.startswith(("_rises_", "_baseline_"))))


def outcomes(evaluated: DataFrame, definition: Definition) -> DataFrame:
    """Tall: a row for each tick and rule of entities that aren't exempt."""
    each = [F.struct(F.lit(r.name).alias("rule"), F.lit(r.group).alias("grp"), F.lit(r.severity).alias("severity"), F.lit(r.confirm).alias("confirm"), F.lit(r.clear).alias("clear"), F.lit(r.notify_recovery).alias("notify_recovery"), F.col(f"`rule:{r.name}`").alias("outcome")) for r in definition.rules]
    return evaluated.where("not exempt").select("monitor", "entity_id", "ts", F.explode(F.array(*each)).alias("r")).select("monitor", "entity_id", "ts", "r.*")


def top_union(ticks: DataFrame, metrics: list[str], n: int) -> DataFrame:
    """(ts, entity_id) of the n greatest of any of the metrics at each tick; ties go to the lesser entity_id."""
    chosen = None
    for metric in metrics:
        rank = F.row_number().over(W.partitionBy("ts").orderBy(F.col(metric).desc_nulls_last(), "entity_id"))
        own = ticks.where(F.col(metric).isNotNull()).withColumn("_rank", rank).where(F.col("_rank") <= n).select("ts", "entity_id")
        chosen = own if chosen is None else chosen.union(own)
    return chosen.distinct()


def promote_step(state: dict, ts: int, matching: list[str], slots: int = MAX_PROMOTED, after: int = DEMOTE_AFTER) -> list[tuple[int, str, str]]:
    """One tick of one monitor: who is promoted, demoted or first denied a slot. ``state`` holds 'held' and 'denied'."""
    held, denied = state.setdefault("held", {}), state.setdefault("denied", set())
    events = []
    for entity in matching:
        if entity in held:
            held[entity] = ts
    for entity in sorted(e for e, seen in held.items() if ts - seen > after):
        del held[entity]
        events.append((ts, entity, "demoted"))
    refused = set()
    for entity in sorted(set(matching) - set(held)):
        if len(held) < slots:
            held[entity] = ts
            events.append((ts, entity, "promoted"))
        else:
            refused.add(entity)
            if entity not in denied:
                events.append((ts, entity, "denied"))
    state["denied"] = refused
    return events


def promotions(matches: DataFrame, ticks: DataFrame | None = None) -> DataFrame:
    """matches: (monitor, ts, entity_id) where the promotion rule is true; ticks: (monitor, ts) of all ticks, those without a
    match too, at which slots may fall free. Sticky slots, one sequence a monitor.

    The state is at most 10 slots a monitor; ticks come in time order from Spark's sort and are read in batches.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        monitor, ts, names, state = None, None, [], {}
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if (r.monitor, r.ts) != (monitor, ts):
                    if ts is not None:
                        out += [(monitor, *e) for e in promote_step(state, ts, names)]
                    if r.monitor != monitor:
                        state = {}
                    monitor, ts, names = r.monitor, r.ts, []
                if r.entity_id is not None:
                    names.append(r.entity_id)
            yield pd.DataFrame(out, columns=["monitor", "ts", "entity_id", "kind"])
        if ts is not None:
            yield pd.DataFrame([(monitor, *e) for e in promote_step(state, ts, names)], columns=["monitor", "ts", "entity_id", "kind"])

    rows = matches.select("monitor", "ts", "entity_id")
    if ticks is not None:
        rows = rows.union(ticks.select("monitor", "ts", F.lit(None).cast("string")).distinct())
    dealt = rows.repartition("monitor").sortWithinPartitions("monitor", "ts", "entity_id")
    return dealt.mapInPandas(work, "monitor string, ts long, entity_id string, kind string")
