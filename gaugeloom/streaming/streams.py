"""The streaming forms of rollups, sessions, replay removal, incident notifications and the sample store."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from gaugeloom.functions import scalar
from gaugeloom.operators import incidents

LATE = "30 seconds"
NOTES = "monitor string, entity_id string, grp string, ts long, kind string, severity int"


def _timed(stream: DataFrame, late: str) -> DataFrame:
    return stream.withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", late)


def rollup_5m(samples: DataFrame, late: str = LATE) -> DataFrame:
    """Five-minute rows of each series, given out once a bucket can get no more samples."""
    keys = ["monitor", "entity_id", "metric"]
    made = _timed(samples, late).groupBy(F.window("at", "5 minutes"), *keys).agg(
        F.avg("value").alias("avg"), F.min("value").alias("min"), F.max("value").alias("max"), F.max_by("value", "ts").alias("last"), F.count("*").alias("cnt")
    )
    return made.select(*keys, F.unix_seconds("window.start").alias("bucket"), "avg", "min", "max", "last", "cnt")


def sessions(log: DataFrame, quiet_s: int, late: str = LATE) -> DataFrame:
    """Episodes of a key: events no further apart than the quiet time."""
    key = scalar.episode_key(F.col("provider"), F.col("event_id"), F.col("message"))
    made = _timed(log.withColumn("key", key), late).groupBy(F.session_window("at", f"{quiet_s} seconds"), "key").agg(F.count("*").alias("occurrences"), F.max("severity").alias("severity"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return made.drop("session_window")


def without_replays(log: DataFrame, identity: str = "identity", late: str = "5 seconds") -> DataFrame:
    """Events whose identity hasn't come before within the watermark."""
    return _timed(log, late).dropDuplicatesWithinWatermark([identity]).drop("at")


def notifications(levels: DataFrame) -> DataFrame:
    """Incident notifications from a stream of levels, as :func:`incidents.notifications` takes them, by the fold that batch uses.

    A group's state is one small JSON text. Rows of a micro-batch are taken in time order; one that is older
    than the group's last tick is passed over, as a late sample can't change what was decided.
    """
    keys = incidents.GROUP

    def work(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {}
        out = fold_levels(key, batches, held)
        state.update((json.dumps(held),))
        yield out

    return incidents.with_defaults(levels).groupBy(*keys).applyInPandasWithState(work, NOTES, "held string", "append", GroupStateTimeout.NoTimeout)


def fold_levels(key: tuple, batches: Iterator[pd.DataFrame], held: dict) -> pd.DataFrame:
    """The notifications of a group's rows of a micro-batch; ``held`` is its state, which goes on from them."""
    out = []
    for r in pd.concat(list(batches)).sort_values("ts").itertuples(index=False):
        if r.ts > held.get("tick", -(2**62)):
            held["tick"] = int(r.ts)
            out += [(*key, r.ts, *n) for n in incidents.step(held, int(r.ts), int(r.severity), bool(r.owner_true), reason=r.reason, tells=bool(r.tells))]
    return pd.DataFrame(out, columns=[*incidents.GROUP, "ts", "kind", "severity"])


class _Resumed(StatefulProcessor):
    """The fold of notifications, of which a new checkpoint begins with given states."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "held string")

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N803
        self.held.update((initialState["held"].iloc[0],))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = json.loads(self.held.get()[0]) if self.held.exists() else {}
        out = fold_levels(key, rows, held)
        self.held.update((json.dumps(held),))
        yield out

    def close(self) -> None:
        pass


def stored_states(stored: DataFrame, notes: DataFrame) -> DataFrame:
    """(monitor, entity_id, grp, held): states of the fold for incidents that are not cleared.

    stored: (incident_id, monitor, entity_id, grp, state: open, acked or cleared, severity, peak_severity, opened_ts, last_change_ts,
    notify_count, flapping); notes: (incident_id, ts), the notifications that were made. The backoff goes on from the number of
    notifications and the time of the last one. Of several open incidents of a group the one opened last counts.
    """
    last = notes.groupBy("incident_id").agg(F.max("ts").alias("_told"))
    longest = len(incidents.BACKOFF) - 1
    open_ = stored.where("state <> 'cleared'").join(last, "incident_id", "left")
    tier = F.when(F.col("flapping"), longest).otherwise(F.least(F.greatest(F.col("notify_count") - 1, F.lit(0)), F.lit(longest)))
    state = F.struct(
        "severity", F.greatest("severity", "peak_severity").alias("peak"), F.coalesce("_told", "opened_ts").alias("last"), tier.cast("int").alias("tier"), "flapping",
        (F.col("state") == "acked").alias("acked"), F.col("opened_ts").alias("opened"), F.greatest("last_change_ts", F.coalesce("_told", "opened_ts")).alias("tick"),
    )
    newest = open_.groupBy(*incidents.GROUP).agg(F.max_by(F.to_json(state), F.struct("opened_ts", "incident_id")).alias("held"))
    return newest.select(*incidents.GROUP, "held")


def resumed_notifications(levels: DataFrame, states: DataFrame) -> DataFrame:
    """As :func:`notifications`, for a checkpoint that is new while incidents are open: it begins with their states
    (:func:`stored_states`), so none is opened or told of again. Ticks up to a state's last one are passed over.

    Needs the session's state store to be RocksDB's (spark.sql.streaming.stateStore.providerClass).
    """
    keys = incidents.GROUP
    grouped = incidents.with_defaults(levels).groupBy(*keys)
    return grouped.transformWithStateInPandas(_Resumed(), NOTES, "Append", "None", initialState=states.groupBy(*keys))


def gone(samples: DataFrame, grace_s: int = incidents.GONE_AFTER, late: str = LATE) -> DataFrame:
    """(monitor, entity_id, last_seen) of entities that the stream hasn't shown for the grace, told once each time."""

    def work(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else -1
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(*key, last)], columns=["monitor", "entity_id", "last_seen"])
            return
        for pdf in batches:
            last = max(last, int(pdf["ts"].max()))
        state.update((last,))
        state.setTimeoutTimestamp(max((last + grace_s) * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([], columns=["monitor", "entity_id", "last_seen"])

    timed = _timed(samples, late).groupBy("monitor", "entity_id")
    return timed.applyInPandasWithState(work, "monitor string, entity_id string, last_seen long", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def store(stream: DataFrame, path: str, checkpoint: str, partition: Callable[[DataFrame], DataFrame] | None = None):
    """Append a stream to Parquet by day, each micro-batch written once under its number, so a batch that is run again replaces itself."""

    def put(batch: DataFrame, number: int) -> None:
        rows = partition(batch) if partition else batch.withColumn("day", F.floor(F.col("ts") / 86400))
        rows.write.mode("overwrite").partitionBy("day").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
