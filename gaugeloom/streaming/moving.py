"""Functions over a trailing window in a stream: a series' points no older than the longest window are its state."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gaugeloom.functions.series import capacity

KEYS = ("monitor", "entity_id", "metric")
#: Functions by name; each is a column NAME_LABEL for each window.
FUNCTIONS = ("avg", "min", "max", "delta", "rate", "slope", "monot", "coverage", "count")


def measures(ts: np.ndarray, value: np.ndarray, width: int) -> dict[str, float | None]:
    """The functions over one window's points, oldest first; the last point is now."""
    n = len(ts)
    out: dict[str, float | None] = dict.fromkeys(FUNCTIONS)
    out |= {"avg": float(np.mean(value)), "min": float(value.min()), "max": float(value.max()), "count": float(n)}
    if n < 2:
        return out
    rise, elapsed = float(value[-1] - value[0]), float(ts[-1] - ts[0])
    out |= {"delta": rise, "monot": float(np.mean(value[1:] > value[:-1])), "coverage": min(max(elapsed / width, 0.0), 1.0)}
    if elapsed > 0:
        out["rate"] = max(rise, 0.0) / elapsed
    if n > 2:
        x = (ts - ts[-1]).astype(float)
        x -= x.mean()
        if spread := float(x @ x):
            out["slope"] = float(x @ (value - value.mean())) / spread
    return out


def moving(samples: DataFrame, widths: Mapping[str, int], late: str = "30 seconds", interval: int | None = None) -> DataFrame:
    """samples: a stream of (monitor, entity_id, metric, ts, value). Each point with the functions over the windows that end
    at it, {label: seconds}: columns avg_LABEL, min_LABEL ... count_LABEL. The same as the batch columns over the same rows.

    A point waits until the watermark (the newest ts less ``late``) has passed it, so points that come in another order
    are taken in that of their ts; one that is later still is left out. Of points at the same ts the last that came
    counts. With ``interval``, a series keeps at most the points of the longest window's capacity, the newest.

    A series' state is its waiting points and those of its longest window, as two arrays. It goes with the checkpoint: a
    restarted stream goes on as if it had not stopped. A series that sends nothing more gives its last points once
    other series move the watermark on, and keeps its window.
    """
    longest = max(widths.values())
    room = capacity(longest, interval) if interval else None
    names = [f"{f}_{label}" for label in widths for f in FUNCTIONS]

    def work(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ts, value, done = (np.array(state.get[0], np.int64), np.array(state.get[1], float), state.get[2]) if state.exists else (np.zeros(0, np.int64), np.zeros(0), -(2**62))
        if not state.hasTimedOut:
            rows = pd.concat(list(batches))
            rows = rows[rows["ts"] > done]
            points = dict(zip(ts.tolist(), value.tolist(), strict=True)) | dict(zip(rows["ts"].tolist(), rows["value"].tolist(), strict=True))
            ts = np.array(sorted(points), np.int64)
            value = np.array([points[t] for t in ts.tolist()], float)
        passed = state.getCurrentWatermarkMs() // 1000
        ready = np.flatnonzero((ts > done) & (ts <= passed))
        out = []
        for i in ready:
            row = []
            for label, width in widths.items():
                first = int(np.searchsorted(ts, ts[i] - width))
                if room:
                    first = max(first, i + 1 - room)
                row += measures(ts[first : i + 1], value[first : i + 1], width).values()
            out.append((*key, int(ts[i]), float(value[i]), *row))
        if len(ready):
            done = int(ts[ready[-1]])
        keep = ts >= min(done, int(ts[-1]) if len(ts) else done) - longest
        ts, value = ts[keep], value[keep]
        state.update((ts.tolist(), value.tolist(), done))
        waiting = ts[ts > done]
        if len(waiting):
            state.setTimeoutTimestamp(max(int(waiting[0]) * 1000, state.getCurrentWatermarkMs() + 1))
        made = pd.DataFrame(out, columns=[*KEYS, "ts", "value", *names])
        yield made.astype(dict.fromkeys(names, float))

    timed = samples.select(*KEYS, "ts", "value").where(F.col("value").isNotNull() & ~F.isnan("value")).withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", late)
    schema = ", ".join([*(f"{k} string" for k in KEYS), "ts long", "value double", *(f"{n} double" for n in names)])
    return timed.groupBy(*KEYS).applyInPandasWithState(work, schema, "ts array<long>, value array<double>, done long", "append", GroupStateTimeout.EventTimeTimeout)
