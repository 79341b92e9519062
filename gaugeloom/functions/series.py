"""Functions over a series' trailing window [now - width, now], as columns over a time-range frame."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEYS = ("monitor", "entity_id")


def trailing(width: int, keys: tuple[str, ...] = KEYS, ts: str = "ts") -> WindowSpec:
    """The frame of the last ``width`` seconds, both ends included. Equal widths share one window stage."""
    return W.partitionBy(*keys).orderBy(ts).rangeBetween(-width, 0)


def capacity(width: float, interval: float) -> int:
    """Points that are kept of a series sampled each ``interval`` seconds for windows of up to ``width``."""
    return ceil(width / interval) + 2


def so_far(keys: tuple[str, ...] = KEYS, ts: str = "ts") -> WindowSpec:
    return W.partitionBy(*keys).orderBy(ts).rangeBetween(W.unboundedPreceding, 0)


def _first(v: Column, w: WindowSpec) -> Column:
    return F.first(v, ignorenulls=True).over(w)


def _last(v: Column, w: WindowSpec) -> Column:
    return F.last(v, ignorenulls=True).over(w)


def _seen(v: Column, ts: Column) -> Column:
    return F.when(v.isNotNull(), ts)


def last(v: Column, keys: tuple[str, ...] = KEYS) -> Column:
    """The latest value, which stays where a tick lacks the metric."""
    return _last(v, so_far(keys))


def avg(v: Column, w: WindowSpec) -> Column:
    return F.avg(v).over(w)


def low(v: Column, w: WindowSpec) -> Column:
    return F.min(v).over(w)


def high(v: Column, w: WindowSpec) -> Column:
    return F.max(v).over(w)


def delta(v: Column, w: WindowSpec) -> Column:
    """Last less first; null under two points."""
    return F.when(F.count(v).over(w) >= 2, _last(v, w) - _first(v, w))


def rate(v: Column, w: WindowSpec, ts: Column) -> Column:
    """Rise a second between the window's ends; a fall, as of a counter that was reset, is 0."""
    seen = _seen(v, ts)
    elapsed = F.max(seen).over(w) - F.min(seen).over(w)
    return F.when((F.count(v).over(w) >= 2) & (elapsed > 0), F.greatest(_last(v, w) - _first(v, w), F.lit(0.0)) / elapsed)


def slope(v: Column, w: WindowSpec, ts: Column) -> Column:
    """Least-squares slope a second; null under three points or without spread in time."""
    return F.when(F.count(v).over(w) >= 3, F.regr_slope(v, ts.cast("double")).over(w))


def rises(v: Column, keys: tuple[str, ...] = KEYS) -> Column:
    """1 where a point is above the one before it, else 0: a column that must stand before :func:`monot` is used."""
    before = F.last(v, ignorenulls=True).over(W.partitionBy(*keys).orderBy("ts").rowsBetween(W.unboundedPreceding, -1))
    return F.when(v.isNotNull(), F.coalesce((v > before).cast("int"), F.lit(0)))


def monot(up: Column, v: Column, w: WindowSpec) -> Column:
    """The share of steps within the window that rise; null under two points.

    A step's rise is known at its later point; the first point's step crosses the frame's edge and is left out.
    """
    n = F.count(v).over(w)
    return F.when(n >= 2, (F.sum(up).over(w) - _first(up, w)) / (n - 1))


def coverage(v: Column, w: WindowSpec, ts: Column, width: float) -> Column:
    """The share of the window between its first and last point; null under two points."""
    seen = _seen(v, ts)
    share = (F.max(seen).over(w) - F.min(seen).over(w)) / F.lit(float(width))
    return F.when(F.count(v).over(w) >= 2, F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)))


def age(v: Column, ts: Column, keys: tuple[str, ...] = KEYS) -> Column:
    """Seconds since the last point."""
    return F.greatest(ts - F.max(_seen(v, ts)).over(so_far(keys)), F.lit(0))
