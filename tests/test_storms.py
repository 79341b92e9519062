"""Storms over minutes: windows, the stream and a plain loop over ticks agree."""

import random

import pytest

from gaugeloom.operators import storms
from tests.test_streams import few_partitions, feed, rows_of  # noqa: F401

SCHEMA = "id long, ts long, source string, provider string"


def events(seed=1):
    rng = random.Random(seed)
    rows, n = [], 0
    for provider in ("kern", "web"):
        t = 1_700_000_040
        for _ in range(60):
            t += rng.choice([1, 2, 7, 13, 55, 60, 61, 200])
            for _ in range(rng.choice([1, 1, 2, 5])):
                n += 1
                rows.append((n, t, "app", provider))
    return sorted(rows, key=lambda r: (r[1], r[0]))


def plain(rows, limit, minute=60, tick=5):
    """Every tick of the whole time is stepped through."""
    stored, found = set(), []
    for provider in {r[3] for r in rows}:
        own = {}
        for i, ts, _, p in rows:
            if p == provider:
                own.setdefault(-(-ts // tick) * tick, []).append(i)
        at, n, active, lost, start = None, 0, False, 0, None
        for now in range(min(own), max(own) + 3 * minute, tick):
            for i in sorted(own.get(now, [])):
                if now // minute != at:
                    at, n = now // minute, 0
                if not active:
                    n += 1
                    if n <= limit:
                        stored.add(i)
                        continue
                    active, lost, start = True, 0, now
                lost += 1
            if active and now // minute > at:
                found.append((provider, start, now, lost))
                active, n, at = False, 0, now // minute
    return stored, sorted(found)


@pytest.mark.parametrize("limit", [1, 2, 4])
def test_windows_equal_a_loop_over_ticks(spark, limit):
    rows = events(limit)
    df = spark.createDataFrame(rows, SCHEMA)
    stored, found = plain(rows, limit)
    assert found and {r.id for r in storms.guard(df, limit).where("stored").collect()} == stored
    assert sorted((r.provider, r.start_ts, r.end_ts, r.collapsed) for r in storms.storms(df, limit).collect()) == found
    now = found[0][2] - 1
    assert storms.storms(df, limit, now=now).where("end_ts is null").count() == sum(f[2] > now for f in found)


def test_a_storm_lasts_over_minutes_only_with_an_event_at_the_turn(spark):
    at_turn = [(i, 60 + i, "s", "p") for i in range(5)] + [(9, 118, "s", "p"), (10, 130, "s", "p")]
    late = [(i, 60 + i, "s", "p") for i in range(5)] + [(10, 130, "s", "p")]
    one = lambda rows: [tuple(r) for r in storms.storms(spark.createDataFrame(rows, SCHEMA), 2).collect()]
    assert one(at_turn) == [("s", "p", 65, 180, 5)]
    assert one(late) == [("s", "p", 65, 120, 3)]


def test_stream_equals_batch(spark, tmp_path):
    rows = events(5)
    end = [(10_000 + i, rows[-1][1] + 5000 + 100 * i, "app", "other") for i in range(4)]
    cut = [0, 40, 90, 140, len(rows)]
    stream = feed(spark, tmp_path, [*(rows[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)), *([e] for e in end)], SCHEMA)
    got = [r for r in rows_of(spark, storms.guard_stream(stream, 2), tmp_path, "storms") if r["provider"] != "other"]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(r["id"] for r in got if r["kind"] == "stored") == sorted(r["id"] for r in storms.guard(df, 2).where("stored").collect())
    batch = storms.storms(df, 2).collect()
    assert sorted((r["provider"], r["ts"]) for r in got if r["kind"] == "start") == sorted((r["provider"], r["start_ts"]) for r in batch)
    assert sorted((r["provider"], r["ts"], r["collapsed"]) for r in got if r["kind"] == "over") == sorted((r["provider"], r["end_ts"], r["collapsed"]) for r in batch)


def test_no_rows(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert storms.guard(df).count() == storms.storms(df).count() == 0
