import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeloom.operators import store, upkeep

DAY = 86400
POINTS = "entity_id string, ts long, value double"


def test_tiers():
    now = 1000 * DAY
    assert store.tier(now - DAY // 2, now, now, True) == "raw"
    assert store.tier(now - DAY, now, now, True) == "5m"
    assert store.tier(now - 20 * DAY, now, now, True) == "5m"
    assert store.tier(now - 20 * DAY, now, now, False) == "1h"
    assert store.tier(now - 20 * DAY, now, now, None) == "1h"


def test_lttb_keeps_ends_count_and_spikes():
    rng = random.Random(1)
    for size in (1, 2, 3, 10, 100, 1001):
        ts, v = np.arange(size) * 60.0, np.array([rng.random() for _ in range(size)])
        for n in (2, 3, 10, 50, 2000):
            kept = store.lttb(ts, v, n)
            assert len(kept) == min(n, size) and kept[-1] == size - 1 and kept[0] == 0
            assert (np.diff(kept) > 0).all()
    v = np.zeros(500)
    v[333] = 50.0
    assert 333 in store.lttb(np.arange(500.0), v, 20)


def test_downsample_keeps_each_series_ends(spark):
    df = spark.createDataFrame([(f"e{k}", i * 60, float(i * k % 17)) for k in range(3) for i in range(200)], POINTS)
    rows = store.downsample(df, 10).collect()
    assert len(rows) == 30 and {(r.entity_id, r.ts) for r in rows} >= {(f"e{k}", t) for k in range(3) for t in (0, 199 * 60)}


def test_projection(spark):
    rate = spark.createDataFrame([("d", 100, -10.0), ("d", 200, 100.0), ("d", 300, 100.0)], POINTS)
    left = spark.createDataFrame([("d", 100, 450.0), ("d", 200, 450.0), ("d", 400, 1.0)], POINTS)
    got = store.projection(rate, left).orderBy("ts").collect()
    assert [(r.ts, r.hours, r.limit_ts) for r in got] == [(100, None, None), (200, 4.5, 16400.0)]
    low = spark.createDataFrame([("d", 100, 0.1), ("d", 200, 0.1)], POINTS)
    assert [r.hours for r in store.projection(rate, left, low, 0.5).collect()] == [None, None]


def test_gaps_and_runs(spark):
    df = spark.createDataFrame([("a", t, 1.0) for t in (0, 300, 600, 1500, 1800)], POINTS)
    assert [(r.ts, r.value) for r in store.gaps(df, 300).orderBy("ts").collect()] == [(0, 1.0), (300, 1.0), (600, 1.0), (900, None), (1500, 1.0), (1800, 1.0)]
    assert [(r.first_ts, r.last_ts, r.points) for r in store.runs(df, 300).orderBy("run").collect()] == [(0, 600, 3), (1500, 1800, 2)]


def test_bounded(spark):
    counts = spark.createDataFrame([(f"e{i}", 3000) for i in range(7)], "entity_id string, points long")
    got = store.bounded(counts, max_entities=6).orderBy("entity_id").collect()
    assert [r.budget for r in got] == [2000] * 5 + [0] and all(r.truncated for r in got)


def test_pages_go_through_all(spark):
    rows = spark.createDataFrame([("m", f"e{i:02}", "x") for i in range(25)], "monitor string, entity_id string, metric string")
    seen, after = [], None
    while page := store.page(rows, after, 10).collect():
        seen += [r.entity_id for r in page]
        after = tuple(page[-1])
    assert seen == [f"e{i:02}" for i in range(25)]
    with pytest.raises(ValueError):
        store.page(rows, None, 501)


def test_nearest_rank(spark):
    rows = spark.createDataFrame([("k", float(v)) for v in [5, 1, 3, 2, 4, 4]], "key string, v double")
    assert tuple(store.nearest_rank(rows, "key", "v").first()) == ("k", 3.0, 5.0, 5.0)


def test_stage_rates_and_resets(spark):
    rows = [("s", m, t, v) for m, vs in (("a", [0.0, 10.0, 30.0]), ("b", [9.0, 4.0, 1.0])) for t, v in zip((0, 10, 20), vs, strict=True)] + [("s", "a", 30, 99.0)]
    got = {r.metric: r.rate for r in store.stage_rates(spark.createDataFrame(rows, "entity_id string, metric string, ts long, value double"), ["a", "b"]).collect()}
    assert got == {"a": 1.5, "b": None}


def test_context_is_all_within_the_span(spark):
    log = spark.createDataFrame([(i, i * 100) for i in range(100)], "id long, ts long")
    cases = spark.createDataFrame([(1, 5000), (2, 600), (3, 0)], "incident long, opened_ts long")
    got = {(r.incident, r.ts) for r in store.context(cases, log).collect()}
    assert got == {(i, t * 100) for i, o in ((1, 5000), (2, 600), (3, 0)) for t in range(100) if abs(t * 100 - o) <= 600}


def test_degrade_drops_in_order(spark):
    days = spark.createDataFrame([(1, 1, 10), (1, 2, 10), (2, 1, 10), (3, 1, 10)], "step int, day int, bytes long")
    dropped = lambda budget: sorted((r.step, r.day) for r in upkeep.degrade(days, budget).where("dropped").collect())
    assert dropped(40) == [] and dropped(25) == [(1, 1), (1, 2)] and dropped(15) == [(1, 1), (1, 2), (2, 1)]


def test_retry_schedule(spark):
    df = spark.createDataFrame([(1, None), (2, None), (9, None), (1, 1000)], "n int, after int")
    got = df.select(upkeep.next_attempt(F.lit(100), F.col("n"), F.col("after"), F.lit(0)).alias("t")).collect()
    assert [r.t for r in got] == [130, 220, 21700, 1100]
    assert df.limit(1).select(upkeep.next_attempt(F.lit(90_000), F.col("n"), F.col("after"), F.lit(0)).alias("t")).first().t is None


def test_history_folds(spark):
    df = spark.createDataFrame([("k", i, i, 1 + i % 2, "x") for i in range(1, 8)], "k string, seq long, ts long, severity int, kind string")
    got = upkeep.fold_history(df, ["k"], most=5, fold=3).orderBy("seq").collect()
    assert [(r.seq, r["count"], r.kind) for r in got] == [(1, 3, "collapsed"), (4, 1, "x"), (5, 1, "x"), (6, 1, "x"), (7, 1, "x")]
    assert (got[0].last_ts, got[0].severity_min, got[0].severity) == (3, 1, 2)
    assert upkeep.fold_history(df, ["k"]).count() == 7


def test_digest_is_one_a_night_for_all_channels(spark):
    """Quiet hours from 22:00: what is held after midnight belongs to the day before."""
    rows = [("mail", 100 + i, DAY + 60 * i, 1 + i % 2, f"title {i:02}") for i in range(45)] + [("file", 100, DAY, 1, "title 00"), ("mail", 1, DAY, 3, "error"), ("mail", 2, DAY + 43200, 1, "noon")]
    got = upkeep.digest(spark.createDataFrame(rows, "channel string, notification_id long, ts long, severity int, title string"), "22:00-07:00").collect()
    assert [(r.day, r.n, r.severity, r.channels) for r in got] == [(0, 45, 2, ["file", "mail"])]
    whole = "worst: warning — " + "; ".join(f"title {i:02}" for i in range(45))
    assert got[0].body == whole[:200] and got[0].title == "45 notification(s) held during quiet hours"
