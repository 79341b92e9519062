from gaugeloom.operators import episodes


def told(spark, matches, acks=None, **how):
    rows = spark.createDataFrame(matches, "key string, ts long, count long, id long")
    given = spark.createDataFrame(acks, "key string, ts long") if acks is not None else None
    return sorted((r.key, r.ts, r.kind) for r in episodes.episodes(rows, cooldown=600, clear_after=1800, acks=given, **how).collect())


def test_an_acknowledged_episode_is_silent_until_it_ends(spark):
    times = [0, 600, 1200, 1800, 2400, 6000, 6600]
    matches = [(k, t, 1, i) for k in "ab" for i, t in enumerate(times)]
    got = told(spark, matches, [("b", 900)], now=9000)
    assert [(t, kind) for k, t, kind in got if k == "a"] == [(0, "open"), (600, "renotify"), (1200, "renotify"), (1800, "renotify"), (2400, "renotify"), (4200, "clear"), (6000, "open"), (6600, "renotify"), (8400, "clear")]
    assert [(t, kind) for k, t, kind in got if k == "b"] == [(0, "open"), (600, "renotify"), (4200, "clear"), (6000, "open"), (6600, "renotify"), (8400, "clear")]


def test_an_acknowledgement_at_a_match_comes_first_and_one_before_the_opening_does_nothing(spark):
    matches = [("a", t, 1, t) for t in (0, 600, 1200)]
    assert [t for _, t, kind in told(spark, matches, [("a", 600)]) if kind == "renotify"] == []
    assert [t for _, t, kind in told(spark, matches, [("a", -5), ("a", 0), ("z", 600)]) if kind == "renotify"] == [600, 1200]
    assert told(spark, matches, []) == told(spark, matches)


def test_late_rows_by_ingest_order(spark):
    """Folded by id; an acknowledgement stands by time."""
    matches = [("a", 0, 1, 1), ("a", 1300, 1, 2), ("a", 700, 1, 3)]
    assert [t for _, t, kind in told(spark, matches, [("a", 1000)]) if kind == "renotify"] == []
