import random

from gaugeloom.operators import episodes, incidents, rules

SCHEMA = "monitor string, entity_id string, grp string, rule string, severity int, confirm int, clear int, ts long, outcome string"


def outcomes(spark, texts, confirm=3, clear=2):
    names = {"t": "true", "f": "false", "u": "unknown"}
    rows = [("m", f"e{k}", "g", "r", 2, confirm, clear, i * 60, names[c]) for k, t in enumerate(texts) for i, c in enumerate(t)]
    return spark.createDataFrame(rows, SCHEMA)


def counters(text, confirm=3, clear=2):
    on, up, down, out = False, 0, 0, ""
    for c in text:
        if c == "t":
            up, down = up + 1, 0
            on = on or up >= confirm
        elif c == "f":
            up, down = 0, down + 1
            on = on and down < clear
        out += "1" if on else "0"
    return out


def test_confirmation_is_that_of_counters(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choices("tfu", k=40)) for _ in range(60)] + ["ttt", "ttutf", "uuu"]
    got = {}
    for r in incidents.confirmed(outcomes(spark, texts)).orderBy("ts").collect():
        got[r.entity_id] = got.get(r.entity_id, "") + ("1" if r.confirmed else "0")
    assert [got[f"e{k}"] for k in range(len(texts))] == [counters(t) for t in texts]


def test_ladder_opens_escalates_downgrades_and_clears(spark):
    levels = [80, 87, 87, 98, 98, 87, 70, 70]
    rows = []
    for name, severity, at in (("warn", 2, 85), ("crit", 4, 97)):
        rows += [("m", "e", "space", name, severity, 1, 1, i * 60, "true" if v >= at else "false") for i, v in enumerate(levels)]
    got = incidents.ladder(incidents.confirmed(spark.createDataFrame(rows, SCHEMA))).orderBy("ts").collect()
    assert [(r.ts // 60, r.kind, r.severity) for r in got] == [(1, "open", 2), (3, "escalate", 4), (5, "downgrade", 2), (6, "clear", -1)]
    one = incidents.summary(incidents.ladder(incidents.confirmed(spark.createDataFrame(rows, SCHEMA)))).first()
    assert (one.opened_ts, one.cleared_ts, one.peak_severity, one.state) == (60, 360, 4, "cleared")


def test_flapping_opens(spark):
    got = incidents.flapping(incidents.ladder(incidents.confirmed(outcomes(spark, ["ttff" * 5], 1, 1)))).orderBy("ts").collect()
    assert [r.flapping for r in got] == [False, False, False, True, True]


def test_backoff_escalation_ack_and_recovery():
    state, out = {}, []
    for now in range(0, 6000, 60):
        out += [(now, *n) for n in incidents.step(state, now, 2, True)]
    assert [(t, k) for t, k, _ in out] == [(0, "open"), (300, "renotify"), (1200, "renotify"), (4800, "renotify")]
    assert incidents.step(state, 6000, 4, True) == [("escalate", 4)]
    assert incidents.step(state, 6060, 4, True, acked=True) == []
    assert incidents.step(state, 60_000, 4, True) == []
    assert incidents.step(state, 60_060, 2, True) == []  # a downgrade is silent, whatever the backoff says
    assert incidents.step(state, 60_120, -1, False) == [("recover", 0)]
    assert incidents.step({}, 5, -1, False) == []
    state = {}
    incidents.step(state, 0, 2, True)
    assert incidents.step(state, 400, 2, False) == []


def test_a_flapping_incident_starts_with_the_longest_wait():
    state, out = {}, []
    for now in range(0, 600, 60):
        out += incidents.step(state, now, 2 if now % 120 == 0 else -1, True)
    assert state["clears"] == [60, 180, 300, 420, 540]
    assert incidents.step(state, 600, 2, True) == [("open", 2)] and state["flapping"]
    assert incidents.step(state, 600 + 21_540, 2, True) == []
    assert incidents.step(state, 600 + 21_600, 2, True) == [("renotify", 2)]


def test_notifications_fold_each_group(spark):
    rows = [("m", f"e{k}", "g", t, 2 if t < 1500 else -1, True) for k in range(30) for t in range(0, 1800, 60)]
    got = incidents.notifications(spark.createDataFrame(rows, "monitor string, entity_id string, grp string, ts long, severity int, owner_true boolean")).collect()
    assert len(got) == 30 * 4
    assert [(r.ts, r.kind) for r in sorted(got, key=lambda r: r.ts) if r.entity_id == "e7"] == [(0, "open"), (300, "renotify"), (1200, "renotify"), (1500, "recover")]


def test_gone(spark):
    df = spark.createDataFrame([("m", "a", 0), ("m", "a", 300), ("m", "a", 601), ("m", "b", 900)], "monitor string, entity_id string, ts long")
    got = {(r.entity_id, r.last_seen, r.gone_ts, r.back_ts) for r in incidents.gone(df, now=1000).collect()}
    assert got == {("a", 300, 601, 601), ("a", 601, 902, None)}


def test_promotion_slots():
    state = {}
    first = rules.promote_step(state, 0, [f"p{i:02}" for i in range(12)])
    assert [k for _, _, k in first] == ["promoted"] * 10 + ["denied"] * 2
    assert rules.promote_step(state, 60, [f"p{i:02}" for i in range(12)]) == []
    later = rules.promote_step(state, 1861, ["p11"])
    assert (1861, "p00", "demoted") in later and (1861, "p11", "promoted") in later


def test_promotions_of_each_monitor(spark):
    rows = [(m, t * 60, f"p{i}") for m in "ab" for t in range(5) for i in range(12)]
    got = rules.promotions(spark.createDataFrame(rows, "monitor string, ts long, entity_id string")).collect()
    assert sorted({(r.monitor, r.kind) for r in got}) == [("a", "denied"), ("a", "promoted"), ("b", "denied"), ("b", "promoted")]
    assert len(got) == 24


def test_slots_fall_free_at_ticks_without_matches(spark):
    matches = spark.createDataFrame([("m", 0, "p")], "monitor string, ts long, entity_id string")
    ticks = spark.createDataFrame([("m", t) for t in range(0, 3600, 60)], "monitor string, ts long")
    got = [(r.ts, r.entity_id, r.kind) for r in rules.promotions(matches, ticks).orderBy("ts").collect()]
    assert got == [(0, "p", "promoted"), (1860, "p", "demoted")]


def test_top_union(spark):
    df = spark.createDataFrame([(0, f"p{i}", float(i), float(10 - i)) for i in range(10)], "ts long, entity_id string, cpu double, rss double")
    assert {r.entity_id for r in rules.top_union(df, ["cpu", "rss"], 2).collect()} == {"p9", "p8", "p0", "p1"}


LOG = "id long, ts long, source string, provider string, event_id string, severity int, message string"


def test_coalescing_and_sessions(spark):
    texts = ["oom pid 1", "oom pid 1", "oom pid 2", "other", "oom pid 2"]
    df = spark.createDataFrame([(i, i * 30, "s", "kernel", None, 3, t) for i, t in enumerate(texts)], LOG)
    got = episodes.coalesce_repeats(df).orderBy("id").collect()
    assert [r.repeat_count for r in got] == [2, 1, 1, 1]
    burst = spark.createDataFrame([(i, i * 30, "s", "kernel", None, 3, f"Out of memory: pid {i}") for i in range(12)] + [(99, 5000, "s", "kernel", None, 3, "out  of memory: PID 7")], LOG)
    got = episodes.sessions(burst, 600).orderBy("first_ts").collect()
    assert [(r.occurrences, r.first_ts, r.last_ts) for r in got] == [(12, 0, 330), (1, 5000, 5000)]


def test_storms(spark):
    df = spark.createDataFrame([(i, i // 10, "s", "p", None, 1, "x") for i in range(1500)], LOG)
    assert episodes.storm_guard(df).where("stored").count() == 300
    storm = episodes.storms(df).first()
    assert (storm.start_ts, storm.end_ts, storm.collapsed) == (0, 180, 500 + 500 + 200)


def test_episode_steps():
    state, out = {}, []
    for ts in (0, 10, 20, 4000, 9000):
        out += episodes.step_episode(state, ts, 1, confirm=2, confirm_span=60, cooldown=3600, clear_after=4500)
    assert out == [("open", 10), ("renotify", 4000), ("clear", 8500)]


def test_episodes_in_ingest_order_end_with_the_data(spark):
    rows = [("k", 20, 1, 1), ("k", 10, 1000, 2), ("j", 5000, 1, 3)]
    df = spark.createDataFrame(rows, "key string, ts long, count long, id long")
    got = sorted((r.key, r.kind, r.ts) for r in episodes.episodes(df, confirm=3, clear_after=1800, now=4000).collect())
    assert got == [("k", "clear", 1810), ("k", "open", 10)]


def test_arrival_rate_counts_repeats(spark):
    df = spark.createDataFrame([("p", 0, 30), ("p", 30, None), ("p", 70, 5)], "provider string, ts long, repeat_count long")
    assert [round(r.rate_per_s * 60, 6) for r in episodes.arrival_rate(df).orderBy("ts").collect()] == [30, 31, 6]


def test_confirmation_and_ladder_need_one_sort_each(spark):
    plan = incidents.ladder(incidents.confirmed(outcomes(spark, ["ttff"], 1, 1)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("+- Sort [") == 2 and "HashAggregate" not in plan


def test_a_tasks_share_of_ticks_is_fixed_and_no_map_groups_them(spark):
    from gaugeloom import catalogue

    plan = catalogue.QUERIES["incident_fold"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    moved = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert len(moved) == 2 and all("REPARTITION_BY_NUM" in x for x in moved), moved  # Spark joins no partitions of these by size
    below = plan[plan.rindex("Exchange hashpartitioning") :]
    assert "Aggregate" not in below and "Aggregate" in plan, plan
