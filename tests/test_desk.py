"""Acknowledgements, ends of lives, filters, evidence, integrity."""

import json
import random

import pytest
from pyspark.sql import functions as F

from gaugeloom.operators import desk, incidents, rules, upkeep
from gaugeloom.plans.definitions import load
from gaugeloom.plans.expression import ExpressionError

OUTCOME = "monitor string, entity_id string, ts long, rule string, grp string, severity int, confirm int, clear int, outcome string"
TREND = """
schema = 1
[monitor]
name = "store"
source = "disk"
[[derived]]
name = "db_bytes"
expr = "used_bytes"
[[derived]]
name = "growth"
expr = "rate(used_bytes, '1h')"
[[rule]]
name = "size"
when = "db_bytes > 4 * GB"
severity = "warning"
[[rule]]
name = "work"
when = "db_bytes - free_bytes > 5"
severity = "warning"
[[trend]]
name = "space"
value = "used_bytes"
rate = "growth"
value_unit = "bytes"
rate_unit = "bytes/s"
"""


def outcome_rows(spark, rows):
    return spark.createDataFrame([("m", "e", t, "r", "g", 2, 2, 2, o) for t, o in rows], OUTCOME)


def ends(spark, *rows):
    return spark.createDataFrame([("m", "e", *r) for r in rows], "monitor string, entity_id string, ts long, reason string")


def test_a_gone_entity_clears_and_its_counts_start_anew(spark):
    rows = outcome_rows(spark, [(0, "true"), (60, "true"), (1000, "true"), (1060, "true")])
    end = incidents.gone_ends(rows, 5000, 300)
    assert sorted(r.ts for r in end.collect()) == [361, 1361]
    found = incidents.cleared_by(incidents.ladder(incidents.with_ends(rows, end)), end).orderBy("ts").collect()
    assert [(r.ts, r.kind, r.reason) for r in found] == [(60, "open", None), (361, "clear", "entity_gone"), (1060, "open", None), (1361, "clear", "entity_gone")]


def test_an_end_at_the_second_of_a_tick_counts_before_it(spark):
    rows = outcome_rows(spark, [(0, "true"), (60, "true"), (120, "true"), (180, "true")])
    end = ends(spark, (120, "superseded"))
    found = incidents.ladder(incidents.with_ends(rows, end)).orderBy("ts").collect()
    assert [(r.ts, r.kind) for r in found] == [(60, "open"), (120, "clear"), (180, "open")]


def test_definitions_that_change_or_vanish_end_their_incidents(spark):
    entities = spark.createDataFrame([("m", "a"), ("m", "b"), ("n", "c")], "monitor string, entity_id string")
    versions = spark.createDataFrame([("m", 1, "x"), ("m", 2, "x"), ("m", 3, "y"), ("m", 4, None), ("m", 5, None)], "monitor string, ts long, content_hash string")
    assert sorted((r.entity_id, r.ts) for r in incidents.superseded_ends(entities, versions).collect()) == [("a", 3), ("a", 4), ("b", 3), ("b", 4)]


def test_one_acknowledgement_counts_until_an_escalation(spark):
    moves = [(10, "open", 1), (50, "escalate", 2), (70, "downgrade", 1), (90, "clear", -1)]
    transitions = spark.createDataFrame([("m", "e", "g", t, k, s, 1) for t, k, s in moves], "monitor string, entity_id string, grp string, ts long, kind string, severity int, incident long")
    acks = spark.createDataFrame([("m", "e", "g", t, "x") for t in (5, 10, 20, 80, 85, 90, 95)], "monitor string, entity_id string, grp string, ts long, by string")
    found = incidents.acknowledged(transitions, acks).where("kind = 'acked'").orderBy("ts").collect()
    assert [(r.ts, r.severity, r.incident) for r in found] == [(10, 1, 1), (80, 1, 1)]


def test_acknowledged_incidents_are_not_told_again(spark):
    levels = spark.createDataFrame([("m", "e", "g", t, 2, True) for t in range(0, 3001, 60)], "monitor string, entity_id string, grp string, ts long, severity int, owner_true boolean")
    acks = lambda t: spark.createDataFrame([("m", "e", "g", t)], "monitor string, entity_id string, grp string, ts long")
    told = lambda a: [(r.ts, r.kind) for r in incidents.notifications(levels, a).orderBy("ts").collect()]
    assert told(None) == [(0, "open"), (300, "renotify"), (1200, "renotify")]
    assert told(acks(400)) == [(0, "open"), (300, "renotify")]
    assert told(acks(-5)) == told(None)


def test_rules_see_learned_baselines(spark):
    definition = load('schema = 1\n[monitor]\nname = "m"\nsource = "disk"\n[[rule]]\nname = "r"\nwhen = "used_pct > baseline(used_pct)"\nseverity = "error"\n')
    ticks = spark.createDataFrame([("m", "e", t, v) for t, v in ((100, 5.0), (700, 5.0), (701, 3.0))], "monitor string, entity_id string, ts long, used_pct double")
    history = spark.createDataFrame([("m", "e", "used_pct", 300, 4.0, True)], "monitor string, entity_id string, metric string, bucket long, level double, ready boolean")
    found = rules.outcomes(rules.evaluate(ticks, definition, history), definition).orderBy("ts").collect()
    assert [r.outcome for r in found] == ["unknown", "true", "false"]


def test_ranges():
    assert desk.time_range("90m", 10_000) == (4600, 10_000)
    assert desk.time_range(["1970-01-01T00:01:00", "1970-01-01T01:00:00+01:00"], 0) == (60, 0)
    for wrong in ("soon", ["x", "y"], ["1970-01-01"]):
        with pytest.raises(ExpressionError):
            desk.time_range(wrong, 0)


def test_attributes_that_none_has_are_errors_and_lacking_ones_unknown(spark):
    rows = spark.createDataFrame([("a", '{"team":"x","odd.name":"1"}'), ("b", "{}"), ("c", None)], "entity_id string, attrs string")
    assert [r.entity_id for r in desk.entities_where(rows, "team == 'x'").collect()] == ["a"]
    assert [r.entity_id for r in desk.entities_where(rows, "not (team == 'x')").collect()] == []
    with pytest.raises(ExpressionError):
        desk.entities_where(rows, "owner == 'x'")


def test_plugin_results_need_all_parts_of_the_newest_state(spark):
    parts = [("a", 1, "plugin_state", 0.0), ("a", 1, "plugin_ok", 1.0), ("a", 1, "duration_s", 0.5), ("a", 2, "plugin_state", 2.0), ("a", 2, "plugin_ok", 0.0), ("a", 1, "other", 1.0)]
    rows = parts + [("b", t, m, v) for e, t, m, v in parts[:3]] + [("b", 9, "duration_s", 9.0)]
    samples = spark.createDataFrame([("m", *r) for r in rows], "monitor string, entity_id string, ts long, metric string, value double")
    entities = spark.createDataFrame([("m", "b", '{"plugin_message":"fine"}')], "monitor string, entity_id string, attrs string")
    (one,) = desk.plugin_results(samples, entities, 11).collect()
    assert (one.entity_id, one.plugin_state, one.plugin_ok, one.plugin_message, one.duration_s, one.sample_age_s) == ("b", 0, True, "fine", 0.5, 10)


def test_samples_around_an_incident(spark):
    cases = spark.createDataFrame([("m", "e", 1, 100_000, 190_000), ("m", "e", 2, 195_000, None)], "monitor string, entity_id string, incident long, opened_ts long, cleared_ts long")
    samples = spark.createDataFrame([("m", "e", t) for t in (98_199, 98_200, 150_000, 191_800, 191_801, 193_200, 200_000, 200_001)], "monitor string, entity_id string, ts long")
    found = sorted((r.incident, r.ts) for r in desk.incident_samples(cases, samples, 200_000).collect())
    assert found == [(1, 98_200), (1, 150_000), (1, 191_800), (2, 193_200), (2, 200_000)]


def test_channels_unite(spark):
    asked = [("a", "x", 1), ("a", "x", 2), ("b", "x", 1), ("b", "y", 2), ("c", "x", 1), ("c", None, 2), ("c", "y", 3), ("d", "x", 1), ("d", "y", 2), ("d", None, 3)]
    found = desk.channels(spark.createDataFrame(asked, "path string, query string, nth int")).orderBy("path").collect()
    assert [(r.path, r.query, r.conflict) for r in found] == [("a", "x", False), ("b", "x", True), ("c", None, False), ("d", None, True)]


def test_glances_break_ties_leave_out_and_cut(spark):
    rows = [("m", "max", "a", 90, 5.0), ("m", "max", "b", 95, 5.0), ("m", "max", "c", 95, 5.0), ("m", "max", "d", 95, 9.0), ("n", "min", "a", 95, 2.0), ("n", "min", "b", 95, 1.0), ("o", "max", "a", 10, 1.0)]
    newest = spark.createDataFrame(rows, "monitor string, aggregate string, entity_id string, ts long, value double").withColumn("interval", F.lit(30))
    exempt = spark.createDataFrame([("m", "d")], "monitor string, entity_id string")
    assert [(r.monitor, r.entity_id, r.matched) for r in desk.glances(newest, 100, exempt).collect()] == [("m", "b", 2), ("n", "b", 2)]
    assert [(r.monitor, r.entity_id, r.matched) for r in desk.glances(newest, 100, most=1).collect()] == [("m", "d", 2)]


def test_details_are_objects_whatever_was_stored(spark):
    raw = ['{"a": 1}', "[1]", "null", '"x"', "oops", "", None]
    found = desk.details(spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "seq int, detail string")).orderBy("seq").collect()
    assert [json.loads(r.detail) for r in found] == [{"a": 1}, {"value": [1]}, {"value": None}, {"value": "x"}, {"malformed": "oops"}, {}, {}]


def test_links_prefer_the_first_trend_that_fits(spark):
    cases = spark.createDataFrame([("m", "a b", "g"), ("m", "a", "h"), ("n", "a", "g")], "monitor string, entity_id string, grp string")
    trends = spark.createDataFrame([("m", "t1", "One", "g", 1), ("m", "t2", "Two", None, 2)], "monitor string, trend string, title string, grp string, nth int")
    found = {(r.monitor, r.grp): (r.href, r.label) for r in desk.evidence_links(cases, trends).collect()}
    assert found["m", "g"] == ("/trends/m/t1?entity=a+b&range=24h&group=g", "View One around this incident")
    assert found["m", "h"][0].startswith("/trends/m/t2?") and found["n", "g"] == (None, None)


def test_a_cursor_is_bound_to_its_filter():
    text = desk.cursor(("m", "e", "k"), {"monitor": "m"})
    assert desk.from_cursor(text, {"monitor": "m"}) == ("m", "e", "k")
    for wrong in (text, "bm9uZQ==", "%"):
        with pytest.raises(ValueError):
            desk.from_cursor(wrong, {"monitor": "n"})


def test_lint_and_units(spark):
    definition = load(TREND)
    assert desk.stale_rules(definition) == [("size", "db_bytes", "db_used_bytes")]
    assert desk.unit_and_panels(definition, "used_bytes") == ("bytes", [("space", "value")])
    assert desk.unit_and_panels(definition, "growth") == ("bytes/s", [("space", "rate")])
    assert desk.unit_and_panels(definition, "used_pct") == ("percent", [])
    assert desk.unit_and_panels(definition, "none") == ("value", [])


def test_a_tight_budget_leaves_young_raw_rows_and_events(spark):
    days = spark.createDataFrame([(1, 0, 10), (1, 9, 10), (2, 1, 10), (2, 5, 10), (3, 9, 10), (4, 9, 10)], "step int, day long, bytes long")
    dropped = lambda budget: sorted((r.step, r.day) for r in upkeep.degrade(days, budget, 10 * 86400).where("dropped").collect())
    assert dropped(60) == [] and dropped(45) == [(1, 0), (2, 1)]
    assert dropped(0) == [(1, 0), (2, 1), (3, 9), (4, 9)]


def test_newest_events_without_listing_the_others(spark):
    rng = random.Random(3)
    events = [(i, rng.randrange(0, 6000) if i % 3 else 3000 + i % 2, "p") for i in range(1500)] + [(9000, None, "p"), (9001, -500, "p"), (9002, 601, "p")]
    opened = [-1200, -1100, -1, 0, 1, 599, 600, 1200, 2400, 2999, 3000, 3601, 6600, 6601, 9000, None]
    log = spark.createDataFrame(events, "id long, ts long, provider string")
    rows = desk.with_newest(spark.createDataFrame([(t,) for t in opened], "opened_ts long"), log, "opened_ts", ["provider"])
    got = {r.opened_ts: [(e.ts, e.id) for e in r.related_events] for r in rows.collect()}
    near = lambda t: sorted(((ts, i) for i, ts, _ in events if t is not None and ts is not None and abs(ts - t) <= 600), reverse=True)[:50]
    assert got == {t: near(t) for t in opened}
    assert "abs((ts" not in rows._jdf.queryExecution().optimizedPlan().toString()
