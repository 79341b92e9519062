"""Notifications: silent ends, rules that don't tell, and a new checkpoint that begins with the stored incidents."""

import json

import pytest

from gaugeloom.operators import incidents
from gaugeloom.plans.definitions import DefinitionError, load
from gaugeloom.streaming import streams
from tests.test_streams import few_partitions, feed, rows_of  # noqa: F401

LEVELS = "monitor string, entity_id string, grp string, ts long, severity int, owner_true boolean, reason string, tells boolean"


def level(e, t, severity, reason=None, tells=True):
    return ("m", e, "g", t, severity, severity > 0, reason, tells)


def notes(spark, rows):
    return sorted((r.entity_id, r.ts, r.kind) for r in incidents.notifications(spark.createDataFrame(rows, LEVELS)).collect())


def test_replaced_definitions_and_quiet_rules_do_not_tell_of_recoveries(spark):
    rows = [level(e, 0, 2, tells=e != "quiet") for e in ("gone", "replaced", "quiet", "well")]
    rows += [level("gone", 60, -1, "entity_gone"), level("replaced", 60, -1, "superseded"), level("quiet", 60, -1), level("well", 60, -1)]
    rows += [level("replaced", 120, 2), level("replaced", 180, -1)]
    assert notes(spark, rows) == [("gone", 0, "open"), ("gone", 60, "recover"), ("quiet", 0, "open"), ("replaced", 0, "open"), ("replaced", 120, "open"), ("replaced", 180, "recover"), ("well", 0, "open"), ("well", 60, "recover")]


def test_the_owner_at_the_end_decides(spark):
    rows = [level("a", 0, 2, tells=False), level("a", 60, 4, tells=True), level("a", 120, -1), level("b", 0, 4, tells=True), level("b", 60, 2, tells=False), level("b", 120, -1)]
    assert [n for n in notes(spark, rows) if n[2] == "recover"] == [("a", 120, "recover")]


def test_ends_reach_the_notifications(spark):
    schema = "monitor string, entity_id string, grp string, rule string, severity int, confirm int, clear int, ts long, outcome string, notify_recovery boolean"
    rows = [("m", e, "g", "r", 2, 1, 1, t, "true", True) for e in "ab" for t in (0, 60, 120)]
    ends = spark.createDataFrame([("m", "a", 90, "superseded"), ("m", "b", 90, "entity_gone")], "monitor string, entity_id string, ts long, reason string")
    states = incidents.with_ends(spark.createDataFrame(rows, schema), ends)
    got = sorted((r.entity_id, r.ts, r.kind) for r in incidents.notifications(incidents.levels(states)).collect())
    assert got == [("a", 0, "open"), ("a", 120, "open"), ("b", 0, "open"), ("b", 90, "recover"), ("b", 120, "open")]


def test_definitions_take_recoveries_actions_and_templates():
    text = 'schema = 1\n[monitor]\nname = "d"\nsource = "disk"\ninterval = "60s"\n[[rule]]\nname = "r"\nwhen = "used_pct > 5"\nseverity = "warning"\n'
    rule = load(text + 'notify_recovery = false\naction = "mail"\nmessage = "{used_pct:.1f}%"\n').rules[0]
    assert (rule.notify_recovery, rule.action) == (False, "mail") and load(text).rules[0].notify_recovery
    with pytest.raises(DefinitionError) as e:
        load(text + 'notify_recovery = 1\naction = 2\nmessage = "{"\n')
    assert len(e.value.problems) == 3


STORED = "incident_id long, monitor string, entity_id string, grp string, state string, severity int, peak_severity int, opened_ts long, last_change_ts long, notify_count int, flapping boolean"


def stored(spark):
    rows = [(1, "m", "open", "g", "open", 2, 2, 1000, 1000, 2, False), (2, "m", "acked", "g", "acked", 2, 2, 1000, 1100, 1, False), (3, "m", "old", "g", "cleared", 2, 2, 0, 500, 3, False)]
    told = spark.createDataFrame([(1, 1000), (1, 1300), (2, 1000), (3, 0)], "incident_id long, ts long")
    return streams.stored_states(spark.createDataFrame(rows, STORED), told)


def test_states_of_stored_incidents(spark):
    got = {r.entity_id: json.loads(r.held) for r in stored(spark).collect()}
    assert got.keys() == {"open", "acked"}
    assert got["open"] == {"severity": 2, "peak": 2, "last": 1300, "tier": 1, "flapping": False, "acked": False, "opened": 1000, "tick": 1300}
    assert got["acked"]["acked"] and got["acked"]["tick"] == 1100


def test_new_checkpoint_neither_opens_nor_tells_again(spark, tmp_path):
    key = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rows = [level(e, t, 2) for e in ("open", "acked", "old", "fresh") for t in range(1260, 2460, 60)] + [level("open", 2460, -1), level("acked", 2460, -1)]
        rows.sort(key=lambda r: r[3])
        stream = feed(spark, tmp_path, [rows[:30], rows[30:]], LEVELS)
        got = sorted((r.entity_id, r.ts, r.kind) for r in rows_of(spark, streams.resumed_notifications(stream, stored(spark)), tmp_path, "resumed"))
    finally:
        spark.conf.set(key, was) if was else spark.conf.unset(key)
    # the second repeat comes 900 s after the first, which was at 1300; what is acknowledged stays silent
    assert [n for n in got if n[0] == "open"] == [("open", 2220, "renotify"), ("open", 2460, "recover")]
    assert [n for n in got if n[0] == "acked"] == [("acked", 2460, "recover")]
    assert [n[1:] for n in got if n[0] == "old"][0] == (1260, "open") and ("fresh", 1260, "open") in got
