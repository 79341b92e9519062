import json

from gaugeloom.functions import scalar
from gaugeloom.sources import logs, scenarios
from gaugeloom.sources.checks import parse_check, parse_checks


def test_journal(spark):
    line = lambda **k: json.dumps({"__CURSOR": "c", "__REALTIME_TIMESTAMP": "5000001", "PRIORITY": "3", "SYSLOG_IDENTIFIER": "k", "MESSAGE": "m"} | k)
    rows = [line(PRIORITY=str(p)) for p in range(8)] + [line(MESSAGE=[104, 105]), line(MESSAGE="x" * 3000), line(SYSLOG_IDENTIFIER=None, _SYSTEMD_UNIT="u"), line(__CURSOR=None), "nonsense", "[1]", "", line(PRIORITY="odd")]
    got = logs.parse_journal(spark.createDataFrame([(r,) for r in rows], "value string")).collect()
    assert [r.severity for r in got[:8]] == [4, 4, 4, 3, 2, 1, 0, 0]
    assert got[8].message == "hi" and len(got[9].message) == 2048 and got[10].provider == "u" and len(got) == 12
    assert got[0].ts == 5 and got[11].severity == 0


def test_unified_log(spark):
    event = {"eventType": "logEvent", "timestamp": "2024-01-01 00:00:10.000000+0000", "eventMessage": "m", "subsystem": "a.b", "category": "c", "messageType": "Fault", "bootUUID": "u", "machTimestamp": 5}
    rows = [event, event, event | {"machTimestamp": 6}, event | {"eventType": "other"}]
    got = logs.parse_unified_log(spark.createDataFrame([(json.dumps(r),) for r in rows], "value string")).collect()
    assert len(got) == 3 and got[0].provider == "a.b/c" and got[0].severity == 4 and len(got[0].identity) == 64
    assert got[0].identity == got[1].identity != got[2].identity


def test_event_xml(spark):
    xml = "<Event xmlns='x'><System><Provider Name='P'/><EventID>7</EventID><Level>2</Level><TimeCreated SystemTime='2024-01-01T00:00:00Z'/></System><EventData><Data Name='a'>1</Data><Data Name='b'>2</Data></EventData></Event>"
    got = logs.parse_event_xml(spark.createDataFrame([(xml,)], "value string")).first()
    assert tuple(got) == (1704067200, 3, "P", "7", "a=1; b=2")


def test_event_xml_with_gaps(spark):
    data = lambda inner: f"<Event><System><EventID>5</EventID><EventID>6</EventID></System><EventData>{inner}</EventData></Event>"
    rows = [data("<Data Name='a'/><Data Name='b'> x </Data>"), data(""), "<Event/>", "<bad"]
    got = logs.parse_event_xml(spark.createDataFrame([(r,) for r in rows], "value string")).collect()
    assert [tuple(r) for r in got] == [(None, 0, "", "5", "a=; b= x "), (None, 0, "", "5", ""), (None, 0, "", "", ""), (None, 0, "", "", "")]


def test_perfdata(spark):
    rows = [(1, "OK|'a b'=1.5s;2;3;0;9 c=7KB"), (2, "no data"), (3, "OK|x=1 x=2 y=3"), (4, "OK|z=1;;;9;2")]
    got = logs.parse_perfdata(spark.createDataFrame(rows, "id int, output string"), keys=("id",)).collect()
    assert {(r.id, r.label, r.value, r.unit) for r in got} == {(1, "a b", 1.5, "s"), (1, "c", 7.0, "KB"), (3, "y", 3.0, "")}
    mapping = spark.createDataFrame([("c", "KB", "size", 1024.0), ("a b", "ms", "time", 1.0)], "label string, unit string, metric string, scale double")
    assert [(r.metric, r.value) for r in logs.project_checks(logs.parse_perfdata(spark.createDataFrame(rows, "id int, output string"), keys=("id",)), mapping).collect()] == [("size", 7168.0)]


def test_strict_checks(spark):
    good = '{"schema": 1, "state": 0, "message": "m", "metrics": {"a": {"value": 2, "uom": "s"}}}'
    assert parse_check(good) == (0, "m", {"a": (2.0, "s")})
    for bad in (good.replace("1,", "2,", 1), good.replace('"state": 0', '"state": 7'), good.replace('"state": 0', '"state": true'), good.replace("}}}", '}, "a": {"value": 1, "uom": ""}}}'), good.replace(": 2", ": NaN"), "[]", "", None, good[:-1]):
        assert parse_check(bad)[0] == 3
    rows = parse_checks(spark.createDataFrame([(1, good), (2, "x")], "id long, output string"), "id").orderBy("id").collect()
    assert rows[0].metrics["a"].value == 2.0 and rows[1].state == 3


def test_message_hash_ignores_numbers_case_and_blanks(spark):
    df = spark.createDataFrame([("Out of memory: pid 123",), ("out  of MEMORY: pid 9 ",), ("addr deadbeef00",), ("addr 12",), ("else",)], "m string")
    got = [r.h for r in df.select(scalar.msg_hash(df.m).alias("h")).collect()]
    assert got[0] == got[1] and got[2] == got[3] and len({*got}) == 3 and all(len(h) == 16 for h in got)


def test_scenarios(spark, tmp_path):
    lines = [{"at": 0, "source": "disk", "entities": [{"entity_id": "/", "attrs": {}, "metrics": {"used_pct": 80.0}}]}, {"at": 100, "source": "disk", "entities": []}, {"at": 5, "event": {"source": "s", "provider": "p", "severity": 3, "message": "m"}}]
    (tmp_path / "s.jsonl").write_text("\n".join(map(json.dumps, lines)))
    states, events = scenarios.load(spark, str(tmp_path / "s.jsonl"))
    ticks = spark.createDataFrame([("disk", t) for t in (0, 60, 120)], "source string, ts long")
    assert [(r.ts, r.value) for r in scenarios.samples_at(states, ticks).orderBy("ts").collect()] == [(0, 80.0), (60, 80.0)]
    assert events.first().provider == "p"
    assert scenarios.churn(spark, "p", 20, 60, 10, 290).select("entity_id").distinct().count() == 10 + 20 * 290
    (tmp_path / "bad.jsonl").write_text('{"source": "disk", "entities": []}')
    try:
        scenarios.load(spark, str(tmp_path / "bad.jsonl"))[0].collect()
        raise AssertionError("a line without 'at' was taken")
    except Exception as e:
        assert "at" in str(e)
