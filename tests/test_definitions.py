import pytest

from gaugeloom.operators import rules
from gaugeloom.plans.definitions import DefinitionError, load, load_all
from gaugeloom.plans.shipped import DISK, SHIPPED


pytestmark = pytest.mark.usefixtures("spark")

def test_shipped_definitions_are_right():
    good, wrong = load_all(SHIPPED)
    assert len(good) == len(SHIPPED) and not wrong
    assert load(DISK) == load(DISK) and load(DISK).content_hash == load(DISK).content_hash
    assert [n for n, _ in load(DISK).derived].index("fill_rate_bph") < [n for n, _ in load(DISK).derived].index("full_in_h")
    assert ("used_bytes", 4200) in load(DISK).windows


CASES = [
    ("schema = 1", "schema = 2", "schema", "schema"),
    ('source = "disk"', 'source = "moon"', "monitor.source", "unknown-source"),
    ('interval = "60s"', 'interval = "5s"', "monitor.interval", "range"),
    ('interval = "60s"', 'interval = "soon"', "monitor.interval", "duration"),
    ('interval = "60s"', 'interval = "60s"\ncolour = "red"', "monitor.colour", "unknown-key"),
    ('when = "used_pct >= 85"', 'when = "used_pct >="', "rule[0].when", "expression"),
    ('when = "used_pct >= 85"', 'when = "nothing > 1"', "rule[0].when", "expression"),
    ('severity = "notice"', 'severity = "loud"', "rule[4].severity", "severity"),
    ('name = "space-error"', 'name = "space-warn"', "rule", "duplicate"),
    ("monot(used_bytes, '70m')", "full_in_h + 1", "derived", "cycle"),
    ('expr = "free_bytes / MB"', 'expr = ""', "derived.free_mb", "missing"),
    ('confidence = "filling"', 'confidence = "hope"', "trend[0].confidence", "unknown-metric"),
    ("confirm_cycles = 2", "confirm_cycles = 0", "rule[0].confirm_cycles", "range"),
]


@pytest.mark.parametrize("old,new,path,code", CASES)
def test_invalid(old, new, path, code):
    text = DISK.replace(old, new, 1)
    if code == "cycle":
        text = text.replace("free_bytes / clamp(fill_rate_bph", "filling / clamp(fill_rate_bph")
    assert text != DISK
    with pytest.raises(DefinitionError) as e:
        load(text)
    assert (path, code) in [(p.path, p.code) for p in e.value.problems]


def test_all_problems_are_told_together():
    with pytest.raises(DefinitionError) as e:
        load(DISK.replace("used_pct >= 85", "x").replace("used_pct >= 92", "y").replace("schema = 1", "schema = 3"))
    assert len(e.value.problems) == 3
    good, wrong = load_all({"a": DISK, "b": "not toml ["})
    assert len(good) == 1 and wrong["b"][0].code == "toml"


def test_stale_metric_stays_and_missing_attr_is_unknown(spark):
    definition = load(DISK)
    ticks = spark.createDataFrame([("disk", "/", 0, 99.0), ("disk", "/", 60, None)], "monitor string, entity_id string, ts long, used_pct double")
    rows = rules.evaluate(ticks, definition).orderBy("ts").collect()
    assert [r["rule:space-critical"] for r in rows] == ["true", "true"]
    assert rows[0]["rule:inodes"] == "unknown"


def test_exempt_entities_have_no_outcomes(spark):
    definition = load(DISK.replace("schema = 1\n", 'schema = 1\nexempt = ["fstype == \'tmpfs\'"]\n'))
    ticks = spark.createDataFrame([("disk", "/", 0, 99.0, "ext4"), ("disk", "/run", 0, 99.0, "tmpfs"), ("disk", "/x", 0, 1.0, None)], "monitor string, entity_id string, ts long, used_pct double, fstype string")
    assert {r.entity_id for r in rules.outcomes(rules.evaluate(ticks, definition), definition).collect()} == {"/", "/x"}
