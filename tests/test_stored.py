"""Rollups that catch up, pruning in place, baselines backwards."""

import os
import random
from datetime import UTC, datetime

import pytest

from gaugeloom.operators import rollup, stored
from gaugeloom.operators.upkeep import DAY, KEEP

SAMPLES = "monitor string, entity_id string, metric string, ts long, value double, seq long"


def samples(n=900):
    rng = random.Random(3)
    return [("m", rng.choice("ab"), "x", 1_700_000_000 + rng.randrange(20 * 3600), rng.random(), i) for i in range(n)]


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def table(spark, path):
    names = ["monitor", "entity_id", "metric", "bucket", "avg", "min", "max", "last", "cnt"]
    return sorted(tuple(r) for r in spark.read.parquet(path).select(*names).collect())


def test_two_passes_give_what_one_gives(spark, tmp_path):
    rows = samples()
    rows.sort(key=lambda r: r[3] + 3600 * (r[5] % 7 == 0))  # some come an hour late
    rows = [(*r[:5], i) for i, r in enumerate(rows)]
    rows.append((*rows[10][:4], 99.0, len(rows)))  # written again
    half = str(tmp_path / "half")
    assert stored.catch_up(spark.createDataFrame(rows[:500], SAMPLES), half) > 0
    before = files(half + "/5m") | files(half + "/1h")
    changed = stored.catch_up(spark.createDataFrame(rows, SAMPLES), half)
    after = files(half + "/5m") | files(half + "/1h")
    hours = {r[3] // 3600 * 3600 for r in rows}
    untouched = hours - {r[3] // 3600 * 3600 for r in rows[500:]}
    assert untouched and 0 < changed < len(hours)
    for h in untouched:
        assert {f for f in before if f"hour={h}/" in f} == {f for f in after if f"hour={h}/" in f} != set()
    whole = str(tmp_path / "whole")
    stored.catch_up(spark.createDataFrame(rows, SAMPLES), whole)
    for t in ("5m", "1h"):
        found, wanted = table(spark, f"{half}/{t}"), table(spark, f"{whole}/{t}")
        assert [r[:4] for r in found] == [r[:4] for r in wanted]
        assert [x for r in found for x in r[4:]] == pytest.approx([x for r in wanted for x in r[4:]])
    assert stored.catch_up(spark.createDataFrame(rows, SAMPLES), half) == 0


def test_a_call_that_failed_is_done_again(spark, tmp_path, monkeypatch):
    rows = samples(200)
    root = str(tmp_path / "t")
    put, calls = stored._put, []

    def fails(*a):
        calls.append(a)
        if len(calls) == 2:
            raise OSError("lost")
        put(*a)

    monkeypatch.setattr(stored, "_put", fails)
    with pytest.raises(OSError):
        stored.catch_up(spark.createDataFrame(rows, SAMPLES), root)
    assert stored.cursor(spark, root) == -1
    monkeypatch.setattr(stored, "_put", put)
    stored.catch_up(spark.createDataFrame(rows, SAMPLES), root)
    whole = str(tmp_path / "whole")
    stored.catch_up(spark.createDataFrame(rows, SAMPLES), whole)
    assert table(spark, f"{root}/1h") == table(spark, f"{whole}/1h") and stored.cursor(spark, root) == 199


def test_pruning_drops_days_and_rewrites_edges_only(spark, tmp_path):
    now = int(datetime(2024, 1, 1, 12, tzinfo=UTC).timestamp())
    long, short = KEEP["5m"]
    path = str(tmp_path / "rows")
    days = range(now // DAY - 40, now // DAY + 1)
    rows = [(s, d * DAY + h * 3600, float(s)) for d in days for h in (1, 13) for s in (1, 2, 3)]
    schema = "series_id long, ts long, value double"
    df = spark.createDataFrame(rows, schema)
    df.withColumn("day", (df["ts"] / DAY).cast("int")).repartition("day").write.partitionBy("day").parquet(path)
    series = spark.createDataFrame([(1, True), (2, False)], "series_id long, durable boolean")  # the third isn't known
    names = files(path)
    wanted = sorted(tuple(r) for r in stored.keep_by_class(df, series, "5m", now).collect())
    assert wanted == sorted(r for r in rows if r[1] >= now - (long if r[0] == 1 else short))
    first = stored.prune_days(spark, path, series, "5m", now)
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("series_id", "ts", "value").collect()) == wanted
    assert len(first["dropped"]) == 10 and len(first["rewritten"]) == 24
    young = {f for f in names if int(f.split("day=")[1].split("/")[0]) > (now - short) // DAY}
    assert len(young) == 7 and young <= files(path)
    # a day later only the edges change
    kept = files(path)
    second = stored.prune_days(spark, path, series, "5m", now + DAY)
    assert len(second["dropped"]) == 1 and len(second["rewritten"]) <= 3
    assert len(kept & files(path)) >= len(kept) - 4
    assert stored.prune_days(spark, path, series, "5m", now + DAY) == {"dropped": [], "rewritten": []}


def test_baselines_backwards_equal_those_forwards(spark):
    rng = random.Random(1)
    rows = [("m", e, "x", 300 * b, rng.random() * 10) for e in "abc" for b in range(1000, 1400) if rng.random() < 0.8]
    fives = spark.createDataFrame(rows, "monitor string, entity_id string, metric string, bucket long, avg double")
    forward = rollup.baselines(fives, 7200.0)
    now = rollup.latest_baselines(forward).selectExpr("monitor", "entity_id", "metric", "bucket", "level", "updates", "double(7200) AS half_life")
    start, end = 300 * 1000, 300 * 1400
    back = {(r.entity_id, r.bucket): r for r in rollup.baselines_back(now, fives, start, end).collect()}
    wanted = {(r.entity_id, r.bucket): r.level for r in forward.collect()}
    # dividing by 0.972 again and again makes errors grow: 2 ** 16 over 400 buckets
    assert back.keys() == wanted.keys() and all(back[k].level == pytest.approx(v, rel=1e-6) for k, v in wanted.items())
    assert not any(r.truncated for r in back.values())
    kept = fives.where("bucket >= 300 * 1300 or entity_id = 'b'").where("entity_id <> 'c' or bucket < 300 * 1390")
    some = rollup.baselines_back(now, kept, start, end).collect()
    assert {r.entity_id: r.truncated for r in some} == {"a": True, "b": False, "c": True}
    assert sum(r.entity_id == "c" for r in some) == 1  # the present bucket's row is gone
    late = rollup.baselines_back(now, kept, 300 * 1320, end).collect()
    assert not any(r.truncated for r in late if r.entity_id == "a")
