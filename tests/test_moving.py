"""Trailing windows by running sums, bounded by count too, and in a stream, against plain loops."""

import math
import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugeloom.functions import running, series
from gaugeloom.streaming import moving
from tests.test_streams import SAMPLES, feed, few_partitions, rows_of  # noqa: F401

WIDTH = 600


def points(seed=1, n=120):
    rng = random.Random(seed)
    rows = []
    for entity in "ab":
        t = 1_700_000_000
        for _ in range(n):
            t += rng.choice([1, 30, 60, 60, 60, 700, 5000])
            rows.append(("m", entity, "x", t, 1e9 * (entity == "b") + rng.choice([1.0, 2.5, -3.0, 7.25])))
    return rows


def plain(rows, width, room=None):
    out = {}
    for _, entity, _, t, v in rows:
        own = sorted((u, w) for _, e, _, u, w in rows if e == entity and t - width <= u <= t and w is not None)[-(room or 10**9) :]
        n = len(own)
        d = dict.fromkeys(("avg", "delta", "rate", "slope", "monot", "coverage")) | {"count": n}
        if n:
            d["avg"] = math.fsum(w for _, w in own) / n
        if n > 1:
            rise, dt = own[-1][1] - own[0][1], own[-1][0] - own[0][0]
            d |= {"delta": rise, "rate": max(rise, 0) / dt, "coverage": dt / width, "monot": sum(b > a for (_, a), (_, b) in zip(own, own[1:], strict=False)) / (n - 1)}
        if n > 2:
            mx, my = math.fsum(u for u, _ in own) / n, math.fsum(w for _, w in own) / n
            d["slope"] = math.fsum((u - mx) * (w - my) for u, w in own) / math.fsum((u - mx) ** 2 for u, _ in own)
        out[entity, t] = d
    return out


def measured(df):
    made = {"count": running.count(), "avg": running.avg(), "delta": running.delta(), "rate": running.rate(), "slope": running.slope(), "monot": running.monot(), "coverage": running.coverage(WIDTH)}
    return {(r["entity_id"], r["ts"]): r.asDict() for r in df.select("entity_id", "ts", *(c.alias(k) for k, c in made.items())).collect()}


def same(found, wanted):
    assert found.keys() == wanted.keys()
    for key, w in wanted.items():
        for name, x in w.items():
            assert found[key][name] == (None if x is None else pytest.approx(x, rel=1e-6, abs=1e-6)), (key, name)


def test_running_sums_equal_plain_windows(spark):
    rows = points()
    rows += [("m", "a", "x", rows[0][3] + 17, None), ("m", "c", "x", 5, None), ("m", "d", "x", 5, 1.0)]
    df = spark.createDataFrame([(*r, "kept", 1) for r in rows], SAMPLES + ", _v string, n int")
    got = running.with_window(df, WIDTH)
    assert got.columns == [*df.columns, "w"] and got.where("_v = 'kept' and n = 1").count() == len(rows)
    same(measured(got), plain(rows, WIDTH))


def test_running_sums_equal_frames(spark):
    df = spark.createDataFrame(points(2), SAMPLES)
    w, v, t = series.trailing(WIDTH), F.col("value"), F.col("ts")
    frames = df.withColumn("up", series.rises(v)).select("entity_id", "ts", series.slope(v, w, t).alias("slope"), series.rate(v, w, t).alias("rate"), series.monot(F.col("up"), v, w).alias("monot"))
    wanted = {(r["entity_id"], r["ts"]): {"slope": r["slope"], "rate": r["rate"], "monot": r["monot"]} for r in frames.collect()}
    same(measured(running.with_window(df, WIDTH)), wanted)


@pytest.mark.parametrize("room", [1, 2, 5, 12])
def test_windows_bounded_by_count_too(spark, room):
    rows = points(3)
    got = running.with_window(spark.createDataFrame([*rows, ("m", "a", "x", rows[0][3] + 17, None)], SAMPLES), WIDTH, capacity=room)
    same(measured(got), plain(rows, WIDTH, room))


def test_capacity():
    assert series.capacity(2700, 60) == 47 and series.capacity(100, 60) == 4


def test_no_task_holds_a_series(spark):
    """A series of many widths is dealt over many groups."""
    df = spark.range(20_000).selectExpr("'m' monitor", "'e' entity_id", "'x' metric", "id * 10 ts", "cast(id % 7 as double) value")
    plan = running.with_window(df, WIDTH)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 1 and "_block" in plan.split("Exchange hashpartitioning(", 1)[1].split(")")[0]


def test_stream_equals_batch_over_a_restart(spark, tmp_path):
    rows = points(4, 60)
    rng = random.Random(4)
    rows.sort(key=lambda r: r[3] + rng.randrange(20))  # out of order within the lateness
    parts = [rows[i : i + 30] for i in range(0, len(rows), 30)]
    end = [("m", "z", "x", rows[-1][3] + 10**6 + i, 1.0) for i in range(2)]  # moves the watermark on
    widths = {"10m": WIDTH, "1h": 3600}
    stream = feed(spark, tmp_path, parts[:2], SAMPLES)
    out = str(tmp_path / "out")

    def run():
        q = moving.moving(stream, widths).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)

    run()
    before = spark.read.parquet(out).count()
    for i, part in enumerate([*parts[2:], [end[0]], [end[1]]]):
        spark.createDataFrame(part, SAMPLES).coalesce(1).write.parquet(str(tmp_path / f"in/{10 + i}"))
    run()  # a new query from the checkpoint
    got = spark.read.parquet(out).where("entity_id <> 'z'")
    assert 0 < before < got.count() == len(rows)
    batch = {label: plain(rows, width) for label, width in widths.items()}
    for label in widths:
        same({(r["entity_id"], r["ts"]): {k: r[f"{k}_{label}"] for k in ("count", "avg", "delta", "rate", "slope", "monot", "coverage")} for r in got.collect()}, batch[label])
    w = W.partitionBy("entity_id").orderBy("ts").rangeBetween(-WIDTH, 0)
    extremes = spark.createDataFrame(rows, SAMPLES).select("entity_id", "ts", F.min("value").over(w).alias("min_10m"), F.max("value").over(w).alias("max_10m"))
    assert sorted(map(tuple, got.select("entity_id", "ts", "min_10m", "max_10m").collect())) == sorted(map(tuple, extremes.collect()))


def test_stream_keeps_its_capacity(spark, tmp_path):
    rows = [("m", "e", "x", 1000 + 10 * i, float(i)) for i in range(40)] + [("m", "z", "x", 10**6 + i, 0.0) for i in range(2)]
    stream = feed(spark, tmp_path, [rows[:20], rows[20:40], rows[40:41], rows[41:]], SAMPLES)
    got = {r["ts"]: r["count_1m"] for r in rows_of(spark, moving.moving(stream, {"1m": 60}, interval=30), tmp_path, "room") if r["entity_id"] == "e"}
    assert len(got) == 40 and max(got.values()) == 4  # seven lie within 60 s
