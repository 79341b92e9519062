import pytest
from pyspark.sql import functions as F

from gaugeloom.functions import series
from gaugeloom.operators import rollup, rules
from gaugeloom.plans.definitions import load
from gaugeloom.plans.shipped import SHIPPED

MB = 1024.0**2


def points(spark, values, step=60):
    return spark.createDataFrame([("m", "e", i * step, v) for i, v in enumerate(values)], "monitor string, entity_id string, ts long, v double")


def at_end(spark, values, make, step=60):
    df = points(spark, values, step).withColumn("_up", series.rises(F.col("v")))
    return df.select("ts", make(F.col("v"), series.trailing(3600)).alias("x")).orderBy(F.desc("ts")).first().x


CASES = [
    ([1.0, 2.0, 3.0, 4.0], series.avg, 2.5),
    ([1.0, 2.0, 3.0, 4.0], series.low, 1.0),
    ([1.0, 2.0, 3.0, 4.0], series.high, 4.0),
    ([1.0, 2.0, 3.0, 4.0], series.delta, 3.0),
    ([1.0], series.delta, None),
    ([10.0, 11.0, 12.0, 13.0], lambda v, w: series.slope(v, w, F.col("ts")), 1 / 60),
    ([10.0, 11.0], lambda v, w: series.slope(v, w, F.col("ts")), None),
    ([1.0, 2.0, 3.0], lambda v, w: series.monot(F.col("_up"), v, w), 1.0),
    ([3.0, 2.0, 1.0], lambda v, w: series.monot(F.col("_up"), v, w), 0.0),
    ([1.0, 2.0, 1.0, 2.0], lambda v, w: series.monot(F.col("_up"), v, w), 2 / 3),
    ([1.0], lambda v, w: series.monot(F.col("_up"), v, w), None),
    ([1.0, None, 2.0, None, 3.0], lambda v, w: series.monot(F.col("_up"), v, w), 1.0),
    ([100.0, 200.0, 50.0], lambda v, w: series.rate(v, w, F.col("ts")), 0.0),
    ([100.0, 160.0, 220.0], lambda v, w: series.rate(v, w, F.col("ts")), 1.0),
    ([100.0, None, 220.0], lambda v, w: series.rate(v, w, F.col("ts")), 1.0),
    ([1.0] * 11, lambda v, w: series.coverage(v, w, F.col("ts"), 600), 1.0),
    ([1.0] * 3, lambda v, w: series.coverage(v, w, F.col("ts"), 2700), 2 / 45),
    ([1.0] * 60, lambda v, w: series.coverage(v, w, F.col("ts"), 600), 1.0),
    ([5.0, None, None], lambda v, w: series.age(v, F.col("ts")), 120),
    ([5.0, None, None], lambda v, w: series.last(v), 5.0),
]


@pytest.mark.parametrize("values,make,want", CASES)
def test_goldens(spark, values, make, want):
    got = at_end(spark, values, make)
    assert got is None if want is None else got == pytest.approx(want)


def tall(spark, rows):
    return spark.createDataFrame([("m", "e", "x", t, v) for t, v in rows], "monitor string, entity_id string, metric string, ts long, value double")


def test_rollups(spark):
    five = rollup.rollup_5m(tall(spark, [(600, 10.0), (660, 30.0), (840, 20.0)])).first()
    assert (five.bucket, five.avg, five.min, five.max, five.last, five.cnt) == (600, 20.0, 10.0, 30.0, 20.0, 3)
    assert rollup.rollup_5m(tall(spark, [(600, 1.0)]), now=929).count() == 0
    assert rollup.rollup_5m(tall(spark, [(600, 1.0)]), now=930).count() == 1
    fives = spark.createDataFrame([("m", "e", "x", 3600, 10.0, 9.0, 11.0, 10.0, 1), ("m", "e", "x", 3900, 20.0, 5.0, 30.0, 22.0, 3)], "monitor string, entity_id string, metric string, bucket long, avg double, min double, max double, last double, cnt long")
    hour = rollup.rollup_1h(fives).first()
    assert (hour.bucket, hour.avg, hour.min, hour.max, hour.last, hour.cnt) == (3600, 17.5, 5.0, 30.0, 22.0, 4)


def test_baseline(spark):
    fives = rollup.rollup_5m(tall(spark, [(0, 10.0), (300, 20.0), (600, 30.0)]))
    rows = rollup.baselines(fives, half_life=300.0).orderBy("bucket").collect()
    assert [r.level for r in rows] == pytest.approx([10.0, 15.0, 22.5])
    assert [r.updates for r in rows] == [1, 2, 3] and not rows[-1].ready


def test_baseline_of_a_very_long_series(spark):
    values = [float((i * 7919) % 101) for i in range(3000)]
    rows = rollup.baselines(rollup.rollup_5m(tall(spark, [(i * 300, v) for i, v in enumerate(values)])), half_life=600.0).orderBy("bucket").collect()
    level, a, want = values[0], 1 - 2 ** (-300 / 600), []
    for i, v in enumerate(values):
        level = level + a * (v - level) if i else v
        want.append(level)
    assert [r.level for r in rows] == pytest.approx(want)


def leak(spark, values):
    definition = load(SHIPPED["leak"])
    ticks = spark.createDataFrame([("leak", "p", i * 60, v * MB) for i, v in enumerate(values)], "monitor string, entity_id string, ts long, rss_bytes double")
    rows = rules.evaluate(ticks, definition).orderBy("ts").collect()
    return [[i for i, r in enumerate(rows) if r[f"rule:{n}"] == "true"] for n in ("leak-warn", "leak-crit")]


def test_leak_rules(spark):
    warn, crit = leak(spark, [100.0 + i for i in range(90)])
    assert warn and warn[0] >= 36 and not crit
    assert leak(spark, [100.0 + i % 10 * 4 for i in range(90)]) == [[], []]
    assert leak(spark, [100.0 + 8 * (i // 4) for i in range(90)])[0]
    assert leak(spark, [100.0 + (100 if 20 <= i < 30 else 0) for i in range(31)]) == [[], []]
