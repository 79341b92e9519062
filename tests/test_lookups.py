from pyspark.sql import functions as F

from gaugeloom.functions import scalar
from gaugeloom.operators import lookups, upkeep


def test_actions_run_at_most_once_in_a_while(spark):
    rows = [(a, t) for a in "ab" for t in (0, 100, 600, 700, 1300)]
    got = lookups.action_runs(spark.createDataFrame(rows, "action string, ts long")).collect()
    assert sorted((r.action, r.ts) for r in got if r.ran) == [(a, t) for a in "ab" for t in (0, 600, 1300)]


def test_thinning_keeps_ends_and_gap_edges(spark):
    rows = [("e", t, None if t in (5, 6) else 1.0) for t in range(12)]
    got = sorted(r.ts for r in lookups.thin(spark.createDataFrame(rows, "k string, ts long, value double"), 100, ["k"]).collect())
    assert got == [0, 4, 5, 6, 7, 11]


def test_overflow(spark):
    rows = [("q", t, d) for t, d in enumerate((0, 3, 5, 5, 9))]
    got = lookups.overflow_episodes(spark.createDataFrame(rows, "k string, ts long, dropped long"), ["k"]).orderBy("start_ts").collect()
    assert [(r.start_ts, r.end_ts, r.lost) for r in got] == [(1, 2, 5), (4, 4, 4)]


def test_clamp_health_and_status_at_their_edges(spark):
    row = spark.range(1).select(scalar.clamp(F.lit(5.0), F.lit(10.0), F.lit(3.0)).alias("c"), upkeep.health(F.lit(0), F.lit(False), F.lit(False), F.lit(False)).alias("h"), upkeep.health(F.lit(None), F.lit(False), F.lit(False), F.lit(False)).alias("n")).first()
    assert (row.c, row.h, row.n) == (3.0, "warning", "clear")
    samples = spark.createDataFrame([(5,)], "ts long")
    code = lambda rows: lookups.status(samples, spark.createDataFrame(rows, "state string, peak_severity int"), 9).first().exit_code
    assert [code([]), code([("open", 0)]), code([("open", 2)]), code([("open", 3), ("cleared", 4)])] == [0, 1, 1, 2]
