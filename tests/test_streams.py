import pytest

from gaugeloom.streaming import streams

SAMPLES = "monitor string, entity_id string, metric string, ts long, value double"


def feed(spark, tmp_path, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))


def rows_of(spark, stream, tmp_path, name):
    q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return spark.table(name).collect()


def test_rollup_stream(spark, tmp_path):
    first = [("m", "e", "x", t, v) for t, v in ((600, 10.0), (660, 30.0), (840, 20.0))]
    stream = feed(spark, tmp_path, [first, [("m", "e", "x", 2000, 1.0)], [("m", "e", "x", 9000, 1.0)]], SAMPLES)
    got = {r.bucket: r for r in rows_of(spark, streams.rollup_5m(stream), tmp_path, "r5")}
    assert (got[600].avg, got[600].last, got[600].cnt) == (20.0, 20.0, 3) and 1800 in got


def test_session_stream(spark, tmp_path):
    schema = "ts long, provider string, event_id string, severity int, message string"
    rows = [(t, "k", None, 3, f"oom {t}") for t in (0, 30, 60, 5000)]
    got = rows_of(spark, streams.sessions(feed(spark, tmp_path, [rows, [(90_000, "k", None, 1, "end")], [(99_000, "k", None, 1, "end")]], schema), 600), tmp_path, "sess")
    assert sorted((r.first_ts, r.occurrences) for r in got)[:2] == [(0, 3), (5000, 1)]


def test_notification_stream_is_the_batch_fold(spark, tmp_path):
    schema = "monitor string, entity_id string, grp string, ts long, severity int, owner_true boolean"
    rows = [("m", "e", "g", t, 2 if t < 1500 else -1, True) for t in range(0, 1800, 60)]
    got = rows_of(spark, streams.notifications(feed(spark, tmp_path, [rows[:10], rows[10:20], rows[20:]], schema)), tmp_path, "notes")
    assert sorted((r.ts, r.kind) for r in got) == [(0, "open"), (300, "renotify"), (1200, "renotify"), (1500, "recover")]


def test_replays_and_store(spark, tmp_path):
    schema = "ts long, identity string"
    stream = feed(spark, tmp_path, [[(1, "a"), (2, "b"), (1, "a")], [(3, "b"), (4, "c")]], schema)
    q = streams.store(streams.without_replays(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert q.awaitTermination(120)
    assert sorted(r.identity for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c"]


def test_gone_stream(spark, tmp_path):
    rows = [[("m", "a", "x", 1000, 1.0), ("m", "b", "x", 1000, 1.0)], [("m", "b", "x", 1400, 1.0)], [("m", "b", "x", 1800, 1.0)], [("m", "b", "x", 1900, 1.0)]]
    got = rows_of(spark, streams.gone(feed(spark, tmp_path, rows, SAMPLES)), tmp_path, "gone")
    assert [(r.entity_id, r.last_seen) for r in got][:1] == [("a", 1000)]


@pytest.fixture(autouse=True)
def few_partitions(spark):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", was)
