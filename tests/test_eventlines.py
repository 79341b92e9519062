import pytest

from gaugeloom.sources.eventlines import EventLines, EventLinesReader


def drain(spark, folder, checkpoint, out, **options):
    spark.dataSource.register(EventLines)
    reader = spark.readStream.format("event_lines").option("path", str(folder)).option("checkpoint", str(checkpoint))
    for k, v in options.items():
        reader = reader.option(k, v)
    q = reader.load().writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return spark.read.parquet(str(out))


def test_drains_bounded_batches_over_restarts(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    lines = [f"line {i} é{'x' * (i % 90)}" for i in range(5000)]
    (folder / "a.log").write_text("\n".join(lines[:2600]) + "\n")
    (folder / "b.log").write_text("\n".join(lines[2600:4900]) + "\n")
    sizes = []
    for k in range(4):
        if k == 2:
            (folder / "c.log").write_text("\n".join(lines[4900:]) + "\nhalf a li")
        got = drain(spark, folder, tmp_path / "cp", tmp_path / "out", start="begin", limit=2000)
        sizes.append(got.count())
    assert sizes == [2000, 4000, 5000, 5000]
    assert [r.line for r in got.orderBy("file", "at").collect()] == lines
    with (folder / "c.log").open("a") as f:
        f.write("ne\n")
    assert drain(spark, folder, tmp_path / "cp", tmp_path / "out", start="begin", limit=2000).orderBy("file", "at").collect()[-1].line == "half a line"


def test_starts_now_without_what_was_before(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    (folder / "a.log").write_text("old\nolder\n")
    assert drain(spark, folder, tmp_path / "cp", tmp_path / "out").count() == 0
    with (folder / "a.log").open("a") as f:
        f.write("new\n")
    assert [r.line for r in drain(spark, folder, tmp_path / "cp", tmp_path / "out").collect()] == ["new"]


def test_ranges_of_a_file_share_no_line(tmp_path, monkeypatch):
    from gaugeloom.sources import eventlines

    (tmp_path / "a").write_text("".join(f"{'y' * (i % 13)}{i}\n" for i in range(300)))
    monkeypatch.setattr(eventlines, "TASK_BYTES", 37)
    monkeypatch.setattr(eventlines, "_READ", 16)
    reader = EventLinesReader({"path": str(tmp_path), "limit": "250", "start": "begin"})
    start, end = reader.initialOffset(), reader.latestOffset()
    ranges = reader.partitions(start, end)
    assert len(ranges) > 20
    assert [line for r in ranges for _, _, line in reader.read(r)] == [f"{'y' * (i % 13)}{i}" for i in range(250)]
    rest = reader.partitions(end, reader.latestOffset())
    assert [line for r in rest for _, _, line in reader.read(r)] == [f"{'y' * (i % 13)}{i}" for i in range(250, 300)]
    assert reader.partitions(reader.latestOffset(), reader.latestOffset()) == []


def test_wrong_options():
    for options in ({"limit": "0"}, {"start": "later"}):
        with pytest.raises(ValueError, match="limit must be"):
            EventLinesReader({"path": "/tmp", **options})
