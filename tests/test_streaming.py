"""Streams give what their batch twins give."""

import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lumenscape.operators import volume
from lumenscape.plans.analytics import ALL
from lumenscape.plans.scene_view import scene_events
from lumenscape.streaming import jobs
from tests.test_golden import AGENT, EVENTS, T0

BASE = datetime(2024, 1, 1, 12)


def drained(stream, name, spark, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_type_counts_equal_batch(spark, sf, tmp_path):
    events = scene_events(spark, sf)
    path = str(tmp_path / "e")
    events.repartitionByRange(2, "ts").write.parquet(path)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    got = drained(jobs.stream_type_counts(jobs.read_event_stream(spark, path), 3600), "types", spark, "complete").groupBy("event_type").agg(F.sum("count").alias("n"))
    want = volume.event_type_counts(events, ALL)
    assert {r.event_type: r.n for r in got.collect()} == {r.event_type: r["count"] for r in want.collect()}


def test_deduplicate(spark, tmp_path):
    rows = [("p", "s", BASE, "a"), ("p", "s", BASE, "a"), ("p", "s", BASE, "b")]
    path = str(tmp_path / "d")
    spark.createDataFrame(rows, "project_id string, session_id string, ts timestamp, payload string").write.parquet(path)
    assert drained(jobs.deduplicate(jobs.read_event_stream(spark, path)), "dedup", spark).count() == 2


def test_late_rows_are_counted(spark, tmp_path):
    """A row behind the watermark is left out of its window, and told."""
    path, out = tmp_path / "late", str(tmp_path / "out")
    schema = "project_id string, session_id string, ts timestamp, event_type string, payload string, fps double"

    def arrive(*hours):
        rows = [("p", "s", BASE + timedelta(hours=h), "frame_perf", str(h), 60.0) for h in hours]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))

    def run():
        stream = jobs.stream_type_counts(jobs.read_event_stream(spark, str(path)), 3600)
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return jobs.rows_too_late(q)

    arrive(0, 1, 5)
    assert run() == 0
    arrive(0, 6)
    assert run() == 1
    # the watermark is ten minutes behind hour 6, so the window of hour 5 is still open
    assert sum(r["count"] for r in spark.read.parquet(out).collect()) == 2
    arrive(8)
    assert run() == 0
    assert sum(r["count"] for r in spark.read.parquet(out).collect()) == 4


def test_feed_starts_with_what_is_stored(spark, tmp_path):
    stored = present(spark).where("event_id <= 2")
    present(spark).where("event_id > 2").coalesce(1).write.parquet(str(tmp_path / "live"))
    for _ in range(2):  # started again it adds nothing
        jobs.session_feed(stored, jobs.read_event_stream(spark, str(tmp_path / "live")), "p", "a", str(tmp_path / "feed"), str(tmp_path / "cp"), n=1).awaitTermination(120)
    got = {(r.event_id, r.phase) for r in spark.read.parquet(str(tmp_path / "feed")).collect()}
    assert (2, "backfill") in got and not any(i == 1 for i, _ in got) and all(p == "live" for i, p in got if i > 2)


def test_streaming_ingest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [("b0", json.dumps({"events": EVENTS}), T0.replace(tzinfo=None), "ip", AGENT), ("b1", json.dumps({"events": []}), T0.replace(tzinfo=None), "ip", AGENT)]
    spark.createDataFrame(rows, "batch_id string, body string, received_at timestamp, ip string, user_agent string").write.parquet(str(tmp_path / "in/batches"))
    projects = spark.createDataFrame([("parity-project",)], "project_id string")
    stream = jobs.read_event_stream(spark, str(tmp_path / "in/batches"))
    jobs.streaming_ingest(stream, projects, "secret", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    out = str(tmp_path / "out")
    assert [jobs.ingested(spark, out, t).count() for t in ("events", "node_samples", "quarantine")] == [14, 0, 1]


def test_one_file_of_batches_is_parsed_by_many_tasks(spark, tmp_path):
    rows = [(f"b{i}", json.dumps({"events": []}), T0.replace(tzinfo=None), "ip", AGENT) for i in range(40)]
    spark.createDataFrame(rows, "batch_id string, body string, received_at timestamp, ip string, user_agent string").coalesce(1).write.parquet(str(tmp_path / "in"))
    projects = spark.createDataFrame([("parity-project",)], "project_id string")
    jobs.streaming_ingest(jobs.read_event_stream(spark, str(tmp_path / "in")), projects, "secret", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    rejected = jobs.ingested(spark, str(tmp_path / "out"), "quarantine")
    assert rejected.count() == 40 and rejected.select(F.input_file_name()).distinct().count() > 1


PRESENT = "project_id string, session_id string, event_type string, visitor_id string, scene_id string, received_at timestamp, event_id long"


def present(spark):
    at = lambda s: BASE + timedelta(seconds=s)
    rows = [("p", "a", "camera_sample", "v1", "x", at(0), 1), ("p", "a", "camera_sample", "", "", at(10), 2), ("p", "b", "camera_sample", "", "y", at(5), 3), ("p", "b", "session_end", "", "", at(8), 4), ("p", "c", "camera_sample", "v1", "y", at(-60), 5), ("p", "d", "camera_sample", "", "y", at(-60), 6), ("p", "d", "camera_sample", "", "y", at(11), 7)]
    return spark.createDataFrame(rows, PRESENT)


def test_presence(spark):
    now = F.lit(BASE + timedelta(seconds=12))
    live = jobs.presence_at(present(spark), now)
    rows = {r.session_id: r for r in live.collect()}
    assert set(rows) == {"a", "d"} and rows["a"].visitor_id == "v1" and rows["d"].started_at == BASE + timedelta(seconds=11)
    totals, roster = jobs.presence_snapshot(live, now)
    assert tuple(totals.first()) == ("p", 2, 2)
    assert [(r.session_id, r.activity) for r in roster.collect()] == [("d", "active"), ("a", "active")] and "visitor_id" not in roster.columns


def test_backfill_and_firehose(spark):
    assert [r.event_id for r in jobs.backfill(present(spark), 1).collect()] == [2, 4, 5, 7]
    assert jobs.firehose(present(spark), "p", ["session_end"]).count() == 1
    assert jobs.session_tail(present(spark), "p", "a").count() == 2
