"""The table of scene events: all rows, sorted within its files, dealt without their many columns; its readers read their days only."""

from pathlib import Path

import pyarrow.parquet as pq

from lumenscape.plans import scene_view as v
from lumenscape.plans import source_queries
from lumenscape.sources import ingest
from tests.test_plans import plan


def test_scene_table_holds_the_view_sorted(spark, sf, tmp_path):
    v.write_scene_events(spark, sf, str(tmp_path / "t"))
    want = v.scene_view(spark, sf)
    got = spark.read.parquet(str(tmp_path / "t"))
    assert set(got.columns) == {*want.columns, "inserted_at", "event_date"}
    got, n = got.select(*want.columns), want.count()
    assert got.count() == n and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert spark.conf.get(v._FUSED) == "65535"
    files = list(Path(tmp_path / "t").rglob("*.parquet"))
    rows = [pq.ParquetFile(f).read(["event_type", "session_id", "ts"]).to_pylist() for f in files]
    assert sum(len(r) for r in rows) == n
    for r in rows:
        keys = [(x["event_type"], x["session_id"], x["ts"]) for x in r]
        assert keys == sorted(keys)


def test_rows_are_widened_after_they_are_dealt(spark, tmp_path):
    rows = spark.sql("SELECT 'p' AS project_id, 't' || id % 3 AS event_type, 's' || id AS session_id, timestamp_seconds(id * 40000) AS ts, id FROM range(40)")
    seen = []

    def widen(dealt):
        seen.append(plan(dealt))
        return dealt.withColumn("twice", dealt.id * 2)

    ingest.write_events(rows, str(tmp_path / "t"), widen=widen)
    assert "rangepartitioning" in seen[0] and "Sort" in seen[0]
    got = spark.read.parquet(str(tmp_path / "t"))
    assert sorted((r.id, r.twice, r.project_id) for r in got.collect()) == [(i, 2 * i, "p") for i in range(40)]


def test_registry_commits_read_their_days_only(spark, sf, monkeypatch):
    scans = []
    put = ingest.SceneRegistry.put

    def watched(self, proxies, writer, number):
        scans.append(plan(proxies))
        return put(self, proxies, writer, number)

    monkeypatch.setattr(ingest.SceneRegistry, "put", watched)
    events = v.scene_events(spark, sf)
    assert source_queries.registry(events).current().count() == 3
    assert len(scans) == 8 and all("event_date" in next(x for x in s.splitlines() if x.startswith("PartitionFilters")) for s in scans)
