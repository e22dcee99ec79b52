"""Commits, rollups, registry and live state: a write that breaks off or is repeated changes nothing."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lumenscape.operators import volume
from lumenscape.operators.rollups import Rollups
from lumenscape.plans.scene_view import scene_events
from lumenscape.sources import ingest
from lumenscape.sources.commits import CommitLog
from lumenscape.streaming import jobs, live

BASE = datetime(2024, 1, 1, 12)


class Broken(Exception):
    pass


def test_commits_are_whole_and_count_once(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "t"))
    write = lambda df: lambda path: df.write.mode("overwrite").parquet(path)
    tables = {"a": write(spark.range(3)), "b": write(spark.range(5))}
    with pytest.raises(ValueError):
        log.read("a")
    assert log.read("a", "id long").count() == 0

    def stop(at):
        def after(part):
            if part == at:
                raise Broken

        return after

    for part in ("a", "b"):
        with pytest.raises(Broken):
            log.commit("w", 0, tables, stop(part))
        assert log.read("a", "id long").count() == 0  # not seen before it is whole
    with pytest.raises(Broken):
        log.commit("w", 0, tables, stop("record"))
    assert log.commit("w", 0, tables) is False and log.read("b").count() == 5
    assert log.commit("w", 1, tables) and log.commit("other", 1, tables)
    assert log.read("a").groupBy("commit").count().count() == 3
    assert log.compact(0, {"a": lambda rows, p: write(rows)(p), "b": lambda rows, p: write(rows)(p)}) == 3
    assert log.compact(0, {}) == 0 and len(log.live()) == 1 and log.read("a").count() == 9 and log.read("b").count() == 15
    assert log.vacuum(["a", "b"]) == 6 and log.vacuum(["a", "b"]) == 0 and log.read("a").count() == 9
    assert log.commit("w", 1, tables) is False and log.commit("w", 2, tables) and log.read("b").count() == 20


def test_rollups_merge_to_what_one_pass_gives(spark, sf, tmp_path):
    events = scene_events(spark, sf)
    odd = events.withColumn("fps", F.when(F.col("event_id") % 7 == 0, F.lit(None)).when(F.col("event_id") % 7 == 1, F.lit(float("nan"))).otherwise(F.col("fps")))
    kept = Rollups(spark, str(tmp_path / "r"))
    for n in range(3):
        assert kept.append(odd.where(F.col("event_id") % 3 == n), "w", n) and not kept.append(odd, "w", n)
    rows = lambda df: sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*sorted(df.columns)).collect()), key=repr)
    clean = odd.withColumn("fps", F.nanvl("fps", F.lit(None)))
    want = rows(volume.perf_daily(clean)), rows(volume.events_daily(odd))
    assert (rows(kept.perf_daily()), rows(kept.events_daily())) == want
    assert kept.compact(0) == 3 and (rows(kept.perf_daily()), rows(kept.events_daily())) == want
    assert kept.read("frames").count() == kept.perf_daily().count()  # one state a day


def test_registry_keeps_the_last_write_and_label(spark, tmp_path):
    shape = f"project_id string, scene_id string, updated_at timestamp, label string, meshes {ingest.T.ArrayType(ingest.MESH).simpleString()}"
    write = lambda scene, hour, label, name: spark.createDataFrame([("p", scene, BASE + timedelta(hours=hour), label, [(name, [0.0] * 6, name)])], shape)
    registry = ingest.SceneRegistry(spark, str(tmp_path / "s"))
    for n, (scene, hour, label, name) in enumerate([("a", 0, "first", "m0"), ("a", 2, None, "m2"), ("b", 1, None, "m1"), ("a", 1, "late", "m1")]):
        registry.put(write(scene, hour, label, name), "w", n)
        registry.put(write(scene, hour, label, name), "w", n)
    view = lambda: {r.scene_id: (r.label, r.meshes[0].name) for r in registry.current().collect()}
    assert view() == {"a": ("late", "m2"), "b": (None, "m1")}
    assert registry.snapshot(0) == 4 and view() == {"a": ("late", "m2"), "b": (None, "m1")} and len(registry.log.live()) == 1
    registry.put(write("a", 3, None, "m3"), "w", 9)
    assert view()["a"] == ("late", "m3")


def test_live_state_goes_on_after_a_stop(spark, tmp_path):
    shape = "project_id string, session_id string, event_type string, visitor_id string, scene_id string, received_at timestamp, event_id long, payload string"
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "cp"))

    def arrive(*rows):
        made = [("p", s, kind, visitor, scene, BASE + timedelta(seconds=t), i, "{}") for s, kind, visitor, scene, t, i in rows]
        spark.createDataFrame(made, shape).coalesce(1).write.mode("append").parquet(source)
        live.start_live(jobs.read_event_stream(spark, source), out, state, ring=2).awaitTermination(300)
        now = {r.session_id: (r.visitor_id, r.scene_id, (r.started_at - BASE).seconds, (r.last_seen - BASE).seconds) for r in live.live_now(spark, state).collect()}
        return now, [(r.session_id, r.event_id) for r in live.recent_events(spark, state).collect()]

    now, ring = arrive(("a", "x", "v", "lobby", 0, 1), ("a", "x", "", "", 1, 2), ("a", "x", "", "hall", 2, 3), ("b", "x", None, None, 1, 4), ("c", "x", "w", "lobby", 0, 5), ("c", "session_end", "w", "lobby", 2, 6))
    assert now == {"a": ("v", "hall", 0, 2), "b": ("b", "default", 1, 1)} and ring == [("a", 2), ("a", 3), ("b", 4)]
    now, ring = arrive(("a", "x", "", "", 20, 7))  # the state of before the stop
    assert now["a"] == ("v", "hall", 0, 20) and ring == [("a", 3), ("a", 7), ("b", 4)]
    now, ring = arrive(("d", "x", "u", "lobby", 40, 8), ("a", "x", "", "", 45, 9))  # b has been silent for over 30 s
    assert set(now) == {"a", "d"} and [r for r in ring if r[0] == "b"] == []
    now, ring = arrive(("a", "x", "z", "lobby", 100, 10))  # silent as well: it starts anew
    assert now == {"a": ("z", "lobby", 100, 100)} and ring == [("a", 10)]
    assert live.recent_events(spark, state, "p", "a").count() == 1 and live.recent_events(spark, state, "q").count() == 0
    ended = spark.read.parquet(out).where("not live").select("session_id").distinct()
    assert {r.session_id for r in ended.collect()} >= {"b", "c", "d"}


def test_live_state_is_followed_by_windows(spark, tmp_path):
    """Sessions of a micro-batch are no calls of their own; a state that was replaced is deleted one batch later."""
    shape = "project_id string, session_id string, event_type string, visitor_id string, scene_id string, received_at timestamp, event_id long, payload string"
    at = lambda t: BASE + timedelta(seconds=t)
    made = lambda rows: spark.createDataFrame([("p", s, kind, visitor, scene, at(t), i, "{}") for s, kind, visitor, scene, t, i in rows], shape)
    before = spark.createDataFrame([("p", "on", "v", "hall", at(-50), at(0)), ("p", "gone", "w", "hall", at(-50), at(0)), ("p", "quiet", "q", "hall", at(-9), at(1))], live.STAY)
    rows = made([("on", "x", "", "atrium", 30, 1), ("gone", "x", "", "", 31, 2), ("end", "session_end", "e", "e", 5, 3), ("anew", "x", "n", "", 5, 4), ("anew", "session_end", "", "", 6, 5), ("anew", "x", None, None, 7, 6)])
    got = {(r.session_id, r.started_at == at(-50), r.visitor_id, r.scene_id, r.live, r.went_on) for r in live.stays(live.followed(rows, before)).collect()}
    quiet, ended = ("quiet", False, "q", "hall", True, True), ("anew", False, "n", "default", False, False)
    assert got == {("on", True, "v", "atrium", True, True), ("gone", True, "w", "hall", False, True), ("gone", False, "gone", "default", True, False), quiet, ended, ("anew", False, "anew", "default", True, False)}
    source, state = str(tmp_path / "in"), str(tmp_path / "cp")
    for n in range(3):
        made([("a", "x", "v", "lobby", n, n)]).coalesce(1).write.mode("append").parquet(source)
        live.start_live(jobs.read_event_stream(spark, source), str(tmp_path / "out"), state).awaitTermination(300)
    assert len(list((tmp_path / "cp/live/ring").glob("commit=*"))) == 2 and live.recent_events(spark, state).count() == 3
