"""The 14-event fixture through ingest and the aggregations; expected values worked out by hand."""

import json
import math
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from lumenscape.functions.filters import Scope
from lumenscape.operators import correlate, meshes, performance, spatial, volume
from lumenscape.operators.meshes import Step
from lumenscape.sources import ingest as I

T0 = datetime(2024, 6, 16, 10, tzinfo=timezone.utc)
SCOPE = Scope("parity-project", datetime(2024, 6, 16, 9, 59), datetime(2024, 6, 16, 10, 1))


def event(offset, session, scene_id, kind, /, **fields):
    return {"type": kind, "projectId": "parity-project", "sessionId": session, "ts": int(T0.timestamp() * 1000) + offset * 1000, "sdkVersion": "0.1.0", "sceneId": scene_id, **fields}


EVENTS = [
    event(0, "s1", "lobby", "session_start", scene={"cameraType": "arc-rotate", "meshCount": 3}, device={"engine": "webgpu"}, graphics={"api": "webgpu", "backend": "metal", "apiVersion": "1.0", "shadingLanguage": "wgsl"}),
    event(1, "s1", "lobby", "camera_sample", position=[0, 0, 0], direction=[2, 1, 2], fov=math.pi / 2, aspect=2, near=0.1, hitPoint=[0.2, 0.2, 0.2]),
    event(2, "s1", "lobby", "pointer_click", screen=[0.15, 0.15], hitPoint=[0.2, 0.2, 0.2], hitMesh="box", button=0, source="mouse"),
    event(3, "s1", "lobby", "camera_sample", position=[10, 0, 0], direction=[1, 3, -2], hitPoint=[5, 5, 5]),
    event(4, "s1", "lobby", "pointer_click", screen=[0.95, 0.95], hitPoint=[5, 5, 5], hitMesh="sphere"),
    event(5, "s1", "lobby", "frame_perf", fps=60, frameTimeMs=16, frameTimeP95Ms=20, longFrames=1, dpr=2, renderScale=1),
    event(6, "s1", "lobby", "frame_perf", fps=30, frameTimeMs=33, frameTimeP95Ms=40, longFrames=5, dpr=2, renderScale=0.8),
    event(7, "s1", "lobby", "mesh_visibility", mesh="box", visibleMs=4000, centeredMs=1500, maxScreenFraction=0.4),
    event(8, "s1", "lobby", "mesh_visibility", mesh="sphere", visibleMs=2000, centeredMs=800, maxScreenFraction=0.7),
    event(10, "s2", "arena", "session_start", scene={"cameraType": "free", "meshCount": 5}, device={"engine": "webgl2"}, graphics={"api": "webgl2", "backend": "opengl", "apiVersion": "3.0", "shadingLanguage": "glsl-es"}),
    event(11, "s2", "arena", "camera_sample", position=[0, 0, 0], direction=[-2, -1, 1], hitPoint=[1, 1, 1]),
    event(12, "s2", "arena", "pointer_move", screen=[0.55, 0.55], hitPoint=[1, 1, 1], hitMesh="floor"),
    event(13, "s2", "arena", "pointer_click", screen=[0.55, 0.55], hitPoint=[1, 1, 1], hitMesh="floor", button=2),
    event(14, "s2", "arena", "frame_perf", fps=45, frameTimeMs=22, frameTimeP95Ms=28, longFrames=2, dpr=1, renderScale=1),
]
AGENT = "Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15) AppleWebKit/537.36 Chrome/126.0 Safari/537.36"


def batches(spark, *lists):
    rows = [(f"b{i}", json.dumps({"schemaVersion": "1.0", "events": e}), T0.replace(tzinfo=None), "10.0.0.1", AGENT) for i, e in enumerate(lists)]
    return spark.createDataFrame(rows, I.BATCHES)


@pytest.fixture(scope="module")
def projects(spark):
    return spark.createDataFrame([("parity-project",)], "project_id string")


@pytest.fixture(scope="module")
def events(spark, projects):
    wide, _, _ = I.ingest(batches(spark, EVENTS), projects, "secret")
    # the tie-break of the operators
    return wide.withColumn("event_id", F.unix_millis("ts")).cache()


def only(df):
    return df.collect()[0].asDict()


def test_wide_rows(events):
    assert events.count() == 14
    assert set(c for c, _ in events.dtypes) >= {f.name for f in I.S.EVENTS.fields}
    row = only(events.where("event_type = 'session_start' and session_id = 's1'"))
    payload = json.loads(row["payload"])
    assert payload["device"] == {"engine": "webgpu", "browser": "Chrome", "os": "macOS"} and payload["scene"]["cameraType"] == "arc-rotate"
    assert row["payload"].count('"device"') == 1 and payload["visitorId"] == row["visitor_id"]
    assert len(row["visitor_id"]) == 32 and row["position"] == [] and row["fps"] == 0
    click = only(events.where("mesh = 'box' and event_type = 'pointer_click'"))
    assert click["hit_point"] == [0.2, 0.2, 0.2] and click["source"] == "mouse"


def test_performance(events):
    d = only(performance.perf_distribution(events, SCOPE))
    assert (d["sessions"], d["samples"]) == (2, 3)
    assert [round(d[f"{p}_fps"], 6) for p in ("p05", "p50", "p95")] == [38.25, 45, 51.75]
    f = only(performance.frame_time_percentiles(events, SCOPE))
    assert (f["p50_ms"], f["p95_ms"]) == (23.25, 34)
    j = only(performance.jank_rate(events, SCOPE))
    assert (round(j["median_rate"], 9), round(j["worst_decile_rate"], 9)) == (2.5, 2.9)


def test_space(events):
    bins = {(r.azimuth_bin, r.elevation_bin) for r in spatial.view_direction_heatmap(events, SCOPE, 8).collect()}
    assert bins == {(5, 4), (7, 2), (2, 6)}
    assert {(r.azimuth_bin, r.elevation_bin) for r in correlate.flow(events, SCOPE).collect()} == {(15, 14), (22, 8), (7, 19)}
    rays = {r.mesh: r for r in correlate.click_rays(events, SCOPE).collect()}
    assert [round(rays["box"][f"origin_{a}"], 3) for a in "xyz"] == [-0.049, 0.099, 0.149]
    assert rays["sphere"].origin_x == 10.0  # no intrinsics: the camera itself
    turns = {r.session_id: r for r in correlate.rotation_rate(events, SCOPE).collect()}
    assert abs(turns["s1"].max_turn_rad - 1.4815909832473548) < 1e-9 and "s2" not in turns


def test_funnel_and_camera_mode(events):
    steps = [Step("session_start"), Step("pointer_click", mesh="box")]
    assert [r.sessions for r in meshes.funnel(events, SCOPE, steps).collect()] == [2, 1]
    assert [r.sessions for r in meshes.funnel(events, SCOPE.but(camera_mode="viewer"), steps).collect()] == [1, 1]
    assert [r.session_id for r in volume.list_sessions(events, SCOPE.but(camera_mode="first-person")).collect()] == ["s2"]
    none = meshes.funnel(events, SCOPE.but(scene="nowhere"), steps).collect()
    assert [r.sessions for r in none] == [0, 0]


def test_empty_input(events):
    nowhere = SCOPE.but(scene="nowhere")
    assert only(meshes.dead_clicks(events, nowhere)) == {"total_clicks": 0, "dead_clicks": None}
    assert only(performance.stability_counts(events, nowhere)) == {"context_losses": 0, "compile_stalls": 0, "incidents": 0}
    assert only(spatial.world_heatmap_totals(events, nowhere)) == {"cells": 0, "hits": 0}


def test_batches_count_whole_or_not(spark, projects):
    bad = [EVENTS[0], {**EVENTS[1], "position": [1, 2]}]
    mixed = [EVENTS[0], {**EVENTS[1], "projectId": "other"}]
    unknown = [{**EVENTS[0], "projectId": "other"}]
    screen = [{**EVENTS[2], "screen": [1.5, 0]}]
    wide, _, rejected = I.ingest(batches(spark, EVENTS[:2], bad, mixed, unknown, [], screen), projects, "secret")
    assert wide.count() == 2
    assert {r.batch_id: r.reason for r in rejected.collect()} == {"b1": "invalid: camera_sample", "b2": "several projects", "b3": "unknown project", "b4": "batch size", "b5": "invalid: pointer_click"}


def test_node_samples_and_timeline(spark, projects):
    node = event(2, "s1", "lobby", "node_transform", nodeId="n", position=[1, 2, 3], rotation=[0, 0, 0, 1])
    wide, samples, _ = I.ingest(batches(spark, [*EVENTS[:3], node]), projects, "secret")
    assert wide.count() == 3
    row = only(samples)
    assert row["scale"] == [] and row["bone_id"] == ""
    back = json.loads(only(I.node_events(samples))["payload"])
    assert back["nodeId"] == "n" and "boneId" not in back and "scale" not in back
    kinds = [r.event_type for r in I.session_timeline(wide, samples, "s1").collect()]
    assert kinds == ["session_start", "camera_sample", "pointer_click", "node_transform"]


def test_write_and_read(spark, projects, tmp_path):
    wide, _, _ = I.ingest(batches(spark, EVENTS), projects, "secret")
    I.write_events(wide, str(tmp_path / "events"))
    back = spark.read.parquet(str(tmp_path / "events"))
    assert volume.event_type_counts(back, SCOPE).count() == volume.event_type_counts(wide, SCOPE).count()
    (tmp_path / "s.ndjson").write_text("\n".join([json.dumps(EVENTS[0]), "{broken", "", json.dumps(EVENTS[1])]))
    good, skipped = I.read_ndjson(spark, str(tmp_path / "s.ndjson"))
    assert (good.count(), skipped.first()[0]) == (2, 1)


def test_agents(spark):
    agents = [("Mozilla/5.0 Edg/120.0 Chrome/120 Safari/537", "Edge"), ("Opera/9.8", "Opera"), ("Mozilla FxiOS/1 iPhone", "Firefox"), ("", "Other"), (None, "Other"), ("curl", "Other"), ("Mozilla Version/17 Mobile/15 Safari/604", "Safari")]
    df = spark.createDataFrame(agents, "ua string, want string").select("want", I.agent_family(F.col("ua"), I.BROWSERS).alias("got"))
    assert all(r.want == r.got for r in df.collect())
