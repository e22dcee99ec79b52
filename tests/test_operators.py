"""As-of joins, filters, capture reductions and derived tables against plain Python."""

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from lumenscape.functions import filters, geometry as g
from lumenscape.operators import capture, derived
from lumenscape.operators.asof import asof_join, with_previous
from lumenscape.operators.quantiles import summary_with_quantiles

T = datetime(2024, 1, 1)
times = st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 6)), max_size=12)


def frame(spark, items, column):
    return spark.createDataFrame([(s, T + timedelta(seconds=t), i, i) for i, (s, t) in enumerate(items)], f"session_id string, ts timestamp, event_id long, {column} long")


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(times, times)
def test_asof_join(spark, lefts, rights):
    got = {r.l: r.found and r.found.r for r in asof_join(frame(spark, lefts, "l"), frame(spark, rights, "r")).collect()}
    for i, (s, t) in enumerate(lefts):
        before = [(u, j) for j, (s2, u) in enumerate(rights) if s2 == s and u <= t]
        assert got[i] == (max(before)[1] if before else None)


def test_previous_distinct_time(spark):
    items = [("a", 1), ("a", 1), ("a", 2), ("a", 2), ("a", 5), ("b", 1)]
    got = sorted((r.cur.v, r.prev.v) for r in with_previous(frame(spark, items, "v"), ["v"]).collect())
    assert got == [(2, 1), (3, 1), (4, 3)]


def test_scope_checks():
    with pytest.raises(ValueError):
        filters.Scope("")
    with pytest.raises(ValueError):
        filters.Scope("p", scene="no spaces")
    with pytest.raises(ValueError):
        filters.check_options(bins=501)
    with pytest.raises(ValueError):
        filters.parse_region("1,2,3,0,5,6")
    assert filters.parse_region("0,0,0,1,2,3") == (0, 0, 0, 1, 2, 3)
    assert filters.Scope("p", camera_mode="viewer").camera_mode == "arc-rotate"
    assert filters.cell_size_for((0, 0, 0, 64, 1, 1)) == 1 and filters.cell_size_for((0, 0, 0, 0, 0, 0)) is None
    assert filters.resolve_cell_size(None, None, (0, 0, 0, 128, 1, 1), 0.5) == 2
    assert filters.bucket_seconds(7 * 86_400) == 10_800


def test_frame_conversion(spark):
    row = spark.range(1).select(g.to_left_handed(F.array(F.lit(1.0), F.lit(2.0), F.lit(0.0))).alias("p"), g.box_to_left_handed(F.array(*[F.lit(float(i)) for i in range(6)])).alias("b"), g.quaternion_to_left_handed(F.array(*[F.lit(0.5)] * 4)).alias("q")).first()
    assert row.p == [1, 2, 0] and row.b == [0, 1, -5, 3, 4, -2] and row.q == [-0.5, -0.5, 0.5, 0.5]


def test_keep_changes_compares_with_the_last_kept(spark):
    fps = [60, 61, 62, 63, 60, 50]
    df = spark.createDataFrame([("s", T + timedelta(seconds=i), float(x)) for i, x in enumerate(fps)], "session_id string, ts timestamp, fps double")
    assert [r.fps for r in capture.suppress_idle_fps(df, 2).orderBy("ts").collect()] == [60, 63, 60, 50]
    assert [r.fps for r in capture.thin(df, 2000, ["session_id"]).orderBy("ts").collect()] == [60, 62, 60]
    assert capture.thin_by_grid(df, 2000, ["session_id"]).count() == 3


def test_frame_windows(spark):
    ms = list(range(1, 101))
    random.Random(1).shuffle(ms)
    row = capture.frame_windows(spark.createDataFrame([("s", 1, float(x)) for x in ms], "session_id string, window int, frame_ms double")).first()
    assert (row.frame_time_p95_ms, row.frame_time_p99_ms, row.long_frames) == (95, 99, 50)


def test_decompose(spark):
    angle = 0.7
    c, s = np.cos(angle), np.sin(angle)
    m = [2 * c, 0, -2 * s, 0, 0, 2, 0, 0, 2 * s, 0, 2 * c, 0, 5, 6, 7, 1]
    row = capture.decompose(spark.createDataFrame([([float(x) for x in m],)], "matrix array<double>")).first()
    assert row.position == [5, 6, 7]
    assert np.allclose(row.rotation, [0, np.sin(angle / 2), 0, np.cos(angle / 2)]) and np.allclose(row.scale, [2, 2, 2])
    assert capture.decompose(spark.createDataFrame([([float(x) for x in np.eye(4).ravel()],)], "matrix array<double>")).first().scale is None


def test_gestures(spark):
    fields = "s_position array<double>, s_forward array<double>, s_up array<double>, s_pivot array<double>, s_fov double, s_distance double, e_position array<double>, e_forward array<double>, e_up array<double>, e_pivot array<double>, e_fov double, e_distance double"
    x, z, up = [1.0, 0.0, 0.0], [0.0, 0.0, 1.0], [0.0, 1.0, 0.0]
    o = [0.0, 0.0, 0.0]
    turned = [0.0, 0.7071067811865476, 0.7071067811865476]
    rows = [
        (o, z, None, None, None, None, o, x, None, None, None, None),
        (o, z, None, None, 1.0, None, o, z, None, None, 0.5, None),
        (o, z, None, None, None, None, [0.0, 0.0, 3.0], z, None, None, None, None),
        (o, z, None, z, None, 2.0, o, z, None, z, None, 1.0),
        (o, z, None, z, None, 2.0, o, z, None, [1.0, 0.0, 1.0], None, 2.0),
        (o, x, up, None, None, None, o, x, turned, None, None, None),
        (o, z, None, None, None, None, o, z, None, None, None, None),
    ]
    kinds = [r.kind for r in capture.classify_gestures(spark.createDataFrame(rows, fields).coalesce(1)).collect()]
    assert kinds == ["orbit", "zoom", "fly", "dolly", "pan", "roll", None]


def test_reconstruct(spark):
    samples = spark.createDataFrame([("s", T, "root", "", [10.0, 0.0, 0.0], [0.0, 0.0, 0.0, 1.0], [])], "session_id string, ts timestamp, node_id string, child_path string, position array<double>, rotation array<double>, scale array<double>")
    meshes = spark.createDataFrame([("root", [1.0, 0.0, 0.0], [0.0, 0.0, 0.0, 1.0], None), ("root/arm", [1.0, 2.0, 0.0], [0.0, 0.0, 0.0, 1.0], None), ("rooted", [9.0, 9.0, 9.0], [0.0, 0.0, 0.0, 1.0], None)], "path string, position array<double>, rotation array<double>, scale array<double>")
    rows = capture.reconstruct_children(samples, meshes).collect()
    assert [r.path for r in rows] == ["root/arm"] and np.allclose(np.array(rows[0].matrix).reshape(4, 4)[:3, 3], [10, 2, 0])


def test_errors_hovers_diagnostics(spark):
    errors = spark.createDataFrame([("s", T + timedelta(seconds=i), i, m, "") for i, m in enumerate("aabba")], "session_id string, ts timestamp, event_id long, message string, stack string")
    assert [r.message for r in capture.limit_errors(errors).orderBy("ts").collect()] == ["a", "b", "a"]
    hovers = spark.createDataFrame([("s", T + timedelta(milliseconds=200 * i), m) for i, m in enumerate(["x", "x", "x", "x", None, "y", None])], "session_id string, ts timestamp, mesh string")
    assert [(r.mesh, r.dwell_ms) for r in capture.hover_episodes(hovers).collect()] == [("x", 800.0)]
    diagnostics = spark.createDataFrame([("s", T + timedelta(seconds=i), "error", "validation", "", "", str(i)) for i in (0, 1, 31)], "session_id string, ts timestamp, severity string, category string, backend string, code string, payload string")
    assert sorted((r["count"], r.payload) for r in capture.roll_up_diagnostics(diagnostics).collect()) == [(1, "31"), (2, "0")]


def test_visibility(spark):
    rows = [("s", T + timedelta(milliseconds=100 * i), "m", 100.0, [0.0, 0.0, 0.0], [0.0, 0.0, 1.0], 0.8, [0.0, 0.0 if i < 3 else 9.0, 5.0], 1.0) for i in range(5)]
    df = spark.createDataFrame(rows, "session_id string, ts timestamp, mesh string, step_ms double, cam_pos array<double>, forward array<double>, fov double, center array<double>, radius double")
    row = capture.mesh_visibility(df, 0.97).first()
    assert (row.visible_ms, row.centered_ms, row.max_screen_fraction) == (500, 300, 0.4935)


def test_dead_zones(spark):
    coverage = spark.createDataFrame([(0, 0, 0, 5), (3, 0, 0, 2)], "vx long, vy long, vz long, count long")
    meshes = spark.createDataFrame([("near", [0.0, 0.0, 0.0, 1.0, 1.0, 1.0]), ("far", [50.0, 0.0, 0.0, 51.0, 1.0, 1.0]), ("wide", [-9.0, -9.0, -9.0, 9.0, 9.0, 9.0])], "name string, aabb array<double>")
    got = {r.name: (r.visits, r.dead) for r in derived.dead_zones(coverage, meshes, 1.0).collect()}
    assert got == {"near": (5, False), "far": (0, True), "wide": (7, False)}


def test_flow_graph_keeps_totals(spark):
    rng = random.Random(3)
    rows = [(0, 0, f"m{rng.randint(0, 12)}", rng.randint(0, 12), 0, 0, rng.randint(1, 9)) for _ in range(200)]
    flows = spark.createDataFrame(rows, "azimuth_bin long, elevation_bin long, mesh string, origin_vx long, origin_vy long, origin_vz long, count long")
    links = derived.flow_graph(flows, 3, 3, 5).collect()
    assert sum(r["count"] for r in links) == sum(r[-1] for r in rows)
    assert len({r.standpoint for r in links}) <= 4 and len({r.mesh for r in links}) <= 4


def test_drawing_tables(spark):
    voxels = spark.createDataFrame([(0, 0, 0, 4), (1, 0, 0, 2), (2, 0, 0, 0)], "vx long, vy long, vz long, count long")
    rows = {r.vx: r for r in derived.heatmap_instances(voxels, 2.0).collect()}
    assert set(rows) == {0, 1} and (rows[0].x, rows[0].edge, rows[0].r, rows[0].b) == (1.0, 1.8, 1.0, 1.0)
    dome = derived.gaze_dome(spark.createDataFrame([(4, 4, 1)], "azimuth_bin long, elevation_bin long, count long"), 8, 2.0).first()
    assert abs((dome.x**2 + dome.y**2 + dome.z**2) ** 0.5 - 2) < 1e-9


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_exact_quantiles(spark, keys):
    rng = np.random.default_rng(2)
    rows = [(int(k), float(v), float(w)) for k, v, w in zip(rng.integers(0, 3, 500), np.round(rng.normal(scale=30, size=500), 1), rng.lognormal(sigma=4, size=500))]
    rows += [(0, None, 0.0), (3, None, None), (4, 7.0, float("nan"))]
    df = spark.createDataFrame(rows, "k long, v double, w double")
    wanted = {"v05": ("v", 0.05), "v50": ("v", 0.5), "w99": ("w", 0.99), "w0": ("w", 0.0)}
    aggregates = {"n": F.count("one"), "most": F.max("w"), "some": F.count("v")}
    got = {tuple(r[k] for k in keys): r for r in summary_with_quantiles(df, keys, wanted, aggregates, ("n",)).collect()}
    groups = {(k,) for k, _, _ in rows} if keys else {()}
    assert set(got) == groups
    none = summary_with_quantiles(df.where("k > 9"), keys, wanted, aggregates, ("n",)).collect()
    assert none == [] if keys else (len(none), none[0]["n"], none[0]["v50"]) == (1, 0, None)
    for group in groups:
        mine = [r for r in rows if not keys or r[0] == group[0]]
        assert (got[group]["n"], got[group]["some"]) == (len(mine), sum(v is not None for _, v, _ in mine))
        for name, (column, q) in wanted.items():
            values = [x for k, *vw in rows if not keys or k == group[0] for x in [vw["vw".index(column)]] if x is not None and x == x]
            assert (got[group][name] is None) if not values else math.isclose(got[group][name], np.quantile(values, q), rel_tol=1e-9, abs_tol=1e-9)
