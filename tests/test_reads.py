"""Reads by name: every one answers with defaults, and refuses what it does not take."""

from datetime import datetime

import pytest

from lumenscape.operators import spatial
from lumenscape.plans.analytics import ALL
from lumenscape.plans.reads import READS, read
from lumenscape.plans.scene_view import PROJECT, scene_events
from lumenscape.sources.ingest import MESH

NEEDED = {"funnel": {"steps": '[{"type": "session_start"}, {"type": "pointer_click", "mesh": "mesh_1"}]'}}


@pytest.fixture(scope="module")
def events(spark, sf):
    return scene_events(spark, sf)


def test_every_read_answers(spark, events):
    proxies = spark.createDataFrame([(PROJECT, "lobby", datetime(2024, 1, 1), None, [])], f"project_id string, scene_id string, updated_at timestamp, label string, meshes array<{MESH.simpleString()}>")
    for name, wanted in READS.items():
        options = {"scene": "lobby", "source": "mouse", "session": "u7-w0", "camera_mode": "viewer", "region": "-9,-9,-9,9,9,9"}
        some = {k: v for k, v in options.items() if k in wanted.takes.split()}
        tables = {"proxies": proxies} if "proxies" in wanted.tables else {}
        assert read(events, name, PROJECT, since=datetime(2024, 1, 1), **tables, **some, **NEEDED.get(name, {})).schema, name


def test_cell_size_follows_region_then_bounds(spark, events):
    bounds = spark.createDataFrame([(PROJECT, "lobby", [0.0, 0.0, 0.0, 128.0, 1.0, 1.0])], "project_id string, scene_id string, bounds array<double>")
    cells = lambda **o: read(events, "world_heatmap_totals", PROJECT, bounds, **o).first()[0]
    want = lambda size, scope: spatial.world_heatmap_totals(events, scope, size).first()[0]
    assert cells(scene="lobby") == want(2.0, ALL.but(scene="lobby"))
    assert cells(scene="lobby", region="-8,-8,-8,8,8,8") == want(0.25, ALL.but(scene="lobby", region=(-8, -8, -8, 8, 8, 8)))
    assert cells(scene="atrium") == want(0.5, ALL.but(scene="atrium")) and cells(cell_size=3) == want(3, ALL)


@pytest.mark.parametrize(
    "name, options",
    [
        ("nonsense", {}), ("world_heatmap", {"limit": 1001}), ("floor_plan", {"limit": 10_001}), ("trajectories", {"limit": 50_001}), ("rage_clicks", {"min_repeats": 1}), ("rage_clicks", {"interval": 61}),
        ("timeseries", {"interval": 0}), ("timeseries", {"interval": 1.5}), ("timeseries", {"event_type": "Not A Type"}), ("event_counts", {"source": "mouse"}), ("fps_histogram", {"bucket": 241}),
        ("rotation_rate", {"rapid_turn": 4.0}), ("top_meshes", {"source": "keyboard"}), ("list_sessions", {"camera_mode": "orbit"}), ("world_heatmap", {"region": "1,2,3"}), ("world_heatmap", {"cell_size": float("nan")}),
        ("top_meshes", {"scene": "no spaces"}), ("top_meshes", {"session": "x" * 129}), ("flow_links", {"origin_voxel": "1,2"}), ("list_sessions", {"since": "yesterday"}), ("perf_summary", {"limit": 5}), ("session_events", {}), ("scene_representations", {}), ("scene_representation", {"scene": "lobby"}), ("scene_representation", {}),
    ],
)
def test_refused(events, name, options):
    with pytest.raises(ValueError):
        read(events, name, PROJECT, **options)


def test_accepted_at_the_bounds(events):
    for name, options in (("trajectories", {"limit": 50_000}), ("rage_clicks", {"min_repeats": 2, "interval": 60}), ("navigation_effort", {"move_threshold": 0}), ("flow_links", {"group_by_origin": True, "origin_voxel": "1,-2,0", "cell_size": 2.0})):
        assert read(events, name, PROJECT, **options).columns
