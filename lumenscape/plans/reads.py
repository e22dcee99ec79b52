"""Reads by name: a caller names a question and gives its options; what it does not take, or out of bounds, is refused."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from lumenscape.functions.filters import Scope, parse_region, resolve_cell_size
from lumenscape.operators import correlate, meshes, performance, spatial, volume
from lumenscape.operators.meshes import Step
from lumenscape.schema import NODE_SAMPLES
from lumenscape.sources import ingest


@dataclass(frozen=True)
class Bound:
    """A number option: above `least` (or `least` itself, if closed) up to `most`."""

    most: float = math.inf
    least: float = 0
    whole: bool = True
    closed: bool = False

    def check(self, name: str, value) -> None:
        number = isinstance(value, (int, float)) and not isinstance(value, bool) and math.isfinite(value)
        if not number or self.whole and value != int(value) or value > self.most or value < self.least or value == self.least and not self.closed:
            raise ValueError(f"{name} must be {'a whole number ' if self.whole else ''}{'from' if self.closed else 'above'} {self.least} up to {self.most}, not {value!r}")


# Bounds of options, input sources and camera modes that a caller can ask for.
LIMIT, CELL, SECONDS = Bound(1000), Bound(1000, whole=False), Bound(31_536_000)
SOURCES = "mouse touch stylus pen xr-controller hand gaze transient other".split()
MODES = ["viewer", "first-person"]
_PATTERNS = {"session": r"(?s).{1,128}", "scene": r"[A-Za-z0-9._:-]{1,64}", "event_type": "[a-z_]{1,40}", "origin_voxel": r"-?\d+(\.\d+)?(,-?\d+(\.\d+)?){2}", "steps": r"(?s).{1,8192}"}


@dataclass(frozen=True)
class Read:
    """build(events, scope, **options). takes: scope options beside since and until; numbers and texts: its own.

    needs: scope options that it does not answer without; tables: which others than the events build() is given.
    """

    build: Callable[..., DataFrame]
    takes: str = ""
    numbers: dict[str, Bound] = field(default_factory=dict)
    texts: str = ""
    cell_default: float | None = None
    needs: str = ""
    tables: str = ""

    def options(self) -> set[str]:
        return {"since", "until", *self.takes.split(), *self.numbers, *self.texts.split()}


def _flow(events: DataFrame, scope: Scope, group_by_origin: bool = False, origin_voxel: str = "", **options) -> DataFrame:
    if not group_by_origin and not origin_voxel:
        return correlate.flow(events, scope, **{k: v for k, v in options.items() if k != "cell_size"})
    voxel = tuple(int(float(x)) for x in origin_voxel.split(",")) if origin_voxel else None
    return correlate.flow_by_standpoint(events, scope, origin_voxel=voxel, **options)


def _funnel(events: DataFrame, scope: Scope, steps: str) -> DataFrame:
    """steps: a JSON list of {"type", "mesh"?, "name"?}."""
    return meshes.funnel(events, scope, [Step(s["type"], s.get("mesh", ""), s.get("name", "")) for s in json.loads(steps)])


def _distance(events: DataFrame, scope: Scope, center_x: float = 0.0, center_y: float = 0.0, center_z: float = 0.0, **options) -> DataFrame:
    return spatial.camera_distance(events, scope, (float(center_x), float(center_y), float(center_z)), **options)


def _navigation(events: DataFrame, scope: Scope, move_threshold: float = 0.05, **options) -> DataFrame:
    return correlate.navigation_effort(events, scope, move_threshold, **options)


def _histogram(events: DataFrame, scope: Scope, bucket: int = 10) -> DataFrame:
    return performance.fps_histogram(events, scope, bucket)


def _session_events(events: DataFrame, scope: Scope, samples: DataFrame | None) -> DataFrame:
    """All events of a session in the order of its timeline, node samples among them."""
    mine = lambda df: df.where((F.col("project_id") == scope.project) & (F.col("session_id") == scope.session))
    samples = events.sparkSession.createDataFrame([], NODE_SAMPLES) if samples is None else samples
    return ingest.session_timeline(mine(events), mine(samples), scope.session)


_HERE, _PLACED = "scene source session", "scene source session region camera_mode"
_BINS = {"bins": Bound(500)}
_VOXELS = {"cell_size": CELL, "limit": LIMIT}

READS: dict[str, Read] = {
    "list_sessions": Read(volume.list_sessions, "camera_mode", {"limit": LIMIT}),
    "list_scenes": Read(volume.distinct_scenes, "", {"limit": LIMIT}),
    "timeseries": Read(volume.timeseries, "scene", {"interval": SECONDS}, "event_type"),
    "event_counts": Read(volume.event_type_counts, "scene"),
    "session_meta": Read(lambda events, scope: ingest.session_meta(events.where((F.col("project_id") == scope.project) & (F.col("session_id") == scope.session))), "session"),
    "session_events": Read(_session_events, "session", needs="session", tables="samples"),
    "scene_representations": Read(lambda events, scope, proxies: ingest.list_proxies(proxies, scope.project), tables="proxies"),
    "scene_representation": Read(lambda events, scope, proxies: ingest.proxy(proxies, scope.project, scope.scene), "scene", needs="scene", tables="proxies"),
    "pointer_heatmap": Read(spatial.pointer_heatmap, "scene source session camera_mode", _BINS),
    "world_heatmap": Read(spatial.world_heatmap, _PLACED, _VOXELS, cell_default=0.5),
    "world_heatmap_totals": Read(spatial.world_heatmap_totals, _PLACED, {"cell_size": CELL}, cell_default=0.5),
    "gaze_heatmap": Read(spatial.gaze_heatmap, "scene session region camera_mode", _VOXELS, cell_default=0.5),
    "gaze_heatmap_totals": Read(spatial.gaze_heatmap_totals, "scene session region camera_mode", {"cell_size": CELL}, cell_default=0.5),
    "camera_heatmap": Read(spatial.view_direction_heatmap, "scene session camera_mode", _BINS),
    "floor_plan": Read(spatial.floor_plan, "scene session region camera_mode", {"cell_size": CELL, "limit": Bound(10_000)}, cell_default=1.0),
    "session_trajectory": Read(spatial.session_trajectory, "session", {"limit": Bound(10_000)}),
    "trajectories": Read(spatial.trajectories, "scene camera_mode", {"cell_size": CELL, "limit": Bound(50_000)}),
    "scene_coverage": Read(spatial.scene_coverage, "scene session", {"cell_size": CELL, "limit": Bound(10_000)}, cell_default=1.0),
    "camera_distance": Read(_distance, "scene session", {**{f"center_{a}": Bound(least=-math.inf, whole=False) for a in "xyz"}, "bucket_size": CELL, "limit": LIMIT}),
    "click_rays": Read(correlate.click_rays, _HERE, _VOXELS, cell_default=0.5),
    "flow_links": Read(_flow, "scene session camera_mode", {**_BINS, "limit": LIMIT, "cell_size": CELL}, "group_by_origin origin_voxel"),
    "navigation_effort": Read(_navigation, "scene session", {"move_threshold": Bound(1000, whole=False, closed=True), "limit": LIMIT}),
    "rotation_rate": Read(correlate.rotation_rate, "scene session", {"rapid_turn": Bound(math.pi, whole=False), "limit": LIMIT}),
    "top_meshes": Read(meshes.top_meshes, _HERE, {"limit": LIMIT}),
    "meshes_by_source": Read(meshes.meshes_by_source, _HERE, {"limit": LIMIT}),
    "mesh_trend": Read(meshes.mesh_trend, _HERE, {"interval": SECONDS, "limit": LIMIT}),
    "mesh_dwell": Read(meshes.mesh_dwell, _HERE, {"limit": LIMIT}),
    "interaction_kinds": Read(meshes.interaction_kinds, _HERE, {"limit": LIMIT}),
    "dead_clicks": Read(meshes.dead_clicks, _HERE),
    "rage_clicks": Read(meshes.rage_clicks, _HERE, {"interval": Bound(60), "min_repeats": Bound(100, 2, closed=True), "limit": LIMIT}),
    "hover_dwell": Read(meshes.hover_dwell, _HERE, {"limit": LIMIT}),
    "interactions_by_source": Read(meshes.interactions_by_source, _HERE, {"limit": LIMIT}),
    "top_input_actions": Read(meshes.top_input_actions, _HERE, {"limit": LIMIT}),
    "camera_gestures": Read(meshes.camera_gestures, _HERE, {"limit": LIMIT}),
    "compile_stalls": Read(meshes.compile_stalls, _HERE, {"limit": LIMIT}),
    "xr_source_usage": Read(meshes.xr_source_usage, _HERE, {"limit": LIMIT}),
    "xr_abandonment": Read(meshes.xr_abandonment, _HERE, {"limit": LIMIT}),
    "funnel": Read(_funnel, "scene camera_mode", texts="steps"),
    "perf_summary": Read(performance.perf_summary, "session"),
    "render_scale_truth": Read(performance.render_scale_truth, "session"),
    "perf_distribution": Read(performance.perf_distribution, "scene session"),
    "fps_histogram": Read(_histogram, "scene session", {"bucket": Bound(240)}),
    "frame_time_percentiles": Read(performance.frame_time_percentiles, "scene session"),
    "jank_rate": Read(performance.jank_rate, "scene session"),
    "perf_by_device": Read(performance.perf_by_device, "scene session"),
    "perf_by_scene": Read(performance.perf_by_scene, "scene session"),
    "resource_summary": Read(performance.resource_summary, "session"),
    "resource_percentiles": Read(performance.resource_percentiles, "scene session"),
    "stability_counts": Read(performance.stability_counts, "scene session"),
    "graphics_diagnostics": Read(performance.graphics_diagnostics, "scene session"),
    "rendering_technology": Read(performance.rendering_technology, "scene session"),
    "capability_changes": Read(performance.capability_changes, "scene session", {"limit": LIMIT}),
}


def read(events: DataFrame, name: str, project: str, proxies: DataFrame | None = None, samples: DataFrame | None = None, **options) -> DataFrame:
    """The answer to a named question. ValueError for an unknown name, option or value, or for one that is missing.

    A spatial question without a cell size takes it from its region, else from the bounds of the scene's proxy
    (one row of `proxies`, with a column bounds), else its default.
    """
    if name not in READS:
        raise ValueError(f"no read named {name}; there are {', '.join(sorted(READS))}")
    wanted = READS[name]
    if unknown := set(options) - wanted.options():
        raise ValueError(f"{name} takes no {', '.join(sorted(unknown))}")
    given = {k: v for k, v in options.items() if v is not None}
    for option, value in given.items():
        _check(option, value, wanted)
    if missing := set(wanted.needs.split()) - set(given):
        raise ValueError(f"{name} needs {', '.join(sorted(missing))}")
    if "proxies" in wanted.tables and proxies is None:
        raise ValueError(f"{name} needs the table of scene proxies")
    region = parse_region(given["region"]) if "region" in given else None
    own = {k: v for k, v in given.items() if k in wanted.numbers or k in wanted.texts.split()}
    if wanted.cell_default is not None and "cell_size" not in own:
        bounds = None
        if region is None and proxies is not None and given.get("scene"):
            row = ingest.proxy(proxies, project, given["scene"]).select("bounds").first()
            bounds = tuple(row["bounds"]) if row is not None and row["bounds"] else None
        own["cell_size"] = resolve_cell_size(None, region, bounds, wanted.cell_default)
    own |= {t: {"proxies": proxies, "samples": samples}[t] for t in wanted.tables.split()}
    texts = {k: given.get(k, "") for k in ("scene", "source", "session", "camera_mode")}
    return wanted.build(events, Scope(project, given.get("since"), given.get("until"), region=region, **texts), **own)


def _check(option: str, value, wanted: Read) -> None:
    if option in wanted.numbers:
        wanted.numbers[option].check(option, value)
    elif option in ("since", "until"):
        if not isinstance(value, datetime):
            raise ValueError(f"{option} must be a time, not {value!r}")
    elif option == "group_by_origin":
        if not isinstance(value, bool):
            raise ValueError(f"{option} must be true or false, not {value!r}")
    elif not isinstance(value, str):
        raise ValueError(f"{option} must be a text, not {value!r}")
    elif option in ("source", "camera_mode"):
        if value not in {"source": SOURCES, "camera_mode": MODES}[option]:
            raise ValueError(f"not a {option}: {value}")
    elif option in _PATTERNS and not re.fullmatch(_PATTERNS[option], value):
        raise ValueError(f"not a {option}: {value[:100]}")
