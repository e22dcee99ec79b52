"""Registered reads by name with their defaults: each answers as the question that it names, and is checked with its SQL."""

from __future__ import annotations

from lumenscape.plans.analytics import ANALYTICS, Query
from lumenscape.plans.reads import READS, read
from lumenscape.plans.scene_view import PROJECT

#: Reads whose question has another name.
_OTHER = {"list_scenes": "distinct_scenes", "event_counts": "event_type_counts", "camera_heatmap": "view_direction_heatmap", "flow_links": "flow"}
#: Reads that need options, or whose question is registered with others than the defaults.
_APART = {"session_meta", "session_events", "scene_representations", "scene_representation", "session_trajectory", "trajectories", "rage_clicks", "render_scale_truth", "funnel"}


def _read(name: str, question: Query) -> Query:
    return Query(lambda e: read(e, name, PROJECT), question.sql, question.doubles, question.times)


READ_QUERIES: dict[str, Query] = {f"read_{name}": _read(name, ANALYTICS[_OTHER.get(name, name)]) for name in READS if name not in _APART}
