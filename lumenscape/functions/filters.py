"""Scopes: which events a question looks at."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, replace
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from lumenscape.functions.geometry import at, json_text
from lumenscape.schema import CAMERA_ALIASES

Box = tuple[float, float, float, float, float, float]

# Bounds of the options.
MAXIMA = {"bins": 500, "limit": 50_000, "cell_size": 1000.0, "interval": 366 * 86_400, "rapid_turn": math.pi}


@dataclass(frozen=True)
class Scope:
    """since is inclusive, until exclusive; an empty text is no filter."""

    project: str
    since: datetime | None = None
    until: datetime | None = None
    scene: str = ""
    source: str = ""
    session: str = ""
    region: Box | None = None
    camera_mode: str = ""

    def __post_init__(self):
        if not self.project:
            raise ValueError("a project is needed")
        if self.scene and not re.fullmatch(r"[A-Za-z0-9._:-]{1,64}", self.scene):
            raise ValueError(f"not a scene id: {self.scene}")
        if self.since and self.until and self.until < self.since:
            raise ValueError("until lies before since")
        object.__setattr__(self, "camera_mode", CAMERA_ALIASES.get(self.camera_mode, self.camera_mode))

    def but(self, **changes) -> Scope:
        return replace(self, **changes)


def check_options(**options) -> None:
    """Raise ValueError for an option that is not positive or over its maximum."""
    for name, value in options.items():
        most = MAXIMA.get(name, math.inf)
        if not isinstance(value, (int, float)) or not math.isfinite(value) or not 0 < value <= most:
            raise ValueError(f"{name} must be above 0 and at most {most}, not {value}")


def parse_region(text: str) -> Box:
    """'minx,miny,minz,maxx,maxy,maxz' of finite numbers."""
    try:
        values = tuple(float(x) for x in text.split(","))
    except ValueError:
        raise ValueError(f"not numbers: {text}") from None
    if len(values) != 6 or not all(map(math.isfinite, values)) or any(values[i] > values[i + 3] for i in range(3)):
        raise ValueError(f"not a box: {text}")
    return values  # type: ignore[return-value]


def scope_conditions(scope: Scope, use: str) -> list[Column]:
    """What Range, Scene, X source and session N, where `use` names them, ask of a row."""
    out = [F.col("ts") >= F.lit(scope.since)] if "R" in use and scope.since is not None else []
    out += [F.col("ts") < F.lit(scope.until)] if "R" in use and scope.until is not None else []
    texts = (("S", "scene_id", scope.scene), ("X", "source", scope.source), ("N", "session_id", scope.session))
    return out + [F.col(column) == value for part, column, value in texts if part in use and value]


def in_scope(events: DataFrame, scope: Scope, use: str = "RSXNBC", vector: str = "hit_point") -> DataFrame:
    """Events within the parts of a scope named by `use`: Range, Scene, X source, session N, Box of `vector`, Camera mode.

    Equality and range predicates reach the scan; a table partitioned by event_date is pruned as well.
    """
    out = events.where(F.col("project_id") == scope.project)
    if "R" in use:
        dated = "event_date" in events.columns
        if scope.since is not None:
            out = out.where(F.col("ts") >= F.lit(scope.since))
            out = out.where(F.col("event_date") >= F.lit(scope.since.date())) if dated else out
        if scope.until is not None:
            out = out.where(F.col("ts") < F.lit(scope.until))
            out = out.where(F.col("event_date") <= F.lit(scope.until.date())) if dated else out
    for condition in scope_conditions(scope, use.replace("R", "")):
        out = out.where(condition)
    if "B" in use and scope.region:
        for i in range(3):
            out = out.where(at(vector, i).between(float(scope.region[i]), float(scope.region[i + 3])))
    if "C" in use and scope.camera_mode:
        out = out.join(camera_mode_sessions(events, scope), "session_id", "left_semi")
    return out


def camera_mode_sessions(events: DataFrame, scope: Scope) -> DataFrame:
    """Sessions of the project that started in the camera mode; by design not bounded by range or scene."""
    starts = events.where((F.col("project_id") == scope.project) & (F.col("event_type") == "session_start"))
    return starts.where(json_text("payload", "scene", "cameraType") == scope.camera_mode).select("session_id").distinct()


def whole_days(rollup: DataFrame, scope: Scope) -> DataFrame:
    """Rows of a daily rollup: days from since's, before until's."""
    out = rollup.where(F.col("project_id") == scope.project)
    if scope.since is not None:
        out = out.where(F.col("day") >= F.lit(scope.since.date()))
    return out.where(F.col("day") < F.lit(scope.until.date())) if scope.until is not None else out


def cell_size_for(bounds: Box | None, cells: int = 64) -> float | None:
    """A cell size that puts `cells` on the longest axis; None for no or degenerate bounds."""
    if bounds is None or cells <= 0:
        return None
    longest = max(bounds[i + 3] - bounds[i] for i in range(3))
    return longest / cells if math.isfinite(longest) and longest > 0 else None


def resolve_cell_size(explicit: float | None, region: Box | None, bounds: Box | None, default: float) -> float:
    """Explicit, else from the region, else from the scene's registered bounds, else the default."""
    return explicit or cell_size_for(region) or cell_size_for(bounds) or default


def preset_range(preset: str, now: datetime, since: datetime | None = None, until: datetime | None = None) -> tuple[datetime | None, datetime | None]:
    """1h, 24h, 7d, all, or custom: the bounds given."""
    spans = {"1h": timedelta(hours=1), "24h": timedelta(hours=24), "7d": timedelta(days=7)}
    if preset == "all":
        return None, None
    return (since, until) if preset == "custom" else (now - spans[preset], now)


def bucket_seconds(span_seconds: float, buckets: int = 80) -> int:
    """Bucket length for about `buckets` buckets, in whole seconds, snapped up to a usual step."""
    steps = (60, 300, 900, 1800, 3600, 10_800, 21_600, 43_200, 86_400, 604_800)
    wanted = math.floor(span_seconds / buckets + 0.5)
    return next((s for s in steps if s >= wanted), steps[-1])
