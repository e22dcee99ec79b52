"""Heatmaps, paths and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lumenscape.functions import geometry as g
from lumenscape.functions.filters import Scope, check_options, in_scope
from lumenscape.operators.volume import count, of_type, top

VOXEL = ["vx", "vy", "vz"]


def _voxels(rows: DataFrame, vector: str, cell_size: float) -> DataFrame:
    check_options(cell_size=cell_size)
    keys = [g.voxel(x, cell_size).alias(n) for x, n in zip(g.xyz(vector), VOXEL)]
    return rows.where(F.size(vector) == 3).groupBy(*keys).agg(count().alias("count"))


def _totals(voxels: DataFrame) -> DataFrame:
    return voxels.agg(count().alias("cells"), F.coalesce(F.sum("count"), F.lit(0).cast("long")).alias("hits"))


def _hits(events: DataFrame, scope: Scope) -> DataFrame:
    return of_type(in_scope(events, scope, "RSXBC"), "pointer_move", "pointer_click")


def _gaze(events: DataFrame, scope: Scope, use: str = "RSNBC", vector: str = "hit_point") -> DataFrame:
    return of_type(in_scope(events, scope, use, vector), "camera_sample")


def pointer_heatmap(events: DataFrame, scope: Scope, bins: int = 50) -> DataFrame:
    check_options(bins=bins)
    rows = of_type(in_scope(events, scope, "RSXNC"), "pointer_move", "pointer_click").where(F.size("screen") == 2)
    out = rows.groupBy(g.screen_cell(g.at("screen", 0), bins).alias("gx"), g.screen_cell(g.at("screen", 1), bins).alias("gy")).agg(count().alias("count"))
    return top(out, None, F.desc("count"), "gx", "gy")


def world_heatmap(events: DataFrame, scope: Scope, cell_size: float = 0.5, limit: int | None = 1000) -> DataFrame:
    return top(_voxels(_hits(events, scope), "hit_point", cell_size), limit, F.desc("count"), *VOXEL)


def world_heatmap_totals(events: DataFrame, scope: Scope, cell_size: float = 0.5) -> DataFrame:
    return _totals(_voxels(_hits(events, scope), "hit_point", cell_size))


def gaze_heatmap(events: DataFrame, scope: Scope, cell_size: float = 0.5, limit: int | None = 1000) -> DataFrame:
    return top(_voxels(_gaze(events, scope), "hit_point", cell_size), limit, F.desc("count"), *VOXEL)


def gaze_heatmap_totals(events: DataFrame, scope: Scope, cell_size: float = 0.5) -> DataFrame:
    return _totals(_voxels(_gaze(events, scope), "hit_point", cell_size))


def view_direction_heatmap(events: DataFrame, scope: Scope, bins: int = 36) -> DataFrame:
    check_options(bins=bins)
    x, y, z = g.xyz("direction")
    rows = _gaze(events, scope, "RSNC").where(F.size("direction") == 3)
    out = rows.groupBy(g.azimuth_bin(x, z, bins).alias("azimuth_bin"), g.elevation_bin(x, y, z, bins).alias("elevation_bin")).agg(count().alias("count"))
    return top(out, None, F.desc("count"), "azimuth_bin", "elevation_bin")


def floor_plan(events: DataFrame, scope: Scope, cell_size: float = 1.0, limit: int = 2000) -> DataFrame:
    check_options(cell_size=cell_size)
    x, y, z = g.xyz("position")
    rows = _gaze(events, scope, vector="position").where(F.size("position") == 3)
    out = rows.groupBy(g.voxel(x, cell_size).alias("gx"), g.voxel(z, cell_size).alias("gz")).agg(F.avg(y).alias("avg_y"), count().alias("count"))
    return top(out, limit, F.desc("count"), "gx", "gz")


def session_trajectory(events: DataFrame, scope: Scope, limit: int = 5000) -> DataFrame:
    if not scope.session:
        raise ValueError("a trajectory needs a session")
    x, y, z = g.xyz("position")
    rows = _gaze(events, scope, "RSN").where(F.size("position") == 3)
    return top(rows.select(g.epoch_ms(F.col("ts")).alias("ts"), x.alias("x"), y.alias("y"), z.alias("z")), limit, "ts", "x", "y", "z")


def trajectories(events: DataFrame, scope: Scope, cell_size: float = 1.0, limit: int | None = 20_000) -> DataFrame:
    check_options(cell_size=cell_size)
    x, _, z = g.xyz("position")
    rows = _gaze(events, scope, "RSC").where(F.size("position") == 3)
    return top(rows.select("session_id", g.epoch_ms(F.col("ts")).alias("ts"), g.voxel(x, cell_size).alias("gx"), g.voxel(z, cell_size).alias("gz")), limit, "session_id", "ts", "gx", "gz")


def scene_coverage(events: DataFrame, scope: Scope, cell_size: float = 1.0, limit: int | None = 5000) -> DataFrame:
    return top(_voxels(_gaze(events, scope, "RSN"), "position", cell_size), limit, F.desc("count"), *VOXEL)


def camera_distance(events: DataFrame, scope: Scope, centre: tuple[float, float, float] = (0.0, 0.0, 0.0), bucket_size: float = 1.0, limit: int = 1000) -> DataFrame:
    x, y, z = (v - c for v, c in zip(g.xyz("position"), centre))
    rows = _gaze(events, scope, "RSN").where(F.size("position") == 3)
    return top(rows.groupBy(g.voxel(g.norm(x, y, z), bucket_size).alias("bucket")).agg(count().alias("count")), limit, "bucket")
