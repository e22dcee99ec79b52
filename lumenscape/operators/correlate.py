"""What the camera saw when something was clicked, and how it moved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lumenscape.functions import geometry as g
from lumenscape.functions.filters import Scope, check_options, in_scope
from lumenscape.operators.asof import asof_join, with_previous
from lumenscape.operators.volume import count, of_type, top


def _struct3(column: str, vector: str) -> tuple[Column, Column, Column]:
    return tuple(F.get(F.col(f"{column}.{vector}"), i) for i in range(3))  # type: ignore[return-value]


def click_rays(events: DataFrame, scope: Scope, cell_size: float = 0.5, limit: int | None = 500) -> DataFrame:
    """Where clicks came from and went: own ray, else the point on the near plane, else the camera; else dropped."""
    check_options(cell_size=cell_size)
    clicks = of_type(in_scope(events, scope, "RSXN"), "pointer_click").where(F.size("hit_point") == 3).select("session_id", "ts", "event_id", "hit_point", "mesh", "ray_origin", "screen")
    cameras = of_type(in_scope(events, scope, "RSN"), "camera_sample").where(F.size("position") == 3).select("session_id", "ts", "event_id", "position", "direction", "fov", "aspect", "near")
    joined = asof_join(clicks, cameras)
    position, direction = _struct3("found", "position"), _struct3("found", "direction")
    fov, aspect, near = F.col("found.fov"), F.col("found.aspect"), F.col("found.near")
    own = F.size("ray_origin") == 3
    plane = ~own & (F.size("screen") == 2) & g.can_unproject(direction, fov, aspect, near)
    point = g.unproject(position, direction, (g.at("screen", 0), g.at("screen", 1)), fov, aspect, near)
    origin = [F.when(own, g.at("ray_origin", i)).when(plane, point[i]).otherwise(position[i]) for i in range(3)]
    rows = joined.select("mesh", *[o.alias(f"o{a}") for o, a in zip(origin, "xyz")], *[h.alias(f"h{a}") for h, a in zip(g.xyz("hit_point"), "xyz")]).where("ox is not null")
    keys = [g.voxel(F.col(f"o{a}"), cell_size).alias(f"cam_v{a}") for a in "xyz"] + [g.voxel(F.col(f"h{a}"), cell_size).alias(f"hit_v{a}") for a in "xyz"]
    out = rows.groupBy(*keys, "mesh").agg(*[F.avg(f"o{a}").alias(f"origin_{a}") for a in "xyz"], *[F.avg(f"h{a}").alias(f"hit_{a}") for a in "xyz"], count().alias("count"))
    return top(out, limit, F.desc("count"), *[f"cam_v{a}" for a in "xyz"], *[f"hit_v{a}" for a in "xyz"], "mesh")


def _flow_rows(events: DataFrame, scope: Scope, bins: int, standing: bool) -> DataFrame:
    check_options(bins=bins)
    clicks = of_type(in_scope(events, scope, "RSNC"), "pointer_click").where("mesh <> ''").select("session_id", "ts", "event_id", "mesh", "ray_origin")
    cameras = of_type(in_scope(events, scope, "RSNC"), "camera_sample").where(F.size("direction") == 3).select("session_id", "ts", "event_id", "direction", "position")
    cameras = cameras.where(F.size("position") == 3) if standing else cameras
    x, y, z = _struct3("found", "direction")
    return asof_join(clicks, cameras, inner=True).withColumn("azimuth_bin", g.azimuth_bin(x, z, bins)).withColumn("elevation_bin", g.elevation_bin(x, y, z, bins))


FLOW = ["azimuth_bin", "elevation_bin", "mesh"]


def flow(events: DataFrame, scope: Scope, bins: int = 24, limit: int = 150) -> DataFrame:
    """View direction to clicked mesh."""
    return top(_flow_rows(events, scope, bins, False).groupBy(*FLOW).agg(count().alias("count")), limit, F.desc("count"), *FLOW)


def flow_by_standpoint(events: DataFrame, scope: Scope, bins: int = 24, cell_size: float = 0.5, limit: int | None = 150, origin_voxel: tuple[int, int, int] | None = None) -> DataFrame:
    """flow() by the voxel stood in; a click's own ray origin comes before the camera position."""
    check_options(cell_size=cell_size)
    rows = _flow_rows(events, scope, bins, True)
    origin = [F.when(F.size("ray_origin") == 3, g.at("ray_origin", i)).otherwise(F.get(F.col("found.position"), i)) for i in range(3)]
    rows = rows.select(*FLOW, *[o.alias(f"o{a}") for o, a in zip(origin, "xyz")])
    rows = rows.select("*", *[g.voxel(F.col(f"o{a}"), cell_size).alias(f"origin_v{a}") for a in "xyz"])
    voxel = [f"origin_v{a}" for a in "xyz"]
    for name, value in zip(voxel, origin_voxel or ()):
        rows = rows.where(F.col(name) == value)
    out = rows.groupBy(*FLOW[:2], *voxel, "mesh").agg(*[F.avg(f"o{a}").alias(f"origin_{a}") for a in "xyz"], count().alias("count"))
    return top(out, limit, F.desc("count"), *FLOW, *voxel)


def _samples(events: DataFrame, scope: Scope, vector: str) -> DataFrame:
    return of_type(in_scope(events, scope, "RSN"), "camera_sample").where(F.size(vector) == 3).select("session_id", "ts", "event_id", vector)


def navigation_effort(events: DataFrame, scope: Scope, threshold: float = 0.05, limit: int | None = 500) -> DataFrame:
    """Distance between successive camera samples, by session."""
    pairs = with_previous(_samples(events, scope, "position"), ["position"])
    dist = g.norm(*(a - b for a, b in zip(_struct3("cur", "position"), _struct3("prev", "position"))))
    rows = pairs.select("session_id", dist.alias("dist"))
    active = F.col("dist") >= threshold
    out = rows.groupBy("session_id").agg(count().alias("segments"), F.sum("dist").alias("total_distance"), F.count_if(active).alias("active_segments"), F.sum(F.when(active, F.col("dist")).otherwise(0.0)).alias("active_distance"))
    return top(out, limit, F.desc("total_distance"), "session_id")


def rotation_rate(events: DataFrame, scope: Scope, rapid_turn: float = 0.5, limit: int = 500) -> DataFrame:
    """Angle between successive view directions, by session; a zero direction makes no turn."""
    check_options(rapid_turn=rapid_turn)
    pairs = with_previous(_samples(events, scope, "direction"), ["direction"])
    a, b = _struct3("cur", "direction"), _struct3("prev", "direction")
    lengths = g.norm(*a) * g.norm(*b)
    cosine = sum(x * y for x, y in zip(a, b)) / lengths
    turn = F.when(lengths > 0, F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cosine)))).otherwise(0.0)
    rows = pairs.select("session_id", turn.alias("turn"))
    out = rows.groupBy("session_id").agg(count().alias("samples"), F.avg("turn").alias("avg_turn_rad"), F.max("turn").alias("max_turn_rad"), F.sum("turn").alias("total_turn_rad"), F.count_if(F.col("turn") >= rapid_turn).alias("rapid_segments"))
    return top(out, limit, F.desc("total_turn_rad"), "session_id")
