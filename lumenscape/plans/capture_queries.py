"""Registered queries of the capture-side reductions and of frame conversions, on tables made from the scene events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lumenscape.functions import geometry as g
from lumenscape.operators import capture, derived, spatial
from lumenscape.plans.analytics import _HITS_ALL, _MS, _PERF, ALL, N, Query
from lumenscape.streaming import jobs

_POSE = ["position", "direction", "target", "fov", "aspect", "near"]


def _vector(*items) -> Column:
    return F.array(*[F.lit(x).cast("double") if isinstance(x, (int, float)) else x.cast("double") for x in items])


def kept_sql(source: str, keys: str, columns: str, unchanged: str) -> str:
    """Rows of source that differ from the last one kept of their key: `unchanged` compares a row o with the kept values of r."""
    names = columns.split(", ")
    kept = ", ".join(f"k_{n}" for n in names)
    take = ", ".join(f"CASE WHEN {unchanged} THEN r.k_{n} ELSE o.{n} END" for n in names)
    return f"""
WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY ts, event_id) AS rn FROM ({source})),
r AS (
  SELECT {keys}, rn, event_id, true AS keep, {", ".join(f"{n} AS k_{n}" for n in names)} FROM o WHERE rn = 1
  UNION ALL
  SELECT {", ".join(f"o.{k.strip()}" for k in keys.split(","))}, o.rn, o.event_id, NOT ({unchanged}), {take}
  FROM r JOIN o ON {" AND ".join(f"o.{k.strip()} = r.{k.strip()}" for k in keys.split(","))} AND o.rn = r.rn + 1)
SELECT session_id, event_id FROM r WHERE keep"""


def _near(vector: str, n: int, eps: float) -> str:
    return " AND ".join(f"abs(o.{vector}[{i}] - r.k_{vector}[{i}]) <= {eps}" for i in range(1, n + 1))


_CAMERA = "FROM e WHERE event_type = 'camera_sample'"
_BOUNDED = "SELECT session_id, mesh, ts, event_id, floor(visible_ms / 300) AS side FROM e WHERE event_type = 'mesh_visibility' AND mesh <> ''"


def cameras(e: DataFrame) -> DataFrame:
    return e.where("event_type = 'camera_sample'")


def nodes(e: DataFrame) -> DataFrame:
    """Poses of one node a session, every second one of a bone."""
    bone = F.when(F.col("event_id") % 2 == 0, "spine").otherwise("")
    fixed = {"node_id": F.lit("n"), "bone_id": bone, "child_path": F.lit(""), "rotation": _vector(0, 0, 0, 1), "scale": F.lit(None).cast("array<double>")}
    return cameras(e).withColumns(fixed).select("session_id", "ts", "event_id", *fixed, "position")


def bounds(e: DataFrame) -> DataFrame:
    side = F.floor(F.col("visible_ms") / 300)
    return e.where("event_type = 'mesh_visibility' and mesh <> ''").select("session_id", "mesh", "ts", "event_id", _vector(0, 0, 0, side, 1, 1).alias("bounds"))


def matrices(e: DataFrame) -> DataFrame:
    """Column-major matrices of camera positions, turned about y and stretched; each eleventh is mirrored."""
    angle = (F.col("event_id") % 7) * 0.3
    c, s = F.cos(angle), F.sin(angle)
    x = F.when(F.col("event_id") % 11 == 0, -1.0).otherwise(1.0) * (F.col("event_id") % 3 + 1)
    y = (F.col("event_id") % 2 + 1).cast("double")
    m = _vector(x * c, 0, -x * s, 0, 0, y, 0, 0, s, 0, c, 0, *[F.get("position", i) for i in range(3)], 1)
    return cameras(e).select("event_id", m.alias("matrix"))


def decomposed(e: DataFrame) -> DataFrame:
    out = capture.decompose(matrices(e))
    part = lambda c, i, n: F.coalesce(F.get(c, i), F.lit(0.0)).alias(n)
    return out.select("event_id", part("position", 2, "z"), part("rotation", 1, "qy"), part("rotation", 3, "qw"), part("scale", 0, "sx"), part("scale", 1, "sy"))


def ticks(e: DataFrame) -> DataFrame:
    """Frames in which a mesh is in view: what a camera sample hits, seen for a tenth of a second."""
    rows = cameras(e).where("size(hit_point) = 3 and mesh <> ''")
    return rows.select("session_id", "ts", "mesh", F.lit(100.0).alias("step_ms"), F.col("position").alias("cam_pos"), F.col("direction").alias("forward"), "fov", F.col("hit_point").alias("center"), F.lit(1.5).alias("radius"))


def brackets(e: DataFrame) -> DataFrame:
    """Start and end poses about a pivot: some turn, some near it, some shift it, by the number of the event."""
    number, none = F.col("event_id"), F.lit(None).cast("array<double>")
    turned = F.when(number % 3 == 0, F.array(*[F.get("direction", i) for i in (2, 1, 0)])).otherwise(F.col("direction"))
    start = {"s_position": F.col("position"), "s_forward": F.col("direction"), "s_up": none, "s_pivot": _vector(0, 0, 0), "s_fov": F.lit(None).cast("double"), "s_distance": F.lit(5.0)}
    shifted = _vector((number % 5) * 0.01, 0, 0)
    end = {"e_position": F.col("position"), "e_forward": turned, "e_up": none, "e_pivot": shifted, "e_fov": F.lit(None).cast("double"), "e_distance": F.lit(5.0) * (1 + (number % 4) * 0.01)}
    return cameras(e).select("event_id", *[c.alias(n) for n, c in (start | end).items()])


def rigid_samples(e: DataFrame) -> DataFrame:
    """Poses of a moved node; at each fourth its arm was captured too."""
    scale = (F.col("event_id") % 3 + 1).cast("double")
    root = cameras(e).select("session_id", "ts", "event_id", F.lit("root").alias("node_id"), F.lit("").alias("child_path"), "position", _vector(0, 0, 0, 1).alias("rotation"), F.array(scale, scale, scale).alias("scale"))
    arm = root.where("event_id % 4 = 0").withColumn("child_path", F.lit("arm"))
    return root.union(arm).withColumn("ts", F.timestamp_millis("event_id")).drop("event_id")


#: Where the parts of the moved node were when the scene was scanned.
_SCANNED = [("root", 1.0, 0.0, 0.0), ("root/arm", 1.0, 2.0, 0.0), ("root/arm/hand", 1.0, 2.0, 5.0), ("rooted", 9.0, 9.0, 9.0)]


def rigid_children(e: DataFrame) -> DataFrame:
    still, double = [0.0, 0.0, 0.0, 1.0], [2.0, 2.0, 2.0]
    meshes = e.sparkSession.createDataFrame([(p, [x, y, z], still, double) for p, x, y, z in _SCANNED], "path string, position array<double>, rotation array<double>, scale array<double>")
    out = capture.reconstruct_children(rigid_samples(e), meshes)
    return out.select("session_id", F.unix_millis("ts").alias("event_id"), "path", *[F.get("matrix", i).alias(n) for i, n in ((3, "x"), (7, "y"), (11, "z"), (0, "stretch"))])


def ramp_sql(t: str, stops: list, channel: int) -> str:
    """Piecewise linear colour of t."""
    out = f"CAST({stops[-1][1][channel]} AS DOUBLE)"
    for (t0, a), (t1, b) in reversed(list(zip(stops, stops[1:]))):
        out = f"CASE WHEN {t} <= CAST({t1} AS DOUBLE) THEN ({t} - {t0}) / CAST({t1 - t0!r} AS DOUBLE) * ({b[channel]} - {a[channel]}) + {a[channel]} ELSE {out} END"
    return out


def coloured(e: DataFrame) -> DataFrame:
    """Heat in both ramps."""
    voxels = spatial.world_heatmap(e, ALL, limit=None)
    thermal = derived.heatmap_instances(voxels, 0.5).select("vx", "vy", "vz", "r", "g", "b")
    warm = derived.heatmap_instances(voxels, 0.5, stops=derived.WARM).select("vx", "vy", "vz", *[F.col(c).alias(f"warm_{c}") for c in "rgb"])
    return thermal.join(warm, ["vx", "vy", "vz"])


def left_handed(e: DataFrame) -> DataFrame:
    flat = cameras(e).where("size(hit_point) = 3")
    position = g.to_left_handed(F.col("position"))
    box = g.box_to_left_handed(F.concat("position", "hit_point"))
    turn = g.quaternion_to_left_handed(F.concat("direction", F.array(F.lit(1.0))))
    return flat.select("event_id", F.get(position, 0).alias("x"), F.get(position, 2).alias("z"), F.get(box, 2).alias("z0"), F.get(box, 5).alias("z1"), *[F.get(turn, i).alias(f"q{i}") for i in range(4)])


_MODES = ["gaze", "transient-pointer", "screen", "tracked-pointer"]


def xr_inputs(e: DataFrame) -> DataFrame:
    number = F.col("event_id")
    mode = F.get(F.array(*[F.lit(m) for m in _MODES]), (number % 5).cast("int"))  # every fifth has none
    side = F.get(F.array(*[F.lit(s) for s in ("left", "right", "none")]), (number % 3).cast("int"))
    rows = e.select(g.xr_source(mode, number % 7 == 0).alias("source"), g.xr_handedness(side).alias("handedness"))
    return rows.groupBy("source", "handedness").agg(F.count(F.lit(1)).alias("count"))


_TURN = "degrees(acos(least(1, greatest(-1, (d[1] * d[3] * 2 + d[2] * d[2]) / (d[1] * d[1] + d[2] * d[2] + d[3] * d[3])))))"

CAPTURE: dict[str, Query] = {
    "frame_windows": Query(
        lambda e: capture.frame_windows(e.where("event_type = 'frame_perf'").select("session_id", F.lit(0).alias("window"), F.col("frame_time_ms").alias("frame_ms")), 30.0).drop("window"),
        f"""
        SELECT session_id, quantile_disc(frame_time_ms, 0.95) AS frame_time_p95_ms, quantile_disc(frame_time_ms, 0.99) AS frame_time_p99_ms,
          CAST(count(*) FILTER (frame_time_ms > 30) AS BIGINT) AS long_frames
        {_PERF} GROUP BY session_id""",
        "frame_time_p95_ms frame_time_p99_ms",
    ),
    "suppress_idle_fps": Query(
        lambda e: capture.suppress_idle_fps(e.where("event_type = 'frame_perf'").select("session_id", "ts", "event_id", "fps"), 5.0).select("session_id", "event_id"),
        kept_sql(f"SELECT session_id, ts, event_id, fps {_PERF}", "session_id", "fps", "abs(o.fps - r.k_fps) <= 5"),
    ),
    "suppress_idle_camera": Query(
        lambda e: capture.suppress_idle_camera(cameras(e).withColumn("target", F.lit(None).cast("array<double>")).select("session_id", "ts", "event_id", *_POSE), 8.0).select("session_id", "event_id"),
        kept_sql(f"SELECT session_id, ts, event_id, position, direction, fov {_CAMERA}", "session_id", "position, direction, fov", f"{_near('position', 3, 8)} AND {_near('direction', 3, 8)} AND abs(o.fov - r.k_fov) <= 8"),
    ),
    "suppress_idle_nodes": Query(
        lambda e: capture.suppress_idle_nodes(nodes(e), 8.0).select("session_id", "event_id"),
        kept_sql(f"SELECT session_id, ts, event_id, event_id % 2 AS channel, position {_CAMERA}", "session_id, channel", "position", _near("position", 3, 8)),
    ),
    "changed_bounds": Query(
        lambda e: capture.changed_bounds(bounds(e)).select("session_id", "event_id"),
        kept_sql(_BOUNDED, "session_id, mesh", "side", "abs(o.side - r.k_side) <= 0.001"),
    ),
    "thin": Query(
        lambda e: capture.thin(e.where("event_type = 'pointer_move'").select("session_id", "ts", "event_id"), 86_400_000, ["session_id"]).select("session_id", "event_id"),
        kept_sql("SELECT session_id, ts, event_id, epoch_us(ts) AS stamp FROM e WHERE event_type = 'pointer_move'", "session_id", "stamp", "o.stamp - r.k_stamp < 86400000000"),
    ),
    "thin_by_grid": Query(
        lambda e: capture.thin_by_grid(e.where("event_type = 'pointer_move'"), 86_400_000, ["session_id"]).select("session_id", "event_id"),
        f"""
        SELECT session_id, event_id FROM e WHERE event_type = 'pointer_move'
        QUALIFY row_number() OVER (PARTITION BY session_id, floor({_MS} / 86400000e0) ORDER BY ts) = 1""",
    ),
    "decomposed_matrices": Query(
        decomposed,
        f"""
        SELECT event_id, position[3] AS z, sin(a / 2) AS qy, cos(a / 2) AS qw, CASE WHEN x = 1 AND y = 1 THEN 0 ELSE x END AS sx, CASE WHEN x = 1 AND y = 1 THEN 0 ELSE y END AS sy
        FROM (SELECT *, (event_id % 7) * 0.3e0 AS a, CASE WHEN event_id % 11 = 0 THEN -1 ELSE 1 END * (event_id % 3 + 1) AS x, event_id % 2 + 1 AS y {_CAMERA})""",
        "z qy qw sx sy",
    ),
    "mesh_visibility": Query(
        lambda e: capture.mesh_visibility(ticks(e), 0.5),
        f"""
        SELECT session_id, mesh, make_timestamp(w * 5000000) AS ts, CAST(floor(sum(100e0) + 0.5e0) AS BIGINT) AS visible_ms,
          CAST(floor(sum(CASE WHEN cosine >= 0.5e0 THEN 100e0 ELSE 0e0 END) + 0.5e0) AS BIGINT) AS centered_ms,
          floor(max(least(1, atan2(1.5e0, dist) / half)) * 1e4 + 0.5e0) / 1e4 AS max_screen_fraction
        FROM (SELECT session_id, mesh, epoch_us(ts) // 5000000 AS w, dist, (tx * direction[1] + ty * direction[2] + tz * direction[3]) / (dist * len3) AS cosine, half
              FROM (SELECT *, sqrt(tx * tx + ty * ty + tz * tz) AS dist, CASE WHEN fov = 0 THEN 0.4e0 ELSE fov / 2 END AS half,
                      sqrt(direction[1] * direction[1] + direction[2] * direction[2] + direction[3] * direction[3]) AS len3
                    FROM (SELECT *, hit_point[1] - position[1] AS tx, hit_point[2] - position[2] AS ty, hit_point[3] - position[3] AS tz
                          {_CAMERA} AND len(hit_point) = 3 AND mesh <> '')))
        GROUP BY ALL""",
        "max_screen_fraction",
        "ts",
    ),
    "gesture_kinds": Query(
        lambda e: capture.classify_gestures(brackets(e)).select("event_id", F.coalesce("kind", F.lit("none")).alias("kind"), F.coalesce(F.nanvl("orbit_deg", F.lit(None)), F.lit(0.0)).alias("orbit_deg")),
        f"""
        SELECT event_id, CASE WHEN greatest(orbit, zoom, pan) <= 1 THEN 'none' WHEN orbit >= zoom AND orbit >= pan THEN 'orbit' WHEN zoom >= pan THEN 'dolly' ELSE 'pan' END AS kind,
          CASE WHEN orbit > 1 THEN orbit ELSE 0 END AS orbit_deg
        FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN {_TURN} ELSE 0 END AS orbit, abs(1 / (1 + (event_id % 4) * 0.01e0) - 1) / 0.02e0 AS zoom,
                (event_id % 5) * 0.01e0 * sqrt(1 - d[1] * d[1] / (d[1] * d[1] + d[2] * d[2] + d[3] * d[3])) / 5 / 0.005e0 AS pan
              FROM (SELECT event_id, direction AS d {_CAMERA}))""",
        "orbit_deg",
    ),
    "hover_episodes": Query(
        lambda e: capture.hover_episodes(e.select("session_id", "ts", F.nullif("mesh", F.lit("")).alias("mesh")), 3_600_000.0).select("session_id", "mesh", "dwell_ms"),
        f"""
        SELECT session_id, mesh, CAST(max(until) - min(ms) AS DOUBLE) AS dwell_ms
        FROM (SELECT *, sum(CASE WHEN before IS NOT DISTINCT FROM mesh THEN 0 ELSE 1 END) OVER w AS turn, coalesce(lead(ms) OVER w, ms) AS until
              FROM (SELECT session_id, ts, {_MS} AS ms, nullif(mesh, '') AS mesh, lag(nullif(mesh, '')) OVER (PARTITION BY session_id ORDER BY ts) AS before FROM e)
              WINDOW w AS (PARTITION BY session_id ORDER BY ts))
        GROUP BY session_id, turn, mesh
        HAVING mesh IS NOT NULL AND max(until) - min(ms) >= 3600000""",
        "dwell_ms",
    ),
    "limited_errors": Query(
        lambda e: capture.limit_errors(e.select("session_id", "ts", "event_id", F.col("event_type").alias("message"), F.col("mesh").alias("stack")), 10).select("session_id", "event_id"),
        """
        SELECT session_id, event_id
        FROM (SELECT *, lag(event_type || ':' || mesh) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS before FROM e)
        WHERE before IS NULL OR before <> event_type || ':' || mesh
        QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) <= 10""",
    ),
    "rolled_up_diagnostics": Query(
        lambda e: capture.roll_up_diagnostics(e.select(F.col("scene_id").alias("session_id"), "ts", F.col("event_type").alias("severity"), F.col("source").alias("category"), F.lit("").alias("backend"), F.lit("").alias("code"), "payload"), 3600).select("session_id", "severity", "category", "ts", "count"),
        f"""
        SELECT scene_id AS session_id, event_type AS severity, source AS category, min(ts) AS ts, {N} AS count
        FROM e GROUP BY scene_id, event_type, source, epoch_us(ts) // 3600000000""",
        times="ts",
    ),
    "rigid_children": Query(
        rigid_children,
        f"""
        SELECT session_id, event_id, path, position[1] + s / 2 * (x - 1) AS x, position[2] + s / 2 * y AS y, position[3] + s / 2 * z AS z, s AS stretch
        FROM (SELECT *, event_id % 3 + 1e0 AS s {_CAMERA}), (VALUES ('root/arm', 1, 2, 0), ('root/arm/hand', 1, 2, 5)) m(path, x, y, z)
        WHERE NOT (event_id % 4 = 0 AND path = 'root/arm')""",
        "x y z stretch",
    ),
    "heat_colours": Query(
        coloured,
        f"""
        SELECT vx, vy, vz, {", ".join(f"{ramp_sql('t', derived.THERMAL, i)} AS {c}, {ramp_sql('t', derived.WARM, i)} AS warm_{c}" for i, c in enumerate("rgb"))}
        FROM (SELECT *, count / (SELECT max(count) FROM ({_HITS_ALL})) AS t FROM ({_HITS_ALL}))
        ORDER BY count DESC, vx, vy, vz LIMIT 2000""",
        "r g b warm_r warm_g warm_b",
    ),
    "left_handed": Query(
        left_handed,
        f"""
        SELECT event_id, position[1] AS x, -position[3] AS z, -hit_point[3] AS z0, -position[3] AS z1, -direction[1] AS q0, -direction[2] AS q1, direction[3] AS q2, 1e0 AS q3
        {_CAMERA} AND len(hit_point) = 3""",
        "x z z0 z1 q0 q1 q2 q3",
    ),
    "xr_inputs": Query(
        xr_inputs,
        f"""
        SELECT CASE WHEN event_id % 7 = 0 THEN 'hand' WHEN event_id % 5 = 0 THEN 'gaze' WHEN event_id % 5 IN (1, 2) THEN 'transient' ELSE 'xr-controller' END AS source,
          CASE event_id % 3 WHEN 0 THEN 'left' WHEN 1 THEN 'right' END AS handedness, {N} AS count
        FROM e GROUP BY ALL""",
    ),
    "activity_levels": Query(
        lambda e: e.groupBy(jobs.activity((F.col("event_id") % 40) * 500).alias("activity")).agg(F.count(F.lit(1)).alias("count")),
        f"SELECT CASE WHEN event_id % 40 <= 6 THEN 'active' WHEN event_id % 40 <= 30 THEN 'recent' ELSE 'idle' END AS activity, {N} AS count FROM e GROUP BY ALL",
    ),
}
