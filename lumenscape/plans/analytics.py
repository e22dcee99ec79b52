"""Query catalogue of the scene analytics: name -> Spark query, and the DuckDB text it is checked with."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lumenscape.functions.filters import Scope
from lumenscape.functions.geometry import epoch_ms
from lumenscape.operators import capture, correlate, derived, meshes, performance, spatial, volume
from lumenscape.operators.meshes import Step
from lumenscape.sources import ingest
from lumenscape.streaming import jobs
from lumenscape.plans.scene_view import PROJECT, scene_events, scene_sql
from lumenscape.schema import MAX_BATCH

ALL = Scope(PROJECT)
#: Half of the month, one scene.
PART = Scope(PROJECT, datetime(2024, 1, 5), datetime(2024, 1, 20), "lobby")
BOX = (-5.0, -5.0, -5.0, 5.0, 5.0, 5.0)
WIDE = (-9.0, -9.0, -9.0, 9.0, 9.0, 9.0)
STEPS = [Step("session_start"), Step("camera_sample"), Step("pointer_click"), Step("mesh_interaction", name="pick")]


@dataclass(frozen=True)
class Query:
    """run(events) -> DataFrame; sql over the view e; doubles are rounded and times made milliseconds on both sides."""

    run: Callable[[DataFrame], DataFrame]
    sql: str | None
    doubles: str = ""
    times: str = ""

    def spark(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        out = self.run(scene_events(spark, sf_dir))
        changed = {c: F.round(F.col(c).cast("double"), 6) for c in self.doubles.split()} | {c: epoch_ms(F.col(c)) for c in self.times.split()}
        return out.withColumns(changed) if changed else out

    def duckdb(self) -> str:
        changed = [f"round(CAST({c} AS DOUBLE), 6) + 0e0 AS {c}" for c in self.doubles.split()] + [f"(epoch_us({c}) // 1000) AS {c}" for c in self.times.split()]
        replace = f" REPLACE ({', '.join(changed)})" if changed else ""
        return f"WITH e AS ({scene_sql(spark=False)}) SELECT *{replace} FROM ({self.sql})"


def _v(vector: str, names: str = "vx vy vz", size: str = "0.5e0", axes: tuple[int, ...] = (1, 2, 3)) -> str:
    return ", ".join(f"CAST(floor({vector}[{i}] / {size}) AS BIGINT) AS {n}" for i, n in zip(axes, names.split()))


N = "CAST(count(*) AS BIGINT)"
_MS = "(epoch_us(ts) // 1000)"
_HITS = f"SELECT {_v('hit_point')}, {N} AS count FROM e WHERE event_type IN ('pointer_move', 'pointer_click') AND len(hit_point) = 3"
_GAZE = f"SELECT {_v('hit_point')}, {N} AS count FROM e WHERE event_type = 'camera_sample' AND len(hit_point) = 3"
_HITS_ALL, _GAZE_ALL = f"{_HITS} GROUP BY ALL", f"{_GAZE} GROUP BY ALL"
_TOP = " GROUP BY ALL ORDER BY count DESC, vx, vy, vz LIMIT 1000"
_PART = " AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' AND scene_id = 'lobby'"
_BOX = " AND hit_point[1] BETWEEN -5 AND 5 AND hit_point[2] BETWEEN -5 AND 5 AND hit_point[3] BETWEEN -5 AND 5"
_WIDE = " AND hit_point[1] BETWEEN -9 AND 9 AND hit_point[2] BETWEEN -9 AND 9 AND hit_point[3] BETWEEN -9 AND 9"
_FREE = """
 AND session_id IN (SELECT session_id
  FROM e
  WHERE event_type = 'session_start' AND json_extract_string(payload, '$.scene.cameraType') = 'free')"""
_BUCKET = lambda s: f"CAST(floor((epoch_us(ts) // 1000) / ({s} * 1000e0)) AS BIGINT) * {s * 1000} AS bucket"
_ACTIVE = "FROM e WHERE event_type IN ('mesh_interaction', 'pointer_click') AND mesh <> ''"
_PERF = "FROM e WHERE event_type = 'frame_perf'"
_JSON = lambda *p: f"json_extract_string(payload, '$.{'.'.join(p)}')"


def _bins(x: str, y: str, z: str, bins: int) -> str:
    norm = f"greatest(sqrt({x} * {x} + {y} * {y} + {z} * {z}), 1e-6)"
    return f"CAST(floor((atan2({z}, {x}) + pi()) / (2 * pi()) * {bins}) AS BIGINT) AS azimuth_bin, CAST(floor((asin({y} / {norm}) + pi() / 2) / pi() * {bins}) AS BIGINT) AS elevation_bin"


def _asof(clicks: str, cameras: str, kind: str = "ASOF JOIN") -> str:
    return f"""
        (SELECT * FROM e WHERE event_type = 'pointer_click' AND {clicks}) c {kind} (SELECT session_id, ts, position AS p, direction AS d, fov AS f, aspect AS a, near AS n
          FROM e
          WHERE event_type = 'camera_sample' AND {cameras}) m ON c.session_id = m.session_id AND c.ts >= m.ts"""


_FLOW = f"""
SELECT {_bins('d[1]', 'd[2]', 'd[3]', 24)}, mesh, {N} AS count
FROM {_asof('''mesh <> '' ''', 'len(direction) = 3')}
GROUP BY ALL
ORDER BY count DESC, azimuth_bin, elevation_bin, mesh LIMIT 150"""
_ORIGINS = f"""
SELECT {_bins('d[1]', 'd[2]', 'd[3]', 24)}, mesh, CASE WHEN len(ray_origin) = 3 THEN ray_origin ELSE p END AS o
FROM {_asof('''mesh <> '' ''', 'len(direction) = 3 AND len(position) = 3')}"""
_STANDING = f"""
SELECT azimuth_bin, elevation_bin, {_v('o', 'origin_vx origin_vy origin_vz', '2e0')}, mesh, avg(o[1]) AS origin_x, avg(o[2]) AS origin_y, avg(o[3]) AS origin_z, {N} AS count
FROM ({_ORIGINS})
GROUP BY azimuth_bin, elevation_bin, origin_vx, origin_vy, origin_vz, mesh"""
_STANDING_TOP = f"{_STANDING} ORDER BY count DESC, azimuth_bin, elevation_bin, mesh, origin_vx, origin_vy, origin_vz LIMIT 150"
_L, _H = "sqrt(d[1]*d[1] + d[2]*d[2] + d[3]*d[3])", "sqrt(d[1]*d[1] + d[3]*d[3])"
_RIGHT, _UP = "((2 * screen[1] - 1) * n * tan(f / 2) * a)", "((1 - 2 * screen[2]) * n * tan(f / 2))"
_PLANE = {
    1: f"p[1] + d[1] * n / {_L} + d[3] / {_H} * {_RIGHT} - d[1] * d[2] / ({_L} * {_H}) * {_UP}",
    2: f"p[2] + d[2] * n / {_L} + {_H} / {_L} * {_UP}",
    3: f"p[3] + d[3] * n / {_L} - d[1] / {_H} * {_RIGHT} - d[2] * d[3] / ({_L} * {_H}) * {_UP}",
}
_RAY_ROWS = "SELECT mesh, hit_point AS h, " + ", ".join(f"CASE WHEN len(ray_origin) = 3 THEN ray_origin[{i}] WHEN len(screen) = 2 AND f > 0 AND a > 0 AND n > 0 AND {_H} > 1e-6 * {_L} THEN {_PLANE[i]} ELSE p[{i}] END AS o{i}" for i in (1, 2, 3)) + f" FROM {_asof('len(hit_point) = 3', 'len(position) = 3', 'ASOF LEFT JOIN')}"
_RAYS = f"""
SELECT {', '.join(f'CAST(floor(o{i} / 0.5e0) AS BIGINT) AS cam_v{x}' for i, x in zip((1, 2, 3), 'xyz'))}, {_v('h', 'hit_vx hit_vy hit_vz')}, mesh, {', '.join(f'avg(o{i}) AS origin_{x}, avg(h[{i}]) AS hit_{x}' for i, x in zip((1, 2, 3), 'xyz'))}, {N} AS count
FROM ({_RAY_ROWS})
WHERE o1 IS NOT NULL
GROUP BY cam_vx, cam_vy, cam_vz, hit_vx, hit_vy, hit_vz, mesh"""
_RAYS_TOP = f"{_RAYS} ORDER BY count DESC, cam_vx, cam_vy, cam_vz, hit_vx, hit_vy, hit_vz, mesh LIMIT 500"


def _count_types(*types: str) -> str:
    names = ", ".join(f"'{t}'" for t in types)
    return f"CAST(count(*) FILTER (event_type IN ({names})) AS BIGINT)"


def _pairs(vector: str) -> str:
    s = f"(SELECT session_id, ts, {vector} AS v FROM e WHERE event_type = 'camera_sample' AND len({vector}) = 3)"
    return f"{s} c ASOF JOIN {s} m ON c.session_id = m.session_id AND c.ts > m.ts"


_DIST = "sqrt((c.v[1]-m.v[1])*(c.v[1]-m.v[1]) + (c.v[2]-m.v[2])*(c.v[2]-m.v[2]) + (c.v[3]-m.v[3])*(c.v[3]-m.v[3]))"
_NAV = f"""
SELECT session_id, {N} AS segments, sum(dist) AS total_distance, CAST(sum(CASE WHEN dist >= 0.05 THEN 1 ELSE 0 END) AS BIGINT) AS active_segments, sum(CASE WHEN dist >= 0.05 THEN dist ELSE 0 END) AS active_distance
FROM (SELECT c.session_id, {_DIST} AS dist
  FROM {_pairs('position')})
GROUP BY session_id"""
_NAV_TOP = f"{_NAV} ORDER BY total_distance DESC, session_id LIMIT 500"
_LEN = lambda x: f"sqrt({x}.v[1]*{x}.v[1] + {x}.v[2]*{x}.v[2] + {x}.v[3]*{x}.v[3])"
_TURN = f"acos(least(1, greatest(-1, (c.v[1]*m.v[1] + c.v[2]*m.v[2] + c.v[3]*m.v[3]) / ({_LEN('c')} * {_LEN('m')}))))"
_BY_SESSION = lambda cols: f"(SELECT session_id, {N} AS n, {cols} {_PERF} GROUP BY session_id)"
_Q = lambda x, q=0.5: f"quantile_cont({x}, {q})"
_DUR = f"{N} AS {{n}}, sum(visible_ms) AS total_ms, avg(visible_ms) AS avg_ms, max(visible_ms) AS max_ms"
_INPUTS = "event_type IN ('camera_gesture', 'hover_dwell', 'input_action', 'mesh_interaction', 'pointer_click', 'pointer_down', 'pointer_move', 'pointer_up')"
_XR = "source IN ('xr-controller', 'hand', 'gaze', 'transient')"
_BYSRC = f"SELECT event_type, source, {N} AS count, CAST(count(DISTINCT session_id) AS BIGINT) AS sessions FROM e WHERE {_INPUTS} GROUP BY ALL"
_BYSRC_TOP = f"{_BYSRC} ORDER BY count DESC, event_type, source LIMIT 100"
_TRUTH = f"SELECT {N} AS samples, avg(fps) AS avg_fps, {_Q('fps')} AS p50_fps, avg(nullif(render_scale, 0)) AS avg_render_scale, {_Q('nullif(render_scale, 0)')} AS p50_render_scale, CAST(sum(CASE WHEN render_scale > 0 AND render_scale < 1 THEN 1 ELSE 0 END) AS BIGINT) AS downscaled_samples, CAST(sum(CASE WHEN render_scale > 0 THEN 1 ELSE 0 END) AS BIGINT) AS scale_samples {_PERF}"
_DIAG = f"""
SELECT {_JSON('severity')} AS severity, {_JSON('category')} AS category, coalesce({_JSON('backend')}, '') AS backend, CAST(sum(coalesce(TRY_CAST({_JSON('count')} AS BIGINT), 1)) AS BIGINT) AS incidents
FROM e
WHERE event_type = 'graphics_diagnostic'
GROUP BY ALL"""
_GRAPHICS = {"api": "api", "backend": "backend", "api_version": "apiVersion", "shading_language": "shadingLanguage"}
_TEXTS = ", ".join(f"coalesce({_JSON('graphics', path)}, '') AS {name}" for name, path in _GRAPHICS.items())
_TECH = f"SELECT {_TEXTS}, {N} AS sessions FROM e WHERE event_type = 'session_start' GROUP BY ALL"
_COVER = f"SELECT {_v('position', size='1e0')}, {N} AS count FROM e WHERE event_type = 'camera_sample' AND len(position) = 3 GROUP BY ALL"
_COVER_TOP = f"{_COVER} ORDER BY count DESC, vx, vy, vz LIMIT 5000"
_PATHS = f"""
SELECT session_id, (epoch_us(ts) // 1000) AS ts, {_v('position', 'gx gz', '1e0', (1, 3))}
FROM e
WHERE event_type = 'camera_sample' AND len(position) = 3"""
_CELLS = f"SELECT session_id, {_MS} AS ts, {_v('position', 'gx gz', '4e0', (1, 3))} FROM e WHERE event_type = 'camera_sample' AND len(position) = 3"
_LINES = f"""
SELECT session_id, ts, gx, gz
FROM (SELECT *, lag(gx) OVER w AS bx, lag(gz) OVER w AS bz FROM ({_CELLS}) WINDOW w AS (PARTITION BY session_id ORDER BY ts, gx, gz))
WHERE bx IS NULL OR bx <> gx OR bz <> gz"""
_FLOW_GRAPH = f"""
WITH base AS (SELECT concat_ws(',', origin_vx, origin_vy, origin_vz) AS standpoint, mesh, sum(count) AS n FROM ({_STANDING}) GROUP BY ALL),
stands AS (SELECT standpoint FROM base GROUP BY standpoint ORDER BY sum(n) DESC, standpoint LIMIT 8),
front AS (SELECT mesh FROM base GROUP BY mesh ORDER BY sum(n) DESC, mesh LIMIT 8),
folded AS (
  SELECT CASE WHEN standpoint IN (FROM stands) THEN standpoint ELSE 'other' END AS s, CASE WHEN mesh IN (FROM front) THEN mesh ELSE 'other' END AS m, sum(n) AS n
  FROM base GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (ORDER BY n DESC, s, m) AS rn FROM folded),
links AS (SELECT s AS standpoint, CASE WHEN rn <= 24 THEN m ELSE 'other' END AS mesh, CAST(sum(n) AS BIGINT) AS count FROM ranked GROUP BY ALL)
SELECT standpoint, mesh, count,
  CAST(sum(count) OVER (PARTITION BY standpoint) AS BIGINT) AS standpoint_total, CAST(sum(count) OVER (PARTITION BY mesh) AS BIGINT) AS mesh_total
FROM links"""
_GEST = f"SELECT name AS kind, {_DUR.format(n='gestures')} FROM e WHERE event_type = 'camera_gesture' GROUP BY ALL"
_KINDS = f"SELECT mesh, name AS kind, {N} AS count FROM e WHERE event_type = 'mesh_interaction' AND mesh <> '' GROUP BY ALL"
_KINDS_TOP = f"{_KINDS} ORDER BY count DESC, mesh, kind LIMIT 100"
_FUNNEL = [
    "s0 AS (SELECT session_id, min(ts) AS t FROM e WHERE event_type = 'session_start' GROUP BY 1)",
    "s1 AS (SELECT session_id, min(e.ts) AS t FROM e JOIN s0 USING (session_id) WHERE event_type = 'camera_sample' AND ts >= s0.t GROUP BY 1)",
    "s2 AS (SELECT session_id, min(e.ts) AS t FROM e JOIN s1 USING (session_id) WHERE event_type = 'pointer_click' AND ts >= s1.t GROUP BY 1)",
    """
        s3 AS (SELECT session_id, min(e.ts) AS t
          FROM e
          JOIN s2 USING (session_id)
          WHERE event_type = 'mesh_interaction' AND name = 'pick' AND ts >= s2.t
          GROUP BY 1)""",
]
_STEPS = f"WITH {', '.join(_FUNNEL)} " + " UNION ALL ".join(f"SELECT CAST({i} AS INT) AS step, {N} AS sessions FROM s{i}" for i in range(4))
_DAILY = f"SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, {{}} FROM e {{}} GROUP BY ALL"

_BOX_SQL = """
SELECT mesh AS name, min(hit_point[1]) AS x0, min(hit_point[2]) AS y0, min(hit_point[3]) AS z0, max(hit_point[1]) AS x1, max(hit_point[2]) AS y1, max(hit_point[3]) AS z1
FROM e
WHERE mesh <> '' AND len(hit_point) = 3 AND hit_point[1] BETWEEN -3 AND 3 AND hit_point[3] BETWEEN -3 AND 3
GROUP BY mesh"""
_LANE_CASE = "CASE " + " ".join(f"WHEN event_type = '{t}' THEN '{lane}'" for lane, types in derived.LANES.items() for t in types) + " END"

def _mesh_boxes(e: DataFrame) -> DataFrame:
    """Boxes of the hits near the centre: a stand-in for scanned proxies."""
    hit = [F.get("hit_point", i) for i in range(3)]
    rows = e.where((F.col("mesh") != "") & (F.size("hit_point") == 3) & hit[0].between(-3, 3) & hit[2].between(-3, 3))
    return rows.groupBy(F.col("mesh").alias("name")).agg(F.array(*[F.min(h) for h in hit], *[F.max(h) for h in hit]).alias("aabb"))


ANALYTICS: dict[str, Query] = {
    # sessions, scenes, volume
    "list_sessions": Query(lambda e: volume.list_sessions(e, ALL), f"""
        SELECT session_id, min(visitor_id) AS visitor_id, {N} AS events, min(ts) AS started_at, max(ts) AS ended_at
        FROM e
        GROUP BY session_id
        ORDER BY started_at DESC, session_id LIMIT 100""", times="started_at ended_at"),
    "list_sessions_camera_mode": Query(lambda e: volume.list_sessions(e, ALL.but(camera_mode="first-person")), f"""
        SELECT session_id, min(visitor_id) AS visitor_id, {N} AS events, min(ts) AS started_at, max(ts) AS ended_at
        FROM e
        WHERE true{_FREE}
        GROUP BY session_id
        ORDER BY started_at DESC, session_id LIMIT 100""", times="started_at ended_at"),
    "distinct_scenes": Query(lambda e: volume.distinct_scenes(e, ALL), f"SELECT scene_id, {N} AS events, max(ts) AS last_seen FROM e GROUP BY scene_id", times="last_seen"),
    "timeseries": Query(lambda e: volume.timeseries(e, ALL), f"SELECT {_BUCKET(3600)}, {N} AS events, avg(CASE WHEN event_type = 'frame_perf' THEN fps END) AS avg_fps FROM e GROUP BY bucket", "avg_fps"),
    "timeseries_scoped": Query(lambda e: volume.timeseries(e, PART, 86400, "pointer_click"), f"""
        SELECT {_BUCKET(86400)}, {N} AS events, avg(CASE WHEN event_type = 'frame_perf' THEN fps END) AS avg_fps
        FROM e
        WHERE event_type = 'pointer_click'{_PART}
        GROUP BY bucket""", "avg_fps"),
    "event_type_counts": Query(lambda e: volume.event_type_counts(e, ALL), f"SELECT event_type, {N} AS count FROM e GROUP BY ALL"),
    "events_daily": Query(lambda e: volume.read_events_daily(volume.events_daily(e), ALL), "SELECT * FROM (" + _DAILY.format(f"event_type, {N} AS events", "") + ") ORDER BY day DESC, events DESC, event_type LIMIT 200"),
    "perf_daily": Query(lambda e: volume.read_perf_daily(volume.perf_daily(e), ALL), "SELECT * FROM (" + _DAILY.format(f"{N} AS samples, avg(fps) AS avg_fps, min(fps) AS min_fps, {_Q('fps')} AS p50_fps", "WHERE event_type = 'frame_perf'") + ") ORDER BY day DESC LIMIT 30", "avg_fps min_fps p50_fps"),
    # heatmaps and space
    "pointer_heatmap": Query(lambda e: spatial.pointer_heatmap(e, ALL), f"""
        SELECT CAST(floor(screen[1] * 50) AS BIGINT) AS gx, CAST(floor(screen[2] * 50) AS BIGINT) AS gy, {N} AS count
        FROM e
        WHERE event_type IN ('pointer_move', 'pointer_click') AND len(screen) = 2
        GROUP BY ALL"""),
    "world_heatmap": Query(lambda e: spatial.world_heatmap(e, ALL), _HITS + _TOP),
    "world_heatmap_scoped": Query(lambda e: spatial.world_heatmap(e, PART.but(region=WIDE, camera_mode="free", source="mouse")), _HITS + _PART + _WIDE + _FREE + " AND source = 'mouse'" + _TOP),
    "world_heatmap_totals": Query(lambda e: spatial.world_heatmap_totals(e, ALL), f"SELECT {N} AS cells, CAST(coalesce(sum(count), 0) AS BIGINT) AS hits FROM ({_HITS} GROUP BY ALL)"),
    "gaze_heatmap": Query(lambda e: spatial.gaze_heatmap(e, ALL), _GAZE + _TOP),
    "gaze_heatmap_totals": Query(lambda e: spatial.gaze_heatmap_totals(e, ALL), f"SELECT {N} AS cells, CAST(coalesce(sum(count), 0) AS BIGINT) AS hits FROM ({_GAZE} GROUP BY ALL)"),
    "view_direction_heatmap": Query(lambda e: spatial.view_direction_heatmap(e, ALL), f"""
        SELECT {_bins('direction[1]', 'direction[2]', 'direction[3]', 36)}, {N} AS count
        FROM e
        WHERE event_type = 'camera_sample' AND len(direction) = 3
        GROUP BY ALL"""),
    "floor_plan": Query(lambda e: spatial.floor_plan(e, ALL), f"""
        SELECT {_v('position', 'gx gz', '1e0', (1, 3))}, avg(position[2]) AS avg_y, {N} AS count
        FROM e
        WHERE event_type = 'camera_sample' AND len(position) = 3
        GROUP BY gx, gz
        ORDER BY count DESC, gx, gz LIMIT 2000""", "avg_y"),
    "session_trajectory": Query(lambda e: spatial.session_trajectory(e, ALL.but(session="u7-w0")), """
        SELECT (epoch_us(ts) // 1000) AS ts, position[1] AS x, position[2] AS y, position[3] AS z
        FROM e
        WHERE session_id = 'u7-w0' AND event_type = 'camera_sample' AND len(position) = 3""", "x y z"),
    "trajectories": Query(lambda e: spatial.trajectories(e, ALL), f"{_PATHS} ORDER BY session_id, ts, gx, gz LIMIT 20000"),
    "scene_coverage": Query(lambda e: spatial.scene_coverage(e, ALL), _COVER_TOP),
    "camera_distance": Query(lambda e: spatial.camera_distance(e, ALL), f"""
        SELECT CAST(floor(sqrt(position[1]*position[1] + position[2]*position[2] + position[3]*position[3]) / 1e0) AS BIGINT) AS bucket, {N} AS count
        FROM e
        WHERE event_type = 'camera_sample' AND len(position) = 3
        GROUP BY ALL
        ORDER BY bucket LIMIT 1000"""),
    # as-of correlations
    "click_rays": Query(lambda e: correlate.click_rays(e, ALL), _RAYS_TOP, "origin_x origin_y origin_z hit_x hit_y hit_z"),
    "flow": Query(lambda e: correlate.flow(e, ALL), _FLOW),
    "flow_by_standpoint": Query(lambda e: correlate.flow_by_standpoint(e, ALL, cell_size=2.0), _STANDING_TOP, "origin_x origin_y origin_z"),
    "navigation_effort": Query(lambda e: correlate.navigation_effort(e, ALL), _NAV_TOP, "total_distance active_distance"),
    "rotation_rate": Query(lambda e: correlate.rotation_rate(e, ALL), f"""
        SELECT session_id, {N} AS samples, avg(turn) AS avg_turn_rad, max(turn) AS max_turn_rad, sum(turn) AS total_turn_rad, CAST(sum(CASE WHEN turn >= 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS rapid_segments
        FROM (SELECT c.session_id, {_TURN} AS turn
          FROM {_pairs('direction')})
        GROUP BY session_id
        ORDER BY total_turn_rad DESC, session_id LIMIT 500""", "avg_turn_rad max_turn_rad total_turn_rad"),
    # meshes and interaction
    "top_meshes": Query(lambda e: meshes.top_meshes(e, ALL), f"SELECT mesh, {N} AS count FROM e WHERE mesh <> '' GROUP BY mesh ORDER BY count DESC, mesh LIMIT 25"),
    "meshes_by_source": Query(lambda e: meshes.meshes_by_source(e, ALL), f"SELECT mesh, source, {N} AS count {_ACTIVE} GROUP BY ALL ORDER BY count DESC, mesh, source LIMIT 200"),
    "mesh_trend": Query(lambda e: meshes.mesh_trend(e, ALL), f"SELECT mesh, {_BUCKET(3600)}, {N} AS count {_ACTIVE} GROUP BY ALL ORDER BY bucket, mesh LIMIT 2000"),
    "mesh_dwell": Query(lambda e: meshes.mesh_dwell(e, ALL), f"""
        SELECT mesh, sum(visible_ms) AS visible_ms, sum(centered_ms) AS centered_ms, max(screen_fraction) AS max_screen_fraction, {N} AS samples
        FROM e
        WHERE event_type = 'mesh_visibility' AND mesh <> ''
        GROUP BY mesh""", "visible_ms centered_ms max_screen_fraction"),
    "interaction_kinds": Query(lambda e: meshes.interaction_kinds(e, ALL), _KINDS_TOP),
    "dead_clicks": Query(lambda e: meshes.dead_clicks(e, ALL), f"""
        SELECT {N} AS total_clicks, CAST(sum(CASE WHEN mesh = '' THEN 1 ELSE 0 END) AS BIGINT) AS dead_clicks
        FROM e
        WHERE event_type = 'pointer_click'"""),
    "rage_clicks": Query(lambda e: meshes.rage_clicks(e, ALL, interval=604_800, min_repeats=2, limit=1000), f"""
        SELECT session_id, mesh, {_BUCKET(604_800)}, {N} AS clicks
        FROM e
        WHERE event_type = 'pointer_click' AND mesh <> ''
        GROUP BY ALL
        HAVING count(*) >= 2
        ORDER BY clicks DESC, session_id, mesh, bucket LIMIT 1000"""),
    "hover_dwell": Query(lambda e: meshes.hover_dwell(e, ALL), f"""
        SELECT mesh, sum(visible_ms) AS dwell_ms, max(visible_ms) AS max_dwell_ms, {N} AS episodes
        FROM e
        WHERE event_type = 'hover_dwell' AND mesh <> ''
        GROUP BY mesh""", "dwell_ms max_dwell_ms"),
    "interactions_by_source": Query(lambda e: meshes.interactions_by_source(e, ALL), _BYSRC_TOP),
    "top_input_actions": Query(lambda e: meshes.top_input_actions(e, ALL), f"SELECT name AS action, source, {N} AS count FROM e WHERE event_type = 'input_action' AND name <> '' GROUP BY ALL"),
    "camera_gestures": Query(lambda e: meshes.camera_gestures(e, ALL), _GEST, "total_ms avg_ms max_ms"),
    "compile_stalls": Query(lambda e: meshes.compile_stalls(e, ALL), f"SELECT name AS phase, {_DUR.format(n='stalls')} FROM e WHERE event_type = 'compile_stall' GROUP BY ALL", "total_ms avg_ms max_ms"),
    "xr_source_usage": Query(lambda e: meshes.xr_source_usage(e, ALL), f"SELECT source, {N} AS interactions, CAST(count(DISTINCT session_id) AS BIGINT) AS sessions FROM e WHERE {_XR} GROUP BY source"),
    "xr_abandonment": Query(lambda e: meshes.xr_abandonment(e, ALL), f"""
        SELECT session_id, {N} AS events, CAST(sum(CASE WHEN {_XR} THEN 1 ELSE 0 END) AS BIGINT) AS xr_interactions, min(ts) AS started_at, max(ts) AS ended_at
        FROM e
        WHERE session_id IN (SELECT session_id
          FROM e
          WHERE {_XR})
        GROUP BY session_id
        ORDER BY started_at DESC, session_id LIMIT 500""", times="started_at ended_at"),
    "funnel": Query(lambda e: meshes.funnel(e, ALL, STEPS), _STEPS),
    "funnel_conversion": Query(lambda e: meshes.funnel_conversion(meshes.funnel(e, ALL, STEPS)), f"SELECT *, sessions / nullif(lag(sessions) OVER (ORDER BY step), 0) AS conversion FROM ({_STEPS})", "conversion"),
    # performance, stability, technology
    "perf_summary": Query(lambda e: performance.perf_summary(e, ALL), f"SELECT {N} AS samples, avg(fps) AS avg_fps, min(fps) AS min_fps, {_Q('fps')} AS p50_fps {_PERF}", "avg_fps min_fps p50_fps"),
    "render_scale_truth": Query(lambda e: derived.hidden_cost(derived.downscaled_share(performance.render_scale_truth(e, ALL))), f"""
        SELECT *, coalesce(downscaled_samples / nullif(scale_samples, 0), 0) AS downscaled_share, coalesce(p50_fps >= 50 AND p50_render_scale > 0 AND p50_render_scale < 0.9, false) AS hidden_cost
        FROM ({_TRUTH})""", "avg_fps p50_fps avg_render_scale p50_render_scale downscaled_share"),
    "perf_distribution": Query(lambda e: performance.perf_distribution(e, ALL), f"""
        SELECT {N} AS sessions, CAST(sum(n) AS BIGINT) AS samples, {_Q('a')} AS p05_fps, {_Q('b')} AS p50_fps, {_Q('c')} AS p95_fps
        FROM {_BY_SESSION(_Q('fps', 0.05) + ' AS a, ' + _Q('fps') + ' AS b, ' + _Q('fps', 0.95) + ' AS c')}""", "p05_fps p50_fps p95_fps"),
    "fps_histogram": Query(lambda e: performance.fps_histogram(e, ALL), f"SELECT CAST(floor(b / 10e0) AS BIGINT) * 10 AS bucket, {N} AS sessions FROM {_BY_SESSION(_Q('fps') + ' AS b')} GROUP BY ALL"),
    "frame_time_percentiles": Query(lambda e: performance.frame_time_percentiles(e, ALL), f"""
        SELECT {N} AS sessions, CAST(sum(n) AS BIGINT) AS samples, {_Q('a')} AS p50_ms, {_Q('b')} AS p95_ms
        FROM {_BY_SESSION(_Q('nullif(frame_time_ms, 0)') + ' AS a, max(nullif(frame_time_p95_ms, 0)) AS b')}""", "p50_ms p95_ms"),
    "jank_rate": Query(lambda e: performance.jank_rate(e, ALL), f"""
        SELECT {N} AS sessions, sum(a) AS total_long_frames, {_Q('r')} AS median_rate, {_Q('r', 0.9)} AS worst_decile_rate
        FROM (SELECT a, a / n AS r
          FROM {_BY_SESSION('sum(long_frames) AS a')})""", "total_long_frames median_rate worst_decile_rate"),
    "perf_by_device": Query(lambda e: performance.perf_by_device(e, ALL), f"""
        SELECT coalesce(engine, '') AS engine, coalesce(is_mobile, '') AS is_mobile, coalesce(renderer, '') AS renderer, coalesce(browser, '') AS browser, coalesce(os, '') AS os, {N} AS sessions, CAST(sum(n) AS BIGINT) AS samples, {_Q('b')} AS p50_fps
        FROM {_BY_SESSION(_Q('fps') + ' AS b')}
        LEFT JOIN (SELECT session_id, {_JSON('device', 'engine')} AS engine, {_JSON('device', 'isMobile')} AS is_mobile, {_JSON('device', 'renderer')} AS renderer, {_JSON('device', 'browser')} AS browser, {_JSON('device', 'os')} AS os
          FROM e
          WHERE event_type = 'session_start') USING (session_id)
        GROUP BY 1, 2, 3, 4, 5""", "p50_fps"),
    "perf_by_scene": Query(lambda e: performance.perf_by_scene(e, ALL), f"""
        SELECT scene_id, {N} AS sessions, CAST(sum(n) AS BIGINT) AS samples, {_Q('b')} AS p50_fps
        FROM {_BY_SESSION('min(scene_id) AS scene_id, ' + _Q('fps') + ' AS b')}
        GROUP BY scene_id""", "p50_fps"),
    "resource_summary": Query(lambda e: performance.resource_summary(e, ALL), f"""
        SELECT {N} AS samples, {', '.join(f'avg(nullif({n}, 0)) AS avg_{n}, max({n}) AS max_{n}' for n in performance.RESOURCES)}
        FROM e
        WHERE event_type = 'resource_sample'""", " ".join(f"avg_{n} max_{n}" for n in performance.RESOURCES)),
    "resource_percentiles": Query(
        lambda e: performance.resource_percentiles(e, ALL),
        f"""
            SELECT {N} AS sessions, CAST(sum(n) AS BIGINT) AS samples, {', '.join(f'quantile_cont(p{q}_{n}, 0.5) AS p{q}_{n}' for n in ('js_heap_bytes', 'texture_bytes', 'triangles') for q in (50, 95))}
            FROM (SELECT session_id, {N} AS n, {', '.join(f'quantile_cont(nullif({n}, 0), {q / 100}) AS p{q}_{n}' for n in ('js_heap_bytes', 'texture_bytes', 'triangles') for q in (50, 95))}
              FROM e
              WHERE event_type = 'resource_sample'
              GROUP BY session_id)""",
        " ".join(f"p{q}_{n}" for n in ("js_heap_bytes", "texture_bytes", "triangles") for q in (50, 95)),
    ),
    "stability_counts": Query(lambda e: performance.stability_counts(e, ALL), f"""
        SELECT CAST(coalesce(sum(CASE WHEN event_type = 'context_lost' THEN 1 ELSE 0 END), 0) AS BIGINT) AS context_losses, CAST(coalesce(sum(CASE WHEN event_type = 'compile_stall' THEN 1 ELSE 0 END), 0) AS BIGINT) AS compile_stalls, {N} AS incidents
        FROM e
        WHERE event_type IN ('context_lost', 'compile_stall')"""),
    "graphics_diagnostics": Query(lambda e: performance.graphics_diagnostics(e, ALL), _DIAG),
    "rendering_technology": Query(lambda e: performance.rendering_technology(e, ALL), _TECH),
    "capability_changes": Query(lambda e: performance.capability_changes(e, ALL), f"SELECT name AS kind, cap_from AS \"from\", cap_to AS \"to\", {N} AS changes FROM e WHERE event_type = 'capability_change' GROUP BY ALL"),
    # derived tables
    "gaze_click_divergence": Query(
        lambda e: derived.gaze_click_divergence(spatial.gaze_heatmap(e, ALL, limit=None), spatial.world_heatmap(e, ALL, limit=None)),
        f"""
            SELECT *, CASE WHEN divergence > 0 THEN 'click' WHEN divergence < 0 THEN 'gaze' ELSE 'even' END AS side
            FROM (SELECT vx, vy, vz, coalesce(g.count, 0) AS gaze, coalesce(c.count, 0) AS clicks, coalesce(c.count, 0) / (SELECT greatest(max(count), 1) FROM ({_HITS_ALL})) - coalesce(g.count, 0) / (SELECT greatest(max(count), 1) FROM ({_GAZE_ALL})) AS divergence
              FROM ({_GAZE_ALL}) g
              FULL JOIN ({_HITS_ALL}) c USING (vx, vy, vz))""",
        "divergence",
    ),
    "desire_lines": Query(lambda e: derived.desire_lines(spatial.trajectories(e, ALL, 4.0, None)), _LINES),
    "standpoints": Query(lambda e: derived.standpoints(correlate.flow_by_standpoint(e, ALL, cell_size=2.0, limit=None)), f"""
        SELECT origin_vx, origin_vy, origin_vz, CAST(sum(count) AS BIGINT) AS count, {', '.join(f'sum(origin_{a} * count) / sum(count) AS origin_{a}' for a in 'xyz')}
        FROM ({_STANDING})
        GROUP BY origin_vx, origin_vy, origin_vz""", "origin_x origin_y origin_z"),
    "collapse_flow": Query(lambda e: derived.collapse_flow(correlate.flow_by_standpoint(e, ALL, cell_size=2.0, limit=None)), f"SELECT azimuth_bin, elevation_bin, mesh, CAST(sum(count) AS BIGINT) AS count FROM ({_STANDING}) GROUP BY ALL"),
    "rays_by_camera": Query(lambda e: derived.rays_by_camera(correlate.click_rays(e, ALL, limit=None)), f"SELECT cam_vx, cam_vy, cam_vz, CAST(sum(count) AS BIGINT) AS count FROM ({_RAYS}) GROUP BY ALL"),
    "rays_by_mesh": Query(lambda e: derived.rays_by_mesh(correlate.click_rays(e, ALL, limit=None)), f"SELECT mesh, CAST(sum(count) AS BIGINT) AS count FROM ({_RAYS}) GROUP BY ALL"),
    "modality_split": Query(lambda e: derived.modality_split(meshes.interactions_by_source(e, ALL, None)), f"""
        SELECT source, CAST(sum(count) AS BIGINT) AS count, sum(count) / (SELECT sum(count)
          FROM ({_BYSRC})) AS share
        FROM ({_BYSRC})
        GROUP BY source""", "share"),
    "source_breakdown": Query(lambda e: derived.source_breakdown(meshes.interactions_by_source(e, ALL, None)), f"""
        SELECT source, CAST(sum(count) AS BIGINT) AS total, max(sessions) AS sessions, string_agg(event_type, ','
          ORDER BY event_type) AS types
        FROM ({_BYSRC})
        GROUP BY source"""),
    "kinds_per_mesh": Query(lambda e: derived.kinds_per_mesh(meshes.interaction_kinds(e, ALL, None)), f"""
        SELECT mesh, CAST(sum(count) AS BIGINT) AS total, string_agg(kind || ':' || count, ','
          ORDER BY count DESC, kind) AS kinds
        FROM ({_KINDS})
        GROUP BY mesh
        ORDER BY total DESC, mesh LIMIT 10"""),
    "navigation_mix": Query(lambda e: derived.navigation_mix(meshes.camera_gestures(e, ALL, None)), f"SELECT kind, gestures, gestures / (SELECT sum(gestures) FROM ({_GEST})) AS share FROM ({_GEST})", "share"),
    "diagnostic_folds": Query(
        lambda e: derived.diagnostic_folds(performance.graphics_diagnostics(e, ALL)).drop("severity_rank"),
        f"""
            SELECT facet, value, CAST(sum(incidents) AS BIGINT) AS incidents
            FROM (SELECT unnest(['severity', 'category', 'backend', 'total']) AS facet, unnest([severity, category, CASE backend WHEN '' THEN 'unknown' ELSE backend END, '']) AS value, incidents
              FROM ({_DIAG})
              WHERE incidents > 0)
            GROUP BY ALL""",
    ),
    "technology_folds": Query(lambda e: derived.technology_folds(performance.rendering_technology(e, ALL)), f"""
        SELECT facet, value, CAST(sum(sessions) AS BIGINT) AS sessions
        FROM (SELECT unnest(['api', 'backend', 'shading_language', 'total']) AS facet, unnest([api, backend, shading_language, '']) AS value, sessions
          FROM ({_TECH}))
        GROUP BY ALL"""),
    "scene_health": Query(
        lambda e: derived.scene_health(volume.event_type_counts(e, ALL), e.agg(F.countDistinct("session_id").alias("sessions"))),
        f"""
            SELECT *, errors / sessions AS errors_per_session
            FROM (SELECT {_count_types('runtime_error')} AS errors, {_count_types('context_lost')} AS context_losses, {_count_types('visibility_change', 'focus_change')} AS attention_gaps, {_count_types('viewport_resize')} AS resizes, CAST(count(DISTINCT session_id) AS BIGINT) AS sessions
              FROM e)""",
        "errors_per_session",
    ),
    "scene_metrics": Query(
        lambda e: derived.scene_metrics(spatial.scene_coverage(e, ALL, limit=None), correlate.navigation_effort(e, ALL, limit=None)),
        f"""
            SELECT * FROM (SELECT {N} AS occupied_cells, CAST(coalesce(sum(count), 0) AS BIGINT) AS samples
              FROM ({_COVER})), (SELECT coalesce(avg(total_distance), 0) AS avg_travel, coalesce(sum(active_segments) / nullif(sum(segments), 0), 0) AS active_share
              FROM ({_NAV}))""",
        "avg_travel active_share",
    ),
    "robust_intensity": Query(lambda e: derived.robust_intensity(spatial.world_heatmap(e, ALL, limit=None)), f"""
        SELECT *, least(1, greatest(0, count / scale)) AS t
        FROM ({_HITS_ALL}), (SELECT greatest(1, {_Q('count', 0.95)}) AS scale
          FROM ({_HITS_ALL}))""", "scale t"),
    "heatmap_instances": Query(
        lambda e: derived.heatmap_instances(spatial.world_heatmap(e, ALL, limit=None), 0.5).drop("r", "g", "b"),
        f"""
            SELECT vx, vy, vz, count, t, (vx + 0.5) * 0.5 AS x, (vy + 0.5) * 0.5 AS y, (vz + 0.5) * 0.5 AS z, 0.45e0 * (0.35e0 + 0.65e0 * t) AS edge
            FROM (SELECT *, count / (SELECT max(count) FROM ({_HITS_ALL})) AS t
              FROM ({_HITS_ALL}))
            ORDER BY count DESC, vx, vy, vz LIMIT 2000""",
        "t x y z edge",
    ),
    "session_duration": Query(lambda e: derived.session_duration(e), "SELECT session_id, (epoch_us(max(ts)) // 1000) - (epoch_us(min(ts)) // 1000) AS duration_ms FROM e GROUP BY session_id"),
    "part_popularity": Query(
        lambda e: derived.part_popularity(meshes.meshes_by_source(e, ALL, None), meshes.mesh_trend(e, ALL, 86400, None)).select("mesh", "total", "delta", F.size("buckets").cast("long").alias("n_buckets")),
        f"""
            SELECT mesh, total, delta, n_buckets
            FROM (SELECT mesh, CAST(sum(count) AS BIGINT) AS total
              FROM (SELECT mesh, source, {N} AS count {_ACTIVE} GROUP BY ALL)
              GROUP BY mesh)
            JOIN (SELECT mesh, CAST(sum(CASE WHEN rn > n // 2 THEN count ELSE -count END) AS BIGINT) AS delta, CAST(max(n) AS BIGINT) AS n_buckets
              FROM (SELECT *, row_number() OVER (PARTITION BY mesh ORDER BY bucket) AS rn, count(*) OVER (PARTITION BY mesh) AS n FROM (SELECT mesh, {_BUCKET(86400)}, {N} AS count {_ACTIVE} GROUP BY ALL))
              GROUP BY mesh) USING (mesh)
            ORDER BY total DESC, mesh LIMIT 12""",
    ),
    "session_lanes": Query(lambda e: derived.session_lanes(e), f"""
        SELECT DISTINCT session_id, lane, CAST(floor((ms - t0) * 600 / greatest(t1 - t0, 1) + 0.5e0) AS BIGINT) AS slot
        FROM (SELECT session_id, {_LANE_CASE} AS lane, {_MS} AS ms, min({_MS}) OVER (PARTITION BY session_id) AS t0, max({_MS}) OVER (PARTITION BY session_id) AS t1
          FROM e)
        WHERE lane IS NOT NULL"""),
    "dead_zones": Query(
        lambda e: derived.dead_zones(spatial.scene_coverage(e, ALL, limit=None), _mesh_boxes(e), 1.0),
        f"""
            SELECT name, CAST(coalesce(sum(count), 0) AS BIGINT) AS visits, coalesce(sum(count), 0) = 0 AS dead
            FROM ({_BOX_SQL}) b
            LEFT JOIN ({_COVER}) c ON vx + 0.5e0 BETWEEN x0 - 1 AND x1 + 1 AND vy + 0.5e0 BETWEEN y0 - 1 AND y1 + 1 AND vz + 0.5e0 BETWEEN z0 - 1 AND z1 + 1
            GROUP BY name""",
    ),
    "gaze_dome": Query(
        lambda e: derived.gaze_dome(spatial.view_direction_heatmap(e, ALL), 36, 2.0).select("azimuth_bin", "elevation_bin", "count", "x", "y", "z"),
        f"""
            SELECT azimuth_bin, elevation_bin, count, 2 * cos(el) * cos(az) AS x, 2 * sin(el) AS y, 2 * cos(el) * sin(az) AS z
            FROM (SELECT *, (azimuth_bin + 0.5e0) / 36 * 2 * pi() - pi() AS az, (elevation_bin + 0.5e0) / 36 * pi() - pi() / 2 AS el
              FROM (SELECT {_bins('direction[1]', 'direction[2]', 'direction[3]', 36)}, {N} AS count FROM e WHERE event_type = 'camera_sample' AND len(direction) = 3 GROUP BY ALL))""",
        "x y z",
    ),
    "flow_graph": Query(lambda e: derived.flow_graph(correlate.flow_by_standpoint(e, ALL, cell_size=2.0, limit=None)), _FLOW_GRAPH),
    "desire_edges": Query(
        lambda e: derived.desire_edges(derived.desire_lines(spatial.trajectories(e, ALL, 4.0, None))),
        f"""
        SELECT from_gx, from_gz, gx AS to_gx, gz AS to_gz, {N} AS count
        FROM (SELECT *, lag(gx) OVER w AS from_gx, lag(gz) OVER w AS from_gz FROM ({_LINES})
              WINDOW w AS (PARTITION BY session_id ORDER BY ts, gx, gz))
        WHERE from_gx IS NOT NULL
        GROUP BY ALL""",
    ),
}
