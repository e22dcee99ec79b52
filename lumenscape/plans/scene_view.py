"""The driver's `events` table seen as scene events: one text for Spark and for DuckDB."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from lumenscape.sources.folders import own_folder
from lumenscape.sources.ingest import write_events

PROJECT = "p0"

_INPUT = "t IN ('camera_gesture', 'hover_dwell', 'input_action', 'mesh_interaction', 'pointer_click', 'pointer_down', 'pointer_move', 'pointer_up')"
_HITS = "t IN ('camera_sample', 'pointer_click', 'pointer_move') AND i % 13 <> 0"


def scene_sql(spark: bool) -> str:
    """SELECT over a view `events` that gives the wide schema, with event_id as the tie-break."""
    steps, columns = _parts(spark)
    return f"{steps}{columns}\nFROM sourced\n"


def _parts(spark: bool) -> tuple[str, str]:
    """The steps up to `sourced`, where a row has its session, type and source, and the SELECT of its columns."""

    def vec(condition: str, *parts: str) -> str:
        items = ", ".join(f"CAST({p} AS DOUBLE)" for p in parts)
        full, empty = (f"array({items})", "CAST(array() AS ARRAY<DOUBLE>)") if spark else (f"[{items}]", "CAST([] AS DOUBLE[])")
        return f"CASE WHEN {condition} THEN {full} ELSE {empty} END"

    def pick(key: str, *values: str) -> str:
        return f"CASE {key} " + " ".join(f"WHEN {n} THEN '{v}'" for n, v in enumerate(values)) + f" ELSE '{values[-1]}' END"

    k = "CAST(get_json_object(props, '$.k') AS INT)" if spark else "CAST(json_extract_string(props, '$.k') AS INT)"
    fps, frame = "(20e0 + (i * 13) % 50)", "(1000e0 / (20e0 + (i * 13) % 50))"
    perf, gpu = "t = 'frame_perf'", "t = 'resource_sample' AND i % 5 <> 0"
    num = lambda cond, x: f"CASE WHEN {cond} THEN CAST({x} AS DOUBLE) ELSE 0e0 END"
    start = (
        """'{"type":"session_start","scene":{"cameraType":"' || """ + pick("user_id % 2", "arc-rotate", "free") + """ || '"},"device":{"engine":"' || """ + pick("user_id % 3", "webgpu", "webgl2", "webgl") + """ || '","isMobile":' || """ + pick("user_id % 2", "true", "false")
        + """ || ',"browser":"' || """ + pick("user_id % 4", "Chrome", "Firefox", "Safari", "Edge") + """ || '","os":"' || """ + pick("user_id % 5", "Windows", "macOS", "iOS", "Android", "Linux") + """ || '"},"graphics":{"api":"' || """ + pick("user_id % 3", "webgpu", "webgl2", "webgl")
        + """ || '","backend":"' || """ + pick("user_id % 4", "metal", "vulkan", "d3d12", "opengl") + """ || '","apiVersion":"' || """ + pick("user_id % 2", "1.0", "2.0") + """ || '","shadingLanguage":"' || """ + pick("user_id % 2", "wgsl", "glsl") + """ || '"}}'"""
    )
    diagnostic = """'{"type":"graphics_diagnostic","severity":"' || """ + pick("(k + i) % 4", "info", "warning", "error", "fatal") + """ || '","category":"' || """ + pick("k % 3", "validation", "shader-compile", "out-of-memory") + """ || '"' || CASE WHEN i % 3 = 0 THEN ',"backend":"vulkan"' ELSE '' END || CASE WHEN (k + i) % 3 = 0 THEN ',"count":' || CAST(k % 7 AS VARCHAR(9)) ELSE '' END || '}'"""
    if spark:
        diagnostic = diagnostic.replace("VARCHAR(9)", "STRING")
    own = """'{"type":"custom","props":{"level":' || CAST(k % 5 AS STRING) || ',"mode":"' || """ + pick("i % 3", "solo", "team", "free") + """ || '"}}'"""
    if not spark:
        own = own.replace("STRING", "VARCHAR")
    text = "STRING" if spark else "VARCHAR"
    steps = f"""
WITH raw AS (
  SELECT event_id AS i, CAST(ts AS TIMESTAMP) AS ts, user_id, value, {k} AS k,
    'u' || CAST(user_id AS {text}) || '-w' || CAST(CAST(floor((day(ts) - 1) / 7e0) AS INT) AS {text}) AS session_id
  FROM events),
ranked AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts, i) AS rn FROM raw),
typed AS (
  SELECT *, CASE WHEN rn = 1 THEN 'session_start' WHEN i % 20 < 6 THEN 'camera_sample' WHEN i % 20 < 9 THEN 'pointer_click'
    WHEN i % 20 < 11 THEN 'pointer_move' WHEN i % 20 < 13 THEN 'frame_perf' WHEN i % 20 = 13 THEN 'mesh_interaction'
    WHEN i % 20 = 14 THEN 'mesh_visibility' WHEN i % 20 = 15 THEN 'hover_dwell' WHEN i % 20 = 16 THEN 'resource_sample'
    WHEN i % 20 = 17 THEN 'camera_gesture' WHEN i % 20 = 18 THEN {pick('k % 3', 'compile_stall', 'context_lost', 'graphics_diagnostic')}
    ELSE {pick('k % 4', 'capability_change', 'input_action', 'runtime_error', 'custom')} END AS t
  FROM ranked),
sourced AS (
  SELECT *, CASE WHEN NOT ({_INPUT}) THEN 'mouse' WHEN (i * 7) % 11 < 7 THEN 'mouse' WHEN (i * 7) % 11 < 9 THEN 'touch'
    WHEN (i * 7) % 11 = 9 THEN 'xr-controller' ELSE 'hand' END AS source FROM typed)
"""
    return steps, f"""SELECT i AS event_id, '{PROJECT}' AS project_id, session_id, 'v' || CAST(user_id AS {text}) AS visitor_id, t AS event_type, ts,
  '0.1.0' AS sdk_version, '' AS url, {pick('user_id % 3', 'lobby', 'atrium', 'gallery')} AS scene_id, source, '' AS handedness, '' AS source_id,
  {vec("t = 'pointer_click' AND source IN ('xr-controller', 'hand')", '((i * 41) % 97) / 10e0 - 5.013e0', '1.613e0', '((i * 43) % 89) / 10e0 - 4.517e0')} AS ray_origin,
  {vec("t = 'pointer_click' AND source IN ('xr-controller', 'hand')", '0e0', '0e0', '1e0')} AS ray_direction,
  {vec("t = 'camera_sample'", '((i * 37) % 401) / 20e0 - 10.013e0', '((i * 11) % 41) / 20e0 + 0.007e0', '((i * 53) % 401) / 20e0 - 10.017e0')} AS position,
  {vec("t = 'camera_sample'", '(i * 7) % 11 - 4.863e0', '(i * 5) % 7 - 2.937e0', '(i * 3) % 13 - 6.129e0')} AS direction,
  {vec(_HITS, '((i * 29) % 201) / 10e0 - 10.041e0', '((i * 31) % 97) / 10e0 - 10.041e0', '((i * 23) % 211) / 10e0 - 10.041e0')} AS hit_point,
  {vec("t IN ('pointer_click', 'pointer_move')", '((i * 17) % 100) / 100e0 + 0.003e0', '((i * 19) % 100) / 100e0 + 0.003e0')} AS screen,
  CASE WHEN t IN ('camera_sample', 'pointer_click', 'pointer_move', 'mesh_interaction', 'mesh_visibility', 'hover_dwell') AND i % 9 <> 0 THEN 'mesh_' || CAST(i % 8 AS {text}) ELSE '' END AS mesh,
  CASE t WHEN 'mesh_interaction' THEN {pick('k % 4', 'pick', 'drag', 'hover', 'select')} WHEN 'camera_gesture' THEN {pick('k % 4', 'orbit', 'pan', 'zoom', 'dolly')}
    WHEN 'compile_stall' THEN {pick('(k + user_id) % 2', 'shader', 'pipeline')} WHEN 'capability_change' THEN {pick('i % 3', 'quality', 'graphics-backend', 'feature')}
    WHEN 'input_action' THEN {pick('(k + user_id) % 5', 'jump', 'crouch', 'grab', 'menu', '')} WHEN 'runtime_error' THEN 'error'
    WHEN 'custom' THEN {pick('user_id % 2', 'quest', 'purchase')} ELSE '' END AS name,
  {num(perf, fps)} AS fps, {num(perf, frame)} AS frame_time_ms, {num(perf, frame + ' * 1.5e0')} AS frame_time_p95_ms,
  {num(perf, 'i % 4')} AS long_frames, {num(perf, '1')} AS dpr, CASE WHEN NOT ({perf}) THEN 0e0 WHEN i % 4 = 0 THEN 0e0 WHEN i % 4 = 1 THEN 0.5e0 WHEN i % 4 = 2 THEN 0.8e0 ELSE 1e0 END AS render_scale,
  {num("t IN ('mesh_visibility', 'hover_dwell', 'camera_gesture', 'compile_stall')", 'value * 10')} AS visible_ms,
  {num("t = 'mesh_visibility'", 'value * 4')} AS centered_ms, {num("t = 'mesh_visibility'", '(k % 100) / 100e0')} AS screen_fraction,
  {num(gpu, 'value * 1000')} AS texture_bytes, {num(gpu, 'value * 500')} AS geometry_bytes, {num(gpu, 'value * 30')} AS triangles, {num(gpu, 'value * 20')} AS vertices, {num(gpu, 'value * 4000')} AS js_heap_bytes,
  CASE WHEN t = 'capability_change' THEN {pick('user_id % 2', 'high', 'low')} ELSE '' END AS cap_from, CASE WHEN t = 'capability_change' THEN {pick('(k + user_id) % 2', 'medium', 'low')} ELSE '' END AS cap_to,
  {num("t = 'camera_sample' AND i % 3 <> 0", '1.0471975511965976e0')} AS fov, {num("t = 'camera_sample' AND i % 3 <> 0", '1.777e0')} AS aspect, {num("t = 'camera_sample' AND i % 3 <> 0", '0.1e0')} AS near,
  CASE t WHEN 'session_start' THEN {start} WHEN 'graphics_diagnostic' THEN {diagnostic} WHEN 'custom' THEN {own} ELSE '{{"type":"' || t || '"}}' END AS payload"""


#: Folder of the written table by application and data folder.
_WRITTEN: dict[tuple[str, str], str] = {}

#: Spark runs a stage's operators one by one where their fused method is larger than this.
_FUSED = "spark.sql.codegen.hugeMethodLimit"


def _of_events(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    text = text.replace("{", "{{").replace("}", "}}").replace("FROM events)", "FROM {events})")
    return spark.sql(text, events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def scene_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scene events of one data folder, worked out anew."""
    return _of_events(spark, sf_dir, scene_sql(spark=True))


def write_scene_events(spark: SparkSession, sf_dir: str, path: str) -> None:
    """Write the scene events as the event sink keeps them.

    Only what the steps give is sampled, shuffled and sorted; the many columns of a row are worked out as it is written.
    All rows are of one project, so its folder is named here: Spark drops a column of one value from a sort. Fused into one
    method, those columns are too much for the JVM to compile (over 8,000 bytes), so the limit for fusing is lowered for this write.
    """
    steps, columns = _parts(spark=True)
    columns = columns.replace("{", "{{").replace("}", "}}")

    def widen(rows: DataFrame) -> DataFrame:
        return spark.sql(f"{columns}, event_date FROM {{rows}}", rows=rows.withColumnRenamed("event_type", "t")).drop("project_id")

    rows = _of_events(spark, sf_dir, f"{steps}SELECT * FROM sourced").withColumnRenamed("t", "event_type")
    before = spark.conf.get(_FUSED, None)
    spark.conf.set(_FUSED, 8000)
    try:
        write_events(rows, f"{path}/project_id={PROJECT}", widen=widen)
    finally:
        spark.conf.set(_FUSED, before) if before is not None else spark.conf.unset(_FUSED)


def scene_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scene events of one data folder as the event sink keeps them: written once a session, by project and day.

    Questions read that table, so that their filters prune its days and skip its row groups.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key in _WRITTEN:
        try:
            return spark.read.parquet(_WRITTEN[key])
        except AnalysisException as gone:
            if "PATH_NOT_FOUND" not in str(gone):
                raise
    path = own_folder(spark, "scene-events")
    write_scene_events(spark, sf_dir, path)
    _WRITTEN[key] = path
    return spark.read.parquet(path)
