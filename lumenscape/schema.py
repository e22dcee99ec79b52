"""Schemas, enumerations and limits of scene events."""

from __future__ import annotations

from pyspark.sql import types as T

_VEC = T.ArrayType(T.DoubleType())


def _fields(kind: T.DataType, names: str) -> list[T.StructField]:
    return [T.StructField(n, kind) for n in names.split()]


#: The wide table: one row per event, promoted columns beside the whole event as JSON.
EVENTS = T.StructType([
    *_fields(T.StringType(), "project_id session_id visitor_id event_type"), T.StructField("ts", T.TimestampType()),
    *_fields(T.StringType(), "sdk_version url scene_id source handedness source_id"),
    *_fields(_VEC, "ray_origin ray_direction position direction hit_point screen"), *_fields(T.StringType(), "mesh name"),
    *_fields(T.DoubleType(), "fps visible_ms centered_ms screen_fraction texture_bytes geometry_bytes triangles vertices js_heap_bytes"),
    *_fields(T.StringType(), "cap_from cap_to"),
    *_fields(T.DoubleType(), "frame_time_ms frame_time_p95_ms long_frames dpr render_scale fov aspect near"),
    T.StructField("payload", T.StringType()),
])

NODE_SAMPLES = T.StructType([
    *_fields(T.StringType(), "project_id session_id"), T.StructField("ts", T.TimestampType()),
    *_fields(T.StringType(), "sdk_version scene_id node_id bone_id child_path"), *_fields(_VEC, "position rotation scale"),
])

_RAY = T.StructType(_fields(_VEC, "origin direction"))
#: One permissive superset of the 27 event types as they are sent; absent fields are null.
WIRE_EVENT = T.StructType([
    *_fields(T.StringType(), "type projectId visitorId sessionId sdkVersion url sceneId"), T.StructField("ts", T.LongType()),
    *_fields(_VEC, "position direction target hitPoint point screen rotation scale bounds"), T.StructField("ray", _RAY),
    *_fields(T.StringType(), "mesh hitMesh name phase kind action source handedness sourceId from to reason state severity category backend message code stack nodeId boneId childPath"),
    *_fields(T.DoubleType(), "fps frameTimeMs frameTimeP95Ms frameTimeP99Ms longFrames drawCalls dpr renderScale fov aspect near visibleMs centeredMs maxScreenFraction dwellMs durationMs textureBytes geometryBytes triangles vertices jsHeapBytes orbitDeg rollDeg zoomRatio panDist bytes loadMs ttffMs ttiMs width height button count lineno colno"),
    *_fields(T.BooleanType(), "focused pressed"),
    T.StructField("props", T.MapType(T.StringType(), T.StringType())),
    T.StructField("device", T.MapType(T.StringType(), T.StringType())), T.StructField("scene", T.MapType(T.StringType(), T.StringType())),
    T.StructField("user", T.MapType(T.StringType(), T.StringType())), T.StructField("graphics", T.MapType(T.StringType(), T.StringType())),
])

# The event types and enumerations of the wire format.
EVENT_TYPES = (
    "session_start session_end frame_perf camera_sample node_transform pointer_move pointer_click pointer_down pointer_up camera_gesture "
    "mesh_interaction mesh_visibility hover_dwell compile_stall resource_sample capability_change asset_load scene_change viewport_resize "
    "visibility_change focus_change context_lost context_restored graphics_diagnostic runtime_error input_action custom"
).split()
INPUT_EVENTS = "camera_gesture hover_dwell input_action mesh_interaction pointer_click pointer_down pointer_move pointer_up".split()
XR_SOURCES = "xr-controller hand gaze transient".split()
CAMERA_ALIASES = {"viewer": "arc-rotate", "first-person": "free"}
SEVERITIES = "info warning error fatal".split()
MAX_BATCH = 1000
SCENE_ID = r"^[A-Za-z0-9._:-]{1,64}$"
DEFAULT_SCENE, DEFAULT_SOURCE = "default", "mouse"
