"""From collected batches to the two event tables: read, validate, enrich, flatten, write."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from lumenscape import schema as S
from lumenscape.sources.commits import CommitLog

#: One row per collected batch: the request body and what the collector saw of the client.
BATCHES = "batch_id string, body string, received_at timestamp, ip string, user_agent string"


_STORED = [T.StructField("inserted_at", T.TimestampType()), T.StructField("event_date", T.DateType())]
#: The tables that streaming ingest keeps.
INGESTED = {
    "events": T.StructType([*S.EVENTS.fields, *_STORED]),
    "node_samples": T.StructType([*S.NODE_SAMPLES.fields, *_STORED]),
    "quarantine": "batch_id string, n_events int, reason string",
}


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """Files of one JSON batch a line; the batch id is the hash of its text, so a re-read gives the same ids."""
    lines = spark.read.text(path).withColumnRenamed("value", "body")
    return lines.select(F.sha2("body", 256).alias("batch_id"), "body", F.current_timestamp().alias("received_at"), F.lit("").alias("ip"), F.lit("").alias("user_agent"))


def parse_batches(batches: DataFrame) -> DataFrame:
    """One row a batch: n_events, and events, an array of raw (an event's JSON), v (parsed) and e (its known fields)."""
    each = F.transform("raws", lambda raw: F.struct(raw.alias("raw"), F.try_parse_json(raw).alias("v"), F.from_json(raw, S.WIRE_EVENT).alias("e")))
    parsed = batches.withColumn("raws", F.from_json(F.get_json_object("body", "$.events"), "array<string>"))
    return parsed.select("batch_id", "received_at", "ip", "user_agent", F.coalesce(F.size("raws"), F.lit(0)).alias("n_events"), each.alias("events"))


def _exploded(parsed: DataFrame, events: Column, outer: bool = False) -> DataFrame:
    """outer: a batch without events is one row too; what else judge() gives is kept."""
    kept = ["batch_id", "received_at", "ip", "user_agent", "n_events", *(["reason"] if outer else [])]
    rows = parsed.select(*kept, (F.posexplode_outer if outer else F.posexplode)(events).alias("seq", "x"))
    return rows.select(*kept, "seq", F.col("x.raw").alias("raw"), F.col("x.v").alias("v"), F.col("x.e").alias("e"))


def explode_batches(batches: DataFrame) -> DataFrame:
    """Every event of every batch: batch columns, seq, n_events, raw, v and e."""
    return _exploded(parse_batches(batches), F.col("events"))


# Input sources and graphics interfaces of the wire format.
_SOURCES = " ".join(["mouse", "touch", "stylus", "pen", "keyboard", "gamepad", "xr-controller", "hand", "gaze", "transient", "other"])
_APIS = " ".join(["webgl", "webgl2", "webgpu", "opengl", "opengles", "d3d11", "d3d12", "vulkan", "metal", "unknown"])
_INPUT = {"source?": f"one of {_SOURCES}", "handedness?": "one of left right none", "sourceId?": "text 1 64", "ray?": "object", "ray.origin": "vector 3", "ray.direction": "vector 3"}
_POINTER = {"screen?": "unit vector 2", "hitPoint?": "vector 3", "hitMesh?": "text 0", **_INPUT}
_BUTTON = {**_POINTER, "button?": "whole >= 0"}

# What the wire format asks of the envelope and of each event type. A field with a question mark may be
# absent, but not null; a field of an object is asked for where the object is there. Lengths are in UTF-16 units.
ENVELOPE = {
    "projectId": "text 1 128",
    "visitorId?": "text 0",
    "sessionId": "text 1 128",
    "ts": "whole >= 0",
    "sdkVersion": "text 1 64",
    "url?": "text 0 2048",
    "sceneId?": "scene id",
    "pageMeta?": "object",
    "pageMeta.title?": "text 0 512",
    "pageMeta.referrer?": "text 0 2048",
    "pageMeta.viewport?": "vector 2",
    "pageMeta.devicePixelRatio?": "number > 0",
    "pageMeta.language?": "text 0 35",
}
RULES: dict[str, dict[str, str]] = {
    "session_start": {
        "device?": "object",
        "device.engine?": "one of webgl2 webgpu webgl unknown",
        **{f"device.{n}?": "text 0" for n in ("vendor", "renderer", "browser", "os")},
        **{f"device.{n}?": "number" for n in ("maxTextureSize", "hardwareConcurrency", "deviceMemoryGb")},
        "device.isMobile?": "flag",
        "graphics?": "object",
        "graphics.api?": f"one of {_APIS}",
        "graphics.backend?": "one of metal d3d11 d3d12 vulkan opengl opengles unknown",
        "graphics.apiVersion?": "text 0",
        "graphics.shadingLanguage?": "one of glsl glsl-es wgsl hlsl msl spirv unknown",
        "scene?": "object",
        "scene.description?": "text 0 256",
        "scene.cameraType?": "one of arc-rotate free follow static other",
        "scene.cameraName?": "text 0 128",
        "scene.meshCount?": "whole >= 0",
        "user?": "object",
        "user.id?": "text 0 128",
        "user.traits?": "scalars 64 1024",
        "connector?": "object",
        "connector.name": "text 0",
        "connector.version?": "text 0",
        "connector.coordinateSystem?": "object",
        "connector.coordinateSystem.handedness": "one of left right",
        "connector.coordinateSystem.upAxis?": "one of y z",
        "connector.coordinateSystem.unitScale?": "number > 0",
    },
    "session_end": {"durationMs?": "number >= 0", "reason?": "one of unload hidden manual timeout"},
    "frame_perf": {
        "fps": "number >= 0",
        **{f"{n}?": "number >= 0" for n in ("frameTimeMs", "frameTimeP95Ms", "frameTimeP99Ms", "drawCalls")},
        "longFrames?": "whole >= 0",
        "dpr?": "number > 0",
        "renderScale?": "number > 0",
    },
    "camera_sample": {
        "position": "vector 3",
        "direction": "vector 3",
        "target?": "vector 3",
        "fov?": "number",
        "aspect?": "number > 0",
        "near?": "number > 0",
        "hitPoint?": "vector 3",
        "hitMesh?": "text 0",
    },
    "node_transform": {"nodeId": "text 1 128", "boneId?": "text 1 128", "childPath?": "text 1 512", "position": "vector 3", "rotation": "vector 4", "scale?": "vector 3"},
    "pointer_move": _POINTER,
    "pointer_click": _BUTTON,
    "pointer_down": _BUTTON,
    "pointer_up": _BUTTON,
    "camera_gesture": {
        "kind": "one of orbit pan dolly zoom roll fly navigate",
        "durationMs": "number >= 0",
        **{f"{n}?": "number >= 0" for n in ("orbitDeg", "rollDeg", "panDist")},
        "zoomRatio?": "number > 0",
        **_INPUT,
    },
    "mesh_interaction": {"mesh": "text 1 256", "kind": "one of hover pick click drag select squeeze grab release teleport", "point?": "vector 3", **_INPUT},
    "mesh_visibility": {"mesh": "text 1 256", "visibleMs": "number >= 0", "centeredMs?": "number >= 0", "maxScreenFraction?": "number BETWEEN 0 AND 1", "bounds?": "vector 6"},
    "hover_dwell": {"mesh": "text 1", "dwellMs": "number >= 0", **_INPUT},
    "compile_stall": {"durationMs": "number >= 0", "phase?": "one of shader pipeline material other"},
    "resource_sample": {**{f"{n}?": "number >= 0" for n in ("textureBytes", "geometryBytes", "jsHeapBytes")}, "triangles?": "whole >= 0", "vertices?": "whole >= 0"},
    "capability_change": {"kind": "one of graphics-backend quality device-recovery feature other", "from?": "text 0 64", "to?": "text 0 64", "reason?": "text 0 120"},
    "asset_load": {"name": "text 0 1024", "loadMs": "number >= 0", **{f"{n}?": "number >= 0" for n in ("bytes", "ttffMs", "ttiMs")}},
    "scene_change": {},
    "viewport_resize": {"width": "number > 0", "height": "number > 0", "dpr?": "number > 0"},
    "visibility_change": {"state": "one of visible hidden"},
    "focus_change": {"focused": "flag"},
    "context_lost": {"reason?": "text 0 512"},
    "context_restored": {},
    "graphics_diagnostic": {
        "severity": "one of info warning error fatal",
        "category": "one of context-loss validation out-of-memory shader-compile device-lost fallback",
        "backend?": f"one of {_APIS}",
        "message?": "text 0 1024",
        "code?": "text 0 64",
        "count?": "whole > 0",
    },
    "runtime_error": {
        "kind": "one of error unhandledrejection",
        "message": "text 0 1024",
        "source?": "text 0 1024",
        "lineno?": "whole >= 0",
        "colno?": "whole >= 0",
        "stack?": "text 0 4096",
    },
    "input_action": {"action": "text 1 64", "code?": "text 1 64", "button?": "whole >= 0", "pressed?": "flag", **_INPUT},
    "custom": {"name": "text 1 128", "props?": "scalars 64 1024"},
}


#: Types that a field's value is read as, where the known fields of an event have it so.
_KNOWN = {(f.name, f.dataType.simpleString()) for f in S.WIRE_EVENT.fields} | {("ts", "double")}


def _field_check(field: str, rule: str, event: str, known: str) -> str:
    """SQL for one field of a parsed event; o is what event_problem() has read of the event, an entry a field at its top."""
    path = field.rstrip("?")
    if "." in path:
        of = lambda at: f"try_variant_get({event}, '$.{at}', 'variant')"
        value, absent = of(path), of(path if field.endswith("?") else path.rpartition(".")[0])
        kind = f"schema_of_variant({value})"
    else:
        value, kind = f"o.fields['{path}'].value", f"o.fields['{path}'].kind"
        absent = kind if field.endswith("?") else ""

    def as_type(kind: str) -> str:
        read = f"try_variant_get({value}, '$', '{kind}')"
        return f"coalesce(CAST({known}.`{path}` AS {kind}), {read})" if known and (path, kind) in _KNOWN else read

    # a value that is used twice is read once, as x
    once = lambda t, check: f"transform(array({as_type(t)}), x -> {check})[0]"
    number = "^(BIGINT|DECIMAL|DOUBLE)"
    units = lambda text: f"octet_length(encode({text}, 'UTF-16BE')) div 2"
    word, _, rest = rule.partition(" ")
    if word == "text":
        least, _, most = rest.partition(" ")  # no text has more units than bytes, and only an empty one has none
        bounds = [f"octet_length(x) >= {least}"] if least == "1" else []
        bounds += [f"(octet_length(x) <= {most} OR {units('x')} <= {most})"] if most else []
        check = f"{kind} = 'STRING'" + (f" AND {once('string', ' AND '.join(bounds))}" if bounds else "")
    elif rule == "scene id":
        check = f"{kind} = 'STRING' AND {as_type('string')} RLIKE '{S.SCENE_ID}'"
    elif word == "one":
        names = ", ".join(f"'{name}'" for name in rest.split()[1:])
        check = f"{kind} = 'STRING' AND {as_type('string')} IN ({names})"
    elif word in ("number", "whole"):
        bounds = [f"x {rest}"] if rest else []
        bounds += ["x = floor(x)"] if word == "whole" else []
        check = f"{kind} RLIKE '{number}'" + (f" AND {once('double', ' AND '.join(bounds))}" if bounds else "")
    elif word in ("vector", "unit"):
        inside = "y IS NOT NULL" + (" AND y BETWEEN 0 AND 1" if word == "unit" else "")
        check = f"{kind} RLIKE '^ARRAY<(BIGINT|DECIMAL|DOUBLE)' AND {once('array<double>', f'size(x) = {rule.split()[-1]} AND forall(x, y -> {inside})')}"
    elif word == "flag":
        check = f"{kind} = 'BOOLEAN'"
    elif word == "object":
        check = f"{kind} RLIKE '^OBJECT'"
    else:
        most, letters = rest.split()
        plain = f"schema_of_variant(y) RLIKE '{number[:-1]}|BOOLEAN|VOID)' OR schema_of_variant(y) = 'STRING' AND {units('CAST(y AS STRING)')} <= {letters}"
        check = f"{kind} RLIKE '^OBJECT' AND {once('map<string,variant>', f'size(x) <= {most} AND forall(map_values(x), y -> {plain})')}"
    return f"({absent} IS NULL OR ({check}))" if absent else f"({check})"


def event_problem(event: str = "v", known: str = "") -> str:
    """SQL: why a parsed event is not valid; null if it is. Fields that a type does not know are ignored.

    known: the event's known fields, if they have been read: a value is taken from there once its kind is seen to be right.

    The fields at the top of an event are taken from it once, each with its kind; every rule looks there. Reading a path of
    a variant is the dearest thing here, so what lies deeper is read only where the object above it is there.
    """

    def bad(rules: dict[str, str]) -> str:
        checks = [_field_check(f, r, event, known) for f, r in rules.items() if "." not in f]
        for top in dict.fromkeys(f.partition(".")[0] for f in rules if "." in f):
            below = " AND ".join(_field_check(f, r, event, known) for f, r in rules.items() if f.startswith(f"{top}."))
            checks.append(f"(o.fields['{top}'] IS NULL OR {below})")
        return f"NOT coalesce({' AND '.join(checks)}, false)"

    names = ", ".join(f"'{t}'" for t in S.EVENT_TYPES)
    own = "CASE o.type " + " ".join(f"WHEN '{name}' THEN if({bad(rules)}, '{name}', NULL)" for name, rules in RULES.items() if rules) + " END"
    why = f"CASE WHEN o.type IS NULL THEN 'not an event' WHEN o.type NOT IN ({names}) THEN 'unknown type' WHEN {bad(ENVELOPE)} THEN 'envelope' ELSE {own} END"
    fields = f"transform_values(try_variant_get({event}, '$', 'map<string,variant>'), (k, x) -> named_struct('value', x, 'kind', schema_of_variant(x)))"
    return f"transform(array(named_struct('type', try_variant_get({event}, '$.type', 'string'), 'fields', {fields})), o -> {why})[0]"


def judge(batches: DataFrame, projects: DataFrame) -> DataFrame:
    """parse_batches() with a reason why a batch is rejected; null if it is accepted.

    A batch counts whole or not at all: 1 to 1000 events, all valid, of one known project. It is judged within its own
    row, from one parse of its events; the one join is that with the registered projects, a short list of ids that is
    broadcast. Dealt by project, the batches of a busy one, parsed events and all, would be read by one task.
    """
    parsed = parse_batches(batches)
    named = F.transform("events", lambda x: x["e"]["projectId"])
    flaws = F.expr(f"array_min(transform(events, ev -> {event_problem('ev.v', 'ev.e')}))")
    seen = parsed.select("*", flaws.alias("problem"), F.array_min(named).alias("p0"), F.array_max(named).alias("p1"))
    known = projects.select(F.col("project_id").alias("p0"), F.lit(True).alias("known")).distinct()
    reason = F.when(~F.col("n_events").between(1, S.MAX_BATCH), "batch size").when(F.col("problem").isNotNull(), F.concat(F.lit("invalid: "), "problem")).when(F.col("p0") != F.col("p1"), "several projects").when(F.col("known").isNull(), "unknown project")
    return seen.join(F.broadcast(known), "p0", "left").withColumn("reason", reason).drop("problem", "p0", "p1", "known")


def accepted_events(judged: DataFrame) -> DataFrame:
    """The events of the batches that judge() accepts, one a row."""
    return _exploded(judged, F.when(F.col("reason").isNull(), F.col("events")))


def rejected_batches(judged: DataFrame) -> DataFrame:
    return judged.where("reason is not null").select("batch_id", "n_events", "reason")


def unknown_projects(events: DataFrame, projects: DataFrame) -> DataFrame:
    """Projects that events name and nobody registered, with their batches and events."""
    named = events.where("e.projectId is not null").groupBy(F.col("e.projectId").alias("project_id")).agg(F.countDistinct("batch_id").alias("batches"), F.count(F.lit(1)).alias("events"))
    return named.join(projects.select("project_id").distinct(), "project_id", "left_anti")


def visitor_id(ip: Column, agent: Column, received: Column, secret: str) -> Column:
    """A hash that changes every day; the address is not kept."""
    salt = F.sha2(F.concat(F.lit(f"{secret}:"), F.date_format(received, "yyyy-MM-dd")), 256)
    return F.substring(F.sha2(F.concat_ws("|", ip, agent, salt), 256), 1, 32)


# User agent families, in the order they are tried.
BROWSERS = [("Edge", r"(?i)\bEdg(?:e|A|iOS)?/"), ("Opera", r"(?i)\bOPR/|\bOpera\b"), ("Samsung Internet", r"(?i)\bSamsungBrowser/"), ("Firefox", r"(?i)\bFirefox/|\bFxiOS/"), ("Chrome", r"(?i)\bChrome/|\bCriOS/"), ("Safari", r"(?i)\bSafari/|\bVersion/.*\bMobile\b")]
SYSTEMS = [("iOS", r"(?i)\biPhone\b|\biPad\b|\biPod\b"), ("Android", r"(?i)\bAndroid\b"), ("Windows", r"(?i)\bWindows\b"), ("macOS", r"(?i)\bMac OS X\b|\bMacintosh\b"), ("ChromeOS", r"(?i)\bCrOS\b"), ("Linux", r"(?i)\bLinux\b")]


def agent_family(agent: Column, families: list[tuple[str, str]]) -> Column:
    out = F.when(F.coalesce(agent, F.lit("")) == "", "Other")
    for name, pattern in families:
        out = out.when(agent.rlike(pattern), name)
    return out.otherwise("Other")


def enrich(events: DataFrame, secret: str) -> DataFrame:
    """Set the visitor id, and browser and system of session starts, in e and in raw; address and agent go.

    Both take the place of what the client sent, at the top of the event only; its other fields keep their values,
    written anew as JSON.
    """
    ip, agent = F.coalesce("ip", F.lit("")), F.coalesce("user_agent", F.lit(""))
    events = events.withColumn("visitor", visitor_id(ip, agent, F.col("received_at"), secret))
    family = {"browser": agent_family(agent, BROWSERS), "os": agent_family(agent, SYSTEMS)}
    sent = F.coalesce("e.device", F.create_map().cast("map<string,string>"))
    device = F.map_concat(F.map_filter(sent, lambda k, v: ~k.isin(*family)), F.create_map(*[x for k, v in family.items() for x in (F.lit(k), v)]))
    start = F.col("e.type") == "session_start"
    e = F.col("e").withField("visitorId", F.col("visitor"))
    e = F.when(start, e.withField("device", device)).otherwise(e)

    def fields(path: str, *without: str) -> str:
        names = ", ".join(f"'{w}'" for w in without)
        return f"map_filter(coalesce(try_variant_get(v, '{path}', 'map<string,variant>'), map()), (k, x) -> k NOT IN ({names}))"

    new_device = f"parse_json(to_json(map_concat({fields('$.device', *family)}, map('browser', CAST(browser AS VARIANT), 'os', CAST(os AS VARIANT)))))"
    with_device = F.expr(f"to_json(map_concat({fields('$', 'visitorId', 'device')}, map('visitorId', CAST(visitor AS VARIANT), 'device', {new_device})))")
    without = F.expr(f"to_json(map_concat({fields('$', 'visitorId')}, map('visitorId', CAST(visitor AS VARIANT))))")
    raw = F.when(start, with_device).otherwise(without)
    changed = events.withColumns(family).withColumns({"raw": raw, "new_e": e})
    return changed.drop("e", "ip", "user_agent", "visitor", "v", *family).withColumnRenamed("new_e", "e")


def _or(value: str, default: str) -> Column:
    c = F.col(f"e.{value}")
    return F.when(c.isNotNull() & (c != ""), c).otherwise(default)


def wide_row() -> list[Column]:
    """The columns of the wide table from e and raw: vectors and numbers are never null."""
    vec = lambda c: F.coalesce(c, F.array().cast("array<double>"))
    txt = lambda *names: F.coalesce(*[F.col(f"e.{n}") for n in names], F.lit(""))
    num = lambda *names: F.coalesce(*[F.col(f"e.{n}") for n in names], F.lit(0.0))
    hit = F.when(F.size(F.coalesce("e.hitPoint", F.array().cast("array<double>"))) > 0, F.col("e.hitPoint")).otherwise(F.col("e.point"))
    values = {
        "project_id": F.col("e.projectId"), "session_id": F.col("e.sessionId"), "visitor_id": txt("visitorId"), "event_type": F.col("e.type"), "ts": F.timestamp_millis("e.ts"),
        "sdk_version": txt("sdkVersion"), "url": txt("url"), "scene_id": _or("sceneId", S.DEFAULT_SCENE), "source": _or("source", S.DEFAULT_SOURCE), "handedness": txt("handedness"), "source_id": txt("sourceId"),
        "ray_origin": vec(F.col("e.ray.origin")), "ray_direction": vec(F.col("e.ray.direction")), "position": vec(F.col("e.position")), "direction": vec(F.col("e.direction")), "hit_point": vec(hit), "screen": vec(F.col("e.screen")),
        "mesh": txt("mesh", "hitMesh"), "name": txt("name", "phase", "kind", "action"), "fps": num("fps"), "visible_ms": num("visibleMs", "dwellMs", "durationMs"), "centered_ms": num("centeredMs"), "screen_fraction": num("maxScreenFraction"),
        "texture_bytes": num("textureBytes"), "geometry_bytes": num("geometryBytes"), "triangles": num("triangles"), "vertices": num("vertices"), "js_heap_bytes": num("jsHeapBytes"), "cap_from": txt("from"), "cap_to": txt("to"),
        "frame_time_ms": num("frameTimeMs"), "frame_time_p95_ms": num("frameTimeP95Ms"), "long_frames": num("longFrames"), "dpr": num("dpr"), "render_scale": num("renderScale"), "fov": num("fov"), "aspect": num("aspect"), "near": num("near"),
        "payload": F.col("raw"),
    }
    return [values[f.name].alias(f.name) for f in S.EVENTS.fields]


def _node_row() -> list[Column]:
    """What a node sample has besides the columns of the wide table."""
    empty = F.array().cast("array<double>")
    texts = [F.col("e.nodeId").alias("node_id"), F.coalesce("e.boneId", F.lit("")).alias("bone_id"), F.coalesce("e.childPath", F.lit("")).alias("child_path")]
    return [*texts, F.coalesce("e.rotation", empty).alias("rotation"), F.coalesce("e.scale", empty).alias("scale")]


def _split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    node = F.col("event_type") == "node_transform"
    return rows.where(~node).select(*S.EVENTS.names), rows.where(node).select(*S.NODE_SAMPLES.names)


def split_events(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(wide rows, node samples): node transforms go to their own table."""
    return _split(events.select(*wide_row(), *_node_row()))


def node_events(samples: DataFrame) -> DataFrame:
    """Node samples as node_transform events again; defaults are left out of the JSON."""
    some = lambda c: F.when(F.col(c) != "", F.col(c))
    scale = F.when(F.size("scale") == 3, F.col("scale"))
    payload = F.to_json(F.struct(F.lit("node_transform").alias("type"), F.col("project_id").alias("projectId"), F.col("session_id").alias("sessionId"), F.unix_millis("ts").alias("ts"), F.col("sdk_version").alias("sdkVersion"), F.col("scene_id").alias("sceneId"), F.col("node_id").alias("nodeId"), some("bone_id").alias("boneId"), some("child_path").alias("childPath"), "position", "rotation", scale.alias("scale")))
    return samples.select("project_id", "session_id", "ts", F.lit("node_transform").alias("event_type"), payload.alias("payload"))


def write_events(rows: DataFrame, path: str, mode: str = "append", widen: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Append (or overwrite), partitioned for pruning by project and day and sorted for skipping within files.

    Rows are dealt by ranges of project, day, type and session, so that a busy day is written by many tasks. Dealing samples
    the rows first, so they are worked out twice: widen is given the dealt and sorted rows, with event_date, and adds the columns that have no part in that.
    Rows without project_id are of one project, whose folder path is.
    """
    dated = rows.withColumn("event_date", F.to_date("ts"))
    folders = [c for c in ("project_id", "event_date") if c in dated.columns]
    order = [*folders, *[c for c in ("event_type", "node_id", "session_id", "ts") if c in dated.columns]]
    dealt = dated.repartitionByRange(*order[:-1]).sortWithinPartitions(*order)
    out = (widen(dealt) if widen else dealt).withColumn("inserted_at", F.current_timestamp())
    out.write.mode(mode).partitionBy(*folders).parquet(path)


def ingest_judged(judged: DataFrame, secret: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(wide rows, node samples, rejected batches) of what judge() gives."""
    events, samples = split_events(enrich(accepted_events(judged), secret))
    return events, samples, rejected_batches(judged)


def finished_rows(judged: DataFrame, secret: str) -> DataFrame:
    """What judge() gives as rows that need no more work: each accepted event with all columns of either table, each rejected batch with its reason.

    Kept, it is short and its columns are read one by one; split_finished() takes the three tables from it.
    """
    events = _exploded(judged, F.when(F.col("reason").isNull(), F.col("events")), outer=True)
    return enrich(events, secret).select("batch_id", "n_events", "reason", *wide_row(), *_node_row())


def split_finished(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(wide rows, node samples, rejected batches) of finished_rows()."""
    return *_split(rows.where("reason is null")), rejected_batches(rows)


def ingest(batches: DataFrame, projects: DataFrame, secret: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(wide rows, node samples, rejected batches) of collected batches."""
    return ingest_judged(judge(batches, projects), secret)


def timeline_rows(events: DataFrame, samples: DataFrame) -> DataFrame:
    """Events and node samples as one stream, ordered within a session by ts, rank and payload; unreadable payloads are skipped."""
    both = events.select("project_id", "session_id", "ts", "event_type", "payload", F.lit(0).alias("rank")).unionByName(node_events(samples).withColumn("rank", F.lit(1)))
    return both.where(F.from_json("payload", S.WIRE_EVENT)["type"].isNotNull())


def session_timeline(events: DataFrame, samples: DataFrame, session: str) -> DataFrame:
    """All events of one session by time, wide events before node samples of the same time."""
    here = F.col("session_id") == session
    return timeline_rows(events.where(here), samples.where(here)).orderBy("ts", "rank", "payload").drop("rank")


#: Lines of one NDJSON file at most, or nearly so.
LINES_PER_FILE = 100_000


def write_session_ndjson(timeline: DataFrame, path: str, lines_per_file: int = LINES_PER_FILE) -> None:
    """One JSON text a line, in order of session and time: many short sessions a file, a long session in several.

    Beside lines/ an index tells which lines of which file (counted from 0) are a session's, so that one is read without the others.
    """
    order = ["session_id", "ts", "payload"]
    # as many ranges as Spark deals out, whatever the number of files: bounds are sampled from short keys
    dealt = timeline.select(*order).repartitionByRange("session_id", "ts").sortWithinPartitions(*order)
    number = F.monotonically_increasing_id()
    placed = dealt.select("session_id", F.shiftright(number, 33).alias("part"), number.bitwiseAND((1 << 33) - 1).alias("at"), F.regexp_replace("payload", "[\\r\\n]+", " ").alias("value"))
    placed.write.parquet(f"{path}/placed")  # lines are numbered once, for the texts and for the index
    rows = timeline.sparkSession.read.parquet(f"{path}/placed")
    most = rows.agg(F.max("at")).first()[0] or 0  # of any range
    place = [(F.col("part") * (most // lines_per_file + 1) + F.expr(f"at div {lines_per_file}")).alias("file"), (F.col("at") % lines_per_file).alias("line")]
    kept = rows.select("session_id", *place, "value")
    kept.repartition("file").sortWithinPartitions("file", "line").select("file", "value").write.partitionBy("file").text(f"{path}/lines")
    kept.groupBy("session_id", "file").agg(F.min("line").alias("first"), F.max("line").alias("last")).sort("session_id").write.parquet(f"{path}/index")


def read_session_ndjson(spark: SparkSession, path: str, session: str) -> DataFrame:
    """place, value: the lines of one session in their order. Only its files are opened, each of which a task can hold."""
    found = spark.read.parquet(f"{path}/index").where(F.col("session_id") == session).collect()  # a row for each file
    if not found:
        return spark.createDataFrame([], "place long, value string")
    files = spark.read.option("basePath", f"{path}/lines").text([f"{path}/lines/file={r['file']}" for r in found], wholetext=True)
    ranges = F.create_map(*[x for r in found for x in (F.lit(r["file"]), F.struct(F.lit(r["first"]).alias("first"), F.lit(r["last"]).alias("last")))])
    lines = files.select(F.col("file").cast("long").alias("file"), F.posexplode(F.split("value", "\n")).alias("line", "value"))
    mine = lines.where(F.col("line").between(ranges[F.col("file")]["first"], ranges[F.col("file")]["last"]))
    return mine.select((F.col("file") * (1 << 33) + F.col("line")).alias("place"), "value").orderBy("place")


def read_ndjson(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(events, one row with the number of skipped lines) of a file with one event a line."""
    lines = spark.read.text(path).where(F.trim("value") != "").withColumn("e", F.from_json("value", S.WIRE_EVENT))
    good = F.col("e").isNotNull() & F.col("e.type").isNotNull()
    return lines.where(good).select("e.*"), lines.agg(F.count_if(~good).alias("skipped"))


def session_meta(events: DataFrame) -> DataFrame:
    """First session start of each session: time, device, scene and user as JSON."""
    part = lambda p: F.get_json_object("payload", f"$.{p}").alias(p)
    starts = events.where(F.col("event_type") == "session_start").groupBy("project_id", "session_id").agg(F.min(F.struct("ts", "payload")).alias("first"))
    return starts.select("project_id", "session_id", F.col("first.ts").alias("started_at"), F.col("first.payload").alias("payload")).select("project_id", "session_id", "started_at", part("device"), part("scene"), part("user"))


_PROXY_KEY = ["project_id", "scene_id"]


def current_proxies(log: DataFrame) -> DataFrame:
    """Last write of every scene from a log of writes; a null label keeps the one before."""
    rest = [c for c in log.columns if c not in (*_PROXY_KEY, "label")]
    newest = F.max_by(F.struct(*rest), "updated_at").alias("newest")
    label = F.max_by("label", F.when(F.col("label").isNotNull(), F.col("updated_at"))).alias("label")
    return log.groupBy(*_PROXY_KEY).agg(newest, label).select(*[F.col(f"newest.{c}").alias(c) if c in rest else F.col(c) for c in log.columns])


class SceneRegistry:
    """Scene proxies as a snapshot and the writes after it: the current view reads no more than those."""

    def __init__(self, spark: SparkSession, folder: str):
        self.log = CommitLog(spark, folder)

    def put(self, proxies: DataFrame, writer: str, number: int) -> bool:
        """Add writes (project_id, scene_id, updated_at, label, meshes, ...); the same write of a writer counts once."""
        return self.log.commit(writer, number, {"proxies": lambda path: proxies.write.mode("overwrite").parquet(path)})

    def snapshot(self, number: int) -> int:
        """Put the current view in the place of all writes so far; how many commits there were."""
        return self.log.compact(number, {"proxies": lambda rows, path: current_proxies(rows).write.mode("overwrite").parquet(path)})

    def current(self) -> DataFrame:
        return current_proxies(self.log.read("proxies").drop("commit"))


def proxy(current: DataFrame, project: str, scene: str) -> DataFrame:
    return current.where((F.col("project_id") == project) & (F.col("scene_id") == scene))


def list_proxies(current: DataFrame, project: str) -> DataFrame:
    return current.where(F.col("project_id") == project).drop("meshes").orderBy(F.desc("updated_at"), "scene_id")


def merge_proxies(current: DataFrame, scenes: list[str]) -> DataFrame:
    """Meshes of the scenes in their order; the first of a name counts."""
    rank = F.array_position(F.array(*[F.lit(s) for s in scenes]), F.col("scene_id"))
    each = current.where(F.col("scene_id").isin(scenes)).select(rank.alias("rank"), "scene_id", F.posexplode("meshes").alias("at", "mesh")).select("rank", "at", "scene_id", "mesh.*")
    w = Window.partitionBy("name").orderBy("rank", "at")
    return each.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn", "rank", "at")


MESH = T.StructType([T.StructField("name", T.StringType()), T.StructField("aabb", T.ArrayType(T.DoubleType())), T.StructField("path", T.StringType())])
