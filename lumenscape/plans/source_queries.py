"""Registered queries of sources, sinks and streams: the scene events sent, stored and streamed again."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lumenscape.functions import filters, geometry as g
from lumenscape.operators import meshes, spatial, volume
from lumenscape.operators.rollups import Rollups
from lumenscape.plans.analytics import _BUCKET, _FREE, _HITS, _MS, _PATHS, _STEPS, _TOP, ALL, ANALYTICS, N, PART, Query
from lumenscape.plans.reads import read
from lumenscape.plans.scene_view import PROJECT
from lumenscape.schema import MAX_BATCH
from lumenscape.sources import ingest
from lumenscape.sources.folders import own_folder
from lumenscape.streaming import jobs, live

_RECEIVED = "2024-02-01"


def _projects(e: DataFrame) -> DataFrame:
    return e.sparkSession.createDataFrame([(PROJECT,)], "project_id string")


def as_batches(e: DataFrame) -> DataFrame:
    """The view as it would be sent: a session's events in batches of the wire limit at most, rows of JSON."""
    some = lambda c, n: F.when(F.size(c) == n, F.col(c)).alias(_camel(c))
    word = lambda c: F.when(F.col(c) != "", F.col(c))
    above = lambda c: F.when(F.col(c) > 0, F.col(c)).alias(c)
    same = lambda c, n="": F.col(c).alias(n or _camel(c))
    wire = F.struct(
        same("event_type", "type"),
        *[same(c) for c in ("project_id", "session_id", "sdk_version", "scene_id", "source", "fps", "visible_ms")],
        g.epoch_ms(F.col("ts")).alias("ts"),
        *[some(c, n) for c, n in (("position", 3), ("direction", 3), ("hit_point", 3), ("screen", 2))],
        *[above(c) for c in ("fov", "aspect", "near")],
        same("visible_ms", "dwellMs"),
        same("visible_ms", "durationMs"),
        F.coalesce(word("mesh"), F.lit("floor")).alias("mesh"),
        F.coalesce(word("name"), F.lit("orbit")).alias("kind"),
        F.coalesce(word("name"), F.lit("none")).alias("action"),
        F.when(F.col("event_type") == "custom", F.col("name")).alias("name"),
        F.lit("warning").alias("severity"),
        F.lit("validation").alias("category"),
        F.lit("text").alias("message"),
    )
    listed = F.sort_array(F.collect_list(F.struct("event_id", F.to_json(wire).alias("j"))))
    body = F.concat(F.lit('{"schemaVersion":"1.0","events":['), F.array_join(F.transform(listed, lambda x: x["j"]), ","), F.lit("]}"))
    part = F.floor((F.row_number().over(Window.partitionBy("session_id").orderBy("event_id")) - 1) / MAX_BATCH)
    per = e.withColumn("part", part).groupBy("session_id", "part").agg(body.alias("body"))
    return _sent(per, F.concat_ws("#", "session_id", "part"), F.lit("ip"), F.lit("Chrome/1.0 Linux"))


def _camel(name: str) -> str:
    first, *rest = name.split("_")
    return first + "".join(map(str.title, rest))


def _sent(rows: DataFrame, batch_id: Column, ip: Column, agent: Column, received: Column | None = None) -> DataFrame:
    at = F.lit(_RECEIVED).cast("timestamp") if received is None else received
    return rows.select(batch_id.alias("batch_id"), "body", at.alias("received_at"), ip.alias("ip"), agent.alias("user_agent"))


def _bodies(*events: Column) -> Column:
    return F.to_json(F.struct(F.lit("1.0").alias("schemaVersion"), F.array(*events).alias("events")))


def ingested(e: DataFrame) -> DataFrame:
    wide, _, _ = ingest.ingest(as_batches(e), _projects(e), "secret")
    return wide


def flawed_batches(e: DataFrame) -> DataFrame:
    """Every event as a batch of its own, with one of thirteen flaws by its number, or none."""
    flaw = F.col("event_id") % 14
    kinds = {1: "nonsense", 6: "frame_perf", 7: "pointer_click", 8: "mesh_interaction", 9: "pointer_click", 10: "capability_change", 11: "node_transform"}
    kind = F.lit("scene_change")
    for n, name in kinds.items():
        kind = F.when(flaw == n, name).otherwise(kind)
    only = lambda n, value, name: F.when(flaw == n, value).alias(name)
    three = F.array(*[F.lit(0.5)] * 3)

    def event(project: Column) -> Column:
        return F.struct(
            kind.alias("type"),
            project.alias("projectId"),
            F.when(flaw == 2, "").otherwise(F.col("session_id")).alias("sessionId"),
            F.when(flaw == 3, F.lit(-1)).otherwise(g.epoch_ms(F.col("ts"))).alias("ts"),
            F.lit("0.1.0").alias("sdkVersion"),
            F.when(flaw == 5, "no spaces").otherwise(F.col("scene_id")).alias("sceneId"),
            only(6, F.lit(-1.0), "fps"),
            only(7, F.array(F.lit(1.5), F.lit(0.0)), "screen"),
            only(8, F.lit("m"), "mesh"),
            F.when(flaw == 8, "nonsense").when(flaw == 10, "backend").alias("kind"),
            only(9, F.lit(-1.5), "button"),
            only(11, F.lit("n"), "nodeId"),
            only(11, F.lit(""), "childPath"),
            only(11, three, "position"),
            only(11, F.array(*[F.lit(0.5)] * 4), "rotation"),
        )

    one, other = event(F.when(flaw == 4, "p9").otherwise(F.lit(PROJECT))), event(F.lit("p8"))
    body = F.when(flaw == 12, _bodies(one, other)).when(flaw == 13, F.lit('{"events":[]}')).otherwise(_bodies(one))
    return _sent(e.withColumn("body", body), F.col("event_id").cast("string"), F.lit("ip"), F.lit(""))


# Agents that sessions are sent with, and what family each is of.
_AGENTS = [
    ("Mozilla/5.0 (Windows NT 10.0) Chrome/126.0 Safari/537.36 Edg/126.0", "Edge", "Windows"),
    ("Mozilla/5.0 (X11; Linux x86_64; rv:127.0) Gecko Firefox/127.0", "Firefox", "Linux"),
    ("Mozilla/5.0 (iPhone; CPU iPhone OS 17_5 like Mac OS X) Version/17.5 Mobile Safari/604.1", "Safari", "iOS"),
    ("Mozilla/5.0 (Linux; Android 14) SamsungBrowser/25.0 Chrome/121.0 Mobile Safari/537.36", "Samsung Internet", "Android"),
    ("curl/8.0", "Other", "Other"),
]


def session_starts_sent(e: DataFrame) -> DataFrame:
    """Session starts with an agent by number, and a visitor id and a device of the client's own."""
    agent = F.get(F.array(*[F.lit(a) for a, _, _ in _AGENTS]), (F.col("event_id") % len(_AGENTS)).cast("int"))
    device = F.struct(F.lit("webgl").alias("engine"), F.lit("mine").alias("browser"), F.col("event_id").alias("cores"))
    start = F.struct(
        F.lit("session_start").alias("type"),
        F.lit('client "quoted" id').alias("visitorId"),
        F.lit(PROJECT).alias("projectId"),
        F.col("session_id").alias("sessionId"),
        g.epoch_ms(F.col("ts")).alias("ts"),
        F.lit("0.1.0").alias("sdkVersion"),
        device.alias("device"),
    )
    rows = e.where("event_type = 'session_start'").withColumn("body", _bodies(start))
    return _sent(rows, F.col("session_id"), F.col("visitor_id"), agent, F.col("ts"))


def enriched_starts(e: DataFrame) -> DataFrame:
    wide, _, _ = ingest.ingest(session_starts_sent(e), _projects(e), "secret")
    read = lambda path: g.json_text("payload", *path.split("."))
    fields = {"browser": "device.browser", "os": "device.os", "engine": "device.engine", "cores": "device.cores", "in_payload": "visitorId"}
    return wide.select("session_id", "visitor_id", *[read(p).alias(n) for n, p in fields.items()], F.contains("payload", F.lit("client")).alias("leaks"))


def _case(key: str, values: list[str]) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


def node_batches(e: DataFrame) -> DataFrame:
    """Every camera sample sent as the transform of a node; each third a bone, each third a child."""
    number = F.col("event_id")
    node = F.struct(
        F.lit("node_transform").alias("type"),
        F.lit(PROJECT).alias("projectId"),
        F.col("session_id").alias("sessionId"),
        g.epoch_ms(F.col("ts")).alias("ts"),
        F.lit("0.1.0").alias("sdkVersion"),
        F.concat(F.lit("n"), number % 5).alias("nodeId"),
        F.when(number % 3 == 0, "spine").alias("boneId"),
        F.when(number % 3 == 1, "arm/hand").alias("childPath"),
        F.col("position"),
        F.array(*[F.lit(x) for x in (0.0, 0.0, 0.0, 1.0)]).alias("rotation"),
        F.when(number % 2 == 0, F.array(*[F.lit(2.0)] * 3)).alias("scale"),
    )
    return _sent(e.where("event_type = 'camera_sample'").withColumn("body", _bodies(node)), number.cast("string"), F.lit("ip"), F.lit(""))


def node_samples(e: DataFrame) -> DataFrame:
    _, samples, _ = ingest.ingest(node_batches(e), _projects(e), "secret")
    return samples


def node_rows(e: DataFrame) -> DataFrame:
    samples = node_samples(e)
    read = lambda p: F.coalesce(g.json_text("payload", p), F.lit("-")).alias(p)
    again = ingest.node_events(samples)
    return again.select("session_id", "ts", "event_type", read("nodeId"), read("boneId"), read("childPath"), read("sceneId"), F.coalesce(F.size(F.from_json(F.get_json_object("payload", "$.scale"), "array<double>")), F.lit(-1)).alias("scales"))


def timeline(e: DataFrame) -> DataFrame:
    """All timelines, in the order of session_timeline(), as numbered rows."""
    rows = ingest.timeline_rows(e.withColumn("ts", F.timestamp_millis(F.unix_millis("ts"))), node_samples(e))
    w = Window.partitionBy("session_id").orderBy("ts", "rank", "payload")
    return rows.select("session_id", "event_type", F.row_number().over(w).cast("long").alias("place"))


def _ndjson(e: DataFrame) -> str:
    """Timelines of all sessions as one JSON text a line, some sessions in two files."""
    path = own_folder(e.sparkSession, "ndjson")
    ingest.write_session_ndjson(e.select("session_id", "ts", "payload"), path, lines_per_file=2000)
    return path


def ndjson_round_trip(e: DataFrame) -> DataFrame:
    """All lines written and read again, beside lines that are no events."""
    path = _ndjson(e)
    broken = e.where("event_type = 'pointer_move'").select(F.concat(F.lit("{broken "), "event_id").alias("value"))
    broken.write.text(f"{path}/lines/file=-1")
    good, skipped = ingest.read_ndjson(e.sparkSession, f"{path}/lines")
    return good.groupBy("type").agg(volume.count().alias("count")).union(skipped.select(F.lit("skipped"), "skipped"))


def ndjson_of_sessions(e: DataFrame) -> DataFrame:
    """Three sessions read by the index."""
    path = _ndjson(e)
    each = [ingest.read_session_ndjson(e.sparkSession, path, s).select(F.lit(s).alias("session_id"), "place", g.json_text("value", "type").alias("type")) for s in ("u7-w0", "u8-w1", "u9-w2")]
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("place")).cast("long")
    return reduce(DataFrame.union, each).select("session_id", "type", place.alias("place"))


def proxy_log(e: DataFrame) -> DataFrame:
    """An append-only log of scene proxies: one write a scene and day, with the boxes of that day's hits."""
    hit = [F.get("hit_point", i) for i in range(3)]
    day = F.to_date("ts")
    boxes = e.where("mesh <> '' and size(hit_point) = 3").groupBy("project_id", "scene_id", day.alias("day"), F.col("mesh").alias("name"))
    boxes = boxes.agg(F.array(*[F.min(h) for h in hit], *[F.max(h) for h in hit]).alias("aabb"))
    mesh = F.struct("name", "aabb", F.concat(F.lit("root/"), "name").alias("path"))
    log = boxes.groupBy("project_id", "scene_id", "day").agg(F.sort_array(F.collect_list(mesh)).alias("meshes"))
    label = F.when(F.day("day") % 3 == 0, F.concat(F.lit("v"), F.day("day")))
    return log.select("project_id", "scene_id", F.col("day").cast("timestamp").alias("updated_at"), label.alias("label"), "meshes")


def registry(e: DataFrame) -> ingest.SceneRegistry:
    """The writes of proxy_log() in four commits, each sent twice; after the third the view so far takes their place."""
    kept = ingest.SceneRegistry(e.sparkSession, own_folder(e.sparkSession, "registry"))
    for number in range(4):
        writes = proxy_log(e.where(F.floor(F.day("event_date") / 8) == number))  # reads these days only
        for _ in range(2):
            kept.put(writes, "sent", number)
        if number == 2:
            kept.snapshot(0)
    return kept


_DAYS = "SELECT scene_id, CAST(ts AS DATE) AS day, mesh, min(hit_point[1]) AS x0, max(hit_point[3]) AS z1 FROM e WHERE mesh <> '' AND len(hit_point) = 3 GROUP BY ALL"
_SCENES = f"""
        SELECT scene_id, label, CAST(day AS TIMESTAMP) AS updated_at
        FROM (SELECT scene_id, day, last_value(CASE WHEN day(day) % 3 = 0 THEN 'v' || day(day) END IGNORE NULLS) OVER (PARTITION BY scene_id ORDER BY day) AS label
              FROM (SELECT DISTINCT scene_id, day FROM ({_DAYS})))
        QUALIFY row_number() OVER (PARTITION BY scene_id ORDER BY day DESC) = 1"""
_LAST = f"SELECT d.* FROM ({_DAYS}) d JOIN (SELECT scene_id, max(day) AS day FROM ({_DAYS}) GROUP BY ALL) USING (scene_id, day)"


# what a read takes at most, and what is over it
_ALLOWED = [("floor_plan", "limit", 10_000), ("world_heatmap", "limit", 1000), ("world_heatmap", "cell_size", 1000), ("timeseries", "interval", 31_536_000)]
_REFUSED = [("floor_plan", "limit", 10_001), ("world_heatmap", "limit", 1001), ("world_heatmap", "cell_size", 1001), ("timeseries", "interval", 31_536_001), ("rage_clicks", "min_repeats", 1), ("fps_histogram", "bucket", 241)]


def bounds_of_reads(e: DataFrame) -> DataFrame:
    """How many rows reads give whose options are at their bounds; -1 for those that are refused."""
    out = []
    for name, option, value in [*_ALLOWED, *_REFUSED]:
        what = F.lit(f"{name} {option} {value}").alias("what")
        try:
            out.append(read(e, name, PROJECT, **{option: value}).agg(volume.count().alias("n")).select(what, "n"))
        except ValueError:
            out.append(e.sparkSession.range(1).select(what, F.lit(-1).cast("long").alias("n")))
    return reduce(DataFrame.union, out)


def merged_rollups(e: DataFrame) -> Rollups:
    """Rollups of the events in three batches that share all days, each sent twice, with the first two merged before the last."""
    kept = Rollups(e.sparkSession, own_folder(e.sparkSession, "rollups"))
    for number in range(3):
        for _ in range(2):
            kept.append(e.where(F.col("event_id") % 3 == number), "sent", number)
        if number == 1:
            kept.compact(0)
    return kept


def rollups_of_stream(e: DataFrame) -> Rollups:
    """Rollups kept by a stream of files that arrive in two turns, each with events of all days."""
    spark = e.sparkSession
    source, kept, state = own_folder(spark, "stream-source"), own_folder(spark, "rollups"), own_folder(spark, "stream-state")
    for turn in range(2):
        e.where(F.col("event_id") % 2 == turn).write.mode("append").parquet(source)
        jobs.streaming_rollups(jobs.read_event_stream(spark, source), kept, state).awaitTermination()
    return Rollups(spark, kept)


def streamed(e: DataFrame, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """make() over the events as a stream of files, run until all are read; results are kept as a table."""
    spark = e.sparkSession
    source, out = own_folder(spark, "stream-source"), own_folder(spark, "stream-result")
    e.write.parquet(source)
    keep = lambda rows, _: rows.write.mode("overwrite").parquet(out)
    query = make(jobs.read_event_stream(spark, source)).writeStream.outputMode("complete").foreachBatch(keep)
    query.option("checkpointLocation", own_folder(spark, "stream-state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def appended(e: DataFrame, make: Callable[[DataFrame], DataFrame], rows: DataFrame | None = None) -> DataFrame:
    """As streamed(), for streams whose rows are appended."""
    spark = e.sparkSession
    source, out = own_folder(spark, "stream-source"), own_folder(spark, "stream-result")
    (e if rows is None else rows).write.parquet(source)
    query = make(jobs.read_event_stream(spark, source)).writeStream.option("checkpointLocation", own_folder(spark, "stream-state"))
    query.format("parquet").option("path", out).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


class _Stopped(Exception):
    """Stands for a lost driver."""


#: Events of one file of the stream of batches, about, and files of a micro-batch.
EVENTS_PER_FILE, FILES_PER_BATCH = 400_000, 3


def _files(e: DataFrame) -> int:
    """Of how many files a stream of batches is: the more events, the more files, and micro-batches of the same size."""
    return max(FILES_PER_BATCH, -(-e.count() // EVENTS_PER_FILE))


def stream_ingested(e: DataFrame, stops: tuple[str, ...] = ()) -> DataFrame:
    """Rows by event type and rejected batches by reason of a stream of batches, two micro-batches or more, each of a bounded size.

    stops: the stream breaks down right after that part of a commit is written, once for each, and is started again.
    """
    spark = e.sparkSession
    source, out, state = own_folder(spark, "stream-source"), own_folder(spark, "stream-result"), own_folder(spark, "stream-state")
    files = _files(e)
    as_batches(e).repartition(files).write.parquet(source)
    flawed_batches(e).repartition(files).write.mode("append").parquet(source)
    for stop in (*stops, None):

        def after(part: str, stop: str | None = stop) -> None:
            if part == stop:
                raise _Stopped(part)

        query = jobs.streaming_ingest(jobs.read_event_stream(spark, source, FILES_PER_BATCH), _projects(e), "secret", out, state, after)
        try:
            query.awaitTermination()
        except StreamingQueryException as failed:
            if stop is None or "_Stopped" not in str(failed):
                raise
    jobs.compact_ingested(spark, out, 0)
    kept = jobs.ingested(spark, out, "events").groupBy(F.lit("events").alias("part"), F.col("event_type").alias("what")).agg(volume.count().alias("count"))
    return kept.union(jobs.ingested(spark, out, "quarantine").groupBy(F.lit("quarantine"), "reason").agg(volume.count()))


def session_feed(e: DataFrame) -> DataFrame:
    """The feed of one session: every other event is stored already, the rest arrives while it is read."""
    spark = e.sparkSession
    source, out = own_folder(spark, "stream-source"), own_folder(spark, "stream-result")
    arrived = e.withColumn("received_at", F.col("ts"))
    arrived.where("event_id % 2 = 1").write.parquet(source)
    query = jobs.session_feed(arrived.where("event_id % 2 = 0"), jobs.read_event_stream(spark, source), PROJECT, "u7-w0", out, own_folder(spark, "stream-state"))
    query.awaitTermination()
    return spark.read.parquet(out).select("session_id", "event_id", "phase")


def _clocked(e: DataFrame) -> DataFrame:
    """Events that arrive ten a second, in the order of their numbers; each fortieth ends its session."""
    kind = F.when(F.col("event_id") % 40 == 0, "session_end").otherwise(F.col("event_type"))
    return e.withColumn("event_type", kind).withColumn("received_at", F.timestamp_millis(F.col("event_id") * 100 + 1_704_067_200_000))


# the moment of the last arrival; stays that end with a session_end or before the last 30 s are over
_NOW_MS = "(SELECT max(event_id) * 100 + 1704067200000 FROM e)"
_STAYS = """
SELECT *, sum(CASE WHEN r - before > 30000 OR ended THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY r) AS stay
FROM (SELECT *, lag(r) OVER (PARTITION BY session_id ORDER BY r) AS before, coalesce(lag(ends) OVER (PARTITION BY session_id ORDER BY r), false) AS ended
      FROM (SELECT *, event_id * 100 + 1704067200000 AS r, event_id % 40 = 0 AS ends FROM e))"""
_LIVE = f"""
SELECT session_id, stay, min(r) AS started_at, max(r) AS last_seen, any_value(scene_id) AS scene_id, any_value(visitor_id) AS visitor_id
FROM ({_STAYS})
GROUP BY session_id, stay
HAVING {_NOW_MS} - max(r) <= 30000 AND NOT arg_max(ends, r)"""
_LIVE_ROWS = f"SELECT session_id, started_at, last_seen, scene_id, visitor_id FROM ({_LIVE})"


def _present(e: DataFrame) -> tuple[DataFrame, Column]:
    """Sessions that are live when the last event arrives, and that moment."""
    rows = _clocked(e)
    now = F.lit(rows.agg(F.max("received_at")).first()[0])
    return jobs.presence_at(rows, now), now


def live_state(e: DataFrame, read: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    """What read() finds in the live state after the events have streamed in: the first half, then, after a stop, the rest."""
    spark = e.sparkSession
    source, out, state = own_folder(spark, "stream-source"), own_folder(spark, "stream-result"), own_folder(spark, "stream-state")
    rows = _clocked(e).select("project_id", "session_id", "event_type", "visitor_id", "scene_id", "received_at", "event_id", "payload")
    middle = rows.agg(F.max("event_id")).first()[0] // 2
    for part in (F.col("event_id") <= middle, F.col("event_id") > middle):
        rows.where(part).write.mode("append").parquet(source)
        live.start_live(jobs.read_event_stream(spark, source), out, state).awaitTermination()
    return read(spark, state)


def _ms(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.unix_millis(c) for c in columns})


_REGION = filters.parse_region("-8,-8,-8,8,8,8")
_WEEK = filters.preset_range("7d", datetime(2024, 1, 20))
_IN_WEEK = "ts >= TIMESTAMP '2024-01-13' AND ts < TIMESTAMP '2024-01-20'"
_FLAWS = {
    1: "invalid: unknown type", 2: "invalid: envelope", 3: "invalid: envelope", 4: "unknown project", 5: "invalid: envelope", 6: "invalid: frame_perf", 7: "invalid: pointer_click",
    8: "invalid: mesh_interaction", 9: "invalid: pointer_click", 10: "invalid: capability_change", 11: "invalid: node_transform", 12: "several projects", 13: "batch size",
}
_REASON = "CASE event_id % 14 " + " ".join(f"WHEN {n} THEN '{why}'" for n, why in _FLAWS.items()) + " END"

_INGESTED = f"""
SELECT 'events' AS part, event_type AS what, {N} AS count
FROM (SELECT event_type FROM e UNION ALL SELECT 'scene_change' FROM e WHERE event_id % 14 = 0) GROUP BY ALL
UNION ALL SELECT 'quarantine', {_REASON} AS reason, {N} FROM e WHERE event_id % 14 <> 0 GROUP BY reason"""

SOURCES: dict[str, Query] = {
    "ingest_event_counts": Query(
        lambda e: ingested(e).groupBy("event_type", "scene_id").agg(volume.count().alias("count"), F.sum(F.size("hit_point")).alias("coordinates")),
        f"SELECT event_type, scene_id, {N} AS count, CAST(sum(len(hit_point)) AS BIGINT) AS coordinates FROM e GROUP BY ALL",
    ),
    "ingest_wide_columns": Query(
        lambda e: ingested(e).groupBy("event_type", "mesh", "name", "source").agg(
            *[F.sum(c).alias(c) for c in ("fps", "visible_ms", "fov")], F.sum(F.get("screen", 0)).alias("screen"), F.min(F.unix_millis("ts")).alias("first"), F.max("session_id").alias("last_session"),
        ),
        """
        SELECT event_type, coalesce(nullif(mesh, ''), 'floor') AS mesh, coalesce(nullif(name, ''), 'orbit') AS name, source,
          sum(fps) AS fps, sum(visible_ms) AS visible_ms, sum(fov) AS fov, sum(screen[1]) AS screen, min(epoch_us(ts) // 1000) AS first, max(session_id) AS last_session
        FROM e
        GROUP BY 1, 2, 3, 4""",
        "fps visible_ms fov screen",
    ),
    "ingest_rejections": Query(
        lambda e: ingest.ingest(flawed_batches(e), _projects(e), "secret")[2].groupBy("reason").agg(volume.count().alias("batches"), F.sum("n_events").cast("long").alias("events")),
        f"""
        SELECT reason, {N} AS batches, CAST(sum(events) AS BIGINT) AS events
        FROM (SELECT {_REASON} AS reason, CASE event_id % 14 WHEN 12 THEN 2 WHEN 13 THEN 0 ELSE 1 END AS events FROM e)
        WHERE reason IS NOT NULL
        GROUP BY reason""",
    ),
    "ingest_unknown_projects": Query(
        lambda e: ingest.unknown_projects(ingest.explode_batches(flawed_batches(e)), _projects(e)),
        f"""
        SELECT project_id, {N} AS batches, {N} AS events
        FROM (SELECT CASE event_id % 14 WHEN 4 THEN 'p9' WHEN 12 THEN 'p8' END AS project_id FROM e)
        WHERE project_id IS NOT NULL
        GROUP BY project_id""",
    ),
    "ingest_enriched_starts": Query(
        enriched_starts,
        f"""
        SELECT session_id, id AS visitor_id, {_case('event_id % 5', [b for _, b, _ in _AGENTS])} AS browser, {_case('event_id % 5', [s for _, _, s in _AGENTS])} AS os,
          'webgl' AS engine, CAST(event_id AS VARCHAR) AS cores, id AS in_payload, false AS leaks
        FROM (SELECT *, substr(sha256(visitor_id || '|' || {_case('event_id % 5', [a for a, _, _ in _AGENTS])} || '|' || sha256('secret:' || strftime(ts, '%Y-%m-%d'))), 1, 32) AS id
              FROM e WHERE event_type = 'session_start')""",
    ),
    "node_rows": Query(
        node_rows,
        """
        SELECT session_id, ts, 'node_transform' AS event_type, 'n' || (event_id % 5) AS nodeId, CASE WHEN event_id % 3 = 0 THEN 'spine' ELSE '-' END AS boneId,
          CASE WHEN event_id % 3 = 1 THEN 'arm/hand' ELSE '-' END AS childPath, 'default' AS sceneId, CASE WHEN event_id % 2 = 0 THEN 3 ELSE -1 END AS scales
        FROM e WHERE event_type = 'camera_sample'""",
        times="ts",
    ),
    "session_timelines": Query(
        timeline,
        f"""
        SELECT session_id, event_type, row_number() OVER (PARTITION BY session_id ORDER BY ms, rank, payload) AS place
        FROM (SELECT session_id, event_type, {_MS} AS ms, 0 AS rank, payload FROM e
              UNION ALL SELECT session_id, 'node_transform', {_MS}, 1, '' FROM e WHERE event_type = 'camera_sample')""",
    ),
    "ndjson_round_trip": Query(
        ndjson_round_trip,
        f"SELECT event_type AS type, {N} AS count FROM e GROUP BY ALL UNION ALL SELECT 'skipped', {N} FROM e WHERE event_type = 'pointer_move'",
    ),
    "ndjson_of_sessions": Query(
        ndjson_of_sessions,
        """
        SELECT session_id, event_type AS type, row_number() OVER (PARTITION BY session_id ORDER BY ts, payload) AS place
        FROM e WHERE session_id IN ('u7-w0', 'u8-w1', 'u9-w2')""",
    ),
    "session_meta": Query(
        lambda e: ingest.session_meta(e).select("session_id", "started_at", "scene", "device"),
        """
        SELECT session_id, min(ts) AS started_at, min(CAST(json_extract(payload, '$.scene') AS VARCHAR)) AS scene, min(CAST(json_extract(payload, '$.device') AS VARCHAR)) AS device
        FROM e WHERE event_type = 'session_start'
        GROUP BY session_id""",
        times="started_at",
    ),
    "scene_proxies": Query(
        lambda e: ingest.list_proxies(ingest.current_proxies(proxy_log(e)), PROJECT).select("scene_id", "label", "updated_at"),
        _SCENES,
        times="updated_at",
    ),
    "scene_registry": Query(
        lambda e: ingest.list_proxies(registry(e).current(), PROJECT).select("scene_id", "label", "updated_at"),
        _SCENES,
        times="updated_at",
    ),
    "scene_registry_meshes": Query(
        lambda e: registry(e).current().select("scene_id", F.explode("meshes").alias("m")).select("scene_id", "m.name", F.get("m.aabb", 0).alias("x0")),
        f"SELECT scene_id, mesh AS name, x0 FROM ({_LAST})",
        "x0",
    ),
    "scene_proxy_meshes": Query(
        lambda e: ingest.proxy(ingest.current_proxies(proxy_log(e)), PROJECT, "atrium").select(F.explode("meshes").alias("m")).select("m.name", F.get("m.aabb", 0).alias("x0"), F.get("m.aabb", 5).alias("z1")),
        f"SELECT mesh AS name, x0, z1 FROM ({_LAST}) WHERE scene_id = 'atrium'",
        "x0 z1",
    ),
    "merged_proxies": Query(
        lambda e: ingest.merge_proxies(ingest.current_proxies(proxy_log(e)), ["lobby", "gallery"]).select("scene_id", "name", F.get("aabb", 0).alias("x0"), "path"),
        f"""
        SELECT scene_id, mesh AS name, x0, 'root/' || mesh AS path
        FROM ({_LAST}) WHERE scene_id IN ('lobby', 'gallery')
        QUALIFY row_number() OVER (PARTITION BY mesh ORDER BY CASE scene_id WHEN 'lobby' THEN 1 ELSE 2 END) = 1""",
        "x0",
    ),
    "custom_events": Query(
        lambda e: meshes.custom_events(e, ALL, "quest").select("session_id", "ts", F.col("props")["level"].cast("long").alias("level"), F.col("props")["mode"].alias("mode")),
        """
        SELECT session_id, ts, CAST(json_extract_string(payload, '$.props.level') AS BIGINT) AS level, json_extract_string(payload, '$.props.mode') AS mode
        FROM e WHERE event_type = 'custom' AND name = 'quest'""",
        times="ts",
    ),
    "events_daily_ranged": Query(
        lambda e: volume.read_events_daily(volume.events_daily(e), PART),
        f"""
        SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, event_type, {N} AS events
        FROM e WHERE CAST(ts AS DATE) >= DATE '2024-01-05' AND CAST(ts AS DATE) < DATE '2024-01-20'
        GROUP BY ALL ORDER BY day DESC, events DESC, event_type LIMIT 200""",
    ),
    "world_heatmap_in_region": Query(
        lambda e: spatial.world_heatmap(e, ALL.but(region=_REGION), filters.resolve_cell_size(None, _REGION, None, 0.5)),
        _HITS.replace("/ 0.5e0", "/ 0.25e0") + "".join(f" AND hit_point[{i}] BETWEEN -8 AND 8" for i in (1, 2, 3)) + _TOP,
    ),
    "timeseries_of_last_week": Query(
        lambda e: volume.timeseries(e, ALL.but(since=_WEEK[0], until=_WEEK[1]), filters.bucket_seconds(7 * 86_400)),
        f"SELECT {_BUCKET(10_800)}, {N} AS events, avg(CASE WHEN event_type = 'frame_perf' THEN fps END) AS avg_fps FROM e WHERE {_IN_WEEK} GROUP BY bucket",
        "avg_fps",
    ),
    "read_funnel": Query(
        lambda e: read(e, "funnel", PROJECT, steps='[{"type": "session_start"}, {"type": "camera_sample"}, {"type": "pointer_click"}, {"type": "mesh_interaction", "name": "pick"}]'),
        _STEPS,
    ),
    "read_trajectories": Query(
        lambda e: read(e, "trajectories", PROJECT, camera_mode="first-person", limit=50_000),
        f"{_PATHS}{_FREE} ORDER BY session_id, ts, gx, gz LIMIT 50000",
    ),
    "read_session_events": Query(
        lambda e: read(e, "session_events", PROJECT, samples=node_samples(e), session="u7-w0").select("session_id", "event_type", F.unix_millis("ts").alias("ms")),
        f"""
        SELECT session_id, event_type, {_MS} AS ms FROM e WHERE session_id = 'u7-w0'
        UNION ALL SELECT session_id, 'node_transform', {_MS} FROM e WHERE session_id = 'u7-w0' AND event_type = 'camera_sample'""",
    ),
    "read_scene_representations": Query(
        lambda e: read(e, "scene_representations", PROJECT, ingest.current_proxies(proxy_log(e))).select("scene_id", "updated_at"),
        f"SELECT scene_id, CAST(max(day) AS TIMESTAMP) AS updated_at FROM ({_DAYS}) GROUP BY scene_id",
        times="updated_at",
    ),
    "read_scene_representation": Query(
        lambda e: read(e, "scene_representation", PROJECT, ingest.current_proxies(proxy_log(e)), scene="gallery").select("scene_id", F.explode("meshes").alias("m")).select("scene_id", "m.name", F.get("m.aabb", 0).alias("x0")),
        f"SELECT scene_id, mesh AS name, x0 FROM ({_LAST}) WHERE scene_id = 'gallery'",
        "x0",
    ),
    "read_bounds": Query(
        bounds_of_reads,
        f"""
        SELECT 'floor_plan limit 10000' AS what, least(10000, count(*)) AS n FROM (SELECT 1 FROM e WHERE event_type = 'camera_sample' AND len(position) = 3 GROUP BY floor(position[1]), floor(position[3]))
        UNION ALL SELECT 'world_heatmap limit 1000', least(1000, count(*)) FROM ({_HITS} GROUP BY ALL)
        UNION ALL SELECT 'world_heatmap cell_size 1000', count(*) FROM ({_HITS.replace("/ 0.5e0", "/ 1000e0")} GROUP BY ALL)
        UNION ALL SELECT 'timeseries interval 31536000', count(*) FROM (SELECT DISTINCT {_BUCKET(31_536_000)} FROM e)
        UNION ALL SELECT * FROM (VALUES {", ".join(f"('{name} {option} {value}', -1)" for name, option, value in _REFUSED)})""",
    ),
    # rollups
    "events_daily_merged": Query(lambda e: volume.read_events_daily(merged_rollups(e).events_daily(), ALL), ANALYTICS["events_daily"].sql),
    "perf_daily_merged": Query(lambda e: volume.read_perf_daily(merged_rollups(e).perf_daily(ALL), ALL), ANALYTICS["perf_daily"].sql, "avg_fps min_fps p50_fps"),
    "perf_daily_merged_ranged": Query(
        lambda e: volume.read_perf_daily(merged_rollups(e).perf_daily(PART), PART),
        f"SELECT * FROM ({ANALYTICS['perf_daily'].sql.replace('LIMIT 30', '')}) WHERE day >= '2024-01-05' AND day < '2024-01-20' ORDER BY day DESC LIMIT 30",
        "avg_fps min_fps p50_fps",
    ),
    # streams
    "stream_perf_daily": Query(lambda e: volume.read_perf_daily(rollups_of_stream(e).perf_daily(ALL), ALL), ANALYTICS["perf_daily"].sql, "avg_fps min_fps p50_fps"),
    "stream_timeseries": Query(
        lambda e: streamed(e, jobs.stream_timeseries),
        f"SELECT {_BUCKET(3600)}, {N} AS events, avg(CASE WHEN event_type = 'frame_perf' THEN fps END) AS avg_fps FROM e GROUP BY bucket",
        "avg_fps",
    ),
    "stream_type_counts": Query(lambda e: streamed(e, jobs.stream_type_counts), f"SELECT {_BUCKET(3600)}, event_type, {N} AS count FROM e GROUP BY ALL"),
    "stream_rage_clicks": Query(
        lambda e: streamed(e, lambda s: jobs.stream_rage_clicks(s, 604_800, 2)),
        f"""
        SELECT session_id, mesh, {_BUCKET(604_800)}, {N} AS clicks
        FROM e WHERE event_type = 'pointer_click' AND mesh <> ''
        GROUP BY ALL HAVING count(*) >= 2""",
    ),
    "stream_events_daily": Query(
        lambda e: streamed(e, jobs.stream_events_daily).select("event_type", g.day_text(F.col("day")).alias("day"), "events"),
        f"SELECT event_type, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, {N} AS events FROM e GROUP BY ALL",
    ),
    "stream_deduplicated": Query(
        lambda e: appended(e, jobs.deduplicate, e.union(e)).groupBy("session_id").agg(volume.count().alias("events")),
        "SELECT session_id, CAST(count(DISTINCT payload) AS BIGINT) AS events FROM e GROUP BY session_id",
    ),
    "stream_ingested": Query(stream_ingested, _INGESTED),
    "stream_ingest_replayed": Query(lambda e: stream_ingested(e, ("events", "node_samples", "quarantine", "record")), _INGESTED),
    "stream_firehose": Query(
        lambda e: appended(e, lambda s: jobs.firehose(s, PROJECT, ["pointer_click", "custom"])).select("event_id", "event_type"),
        "SELECT event_id, event_type FROM e WHERE event_type IN ('pointer_click', 'custom')",
    ),
    "session_feed": Query(session_feed, "SELECT session_id, event_id, CASE WHEN event_id % 2 = 0 THEN 'backfill' ELSE 'live' END AS phase FROM e WHERE session_id = 'u7-w0'"),
    "session_backfill": Query(
        lambda e: jobs.backfill(e.withColumn("session_id", F.col("scene_id")).withColumn("received_at", F.col("ts"))).select("session_id", "event_id"),
        "SELECT scene_id AS session_id, event_id FROM e QUALIFY row_number() OVER (PARTITION BY scene_id ORDER BY ts DESC, event_id DESC) <= 200",
    ),
    "presence": Query(lambda e: _ms(_present(e)[0], "started_at", "last_seen").drop("project_id"), _LIVE_ROWS),
    "live_presence": Query(lambda e: _ms(live_state(e, live.live_now), "started_at", "last_seen").drop("project_id"), _LIVE_ROWS),
    "live_backfill": Query(
        lambda e: live_state(e, live.recent_events).select("session_id", "event_id", "event_type", F.unix_millis("received_at").alias("received_at")),
        f"""
        SELECT session_id, event_id, event_type, r AS received_at
        FROM ({_STAYS}) JOIN (SELECT session_id, stay FROM ({_LIVE})) USING (session_id, stay)
        QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY r DESC) <= 200""",
    ),
    "presence_totals": Query(
        lambda e: jobs.presence_snapshot(*_present(e))[0].select("sessions", "visitors"),
        f"SELECT {N} AS sessions, CAST(count(DISTINCT visitor_id) AS BIGINT) AS visitors FROM ({_LIVE})",
    ),
    "presence_roster": Query(
        lambda e: jobs.presence_snapshot(*_present(e))[1].select("session_id", "scene_id", "activity"),
        f"""
        SELECT session_id, scene_id, CASE WHEN {_NOW_MS} - last_seen <= 3000 THEN 'active' WHEN {_NOW_MS} - last_seen <= 15000 THEN 'recent' ELSE 'idle' END AS activity
        FROM ({_LIVE})""",
    ),
}
