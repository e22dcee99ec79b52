"""Registered queries with default parameters over dense events: the scene events, ten a second, in sessions of five minutes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lumenscape.operators import capture, meshes
from lumenscape.plans.analytics import _BUCKET, _MS, ALL, N, Query
from lumenscape.plans.capture_queries import kept_sql
from lumenscape.plans.source_queries import appended, streamed
from lumenscape.streaming import jobs


def dense(e: DataFrame) -> DataFrame:
    """Sessions of 3,000 events a tenth of a second apart, which dwell on one mesh for five seconds."""
    number = F.col("event_id")
    mesh = F.when(F.col("mesh") != "", F.concat(F.lit("mesh_"), F.floor(number / 50) % 8)).otherwise("")
    return e.withColumns({"session_id": F.concat(F.lit("d"), F.floor(number / 3000)), "ts": F.timestamp_millis(number * 100 + 1_704_067_200_000), "mesh": mesh})


_D = """
(SELECT * REPLACE ('d' || event_id // 3000 AS session_id, make_timestamp((event_id * 100 + 1704067200000) * 1000) AS ts,
   CASE WHEN mesh <> '' THEN 'mesh_' || (event_id // 50) % 8 ELSE '' END AS mesh) FROM e)"""
_RAGE = f"""
SELECT session_id, mesh, {_BUCKET(2)}, {N} AS clicks
FROM {_D} WHERE event_type = 'pointer_click' AND mesh <> ''
GROUP BY ALL HAVING count(*) >= 3"""

DENSE: dict[str, Query] = {
    "rage_clicks_by_default": Query(lambda e: meshes.rage_clicks(dense(e), ALL), f"{_RAGE} ORDER BY clicks DESC, session_id, mesh, bucket LIMIT 100"),
    "stream_rage_clicks_by_default": Query(lambda e: streamed(dense(e), jobs.stream_rage_clicks), _RAGE),
    "hover_episodes_by_default": Query(
        lambda e: capture.hover_episodes(dense(e).select("session_id", "ts", F.nullif("mesh", F.lit("")).alias("mesh"))).select("session_id", "mesh", "ts", "dwell_ms"),
        f"""
        SELECT session_id, mesh, min(ts) AS ts, CAST(max(until) - min(ms) AS DOUBLE) AS dwell_ms
        FROM (SELECT *, sum(CASE WHEN before IS NOT DISTINCT FROM mesh THEN 0 ELSE 1 END) OVER w AS turn, coalesce(lead(ms) OVER w, ms) AS until
              FROM (SELECT session_id, ts, {_MS} AS ms, nullif(mesh, '') AS mesh, lag(nullif(mesh, '')) OVER (PARTITION BY session_id ORDER BY ts) AS before FROM {_D})
              WINDOW w AS (PARTITION BY session_id ORDER BY ts))
        GROUP BY session_id, turn, mesh
        HAVING mesh IS NOT NULL AND max(until) - min(ms) >= 500""",
        "dwell_ms",
        "ts",
    ),
    "thin_to_a_second": Query(
        lambda e: capture.thin(dense(e).where("event_type = 'pointer_move'").select("session_id", "ts", "event_id"), 1000, ["session_id"]).select("session_id", "event_id"),
        kept_sql(f"SELECT session_id, ts, event_id, epoch_us(ts) AS stamp FROM {_D} WHERE event_type = 'pointer_move'", "session_id", "stamp", "o.stamp - r.k_stamp < 1000000"),
    ),
    "limited_errors_by_default": Query(
        lambda e: capture.limit_errors(dense(e).select("session_id", "ts", "event_id", F.col("event_type").alias("message"), F.col("mesh").alias("stack"))).select("session_id", "event_id"),
        f"""
        SELECT session_id, event_id
        FROM (SELECT *, lag(event_type || ':' || mesh) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS before FROM {_D})
        WHERE before IS NULL OR before <> event_type || ':' || mesh
        QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) <= 50""",
    ),
    "rolled_up_diagnostics_by_default": Query(
        lambda e: capture.roll_up_diagnostics(dense(e).select("session_id", "ts", F.col("event_type").alias("severity"), F.col("source").alias("category"), F.lit("").alias("backend"), F.lit("").alias("code"), "payload")).select("session_id", "severity", "category", "ts", "count"),
        f"SELECT session_id, event_type AS severity, source AS category, min(ts) AS ts, {N} AS count FROM {_D} GROUP BY session_id, event_type, source, epoch_us(ts) // 30000000",
        times="ts",
    ),
    "session_backfill_dense": Query(
        lambda e: jobs.backfill(dense(e).withColumn("received_at", F.col("ts"))).select("session_id", "event_id"),
        f"SELECT session_id, event_id FROM {_D} QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, event_id DESC) <= 200",
    ),
    "stream_deduplicated_dense": Query(
        lambda e: appended(e, jobs.deduplicate, dense(e.union(e))).groupBy("session_id").agg(F.countDistinct("payload").alias("events")),
        f"SELECT session_id, CAST(count(DISTINCT payload) AS BIGINT) AS events FROM {_D} GROUP BY session_id",
    ),
}
