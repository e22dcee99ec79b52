"""Sessions, scenes and volume (also the daily rollups)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lumenscape.functions import geometry as g
from lumenscape.functions.filters import Scope, check_options, in_scope, whole_days
from lumenscape.operators.quantiles import summary_with_quantiles


def count() -> Column:
    return F.count(F.lit(1))


def top(df: DataFrame, limit: int | None, *order) -> DataFrame:
    """Ordered, and cut if a limit is given: one pass with a bounded heap in every task."""
    out = df.orderBy(*order)
    if limit is None:
        return out
    check_options(limit=limit)
    return out.limit(limit)


def of_type(events: DataFrame, *types: str) -> DataFrame:
    return events.where(F.col("event_type").isin(*types))


def list_sessions(events: DataFrame, scope: Scope, limit: int = 100) -> DataFrame:
    out = in_scope(events, scope, "RC").groupBy("session_id").agg(F.min("visitor_id").alias("visitor_id"), count().alias("events"), F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"))
    return top(out, limit, F.desc("started_at"), "session_id")


def distinct_scenes(events: DataFrame, scope: Scope, limit: int = 200) -> DataFrame:
    return top(in_scope(events, scope, "R").groupBy("scene_id").agg(count().alias("events"), F.max("ts").alias("last_seen")), limit, F.desc("events"), "scene_id")


def timeseries(events: DataFrame, scope: Scope, interval: int = 3600, event_type: str = "") -> DataFrame:
    check_options(interval=interval)
    rows = in_scope(events, scope, "RS")
    rows = of_type(rows, event_type) if event_type else rows
    fps = F.avg(F.when(F.col("event_type") == "frame_perf", F.col("fps")))
    return rows.groupBy(g.time_bucket(F.col("ts"), interval).alias("bucket")).agg(count().alias("events"), fps.alias("avg_fps")).orderBy("bucket")


def event_type_counts(events: DataFrame, scope: Scope) -> DataFrame:
    return top(in_scope(events, scope, "RS").groupBy("event_type").agg(count().alias("count")), None, F.desc("count"), "event_type")


def perf_daily(events: DataFrame) -> DataFrame:
    """Rollup table: frame performance by project and UTC day, with the exact median."""
    frames = of_type(events, "frame_perf").select("project_id", F.to_date("ts").alias("day"), "fps")
    return summary_with_quantiles(frames, ["project_id", "day"], {"p50_fps": ("fps", 0.5)}, {"samples": F.count("one"), "avg_fps": F.avg("fps"), "min_fps": F.min("fps")})


def events_daily(events: DataFrame) -> DataFrame:
    """Rollup table: events by project, type and UTC day."""
    return events.groupBy("project_id", "event_type", F.to_date("ts").alias("day")).agg(count().alias("events"))


def read_perf_daily(rollup: DataFrame, scope: Scope, limit: int = 30) -> DataFrame:
    out = whole_days(rollup, scope).select(g.day_text(F.col("day")).alias("day"), "samples", "avg_fps", "min_fps", "p50_fps")
    return top(out, limit, F.desc("day"))


def read_events_daily(rollup: DataFrame, scope: Scope, limit: int = 200) -> DataFrame:
    out = whole_days(rollup, scope).groupBy(g.day_text(F.col("day")).alias("day"), "event_type").agg(F.sum("events").alias("events"))
    return top(out, limit, F.desc("day"), F.desc("events"), "event_type")
