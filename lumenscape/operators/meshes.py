"""Meshes, interaction and funnels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from lumenscape.functions import geometry as g
from lumenscape.functions.filters import Scope, check_options, in_scope
from lumenscape.operators.asof import time_range
from lumenscape.operators.volume import count, of_type, top
from lumenscape.schema import INPUT_EVENTS, XR_SOURCES


def top_meshes(events: DataFrame, scope: Scope, limit: int = 25) -> DataFrame:
    return top(in_scope(events, scope, "RN").where("mesh <> ''").groupBy("mesh").agg(count().alias("count")), limit, F.desc("count"), "mesh")


def _active(events: DataFrame, scope: Scope) -> DataFrame:
    return of_type(in_scope(events, scope, "RSXN"), "mesh_interaction", "pointer_click").where("mesh <> ''")


def meshes_by_source(events: DataFrame, scope: Scope, limit: int | None = 200) -> DataFrame:
    return top(_active(events, scope).groupBy("mesh", "source").agg(count().alias("count")), limit, F.desc("count"), "mesh", "source")


def mesh_trend(events: DataFrame, scope: Scope, interval: int = 3600, limit: int | None = 2000) -> DataFrame:
    check_options(interval=interval)
    out = _active(events, scope).groupBy("mesh", g.time_bucket(F.col("ts"), interval).alias("bucket")).agg(count().alias("count"))
    return top(out, limit, "bucket", "mesh")


def mesh_dwell(events: DataFrame, scope: Scope, limit: int = 25) -> DataFrame:
    rows = of_type(in_scope(events, scope, "RSN"), "mesh_visibility").where("mesh <> ''")
    out = rows.groupBy("mesh").agg(F.sum("visible_ms").alias("visible_ms"), F.sum("centered_ms").alias("centered_ms"), F.max("screen_fraction").alias("max_screen_fraction"), count().alias("samples"))
    return top(out, limit, F.desc("visible_ms"), "mesh")


def interaction_kinds(events: DataFrame, scope: Scope, limit: int | None = 100) -> DataFrame:
    rows = of_type(in_scope(events, scope, "RSXN"), "mesh_interaction").where("mesh <> ''")
    return top(rows.groupBy("mesh", F.col("name").alias("kind")).agg(count().alias("count")), limit, F.desc("count"), "mesh", "kind")


def dead_clicks(events: DataFrame, scope: Scope) -> DataFrame:
    rows = of_type(in_scope(events, scope, "RSXN"), "pointer_click")
    return rows.agg(count().alias("total_clicks"), F.sum(F.when(F.col("mesh") == "", 1).otherwise(0)).alias("dead_clicks"))


def rage_clicks(events: DataFrame, scope: Scope, interval: int = 2, min_repeats: int = 3, limit: int = 100) -> DataFrame:
    check_options(interval=interval)
    if not 2 <= min_repeats <= 100:
        raise ValueError("min_repeats must lie in 2..100")
    rows = of_type(in_scope(events, scope, "RSXN"), "pointer_click").where("mesh <> ''")
    out = rows.groupBy("session_id", "mesh", g.time_bucket(F.col("ts"), interval).alias("bucket")).agg(count().alias("clicks")).where(F.col("clicks") >= min_repeats)
    return top(out, limit, F.desc("clicks"), "session_id", "mesh", "bucket")


def hover_dwell(events: DataFrame, scope: Scope, limit: int = 25) -> DataFrame:
    rows = of_type(in_scope(events, scope, "RSXN"), "hover_dwell").where("mesh <> ''")
    out = rows.groupBy("mesh").agg(F.sum("visible_ms").alias("dwell_ms"), F.max("visible_ms").alias("max_dwell_ms"), count().alias("episodes"))
    return top(out, limit, F.desc("dwell_ms"), "mesh")


def interactions_by_source(events: DataFrame, scope: Scope, limit: int | None = 100) -> DataFrame:
    rows = of_type(in_scope(events, scope, "RSXN"), *INPUT_EVENTS)
    out = rows.groupBy("event_type", "source").agg(count().alias("count"), F.countDistinct("session_id").alias("sessions"))
    return top(out, limit, F.desc("count"), "event_type", "source")


def top_input_actions(events: DataFrame, scope: Scope, limit: int = 100) -> DataFrame:
    rows = of_type(in_scope(events, scope, "RSXN"), "input_action").where("name <> ''")
    return top(rows.groupBy(F.col("name").alias("action"), "source").agg(count().alias("count")), limit, F.desc("count"), "action", "source")


def _durations(rows: DataFrame, key: str, n: str) -> DataFrame:
    return rows.groupBy(F.col("name").alias(key)).agg(count().alias(n), F.sum("visible_ms").alias("total_ms"), F.avg("visible_ms").alias("avg_ms"), F.max("visible_ms").alias("max_ms"))


def camera_gestures(events: DataFrame, scope: Scope, limit: int | None = 25) -> DataFrame:
    return top(_durations(of_type(in_scope(events, scope, "RSXN"), "camera_gesture"), "kind", "gestures"), limit, F.desc("gestures"), "kind")


def compile_stalls(events: DataFrame, scope: Scope, limit: int = 25) -> DataFrame:
    return top(_durations(of_type(in_scope(events, scope, "RSN"), "compile_stall"), "phase", "stalls"), limit, F.desc("total_ms"), "phase")


def xr_source_usage(events: DataFrame, scope: Scope, limit: int = 50) -> DataFrame:
    rows = in_scope(events, scope, "RSN").where(F.col("source").isin(XR_SOURCES))
    return top(rows.groupBy("source").agg(count().alias("interactions"), F.countDistinct("session_id").alias("sessions")), limit, F.desc("interactions"), "source")


def xr_abandonment(events: DataFrame, scope: Scope, limit: int = 500) -> DataFrame:
    """Sessions with any XR event of the project, in or out of range."""
    xr = F.col("source").isin(XR_SOURCES)
    sessions = in_scope(events, scope, "").where(xr).select("session_id").distinct()
    rows = in_scope(events, scope, "RSN").join(sessions, "session_id", "left_semi")
    out = rows.groupBy("session_id").agg(count().alias("events"), F.count_if(xr).alias("xr_interactions"), F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"))
    return top(out, limit, F.desc("started_at"), "session_id")


@dataclass(frozen=True)
class Step:
    """An event type, and where given the mesh and name that it must have."""

    event_type: str
    mesh: str = ""
    name: str = ""

    def matches(self) -> Column:
        out = F.col("event_type") == self.event_type
        for column in ("mesh", "name"):
            if getattr(self, column):
                out &= F.col(column) == getattr(self, column)
        return out


def funnel(events: DataFrame, scope: Scope, steps: list[Step]) -> DataFrame:
    """Sessions that reached each step, every step at or after the first reach of the one before.

    A session is read by ranges of time, each of which tells how far a session gets in it that has come so far before; the
    ranges, one short row each, are then followed in order. The camera mode counts for the first step, which the others follow.
    """
    if not 2 <= len(steps) <= 20:
        raise ValueError("a funnel has 2 to 20 steps")
    rows = in_scope(events, scope, "RS").select("session_id", "ts", time_range("ts").alias("range"), *[s.matches().alias(f"m{i}") for i, s in enumerate(steps)])
    ranges = _progress(rows.where(" or ".join(f"m{i}" for i in range(len(steps)))), len(steps))
    far = F.aggregate(F.array_sort(F.collect_list(F.struct("range", "onward"))), F.lit(0), lambda reached, r: F.get(r["onward"], reached))
    sessions = ranges.groupBy("session_id").agg(far.alias("reached"))
    if scope.camera_mode:
        sessions = in_scope(events, scope, "RSC").select("session_id").distinct().join(sessions, "session_id")
    wide = sessions.agg(*[F.count_if(F.col("reached") > i).alias(f"s{i}") for i in range(len(steps))])
    pairs = ", ".join(f"{i}, s{i}" for i in range(len(steps)))
    return wide.selectExpr(f"stack({len(steps)}, {pairs}) AS (step, sessions)").orderBy("step")


def _progress(rows: DataFrame, n: int) -> DataFrame:
    """session_id, range, onward: how many steps a session has behind it after the range, by how many it had before (0 to n).

    In a range the first step still missing is reached at its earliest time, each later one at its earliest time not
    before that: one aggregate a step over the rows of the range, all of which stay where one shuffle put them.
    """
    here = Window.partitionBy("session_id", "range")
    for more in range(n):
        new = {}
        for start in range(n - more):
            step = start + more
            due = F.col(f"m{step}") if not more else F.col(f"m{step}") & (F.col("ts") >= F.col(f"a{start}_{more - 1}"))
            new[f"a{start}_{more}"] = F.min(F.when(due, F.col("ts"))).over(here)
        rows = rows.withColumns(new)
    gained = [sum((F.col(f"a{start}_{more}").isNotNull().cast("int") for more in range(n - start)), F.lit(start)) for start in range(n)]
    return rows.select("session_id", "range", F.array(*gained, F.lit(n)).alias("onward")).groupBy("session_id", "range").agg(F.first("onward").alias("onward"))


def funnel_conversion(steps: DataFrame) -> DataFrame:
    """Share of the step before, null for the first; 20 rows at most."""
    before = F.lag("sessions").over(Window.orderBy("step"))
    return steps.withColumn("conversion", F.try_divide(F.col("sessions"), before))


def custom_events(events: DataFrame, scope: Scope, name: str) -> DataFrame:
    """Custom events of one name with their props as map<string,string>."""
    props = F.from_json(F.get_json_object("payload", "$.props"), "map<string,string>")
    return of_type(in_scope(events, scope, "RSN"), "custom").where(F.col("name") == name).select("session_id", "ts", "name", props.alias("props"))
