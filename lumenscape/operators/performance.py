"""Performance, stability and technology."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lumenscape.functions import geometry as g
from lumenscape.functions.filters import Scope, check_options, in_scope, scope_conditions
from lumenscape.operators.quantiles import summary_with_quantiles
from lumenscape.operators.volume import count, of_type, top


def quantile(value: str | Column, q: float) -> Column:
    """Exact, interpolated; nulls are ignored. For groups that a task can hold, such as a session's samples."""
    return F.percentile(value, q)


def median(value: str | Column) -> Column:
    return quantile(value, 0.5)


def _frames(events: DataFrame, scope: Scope, use: str = "RSN") -> DataFrame:
    return of_type(in_scope(events, scope, use), "frame_perf")


def _by_session(rows: DataFrame, *values: Column) -> DataFrame:
    """First level: one row per session, so that long sessions weigh no more than short ones."""
    return rows.groupBy("session_id").agg(count().alias("s_samples"), *values)


def perf_summary(events: DataFrame, scope: Scope) -> DataFrame:
    frames = _frames(events, scope, "RN").select("fps")
    return summary_with_quantiles(frames, [], {"p50_fps": ("fps", 0.5)}, {"samples": F.count("one"), "avg_fps": F.avg("fps"), "min_fps": F.min("fps")}, ("samples",))


def render_scale_truth(events: DataFrame, scope: Scope) -> DataFrame:
    frames = _frames(events, scope, "RN").select("fps", g.reported("render_scale").alias("scale"))
    scale = F.col("scale")
    aggregates = {
        "samples": F.count("one"),
        "avg_fps": F.avg("fps"),
        "avg_render_scale": F.avg("scale"),
        "downscaled_samples": F.sum(F.when((scale > 0) & (scale < 1), F.col("one")).otherwise(F.col("one") * 0)),
        "scale_samples": F.sum(F.when(scale > 0, F.col("one")).otherwise(F.col("one") * 0)),
    }
    return summary_with_quantiles(frames, [], {"p50_fps": ("fps", 0.5), "p50_render_scale": ("scale", 0.5)}, aggregates, ("samples",))


def perf_distribution(events: DataFrame, scope: Scope) -> DataFrame:
    per = _by_session(_frames(events, scope), *[quantile("fps", q).alias(n) for n, q in (("p05", 0.05), ("p50", 0.5), ("p95", 0.95))])
    return _over_sessions(per, {f"{n}_fps": (n, 0.5) for n in ("p05", "p50", "p95")})


def _over_sessions(per: DataFrame, wanted: dict[str, tuple[str, float]], keys: tuple[str, ...] = (), **more: Column) -> DataFrame:
    """Second level: sessions, samples and quantiles over sessions."""
    per = per.drop("session_id")
    return summary_with_quantiles(per, list(keys), wanted, {"sessions": F.count("one"), "samples": F.sum("s_samples"), **more}, ("sessions",))


def fps_histogram(events: DataFrame, scope: Scope, width: int = 10) -> DataFrame:
    check_options(width=width)
    per = _by_session(_frames(events, scope), median("fps").alias("p50"))
    return per.groupBy((g.voxel(F.col("p50"), width) * width).alias("bucket")).agg(count().alias("sessions")).orderBy("bucket")


def frame_time_percentiles(events: DataFrame, scope: Scope) -> DataFrame:
    per = _by_session(_frames(events, scope), median(g.reported("frame_time_ms")).alias("p50"), F.max(g.reported("frame_time_p95_ms")).alias("p95"))
    return _over_sessions(per, {"p50_ms": ("p50", 0.5), "p95_ms": ("p95", 0.5)})


def jank_rate(events: DataFrame, scope: Scope) -> DataFrame:
    per = _by_session(_frames(events, scope), F.sum("long_frames").alias("long"))
    per = per.withColumn("rate", F.col("long") / F.col("s_samples"))
    return _over_sessions(per, {"median_rate": ("rate", 0.5), "worst_decile_rate": ("rate", 0.9)}, total_long_frames=F.sum("long")).drop("samples")


DEVICE = ["engine", "is_mobile", "renderer", "browser", "os"]


def perf_by_device(events: DataFrame, scope: Scope) -> DataFrame:
    """Devices come from every session start of the project, so a session that started twice counts twice."""
    here = in_scope(of_type(events, "frame_perf", "session_start"), scope, "")
    device = F.struct(*[g.json_text("payload", "device", path).alias(n) for n, path in zip(DEVICE, ("engine", "isMobile", "renderer", "browser", "os"))])
    counted = F.col("event_type") == "frame_perf"
    for condition in scope_conditions(scope, "RSN"):
        counted &= condition
    per = here.where(counted | (F.col("event_type") == "session_start")).groupBy("session_id")
    per = per.agg(F.count_if(counted).alias("s_samples"), median(F.when(counted, F.col("fps"))).alias("p50"), F.collect_list(F.when(~counted & (F.col("event_type") == "session_start"), device)).alias("starts"))
    rows = per.where("s_samples > 0").select("s_samples", "p50", F.explode_outer("starts").alias("d")).select("s_samples", "p50", *[F.coalesce(f"d.{n}", F.lit("")).alias(n) for n in DEVICE])
    out = _over_sessions(rows, {"p50_fps": ("p50", 0.5)}, tuple(DEVICE))
    return top(out, None, F.desc("sessions"), *DEVICE)


def perf_by_scene(events: DataFrame, scope: Scope) -> DataFrame:
    per = _by_session(_frames(events, scope), F.min("scene_id").alias("scene_id"), median("fps").alias("p50"))
    out = _over_sessions(per, {"p50_fps": ("p50", 0.5)}, ("scene_id",))
    return top(out, None, F.desc("sessions"), "scene_id")


RESOURCES = ["js_heap_bytes", "triangles", "vertices", "texture_bytes", "geometry_bytes"]


def resource_summary(events: DataFrame, scope: Scope) -> DataFrame:
    rows = of_type(in_scope(events, scope, "RN"), "resource_sample")
    return rows.agg(count().alias("samples"), *[x for n in RESOURCES for x in (F.avg(g.reported(n)).alias(f"avg_{n}"), F.max(n).alias(f"max_{n}"))])


def resource_percentiles(events: DataFrame, scope: Scope) -> DataFrame:
    rows = of_type(in_scope(events, scope, "RSN"), "resource_sample")
    names = ["js_heap_bytes", "texture_bytes", "triangles"]
    per = _by_session(rows, *[quantile(g.reported(n), q / 100).alias(f"p{q}_{n}") for n in names for q in (50, 95)])
    return _over_sessions(per, {f"p{q}_{n}": (f"p{q}_{n}", 0.5) for n in names for q in (50, 95)})


def stability_counts(events: DataFrame, scope: Scope) -> DataFrame:
    rows = of_type(in_scope(events, scope, "RSN"), "context_lost", "compile_stall")
    return rows.agg(F.count_if(F.col("event_type") == "context_lost").alias("context_losses"), F.count_if(F.col("event_type") == "compile_stall").alias("compile_stalls"), count().alias("incidents"))


def graphics_diagnostics(events: DataFrame, scope: Scope) -> DataFrame:
    rows = of_type(in_scope(events, scope, "RSN"), "graphics_diagnostic")
    out = rows.groupBy(g.json_text("payload", "severity").alias("severity"), g.json_text("payload", "category").alias("category"), F.coalesce(g.json_text("payload", "backend"), F.lit("")).alias("backend"))
    out = out.agg(F.sum(F.coalesce(g.json_int("payload", "count"), F.lit(1))).alias("incidents"))
    return top(out, None, F.desc("incidents"), "severity", "category", "backend")


def rendering_technology(events: DataFrame, scope: Scope) -> DataFrame:
    rows = of_type(in_scope(events, scope, "RSN"), "session_start")
    paths = {"api": "api", "backend": "backend", "api_version": "apiVersion", "shading_language": "shadingLanguage"}
    out = rows.groupBy(*[F.coalesce(g.json_text("payload", "graphics", p), F.lit("")).alias(n) for n, p in paths.items()]).agg(count().alias("sessions"))
    return top(out, None, F.desc("sessions"), *paths)


def capability_changes(events: DataFrame, scope: Scope, limit: int = 50) -> DataFrame:
    rows = of_type(in_scope(events, scope, "RSN"), "capability_change")
    out = rows.groupBy(F.col("name").alias("kind"), F.col("cap_from").alias("from"), F.col("cap_to").alias("to")).agg(count().alias("changes"))
    return top(out, limit, F.desc("changes"), "kind", "from", "to")
