"""Tables derived from the aggregations: what a dashboard shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lumenscape.functions import geometry as g

VOXEL = ["vx", "vy", "vz"]

# The colours of heat, cold to hot.
THERMAL = [(0.0, (0.0, 0.1, 0.9)), (0.2, (0.0, 0.85, 1.0)), (0.4, (0.1, 0.9, 0.2)), (0.6, (1.0, 0.85, 0.0)), (0.8, (1.0, 0.15, 0.0)), (1.0, (1.0, 1.0, 1.0))]
WARM = [(0.0, (0.698, 0.184, 0.149)), (0.5, (0.878, 0.482, 0.224)), (1.0, (0.957, 0.784, 0.294))]


def part_popularity(by_source: DataFrame, trend: DataFrame, limit: int = 12) -> DataFrame:
    """Meshes by total, with their sources, their buckets in order, and recent half less earlier half."""
    sources = by_source.groupBy("mesh").agg(F.sum("count").alias("total"), F.array_sort(F.collect_list(F.struct("source", "count"))).alias("sources"))
    order = Window.partitionBy("mesh").orderBy("bucket")
    halves = trend.withColumn("rn", F.row_number().over(order)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("mesh")))
    later = F.col("rn") > F.floor(F.col("n") / 2)
    folded = halves.groupBy("mesh").agg(F.array_sort(F.collect_list(F.struct("bucket", "count"))).alias("buckets"), F.sum(F.when(later, F.col("count")).otherwise(-F.col("count"))).alias("delta"))
    out = sources.join(folded, "mesh", "left").select("mesh", "total", "sources", "buckets", F.coalesce("delta", F.lit(0)).cast("long").alias("delta"))
    return out.orderBy(F.desc("total"), "mesh").limit(limit)


#: Cells are also grouped into blocks of 2, 4, ... to this power on each side; a box takes blocks of which it spans few.
_LEVELS = [0, 3, 6, 9, 12, 15, 18, 21]
_SPAN = 8


def dead_zones(coverage: DataFrame, meshes: DataFrame, cell_size: float) -> DataFrame:
    """Visits of every proxy mesh box, padded by a cell, coldest first.

    meshes: name, aabb. Each box is listed by the blocks of cells that it touches, in the finest size of which it spans at
    most _SPAN on each side (or the largest); each visited cell is in one block of every size. So boxes of any extent meet cells by
    equality of blocks, and what a block has outside the box is left out.
    """
    side = [(F.get("aabb", i) - cell_size, F.get("aabb", i + 3) + cell_size) for i in range(3)]
    first = [F.ceil(lo / cell_size - 0.5).cast("long") for lo, _ in side]
    last = [F.floor(hi / cell_size - 0.5).cast("long") for _, hi in side]
    boxes = meshes.select("name", *[f.alias(f"f{i}") for i, f in enumerate(first)], *[x.alias(f"l{i}") for i, x in enumerate(last)]).where("l0 >= f0 and l1 >= f1 and l2 >= f2")
    widest = F.greatest(*[F.col(f"l{i}") - F.col(f"f{i}") for i in range(3)])
    level = F.lit(_LEVELS[-1])
    for n in reversed(_LEVELS[:-1]):
        level = F.when(widest < _SPAN << n, n).otherwise(level)
    boxes = boxes.withColumn("level", level)
    for i in range(3):
        block = F.expr(f"sequence(shiftright(f{i}, level), shiftright(l{i}, level))")
        boxes = boxes.withColumn(f"b{i}", F.explode(block))
    cells = coverage.select(*VOXEL, "count", F.explode(F.array(*map(F.lit, _LEVELS))).alias("level"))
    cells = cells.select("*", *[F.expr(f"shiftright({v}, level)").alias(f"b{i}") for i, v in enumerate(VOXEL)])
    inside: Column = F.lit(True)
    for i, v in enumerate(VOXEL):
        inside &= F.col(v).between(F.col(f"f{i}"), F.col(f"l{i}"))
    visits = boxes.join(cells, ["level", "b0", "b1", "b2"]).where(inside).groupBy("name").agg(F.sum("count").alias("visits"))
    out = meshes.select("name").join(visits, "name", "left").select("name", F.coalesce("visits", F.lit(0)).cast("long").alias("visits"))
    return out.withColumn("dead", F.col("visits") == 0).orderBy("visits", "name")


def gaze_click_divergence(gaze: DataFrame, clicks: DataFrame) -> DataFrame:
    """Click share less gaze share per voxel, each of its own maximum."""
    top = lambda df, n: df.agg(F.greatest(F.max("count"), F.lit(1)).alias(n))
    both = gaze.select(*VOXEL, F.col("count").alias("gaze")).join(clicks.select(*VOXEL, F.col("count").alias("clicks")), VOXEL, "full").fillna(0, ["gaze", "clicks"])
    # the maxima are one row each
    out = both.crossJoin(F.broadcast(top(gaze, "gaze_max"))).crossJoin(F.broadcast(top(clicks, "click_max")))
    value = F.col("clicks") / F.coalesce("click_max", F.lit(1)) - F.col("gaze") / F.coalesce("gaze_max", F.lit(1))
    return out.select(*VOXEL, "gaze", "clicks", value.alias("divergence")).withColumn("side", F.when(F.col("divergence") > 0, "click").when(F.col("divergence") < 0, "gaze").otherwise("even"))


def desire_lines(paths: DataFrame) -> DataFrame:
    """Session paths without cells that repeat the one before."""
    w = Window.partitionBy("session_id").orderBy("ts", "gx", "gz")
    cell = F.struct("gx", "gz")
    return paths.withColumn("before", F.lag(cell).over(w)).where(F.col("before").isNull() | (F.col("before") != cell)).select("session_id", "ts", "gx", "gz")


def desire_edges(lines: DataFrame) -> DataFrame:
    w = Window.partitionBy("session_id").orderBy("ts", "gx", "gz")
    steps = lines.select(F.col("gx").alias("to_gx"), F.col("gz").alias("to_gz"), F.lag("gx").over(w).alias("from_gx"), F.lag("gz").over(w).alias("from_gz")).where("from_gx is not null")
    return steps.groupBy("from_gx", "from_gz", "to_gx", "to_gz").agg(F.count(F.lit(1)).alias("count"))


ORIGIN = ["origin_vx", "origin_vy", "origin_vz"]


def standpoints(flows: DataFrame) -> DataFrame:
    """Flow rows by the voxel stood in, with the count-weighted mean origin."""
    mean = [(F.sum(F.col(f"origin_{a}") * F.col("count")) / F.sum("count")).alias(f"origin_{a}") for a in "xyz"]
    return flows.groupBy(*ORIGIN).agg(F.sum("count").alias("count"), *mean).orderBy(F.desc("count"), *ORIGIN)


def collapse_flow(flows: DataFrame) -> DataFrame:
    keys = ["azimuth_bin", "elevation_bin", "mesh"]
    return flows.groupBy(*keys).agg(F.sum("count").alias("count")).orderBy(F.desc("count"), *keys)


def flow_graph(flows: DataFrame, top_standpoints: int = 8, top_meshes: int = 8, top_ribbons: int = 24) -> DataFrame:
    """Links (standpoint, mesh, count) with tails folded into 'other', and node totals."""
    base = flows.select(F.concat_ws(",", *ORIGIN).alias("standpoint"), "mesh", "count").groupBy("standpoint", "mesh").agg(F.sum("count").alias("count"))

    def leaders(column: str, n: int) -> DataFrame:
        return base.groupBy(column).agg(F.sum("count").alias("c")).orderBy(F.desc("c"), column).limit(n).select(column, F.lit(True).alias(f"top_{column}"))

    ranked = base.join(F.broadcast(leaders("standpoint", top_standpoints)), "standpoint", "left").join(F.broadcast(leaders("mesh", top_meshes)), "mesh", "left")
    folded = ranked.select(F.when(F.col("top_standpoint"), F.col("standpoint")).otherwise("other").alias("standpoint"), F.when(F.col("top_mesh"), F.col("mesh")).otherwise("other").alias("mesh"), "count")
    ribbons = folded.groupBy("standpoint", "mesh").agg(F.sum("count").alias("count"))
    # at most (top_standpoints + 1) * (top_meshes + 1) rows from here on
    kept = F.row_number().over(Window.orderBy(F.desc("count"), "standpoint", "mesh")) <= top_ribbons
    links = ribbons.withColumn("kept", kept).select("standpoint", F.when(F.col("kept"), F.col("mesh")).otherwise("other").alias("mesh"), "count").groupBy("standpoint", "mesh").agg(F.sum("count").alias("count"))
    total = lambda c: F.sum("count").over(Window.partitionBy(c)).alias(f"{c}_total")
    return links.select("standpoint", "mesh", "count", total("standpoint"), total("mesh")).orderBy(F.desc("count"), "standpoint", "mesh")


def rays_by_camera(rays: DataFrame) -> DataFrame:
    keys = ["cam_vx", "cam_vy", "cam_vz"]
    return rays.groupBy(*keys).agg(F.sum("count").alias("count")).orderBy(F.desc("count"), *keys)


def rays_by_mesh(rays: DataFrame) -> DataFrame:
    return rays.groupBy("mesh").agg(F.sum("count").alias("count")).orderBy(F.desc("count"), "mesh")


def _with_share(df: DataFrame, value: str) -> DataFrame:
    """Share of the total, on already grouped rows."""
    total = df.agg(F.sum(value).alias("__total"))
    return df.crossJoin(F.broadcast(total)).withColumn("share", F.coalesce(F.try_divide(F.col(value), F.col("__total")), F.lit(0.0))).drop("__total")


def modality_split(by_source: DataFrame) -> DataFrame:
    return _with_share(by_source.groupBy("source").agg(F.sum("count").alias("count")), "count").orderBy(F.desc("count"), "source")


def source_breakdown(by_source: DataFrame) -> DataFrame:
    """Sessions are the largest of the types: sums would count a session once for each type."""
    out = by_source.groupBy("source").agg(F.sum("count").alias("total"), F.max("sessions").alias("sessions"), F.array_join(F.sort_array(F.collect_set("event_type")), ",").alias("types"))
    return out.orderBy(F.desc("total"), "source")


def kinds_per_mesh(kinds: DataFrame, limit: int = 10) -> DataFrame:
    out = kinds.groupBy("mesh").agg(F.sum("count").alias("total"), F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("order"), "kind", "count"))).alias("kinds"))
    listed = F.array_join(F.transform("kinds", lambda k: F.concat_ws(":", k["kind"], k["count"].cast("string"))), ",")
    return out.select("mesh", "total", listed.alias("kinds")).orderBy(F.desc("total"), "mesh").limit(limit)


def navigation_mix(gestures: DataFrame) -> DataFrame:
    return _with_share(gestures.select("kind", "gestures"), "gestures").orderBy(F.desc("gestures"), "kind")


def diagnostic_folds(diagnostics: DataFrame) -> DataFrame:
    """Incidents by severity, by category, by backend ('' is unknown) and in total, in one pass of grouping sets."""
    rows = diagnostics.where("incidents > 0").select("severity", "category", F.when(F.col("backend") == "", "unknown").otherwise(F.col("backend")).alias("backend"), "incidents")
    sets = rows.groupingSets([["severity"], ["category"], ["backend"], []], "severity", "category", "backend").agg(F.sum("incidents").alias("incidents"), F.grouping("severity").alias("gs"), F.grouping("category").alias("gc"), F.grouping("backend").alias("gb"))
    facet = F.when(F.col("gs") == 0, "severity").when(F.col("gc") == 0, "category").when(F.col("gb") == 0, "backend").otherwise("total")
    rank = F.array_position(F.array(*[F.lit(s) for s in ("fatal", "error", "warning", "info")]), F.col("severity"))
    return sets.select(facet.alias("facet"), F.coalesce("severity", "category", "backend", F.lit("")).alias("value"), "incidents", F.coalesce(rank, F.lit(0)).alias("severity_rank")).orderBy("facet", "severity_rank", F.desc("incidents"), "value")


def technology_folds(technology: DataFrame) -> DataFrame:
    keys = ["api", "backend", "shading_language"]
    sets = technology.groupingSets([[k] for k in keys] + [[]], *keys).agg(F.sum("sessions").alias("sessions"), *[F.grouping(k).alias(f"g_{k}") for k in keys])
    facet = F.lit("total")
    for k in reversed(keys):
        facet = F.when(F.col(f"g_{k}") == 0, k).otherwise(facet)
    return sets.select(facet.alias("facet"), F.coalesce(*keys, F.lit("")).alias("value"), "sessions").orderBy("facet", F.desc("sessions"), "value")


def scene_health(type_counts: DataFrame, sessions: DataFrame) -> DataFrame:
    """Errors, losses, attention gaps and resizes, with errors a session. sessions: one row with `sessions`."""
    n = lambda *types: F.coalesce(F.sum(F.when(F.col("event_type").isin(*types), F.col("count"))), F.lit(0)).cast("long")
    folded = type_counts.agg(n("runtime_error").alias("errors"), n("context_lost").alias("context_losses"), n("visibility_change", "focus_change").alias("attention_gaps"), n("viewport_resize").alias("resizes"))
    return folded.crossJoin(F.broadcast(sessions)).withColumn("errors_per_session", F.coalesce(F.try_divide(F.col("errors"), F.col("sessions")), F.lit(0.0)))


def scene_metrics(coverage: DataFrame, navigation: DataFrame) -> DataFrame:
    occupied = coverage.agg(F.count(F.lit(1)).alias("occupied_cells"), F.coalesce(F.sum("count"), F.lit(0)).alias("samples"))
    moves = navigation.agg(F.coalesce(F.avg("total_distance"), F.lit(0.0)).alias("avg_travel"), F.coalesce(F.try_divide(F.sum("active_segments"), F.sum("segments")), F.lit(0.0)).alias("active_share"))
    return occupied.crossJoin(moves)


def downscaled_share(truth: DataFrame) -> DataFrame:
    return truth.withColumn("downscaled_share", F.coalesce(F.try_divide(F.col("downscaled_samples"), F.col("scale_samples")), F.lit(0.0)))


def hidden_cost(truth: DataFrame) -> DataFrame:
    """Smooth only because it draws fewer pixels."""
    scale = F.col("p50_render_scale")
    return truth.withColumn("hidden_cost", F.coalesce((F.col("p50_fps") >= 50) & (scale > 0) & (scale < 0.9), F.lit(False)))


def robust_intensity(voxels: DataFrame, q: float = 0.95) -> DataFrame:
    """count over a scale that single hot cells do not set: the q-quantile of counts, at least 1."""
    scale = voxels.agg(F.greatest(F.lit(1.0), F.coalesce(F.percentile("count", q), F.lit(1.0))).alias("scale"))
    return voxels.crossJoin(F.broadcast(scale)).withColumn("t", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("count") / F.col("scale"))))


def _coloured(df: DataFrame, stops: list = THERMAL) -> DataFrame:
    return df.select("*", *[c.alias(n) for c, n in zip(g.ramp(F.col("t"), stops), "rgb")])


def _relative(df: DataFrame, limit: int, keys: list[str]) -> DataFrame:
    """Top rows by count (ties by their keys), with t = count over the largest count."""
    some = df.where("count > 0")
    return some.crossJoin(F.broadcast(some.agg(F.max("count").alias("most")))).withColumn("t", F.col("count") / F.col("most")).drop("most").orderBy(F.desc("count"), *keys).limit(limit)


def heatmap_instances(voxels: DataFrame, cell_size: float, limit: int = 2000, stops: list = THERMAL) -> DataFrame:
    """Boxes to draw: centre, edge and colour of each voxel."""
    rows = _relative(voxels, limit, VOXEL)
    edge = F.lit(cell_size * 0.9) * (F.lit(0.35) + F.col("t") * 0.65)
    return _coloured(rows.select(*VOXEL, "count", "t", *[g.voxel_centre(F.col(v), cell_size).alias(a) for v, a in zip(VOXEL, "xyz")], edge.alias("edge")), stops)


def gaze_dome(directions: DataFrame, bins: int, radius: float, centre: tuple[float, float, float] = (0.0, 0.0, 0.0), limit: int = 1500) -> DataFrame:
    """Points on a sphere, one for each view-direction bin."""
    rows = _relative(directions, limit, ["azimuth_bin", "elevation_bin"])
    d = g.bin_direction(F.col("azimuth_bin"), F.col("elevation_bin"), bins)
    size = F.lit(radius * 0.06) * (F.lit(0.35) + F.col("t") * 0.65)
    return _coloured(rows.select("azimuth_bin", "elevation_bin", "count", "t", *[(x * radius + c).alias(a) for x, c, a in zip(d, centre, "xyz")], size.alias("edge")))


# Which lane of a session's timeline an event type belongs to.
LANES = {
    "interaction": ["pointer_click", "mesh_interaction"],
    "actors": ["node_transform"],
    "custom": ["custom"],
    "camera": ["camera_sample"],
    "pointer": ["pointer_move", "pointer_down", "pointer_up"],
    "perf": ["frame_perf"],
    "lifecycle": [
        "session_start", "session_end", "scene_change", "focus_change", "visibility_change", "viewport_resize", "context_lost", "context_restored", "runtime_error", "capability_change",
        "input_action", "resource_sample", "compile_stall", "mesh_visibility", "hover_dwell",
    ],
}


def session_lanes(events: DataFrame, slots: int = 600) -> DataFrame:
    """Distinct (session, lane, slot): where in a session's span something happened."""
    lane = F.create_map(*[F.lit(x) for lane, types in LANES.items() for t in types for x in (t, lane)])
    ms = g.epoch_ms(F.col("ts"))
    spans = events.groupBy("session_id").agg(F.min(ms).alias("t0"), F.max(ms).alias("t1"))
    rows = events.select("session_id", F.try_element_at(lane, F.col("event_type")).alias("lane"), ms.alias("ms")).where("lane is not null").join(spans, "session_id")
    slot = F.floor((F.col("ms") - F.col("t0")) * slots / F.greatest(F.col("t1") - F.col("t0"), F.lit(1)) + 0.5)
    return rows.select("session_id", "lane", slot.alias("slot")).distinct()


def session_duration(events: DataFrame) -> DataFrame:
    return events.groupBy("session_id").agg((F.max(g.epoch_ms(F.col("ts"))) - F.min(g.epoch_ms(F.col("ts")))).alias("duration_ms"))
