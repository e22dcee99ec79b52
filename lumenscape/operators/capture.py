"""Reductions of raw frame, tick and gesture tables to events, as batch jobs keyed by session."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from lumenscape.functions import geometry as g
from lumenscape.operators.changes import keep_changes

# Dead zones of gestures (degrees, degrees, ratio, share of the distance) and other defaults.
GESTURE_ZONES = {"orbit": 1.0, "roll": 1.0, "zoom": 0.02, "pan": 0.005}
HOVER_MS, ERRORS_PER_SESSION, DIAGNOSTIC_WINDOW_S, VISIBILITY_WINDOW_S = 500.0, 50, 30, 5


def js_round(x: Column) -> Column:
    """Half up, also below zero."""
    return F.floor(x + 0.5)


def frame_windows(frames: DataFrame, jank_ms: float = 50.0) -> DataFrame:
    """session_id, window, frame_ms -> nearest-rank 95th and 99th percentile and frames over jank_ms."""
    rank = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY frame_ms)")
    return frames.groupBy("session_id", "window").agg(rank(0.95).alias("frame_time_p95_ms"), rank(0.99).alias("frame_time_p99_ms"), F.count_if(F.col("frame_ms") > jank_ms).alias("long_frames"))


def suppress_idle_fps(perf: DataFrame, threshold: float) -> DataFrame:
    return keep_changes(perf, ["session_id"], ["fps"], threshold)


def suppress_idle_camera(samples: DataFrame, eps: float) -> DataFrame:
    """A pose counts as unchanged only if the same optional parts are present."""
    return keep_changes(samples, ["session_id"], ["position", "direction", "target", "fov", "aspect", "near"], eps)


def suppress_idle_nodes(samples: DataFrame, eps: float) -> DataFrame:
    keyed = samples.withColumn("channel", F.when(F.col("bone_id") != "", F.concat_ws("\u0001", "node_id", F.lit("bone"), "bone_id")).otherwise(F.concat_ws("\u0001", "node_id", "child_path")))
    return keep_changes(keyed, ["session_id", "channel"], ["position", "rotation", "scale"], eps).drop("channel")


def changed_bounds(visibility: DataFrame, eps: float = 1e-3) -> DataFrame:
    """Bounds that differ from the last ones sent of their mesh, rounded to millimetres."""
    some = visibility.where("bounds is not null")
    return keep_changes(some, ["session_id", "mesh"], ["bounds"], eps).withColumn("bounds", F.transform("bounds", lambda x: js_round(x * 1000) / 1000))


def decompose(matrices: DataFrame, matrix: str = "matrix", scale_eps: float = 1e-3) -> DataFrame:
    """Column-major 4x4 -> position, rotation (xyzw), scale; a negative determinant flips the x scale, a scale near 1 is null."""
    e = [F.get(F.col(matrix), i) for i in range(16)]
    det = e[0] * (e[5] * e[10] - e[6] * e[9]) - e[4] * (e[1] * e[10] - e[2] * e[9]) + e[8] * (e[1] * e[6] - e[2] * e[5])
    lengths = [g.norm(e[i], e[i + 1], e[i + 2]) for i in (0, 4, 8)]
    lengths[0] = F.when(det < 0, -lengths[0]).otherwise(lengths[0])
    inverse = [F.coalesce(F.try_divide(F.lit(1.0), s), F.lit(0.0)) for s in lengths]
    rows = matrices.withColumns({f"__m{r}{c}": e[c * 4 + r] * inverse[c] for c in range(3) for r in range(3)})
    m = {(r, c): F.col(f"__m{r}{c}") for r in range(3) for c in range(3)}
    trace = m[0, 0] + m[1, 1] + m[2, 2]
    root = lambda x: F.sqrt(F.greatest(x, F.lit(0.0))) * 2
    s0, s1, s2, s3 = root(trace + 1), root(m[0, 0] - m[1, 1] - m[2, 2] + 1), root(m[1, 1] - m[0, 0] - m[2, 2] + 1), root(m[2, 2] - m[0, 0] - m[1, 1] + 1)
    a, b, c = m[2, 1] - m[1, 2], m[0, 2] - m[2, 0], m[1, 0] - m[0, 1]
    p, q, r = m[0, 1] + m[1, 0], m[0, 2] + m[2, 0], m[1, 2] + m[2, 1]
    d = lambda x, s: F.try_divide(x, s)
    largest = F.when(trace > 0, F.array(d(a, s0), d(b, s0), d(c, s0), s0 / 4))
    largest = largest.when((m[0, 0] > m[1, 1]) & (m[0, 0] > m[2, 2]), F.array(s1 / 4, d(p, s1), d(q, s1), d(a, s1)))
    largest = largest.when(m[1, 1] > m[2, 2], F.array(d(p, s2), s2 / 4, d(r, s2), d(b, s2)))
    rotation = largest.otherwise(F.array(d(q, s3), d(r, s3), s3 / 4, d(c, s3)))
    unit = F.lit(True)
    for s in lengths:
        unit &= F.abs(s - 1) <= scale_eps
    out = rows.withColumn("position", F.array(e[12], e[13], e[14])).withColumn("rotation", rotation).withColumn("scale", F.when(~unit, F.array(*lengths)))
    return out.drop(*[f"__m{r}{c}" for r in range(3) for c in range(3)])


def mesh_visibility(ticks: DataFrame, centered_cos: float, window_s: int = VISIBILITY_WINDOW_S) -> DataFrame:
    """Ticks (session_id, ts, mesh, step_ms, cam_pos, forward, fov, center, radius) -> one row per mesh and window."""
    to = [F.get("center", i) - F.get("cam_pos", i) for i in range(3)]
    fwd = [F.get("forward", i) for i in range(3)]
    nonzero = lambda x, other: F.when(x == 0, F.lit(other)).otherwise(x)
    dist, length = nonzero(g.norm(*to), 1e-6), nonzero(g.norm(*fwd), 1.0)
    cosine = (to[0] * fwd[0] + to[1] * fwd[1] + to[2] * fwd[2]) / (dist * length)
    half = F.when(F.coalesce("fov", F.lit(0.0)) == 0, F.lit(0.4)).otherwise(F.col("fov") / 2)
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.atan2("radius", dist) / half))
    rows = ticks.where("step_ms > 0").select("session_id", "mesh", F.window("ts", f"{window_s} seconds").alias("w"), "step_ms", (cosine >= centered_cos).alias("centered"), share.alias("share"))
    out = rows.groupBy("session_id", "mesh", F.col("w.start").alias("ts")).agg(F.sum("step_ms").alias("v"), F.sum(F.when(F.col("centered"), F.col("step_ms")).otherwise(0.0)).alias("c"), F.max("share").alias("s"))
    return out.select("session_id", "mesh", "ts", js_round(F.col("v")).alias("visible_ms"), js_round(F.col("c")).alias("centered_ms"), (js_round(F.col("s") * 1e4) / 1e4).alias("max_screen_fraction"))


def _unit(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, n, out=np.zeros_like(v), where=n > 0)


def _angle(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = _unit(a), _unit(b)
    both = (np.abs(a).sum(axis=1) > 0) & (np.abs(b).sum(axis=1) > 0)
    return np.where(both, np.degrees(np.arccos(np.clip(np.einsum("ij,ij->i", a, b), -1, 1))), 0.0)


def _meeting_point(p0, d0, p1, d1) -> tuple[np.ndarray, np.ndarray]:
    """Middle of the nearest points of two view rays, and their mean distance; NaN if parallel or behind."""
    d0, d1, r = _unit(d0), _unit(d1), p0 - p1
    dot = lambda a, b: np.einsum("ij,ij->i", a, b)
    a, b, c, d, e = dot(d0, d0), dot(d0, d1), dot(d1, d1), dot(d0, r), dot(d1, r)
    gap = a * c - b * b
    with np.errstate(divide="ignore", invalid="ignore"):
        t0, t1 = (b * e - c * d) / gap, (a * e - b * d) / gap
    ok = (gap >= 1e-4) & (t0 > 0) & (t1 > 0)
    middle = (p0 + t0[:, None] * d0 + p1 + t1[:, None] * d1) / 2
    return np.where(ok[:, None], middle, np.nan), np.where(ok, (t0 + t1) / 2, np.nan)


def classify_gestures(brackets: DataFrame, sensitivity: float = 1.0, scene_radius: float | None = None) -> DataFrame:
    """Start and end poses -> kind (largest excess over its dead zone) and the magnitudes; no excess: kind null.

    Columns s_ and e_ position, forward, up, pivot (arrays), fov, distance; up, pivot, fov and distance may be null.
    The geometry runs on whole batches in numpy.
    """
    zone = {k: v * (sensitivity if sensitivity > 0 else 1.0) for k, v in GESTURE_ZONES.items()}

    def vec(pdf: pd.DataFrame, name: str) -> np.ndarray:
        return np.array([v if v is not None and len(v) == 3 else [np.nan] * 3 for v in pdf[name]], dtype=float).reshape(-1, 3)

    def run(batches):
        for pdf in batches:
            p0, p1, f0, f1, u0, u1, v0, v1 = (vec(pdf, n) for n in ("s_position", "e_position", "s_forward", "e_forward", "s_up", "e_up", "s_pivot", "e_pivot"))
            num = lambda n: pdf[n].to_numpy(dtype=float)
            fov0, fov1, dist0, dist1 = num("s_fov"), num("e_fov"), num("s_distance"), num("e_distance")
            explicit = ~np.isnan(v0[:, 0]) & ~np.isnan(dist0)
            guess, far = _meeting_point(p0, f0, p1, f1)
            back, _ = _meeting_point(p1, f1, p0, f0)
            pivot = np.where(explicit[:, None], v0, guess)
            distance = np.where(explicit, dist0, far)
            has = ~np.isnan(pivot[:, 0])
            orbit = _angle(f0, f1)
            axis = _unit(f0 + f1)
            flat = lambda u: _unit(u - axis * np.einsum("ij,ij->i", u, axis)[:, None])
            twisted = ~np.isnan(u0[:, 0]) & ~np.isnan(u1[:, 0]) & (np.linalg.norm(axis, axis=1) > 1e-6)
            roll = np.where(twisted, _angle(np.nan_to_num(flat(u0)), np.nan_to_num(flat(u1))), 0.0)
            with np.errstate(divide="ignore", invalid="ignore"):
                by_fov = ~np.isnan(fov0) & (fov1 > 1e-6)
                by_dist = ~by_fov & explicit & (dist1 > 1e-6)
                ratio = np.where(by_fov, fov0 / fov1, np.where(by_dist, dist0 / dist1, np.nan))
            end = np.where(explicit[:, None], np.where(np.isnan(v1), pivot, v1), np.where(np.isnan(back), pivot, back))
            move, ahead = end - pivot, _unit(f0)
            sideways = move - ahead * np.einsum("ij,ij->i", move, ahead)[:, None]
            travel = np.linalg.norm(p1 - p0, axis=1)
            raw = np.where(has, np.linalg.norm(np.nan_to_num(sideways), axis=1), travel)
            scale = np.where(has & (distance > 1e-6), distance, scene_radius if scene_radius and scene_radius > 1e-6 else np.nan)
            pan = np.where(np.isnan(scale), raw, raw / np.where(np.isnan(scale), 1.0, scale))
            zoom = np.nan_to_num(np.abs(ratio - 1))
            excess = np.stack([orbit / zone["orbit"], roll / zone["roll"], zoom / zone["zoom"], pan / zone["pan"]], 1)
            best = excess.argmax(axis=1)
            kinds = np.array(["orbit", "roll", "zoom", "pan"], dtype=object)[best]
            kinds = np.where((best == 2) & by_dist, "dolly", np.where((best == 3) & ~has, "fly", kinds))
            kinds = np.where(excess.max(axis=1) > 1, kinds, None)
            shown = lambda x, i: np.where(excess[:, i] > 1, x, np.nan)
            yield pdf.assign(kind=kinds, orbit_deg=shown(orbit, 0), roll_deg=shown(roll, 1), zoom_ratio=shown(ratio, 2), pan_dist=shown(pan, 3))

    fields = ", ".join(f"`{n}` {t}" for n, t in brackets.dtypes)
    return brackets.mapInPandas(run, f"{fields}, kind string, orbit_deg double, roll_deg double, zoom_ratio double, pan_dist double")


def hover_episodes(hovers: DataFrame, least_ms: float = HOVER_MS) -> DataFrame:
    """Ticks (session_id, ts, mesh, null for none) -> uninterrupted stays on a mesh of least_ms or more."""
    w = Window.partitionBy("session_id").orderBy("ts")
    ms = g.epoch_ms(F.col("ts"))
    turns = hovers.withColumn("ms", ms).withColumn("turn", F.sum(F.when(F.lag("mesh").over(w).eqNullSafe(F.col("mesh")), 0).otherwise(1)).over(w)).withColumn("until", F.coalesce(F.lead("ms").over(w), F.col("ms")))
    stays = turns.groupBy("session_id", "turn", "mesh").agg(F.min("ts").alias("ts"), (F.max("until") - F.min("ms")).cast("double").alias("dwell_ms"))
    return stays.where(F.col("mesh").isNotNull() & (F.col("dwell_ms") >= least_ms)).select("session_id", "mesh", "ts", "dwell_ms")


def thin(rows: DataFrame, interval_ms: float, keys: list[str]) -> DataFrame:
    """Rows at least interval_ms after the last kept row of their key."""
    return keep_changes(rows, keys, ["ts"], interval_ms, below=True)


def thin_by_grid(rows: DataFrame, interval_ms: int, keys: list[str]) -> DataFrame:
    """The first row of every grid interval: cheaper, and as dense."""
    w = Window.partitionBy(*keys, F.floor(g.epoch_ms(F.col("ts")) / interval_ms)).orderBy("ts")
    return rows.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def limit_errors(errors: DataFrame, most: int = ERRORS_PER_SESSION) -> DataFrame:
    """Without errors equal to the one before, at most `most` a session; texts are cut to their wire lengths."""
    w = Window.partitionBy("session_id").orderBy("ts", "event_id")
    same = F.struct("message", "stack")
    fresh = errors.withColumn("__before", F.lag(same).over(w)).where(F.col("__before").isNull() | ~F.col("__before").eqNullSafe(same)).drop("__before")
    kept = fresh.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= most).drop("__rn")
    return kept.withColumn("message", F.substring("message", 1, 1024)).withColumn("stack", F.substring("stack", 1, 4096))


def roll_up_diagnostics(diagnostics: DataFrame, window_s: int = DIAGNOSTIC_WINDOW_S) -> DataFrame:
    """Bursts of equal diagnostics -> one row per window with their number and the first payload."""
    keys = ["session_id", "severity", "category", "backend", "code"]
    out = diagnostics.groupBy(*keys, F.window("ts", f"{window_s} seconds").alias("w")).agg(F.count(F.lit(1)).alias("count"), F.min(F.struct("ts", "payload")).alias("first"))
    return out.select(*keys, F.col("first.ts").alias("ts"), F.col("first.payload").alias("payload"), "count")


def _matrices(position: pd.Series, rotation: pd.Series, scale: pd.Series) -> np.ndarray:
    p, q = np.array(position.tolist(), float), np.array(rotation.tolist(), float)
    s = np.array([v if v is not None and len(v) == 3 else [1.0, 1.0, 1.0] for v in scale], float)
    x, y, z, w = q.T
    out = np.zeros((len(p), 4, 4))
    out[:, 0, :3] = np.stack([1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], 1)
    out[:, 1, :3] = np.stack([2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], 1)
    out[:, 2, :3] = np.stack([2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)], 1)
    out[:, :3, :3] *= s[:, None, :]
    out[:, :3, 3], out[:, 3, 3] = p, 1.0
    return out


def reconstruct_children(samples: DataFrame, meshes: DataFrame) -> DataFrame:
    """World matrices (row-major) of a moved node's children, which follow it rigidly.

    samples: session_id, ts, node_id, child_path, position, rotation, scale. meshes: path, position,
    rotation, scale at scan time. child(t) = root(t) * inverse(root at scan) * child at scan, for paths
    strictly below the node's; a singular root at scan gives none; captured children win. A path meets the paths above
    it by equality: each is listed with all of its beginnings.
    """
    roots = samples.where("child_path = ''")
    world = F.struct("position", "rotation", "scale")
    scan = meshes.select(F.col("path"), world.alias("child"))
    root_scan = meshes.select(F.col("path").alias("root_path"), world.alias("root"))
    parts = F.split("path", "/")
    above = F.transform(F.slice(F.sequence(F.lit(0), F.size(parts) - 1), 2, F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    pairs = scan.select("path", "child", F.explode(above).alias("root_path")).join(root_scan, "root_path")
    joined = roots.join(pairs, F.col("node_id") == F.col("root_path"))
    captured = samples.where("child_path <> ''").select("session_id", "ts", F.concat_ws("/", "node_id", "child_path").alias("path"))
    joined = joined.join(captured, ["session_id", "ts", "path"], "left_anti")
    rows = joined.select("session_id", "ts", "path", "position", "rotation", "scale", *[F.col(f"{o}.{c}").alias(f"{o}_{c}") for o in ("root", "child") for c in ("position", "rotation", "scale")])

    def run(batches):
        for pdf in batches:
            if len(pdf):
                now, then, child = (_matrices(pdf[f"{o}position"], pdf[f"{o}rotation"], pdf[f"{o}scale"]) for o in ("", "root_", "child_"))
                ok = np.abs(np.linalg.det(then)) > 1e-12
                m = now[ok] @ np.linalg.inv(then[ok]) @ child[ok]
                yield pdf.loc[ok, ["session_id", "ts", "path"]].assign(matrix=list(m.reshape(-1, 16)))

    return rows.mapInPandas(run, "session_id string, ts timestamp, path string, matrix array<double>")
