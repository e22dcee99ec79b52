"""One session or one day may hold most rows: what is asked of it is still the work of many tasks, in bounded memory."""

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lumenscape.functions.filters import Scope
from lumenscape.operators import capture, changes, derived, meshes
from lumenscape.operators.asof import RANGE_S, asof_join, with_previous
from lumenscape.operators.meshes import Step
from lumenscape.sources import ingest

BASE = datetime(2024, 1, 1)
ROWS = "session_id string, ts timestamp, event_id long, v long"


def hot_rows(seed, n=900, days=3):
    """(session, ts, id, value): a third in one session over several days, with equal times and long pauses."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        session = "hot" if i % 3 == 0 else f"s{rng.randrange(20)}"
        seconds = rng.randrange(days * 24) * 3600 + rng.choice([0, 0, 1, 5, 3599]) if rng.random() < 0.7 else rng.randrange(days * 86_400)
        rows.append((session, BASE + timedelta(seconds=seconds), i, rng.randrange(100)))
    return rows


def test_asof_join_of_a_hot_session(spark):
    left, right = hot_rows(1), hot_rows(2, 400)
    want = {}
    for s, t, i, v in left:
        before = [(rt, ri, rv) for rs, rt, ri, rv in right if rs == s and rt <= t]
        want[i] = max(before)[2] if before else None
    lefts, rights = spark.createDataFrame(left, ROWS), spark.createDataFrame(right, ROWS).withColumnRenamed("v", "w")
    got = asof_join(lefts, rights)
    assert {r.event_id: r.found.w if r.found else None for r in got.collect()} == want and got.count() == len(left)
    assert asof_join(lefts, rights, inner=True).count() == sum(v is not None for v in want.values())
    # the rows of the hot session are dealt out by ranges of time
    ranges = lefts.where("session_id = 'hot'").select(F.floor(F.unix_seconds("ts") / RANGE_S)).distinct().count()
    assert ranges > 50


def test_previous_rows_of_a_hot_session(spark):
    rows = hot_rows(3)
    want = sorted((s, t, v, max((pt, pi, pv) for ps, pt, pi, pv in rows if ps == s and pt < t)[2]) for s, t, i, v in rows if any(ps == s and pt < t for ps, pt, _, _ in rows))
    got = with_previous(spark.createDataFrame(rows, ROWS), ["v"])
    assert sorted((r.session_id, r.ts, r.cur.v, r.prev.v) for r in got.collect()) == want


@pytest.mark.parametrize("n_steps", [2, 4, 7])
def test_funnel_of_a_hot_session(spark, n_steps):
    rng = random.Random(n_steps)
    kinds = [f"t{i}" for i in range(n_steps)]
    rows = [(s, t, i, rng.choice([*kinds, "other"])) for s, t, i, _ in hot_rows(n_steps + 10)]
    reached = [0] * n_steps
    for session in {r[0] for r in rows}:
        at = datetime.min
        for j, kind in enumerate(kinds):
            later = [t for s, t, _, k in rows if s == session and k == kind and t >= at]
            if not later:
                break
            at, reached[j] = min(later), reached[j] + 1
    df = spark.createDataFrame([("p", *r) for r in rows], "project_id string, session_id string, ts timestamp, event_id long, event_type string").withColumns({"mesh": F.lit(""), "name": F.lit("")})
    got = meshes.funnel(df, Scope("p"), [Step(k) for k in kinds])
    assert [(r.step, r.sessions) for r in got.collect()] == list(enumerate(reached))
    text = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(session_id" in text and ", range" in text


def plain_changes(rows, eps, below):
    """ids that are kept, of (key, order, id, vector or None)."""
    kept, last = [], {}
    same = lambda a, b: a is None and b is None or a is not None and b is not None and len(a) == len(b) and all(abs(x - y) < eps if below else abs(x - y) <= eps for x, y in zip(a, b))
    for key, _, i, v in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        if key not in last or not same(last[key], v):
            last[key] = v
            kept.append(i)
    return sorted(kept)


@pytest.mark.parametrize("batch", [7, 10_000])
def test_changes_are_one_stream_whatever_the_batches(spark, batch):
    rng = random.Random(4)
    rows = [(s, t, i, None if v < 5 else [float(v // 10), rng.choice([0.0, 0.4])][: 1 if v > 95 else 2]) for s, t, i, v in hot_rows(5)]
    df = spark.createDataFrame(rows, "session_id string, ts timestamp, event_id long, pose array<double>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        for eps, below in ((1.0, False), (1.0, True), (0.0, False)):
            got = changes.keep_changes(df, ["session_id"], ["pose"], eps, below)
            assert sorted(r.event_id for r in got.collect()) == plain_changes(rows, eps, below)
        spaced = capture.thin(df, 7_200_000.0, ["session_id"])
        want = plain_changes([(s, t, i, [t.timestamp() * 1000]) for s, t, i, _ in rows], 7_200_000.0, True)
        assert sorted(r.event_id for r in spaced.collect()) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_hot_channel_is_read_by_ranges(spark):
    """A camera that wanders, rests for hours and creeps: most ranges are read side by side, the rest where nothing is sure."""
    rng = random.Random(9)
    rows, at = [], 0.0
    for hour in range(60):
        speed = rng.choice([0.0, 0.0, 0.02, 1.0])
        for k in range(40):
            at += speed * rng.uniform(-1, 1.2)
            rows.append(("hot", BASE + timedelta(hours=hour, seconds=k * 80), len(rows), None if rng.random() < 0.01 else [at, 0.0]))
    df = spark.createDataFrame(rows, "session_id string, ts timestamp, event_id long, pose array<double>")
    for eps in (0.0, 0.3, 5.0):
        got = changes.keep_changes(df, ["session_id"], ["pose"], eps)
        assert sorted(r.event_id for r in got.collect()) == plain_changes(rows, eps, False)
    plan = changes.keep_changes(df, ["session_id"], ["pose"], 0.3)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(session_id" in plan and "__group" in plan


@pytest.mark.parametrize("range_rows", [1, 100, 100_000])
def test_only_long_channels_are_split(spark, range_rows):
    """Ranges are sized by rows, so that a channel with a row an hour is one stream and not as many ranges as rows."""
    rng = random.Random(12)
    rows = [(f"s{i % 30}" if i % 2 else rng.choice(["hot", None]), BASE + timedelta(minutes=47 * i), i, None if rng.random() < 0.02 else [rng.uniform(0, 3), 0.0][: 1 if rng.random() < 0.02 else 2]) for i in range(1200)]
    df = spark.createDataFrame(rows, "session_id string, ts timestamp, event_id long, pose array<double>")
    want = plain_changes([(s or "", *rest) for s, *rest in rows], 1.0, False)
    assert sorted(r.event_id for r in changes.keep_changes(df, ["session_id"], ["pose"], 1.0, range_rows=range_rows).collect()) == want
    parts = changes.ranges_of(df, ["session_id"], range_rows).groupBy("session_id").agg(F.countDistinct("__range").alias("n"))
    ranges = {r.session_id: r.n for r in parts.collect()}
    assert ranges["s1"] == {1: 40}.get(range_rows, 1)  # it has 40 rows, one an hour
    assert range_rows != 100 or 2 <= ranges["hot"] <= 5


@pytest.mark.parametrize("size", [0.5, 3.0, 40.0, 700.0, 1e7])
def test_boxes_of_any_extent_meet_their_cells(spark, size):
    rng = random.Random(int(size))
    cells = [tuple(rng.randrange(-40, 40) for _ in range(3)) for _ in range(300)]
    boxes = [(f"b{i}", [x - size * rng.random() for x in c] + [x + size * rng.random() for x in c]) for i, c in enumerate(cells[:20])] + [("flat", [-size, -0.1, -size, size, 0.1, size]), ("far", [9e6, 9e6, 9e6, 9e6, 9e6, 9e6])]
    coverage = spark.createDataFrame([(*c, n + 1) for n, c in enumerate(cells)], "vx long, vy long, vz long, count long")
    got = derived.dead_zones(coverage, spark.createDataFrame(boxes, "name string, aabb array<double>"), 1.0)
    want = {name: sum(n + 1 for n, c in enumerate(cells) if all(math.ceil(b[i] - 1.0 - 0.5) <= c[i] <= math.floor(b[i + 3] + 1.0 - 0.5) for i in range(3))) for name, b in boxes}
    assert {r["name"]: r.visits for r in got.collect()} == want
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def test_ndjson_sessions_share_files_and_long_ones_span_them(spark, tmp_path):
    rng = random.Random(6)
    lengths = {"long": 70, "a": 3, "b": 4, "c": 1}
    rows = [(s, BASE + timedelta(seconds=rng.randrange(50)), f'{{"type":"custom","n":{i},"session":"{s}"}}') for s, n in lengths.items() for i in range(n)]
    rows.append(("c", BASE, '{"type":"custom",\n"n":1}'))
    path = str(tmp_path / "n")
    ingest.write_session_ndjson(spark.createDataFrame(rows, "session_id string, ts timestamp, payload string"), path, lines_per_file=20)
    index = spark.read.parquet(f"{path}/index").collect()
    files = {r["file"] for r in index}
    assert 1 < len(files) <= 4 and len([r for r in index if r["session_id"] == "long"]) > 1
    for session in lengths:
        want = [p.replace("\n", " ") for s, _, p in sorted(r for r in rows if r[0] == session)]
        assert [r.value for r in ingest.read_session_ndjson(spark, path, session).orderBy("place").collect()] == want
    assert ingest.read_session_ndjson(spark, path, "nobody").count() == 0
    good, skipped = ingest.read_ndjson(spark, f"{path}/lines")
    assert good.count() == len(rows) and skipped.first()[0] == 0


def test_files_of_sessions_are_not_tasks(spark, tmp_path):
    """How many files there are does not set how many tasks write them, nor how many keys are sampled to the driver."""
    rows = spark.range(3000).select(F.concat(F.lit("s"), F.col("id") % 100).alias("session_id"), F.timestamp_seconds("id").alias("ts"), F.format_string('{"type":"custom","n":%d}', "id").alias("payload"))
    path, tracker = str(tmp_path / "n"), spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("ndjson", "ndjson")
    try:
        ingest.write_session_ndjson(rows, path, lines_per_file=10)
        stages = {s for job in tracker.getJobIdsForGroup("ndjson") for s in tracker.getJobInfo(job).stageIds}
    finally:
        spark.sparkContext.setJobGroup("", "")
    assert max(tracker.getStageInfo(s).numTasks for s in stages if tracker.getStageInfo(s)) < 50
    index = spark.read.parquet(f"{path}/index")
    assert index.select("file").distinct().count() >= 300 and index.agg(F.max("last")).first()[0] == 9
    assert [r.value for r in ingest.read_session_ndjson(spark, path, "s7").collect()] == [f'{{"type":"custom","n":{n}}}' for n in range(7, 3000, 100)]
