"""Questions over the stored table prune its days, push filters to the scan and read few columns."""

import contextlib
import io
import os
import subprocess
import sys

import pytest

from lumenscape.operators import correlate, performance, spatial, volume
from lumenscape.operators.rollups import Rollups
from lumenscape.plans import capture_queries
from lumenscape.plans.analytics import PART
from lumenscape.plans.scene_view import PROJECT, scene_events
from lumenscape.plans.source_queries import as_batches, node_batches
from lumenscape.sources import ingest
from tests.conftest import ROOT


def plan(df):
    session = df.sparkSession
    session.conf.set("spark.sql.maxMetadataStringLength", "5000")
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_days_filters_and_columns_reach_the_scan(spark, sf):
    text = plan(spatial.world_heatmap(scene_events(spark, sf), PART))
    line = lambda name: next(x for x in text.splitlines() if x.startswith(name))
    assert "event_date" in line("PartitionFilters") and "2024-01-05" in line("PartitionFilters")
    assert "EqualTo(scene_id,lobby)" in line("PushedFilters") and "event_type" in line("PushedFilters")
    columns = line("ReadSchema")
    assert "hit_point" in columns and "payload" not in columns and "position" not in columns


def test_few_shuffles(spark, sf):
    events = scene_events(spark, sf)
    exchanges = lambda df: plan(df).count("Arguments: hashpartitioning")
    assert exchanges(volume.event_type_counts(events, PART)) == 1
    # rows by session and range of time, once; the rest are a row for each of these
    text = plan(correlate.navigation_effort(events, PART))
    assert text.count("hashpartitioning(session_id#") <= 5 and "NestedLoop" not in text and "CartesianProduct" not in text


@pytest.mark.parametrize("question", ["perf_summary", "render_scale_truth", "perf_distribution", "frame_time_percentiles", "jank_rate", "perf_by_device", "perf_by_scene", "resource_percentiles"])
def test_quantiles_read_their_rows_twice(spark, sf, question):
    text = plan(getattr(performance, question)(scene_events(spark, sf), PART))
    assert scans(text) == 2 and "NestedLoop" not in text and "CartesianProduct" not in text


def scans(text):
    return sum(line.startswith("Location:") for line in text.splitlines())


def test_rollups_read_states_and_not_events(spark, sf, tmp_path):
    assert scans(plan(volume.perf_daily(scene_events(spark, sf)))) == 2
    kept = Rollups(spark, str(tmp_path / "r"))
    kept.append(scene_events(spark, sf), "w", 0)
    text = plan(kept.perf_daily(PART))
    assert scans(text) == 3 and all("2024-01-05" in line for line in text.splitlines() if line.startswith("PartitionFilters"))


def test_admission_is_one_parse_within_the_row(spark, sf, tmp_path):
    """No join but that with the projects, which are broadcast, no shuffle of batches or events, and each event parsed once."""
    as_batches(scene_events(spark, sf)).write.parquet(str(tmp_path / "batches"))
    spark.createDataFrame([(PROJECT,)], "project_id string").write.parquet(str(tmp_path / "projects"))
    read = lambda name: spark.read.parquet(str(tmp_path / name))
    for part in ingest.ingest_judged(ingest.judge(read("batches"), read("projects")), "secret"):
        text = part._jdf.queryExecution().executedPlan().toString()
        assert text.count("Join") == 1 and "BroadcastHashJoin" in text
        assert text.count("hashpartitioning") == 1 and text.index("hashpartitioning") > text.index("BroadcastExchange")  # the projects, made distinct
        assert text.count("from_json(StructField(type") <= 1


def test_batches_are_not_dealt_out_by_project(spark, sf):
    """Projects of unknown size are broadcast too: the batches of one project are not read by one task."""
    projects = spark.createDataFrame([(PROJECT,)], "project_id string")
    for part in ingest.ingest(node_batches(scene_events(spark, sf)), projects, "secret"):
        text = part._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def test_prefixes_and_boxes_join_by_equality(spark, sf):
    children = capture_queries.rigid_children(scene_events(spark, sf))
    assert "NestedLoop" not in plan(children) and "CartesianProduct" not in plan(children)


def test_entry_imports_without_a_session():
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 120 and set(s) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, env={**os.environ, "PYTHONPATH": ROOT}, check=True, timeout=120)
