"""Derived queries over whole inputs: builders' display limits must not cut what a roll-up reads."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from lumenscape.plans.registry import CATALOGUE
from tests.test_catalogue import rows

#: Queries whose inner limits bind on a table, with that table.
BINDS = {
    **dict.fromkeys(["gaze_click_divergence", "standpoints", "collapse_flow", "rays_by_camera", "rays_by_mesh", "scene_metrics", "robust_intensity"], "sf0.01"),
    "desire_lines": "sf0.1",
}


def whole(name, table):
    """Rows of the query's SQL without its inner limits."""
    con = duckdb.connect()
    con.execute(f"create view events as select * from '/root/testdata/{table}/events.parquet'")
    cursor = con.execute(re.sub(r" LIMIT \d+", "", CATALOGUE[name].duckdb()))
    return [d[0] for d in cursor.description], cursor.fetchall()


@pytest.mark.parametrize("name", BINDS)
def test_whole_input(spark, name):
    columns, records = whole(name, BINDS[name])
    got = CATALOGUE[name].spark(spark, f"/root/testdata/{BINDS[name]}")
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, records)


def test_flow_graph_counts_every_flow(spark):
    columns, records = whole("collapse_flow", "sf0.01")
    total = sum(r[columns.index("count")] for r in records)
    assert CATALOGUE["flow_graph"].spark(spark, "/root/testdata/sf0.01").agg(F.sum("count")).first()[0] == total


def test_desire_edges_count_every_step(spark):
    columns, records = whole("desire_lines", "sf0.1")
    steps = len(records) - len({r[columns.index("session_id")] for r in records})
    assert CATALOGUE["desire_edges"].spark(spark, "/root/testdata/sf0.1").agg(F.sum("count")).first()[0] == steps


def test_dead_zones_read_every_cell(spark):
    """6,000 cells visited once each; the only mesh lies by the last of them."""
    cells = spark.range(6000).select(F.lit("camera_sample").alias("event_type"), F.lit("").alias("mesh"), F.array(F.col("id") - 5998.5, F.lit(0.5), F.lit(0.5)).alias("position"), F.array().cast("array<double>").alias("hit_point"))
    hit = spark.range(1).select(F.lit("pointer_click").alias("event_type"), F.lit("m").alias("mesh"), F.array().cast("array<double>").alias("position"), F.array(F.lit(0.5), F.lit(0.5), F.lit(0.5)).alias("hit_point"))
    events = cells.union(hit).select("*", F.lit("p0").alias("project_id"), F.lit("s").alias("session_id"), F.lit("lobby").alias("scene_id"), F.lit("mouse").alias("source"), F.current_timestamp().alias("ts"))
    row = CATALOGUE["dead_zones"].run(events).first()
    assert (row.name, row.dead) == ("m", False)
