"""A session longer than a batch of the wire is sent in several and counted whole."""

import duckdb
from pyspark.sql import functions as F

from lumenscape.plans.registry import CATALOGUE
from lumenscape.plans.scene_view import scene_events
from lumenscape.plans.source_queries import as_batches
from lumenscape.schema import MAX_BATCH
from lumenscape.sources.ingest import explode_batches
from tests.test_catalogue import rows


def test_hot_session_is_counted(spark, tmp_path):
    ts = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 60)
    user = F.when(F.col("id") < 2 * MAX_BATCH + 1, 1).otherwise(F.col("id") % 20 + 2).cast("long")
    events = spark.range(3 * MAX_BATCH).select(F.col("id").alias("event_id"), ts.cast("timestamp_ntz").alias("ts"), user.alias("user_id"), F.lit("view").alias("event_type"), (F.col("id") % 100).cast("double").alias("value"), F.format_string('{"k": %d}', F.col("id") % 100).alias("props"))
    events.write.parquet(str(tmp_path / "events.parquet"))
    sizes = explode_batches(as_batches(scene_events(spark, str(tmp_path)))).groupBy("batch_id").agg(F.count("e.type").alias("n")).agg(F.max("n"), F.sum("n")).first()
    assert sizes[0] <= MAX_BATCH and sizes[1] == 3 * MAX_BATCH
    query = CATALOGUE["ingest_event_counts"]
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    cursor = con.execute(query.duckdb())
    columns, wanted = [d[0] for d in cursor.description], cursor.fetchall()
    got = query.spark(spark, str(tmp_path))
    assert sum(r[columns.index("count")] for r in wanted) == 3 * MAX_BATCH
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, wanted)
