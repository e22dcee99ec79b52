"""Streams: ingest, roll-ups, presence and tails."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from lumenscape.operators.rollups import Rollups
from lumenscape.sources.commits import CommitLog, stream_identity
from lumenscape.sources.ingest import INGESTED, finished_rows, judge, split_finished, write_events

# Presence window, activity levels and back-fill.
LIVE_S, ACTIVE_S, RECENT_S, BACKFILL = 30, 3, 15, 200
#: Tasks that a micro-batch is parsed by, for each core.
TASKS_PER_CORE = 4


def streaming_ingest(batches: DataFrame, projects: DataFrame, secret: str, folder: str, checkpoint: str, after: Callable[[str], None] | None = None) -> StreamingQuery:
    """Collected batches into events, node_samples and quarantine under one folder, exactly once: read them by CommitLog.

    A micro-batch is one commit, named by the query and the number of the micro-batch: one that is run again after a
    failure replaces what it had written, or writes nothing if it was complete. Its events are parsed and worked out once
    and kept as finished rows for the three tables; batches are dealt out evenly before, however few the files they came in.
    What is kept, and what is done anew after a failure, is a micro-batch: bound it by the files of read_event_stream().
    after is called with the name of each table that is written, and at last with "record".
    """
    log = CommitLog(batches.sparkSession, folder)
    tasks = TASKS_PER_CORE * batches.sparkSession.sparkContext.defaultParallelism

    def write(rows: DataFrame, number: int) -> None:
        finished = finished_rows(judge(rows.repartition(tasks), projects), secret).persist()
        events, samples, rejected = split_finished(finished)
        tables = {
            "events": lambda path: write_events(events, path, "overwrite"),
            "node_samples": lambda path: write_events(samples, path, "overwrite"),
            "quarantine": lambda path: rejected.write.mode("overwrite").parquet(path),
        }
        try:
            log.commit(stream_identity(log.spark, checkpoint), number, tables, after)
        finally:
            finished.unpersist()

    return batches.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def compact_ingested(spark: SparkSession, folder: str, number: int) -> int:
    """Rewrite the commits of streaming_ingest() as one, in the order of the event sink; how many there were."""
    dated = lambda rows, path: write_events(rows.drop("event_date", "inserted_at"), path, "overwrite")
    plain = lambda rows, path: rows.write.mode("overwrite").parquet(path)
    return CommitLog(spark, folder).compact(number, {"events": dated, "node_samples": dated, "quarantine": plain}, INGESTED)


def ingested(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """events, node_samples or quarantine as streaming_ingest() has committed them."""
    return CommitLog(spark, folder).read(table, INGESTED[table]).drop("commit")


def streaming_rollups(events: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Daily rollups kept by a stream of the wide table: each micro-batch adds its states once, late days too; read them by Rollups."""
    kept = Rollups(events.sparkSession, folder)

    def write(rows: DataFrame, number: int) -> None:
        kept.append(rows, stream_identity(events.sparkSession, checkpoint), number)

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    return stream.withWatermark("ts", delay)


def deduplicate(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Without re-sent events: equal payloads of one session within the watermark."""
    key = stream.withColumn("__key", F.sha2(F.concat_ws("|", "project_id", "session_id", "payload"), 256))
    return late(key, delay).dropDuplicatesWithinWatermark(["__key"]).drop("__key")


def _windowed(stream: DataFrame, seconds: int, *keys: str) -> DataFrame:
    return late(stream).groupBy(F.window("ts", f"{seconds} seconds").alias("w"), *keys)


def stream_timeseries(stream: DataFrame, seconds: int = 3600) -> DataFrame:
    fps = F.avg(F.when(F.col("event_type") == "frame_perf", F.col("fps")))
    return _windowed(stream, seconds).agg(F.count(F.lit(1)).alias("events"), fps.alias("avg_fps")).select(F.unix_millis("w.start").alias("bucket"), "events", "avg_fps")


def stream_type_counts(stream: DataFrame, seconds: int = 3600) -> DataFrame:
    return _windowed(stream, seconds, "event_type").agg(F.count(F.lit(1)).alias("count")).select(F.unix_millis("w.start").alias("bucket"), "event_type", "count")


def stream_rage_clicks(stream: DataFrame, seconds: int = 2, min_repeats: int = 3) -> DataFrame:
    clicks = stream.where("event_type = 'pointer_click' and mesh <> ''")
    out = _windowed(clicks, seconds, "session_id", "mesh").agg(F.count(F.lit(1)).alias("clicks")).where(F.col("clicks") >= min_repeats)
    return out.select("session_id", "mesh", F.unix_millis("w.start").alias("bucket"), "clicks")


def stream_events_daily(stream: DataFrame) -> DataFrame:
    out = _windowed(stream, 86_400, "project_id", "event_type").agg(F.count(F.lit(1)).alias("events"))
    return out.select("project_id", "event_type", F.to_date("w.start").alias("day"), "events")


def presence_at(events: DataFrame, now: Column) -> DataFrame:
    """Batch twin of live.live_now(): sessions live at a time, from arrival times; a gap over LIVE_S or a session_end ends a stay."""
    w = Window.partitionBy("project_id", "session_id").orderBy("received_at")
    rows = events.where(F.col("received_at") <= now)
    gap = F.unix_millis("received_at") - F.unix_millis(F.lag("received_at").over(w)) > LIVE_S * 1000
    rows = rows.withColumn("stay", F.sum(F.when(gap | (F.lag("event_type").over(w) == "session_end"), 1).otherwise(0)).over(w))
    newest = lambda c: F.max_by(c, F.when(F.col(c) != "", F.col("received_at"))).alias(c)
    stays = rows.groupBy("project_id", "session_id", "stay").agg(F.min("received_at").alias("started_at"), F.max("received_at").alias("last_seen"), newest("visitor_id"), newest("scene_id"), F.max_by("event_type", "received_at").alias("end"))
    live = (F.unix_millis(now) - F.unix_millis("last_seen") <= LIVE_S * 1000) & (F.col("end") != "session_end")
    return stays.where(live).drop("stay", "end")


def activity(age_ms: Column) -> Column:
    return F.when(age_ms <= ACTIVE_S * 1000, "active").when(age_ms <= RECENT_S * 1000, "recent").otherwise("idle")


def presence_snapshot(live: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(sessions and distinct visitors by project, roster newest first): visitor ids are counted, not shown."""
    totals = live.groupBy("project_id").agg(F.count(F.lit(1)).alias("sessions"), F.countDistinct(F.coalesce(F.nullif("visitor_id", F.lit("")), "session_id")).alias("visitors"))
    roster = live.select("project_id", "session_id", "scene_id", "started_at", "last_seen", activity(F.unix_millis(now) - F.unix_millis("last_seen")).alias("activity"))
    return totals, roster.orderBy("project_id", F.desc("last_seen"), "session_id")


def backfill(events: DataFrame, n: int = BACKFILL) -> DataFrame:
    """The last n events of every session, oldest first."""
    w = Window.partitionBy("session_id").orderBy(F.desc("received_at"), F.desc("event_id"))
    return events.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn").orderBy("session_id", "received_at", "event_id")


def firehose(stream: DataFrame, project: str, types: list[str] | None = None) -> DataFrame:
    out = stream.where(F.col("project_id") == project)
    return out.where(F.col("event_type").isin(types)) if types else out


def session_feed(stored: DataFrame, stream: DataFrame, project: str, session: str, folder: str, checkpoint: str, n: int = BACKFILL) -> StreamingQuery:
    """What a viewer of one session gets: its last n stored events first (phase 'backfill'), then live ones as they arrive.

    Rows of one feed are appended under folder; a repeated first micro-batch writes its own rows again, not more.
    """

    def write(rows: DataFrame, number: int) -> None:
        out = rows.withColumn("phase", F.lit("live"))
        if number == 0:
            before = backfill(session_tail(stored, project, session), n).withColumn("phase", F.lit("backfill"))
            out = before.unionByName(out, allowMissingColumns=True)
        out.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    live = session_tail(stream, project, session)
    return live.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rows_too_late(query: StreamingQuery) -> int:
    """How many rows a query left out so far because they came behind its watermark."""
    return sum(state["numRowsDroppedByWatermark"] for progress in query.recentProgress for state in progress["stateOperators"])


def session_tail(stream: DataFrame, project: str, session: str) -> DataFrame:
    """Live events of one session; backfill() gives what came before."""
    return firehose(stream, project).where(F.col("session_id") == session)


def read_event_stream(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """A stream over the files of write_events(), at most so many a micro-batch."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)
