"""Streaming ingest at size: micro-batches stay small, and what one keeps is worked out once and short."""

import json
import re
from datetime import datetime

from pyspark.sql import functions as F

from lumenscape.plans import source_queries
from lumenscape.plans.scene_view import PROJECT, scene_events
from lumenscape.sources import ingest as I
from lumenscape.streaming import jobs
from tests.test_event_rules import cases


def test_micro_batches_do_not_grow_with_the_events(spark, sf, monkeypatch):
    """Ten files a kind are more than two micro-batches, whatever part of a commit the stream breaks down after."""
    events = scene_events(spark, sf)
    commits, compact = [], jobs.compact_ingested
    monkeypatch.setattr(source_queries, "EVENTS_PER_FILE", -(-events.count() // 10), raising=False)
    monkeypatch.setattr(jobs, "compact_ingested", lambda *a: commits.append(compact(*a)))
    rows = {(r.part, r.what): r["count"] for r in source_queries.stream_ingested(events, ("events", "record")).collect()}
    assert commits[0] >= 7
    assert sum(n for (part, _), n in rows.items() if part == "events") == events.count() + events.where("event_id % 14 = 0").count()
    assert sum(n for (part, _), n in rows.items() if part == "quarantine") == events.where("event_id % 14 <> 0").count()


def test_finished_rows_are_the_three_tables(spark, sf):
    """What a micro-batch keeps has no parsed event, and its parts are those that are worked out one by one."""
    events = scene_events(spark, sf)
    batches = source_queries.flawed_batches(events).union(source_queries.node_batches(events)).union(source_queries.as_batches(events))
    judged = I.judge(batches, spark.createDataFrame([(PROJECT,)], "project_id string")).persist()
    finished = I.finished_rows(judged, "secret").persist()
    assert not re.search("variant|struct", finished.schema.simpleString().removeprefix("struct"))
    for got, want in zip(I.split_finished(finished), I.ingest_judged(judged, "secret"), strict=True):
        assert got.schema.names == want.schema.names and want.count() > 0
        assert got.count() == want.count() and got.exceptAll(want).count() == 0
    judged.unpersist()
    finished.unpersist()


def test_rules_read_the_top_of_an_event_once():
    """By a path only the type and what lies in an object of the event are read, never a field at its top."""
    assert set(re.findall(r"'\$\.(\w+)'", I.event_problem())) - {f.partition(".")[0] for r in (I.ENVELOPE, *I.RULES.values()) for f in r if "." in f} == {"type"}


def test_known_fields_change_no_verdict(spark):
    """Rules that take values from the fields known by type find what those find that read the event alone."""
    wanted = list(cases())
    rows = [(str(i), json.dumps({"events": [e]}), datetime(2024, 1, 1), "", "") for i, (e, _) in enumerate(wanted)]
    found = I.explode_batches(spark.createDataFrame(rows, I.BATCHES)).select("batch_id", F.expr(I.event_problem("v", "e")).alias("problem")).collect()
    wrong = [(wanted[int(r.batch_id)], r.problem) for r in found if r.problem != wanted[int(r.batch_id)][1]]
    assert len(found) == len(wanted) and not wrong, wrong[:5]
