"""Every rule of the wire format: a valid event of each type is accepted, one with each flaw is not."""

import json
from datetime import datetime

from pyspark.sql import functions as F

from lumenscape.sources import ingest as I

BASE = {"projectId": "p", "sessionId": "s", "ts": 1, "sdkVersion": "1"}


def good(rule):
    word, *rest = rule.split()
    if word == "text":
        return "x" * int(rest[0] or 0)
    if word == "one":
        return rest[-1]
    if word in ("vector", "unit"):
        return [0.5] * int(rest[-1])
    return {"number": 0.5, "whole": 3, "flag": True, "scene": "lobby", "object": {}, "scalars": {"a": 1, "b": None, "c": "x", "d": False}}[word]


def bad(rule):
    """Values that break a rule; another kind of JSON value always does."""
    word, *rest = rule.split()
    out = [None, [] if word != "vector" else {}]
    if word == "text":
        least, most = int(rest[0]), int(rest[1]) if len(rest) > 1 else None
        return out + [5] + ([""] if least else []) + (["x" * (most + 1), "\U0001f600" * (most // 2 + 1)] if most else [])
    if word == "one":
        return out + ["nonsense", 5, ""]
    if word in ("number", "whole"):
        bound = [-1.5] if ">=" in rule else [0, -1] if ">" in rule else [1.5, -0.1] if "BETWEEN" in rule else []
        return out + ["5", True, *bound, *([0.5] if word == "whole" else [])]
    if word in ("vector", "unit"):
        n = int(rest[-1])
        return out + [[0.5] * (n - 1), [0.5] * (n + 1), [None] * n, ["0.5"] * n, *([[1.5] * n] if word == "unit" else [])]
    if word == "scalars":
        return out + [{"a": []}, {"a": "x" * 1025}, {f"k{i}": 1 for i in range(65)}]
    return out + {"flag": [0, "true"], "scene": ["no spaces", "x" * 65, ""], "object": ["x", 5]}[word]


def put(event, path, value):
    """The event with a field set at a dotted path; objects on the way are made, with what they need."""
    event = json.loads(json.dumps(event))
    at = event
    *parents, name = path.split(".")
    for p in parents:
        at = at.setdefault(p, {"name": "n"} if p == "connector" else {"handedness": "left"} if p == "coordinateSystem" else {"origin": [0, 0, 0], "direction": [0, 0, 1]} if p == "ray" else {})
    at[name] = value
    return event


def cases():
    for kind, rules in I.RULES.items():
        whole = {**BASE, "type": kind} | {f: good(r) for f, r in rules.items() if not f.endswith("?") and "." not in f}
        yield whole, None
        yield put(whole, "unheardOf", {"anything": [1]}), None
        for field, rule in rules.items():
            path = field.rstrip("?")
            if rule != "object":
                yield put(whole, path, good(rule)), None
            for value in bad(rule):
                yield put(whole, path, value), kind
            if not field.endswith("?") and "." not in field:
                yield {k: v for k, v in whole.items() if k != path}, kind
    for field, rule in I.ENVELOPE.items():
        whole = {**BASE, "type": "scene_change"}
        path = field.rstrip("?")
        for value in bad(rule):
            yield put(whole, path, value), "envelope"
        if field.endswith("?"):
            yield put(whole, path, good(rule)), None
        else:
            yield {k: v for k, v in whole.items() if k != path}, "envelope"
    yield {**BASE, "type": "nonsense"}, "unknown type"
    yield {**BASE}, "not an event"
    yield {**BASE, "type": "session_start", "connector": {}}, "session_start"
    yield {**BASE, "type": "pointer_move", "ray": {"origin": [0, 0, 0]}}, "pointer_move"


def test_every_rule(spark):
    wanted = list(cases())
    rows = [(str(i), json.dumps({"events": [e]}), datetime(2024, 1, 1), "", "") for i, (e, _) in enumerate(wanted)]
    found = I.explode_batches(spark.createDataFrame(rows, I.BATCHES)).select("batch_id", F.expr(I.event_problem()).alias("problem")).collect()
    wrong = [(wanted[int(r.batch_id)], r.problem) for r in found if r.problem != wanted[int(r.batch_id)][1]]
    assert len(found) == len(wanted) and not wrong, wrong[:5]


def test_client_identifiers_do_not_survive(spark):
    """A quoted, nested and repeated visitor id: only the one at the top goes, and it goes whole."""
    event = {**BASE, "type": "session_start", "visitorId": 'me "quoted" \\ me', "user": {"id": "u", "traits": {"visitorId": "kept"}}, "device": {"browser": "mine", "vendor": "v"}}
    batch = spark.createDataFrame([("b", json.dumps({"events": [event]}), datetime(2024, 1, 1), "ip", "Firefox/1")], I.BATCHES)
    row = I.enrich(I.explode_batches(batch), "secret").select("raw", "e.visitorId").first()
    sent = json.loads(row.raw)
    assert sent["visitorId"] == row.visitorId and "quoted" not in row.raw and sent["user"] == event["user"]
    assert sent["device"] == {"vendor": "v", "browser": "Firefox", "os": "Other"}
