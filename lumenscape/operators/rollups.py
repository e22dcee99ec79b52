"""Daily rollups kept as states that merge: what a batch of events adds is appended, what the batches make up is worked out at read.

A batch appends counts, sums and least values, how many frame rates lie in each band of their order, and the frame rates
themselves, counted and sorted by band. Reading merges the small states; for the exact median of a day only the
values of the bands that hold it are read. A batch may hold any days, late ones too, and counts once (see CommitLog).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lumenscape.functions.filters import Scope, whole_days
from lumenscape.operators.quantiles import band, null_safe, ranked_values, wanted_bands
from lumenscape.operators.volume import count, events_daily, of_type
from lumenscape.sources.commits import CommitLog

_DAY = ["project_id", "day"]
# The columns of the states.
STATES = {
    "events": "project_id string, event_type string, events long, day date",
    "frames": "project_id string, samples long, fps_sum double, fps_n long, min_fps double, day date",
    "bands": "project_id string, band long, n long, day date",
    "values": "project_id string, band long, value double, n long, day date",
}


class Rollups:
    """The states below one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.log = CommitLog(spark, folder)

    def append(self, events: DataFrame, writer: str, number: int) -> bool:
        """Add a batch of the wide table; False if this batch of this writer has been added before. The batch is read once."""
        rows = events.select("project_id", "event_type", "ts", "fps").persist()
        frames = of_type(rows, "frame_perf").select("project_id", F.to_date("ts").alias("day"), F.nanvl("fps", F.lit(None)).alias("fps"))
        values = frames.where("fps is not null").groupBy(*_DAY, band(F.col("fps")).alias("band"), F.col("fps").alias("value")).agg(count().alias("n"))
        tables = {
            "events": events_daily(rows),
            "frames": frames.groupBy(*_DAY).agg(count().alias("samples"), F.sum("fps").alias("fps_sum"), F.count("fps").alias("fps_n"), F.min("fps").alias("min_fps")),
            "bands": values.groupBy(*_DAY, "band").agg(F.sum("n").alias("n")),
            "values": values,
        }
        try:
            return self.log.commit(writer, number, {name: lambda path, t=table: _write(t, path) for name, table in tables.items()})
        finally:
            rows.unpersist()

    def compact(self, number: int) -> int:
        """Merge all states into one of each day; how many commits there were."""
        merged = lambda name: lambda rows, path: _write(_merged(rows, name), path)
        return self.log.compact(number, {name: merged(name) for name in STATES})

    def read(self, name: str) -> DataFrame:
        return self.log.read(name, STATES[name])

    def events_daily(self) -> DataFrame:
        """As volume.events_daily() of all batches at once."""
        return _merged(self.read("events"), "events")

    def perf_daily(self, scope: Scope | None = None) -> DataFrame:
        """As volume.perf_daily() of all batches at once; a scope bounds the days whose states are read."""
        days = lambda name: whole_days(self.read(name), scope) if scope else self.read(name)
        frames = _merged(days("frames"), "frames")
        hits = wanted_bands(_merged(days("bands"), "bands").withColumn("of", F.lit("fps")), _DAY, {"p50_fps": ("fps", 0.5)})
        found = days("values").alias("v").join(hits.alias("h"), null_safe([*_DAY, "band"], "v", "h"))
        found = found.select(*[f"v.{k}" for k in _DAY], "h.name", "h.at", "h.lo", "h.hi", "h.band", "h.before", "v.value", "v.n")
        median = ranked_values(found, _DAY, {"p50_fps": ("fps", 0.5)})
        out = frames.alias("f").join(median.alias("m"), null_safe(_DAY, "f", "m"), "left")
        return out.select(*[f"f.{k}" for k in _DAY], "f.samples", (F.try_divide("f.fps_sum", F.nullif("f.fps_n", F.lit(0)))).alias("avg_fps"), "f.min_fps", "m.p50_fps")


def _write(rows: DataFrame, path: str) -> None:
    """By day; the values of a busy day are dealt out by ranges, the states of a day are few."""
    order = [c for c in ("project_id", "band", "value") if c in rows.columns]
    dealt = rows.repartitionByRange("day", *order) if "value" in order else rows.repartition("day")
    dealt.sortWithinPartitions("day", *order).write.mode("overwrite").partitionBy("day").parquet(path)


def _merged(rows: DataFrame, name: str) -> DataFrame:
    """One row for each key of a state, whatever number of batches it came in."""
    keys = [c for c in ("project_id", "event_type", "day", "band", "value") if c in rows.columns]
    sums = [F.min(c).alias(c) if c.startswith("min_") else F.sum(c).alias(c) for c in rows.columns if c not in (*keys, "commit")]
    return rows.groupBy(*keys).agg(*sums)
