"""As-of joins that split a key by time ranges, so that a hot session is the work of many tasks.

Rows are ordered within one key and one range of time. What a range needs of those before it is one row, the last right
one; it comes from a small table with a row for each key and range, and is put into the range as its first row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Seconds of one range of time.
RANGE_S = 3600


def time_range(ts: str | Column) -> Column:
    """The number of the range that a time lies in; equal times are never parted."""
    return F.floor(F.unix_seconds(ts) / RANGE_S)


def carried(last: DataFrame, ranges: DataFrame, key: str, value: str) -> DataFrame:
    """key, range and value for every range of `ranges` that an earlier one of `last` has a value for: the newest of those.

    last: one row for each key and range; ranges: those that ask. A key has a row for each range it spans, no more.
    """
    asked = ranges.select(key, "range", F.lit(None).cast(last.schema[value].dataType).alias(value), F.lit(True).alias("asks"))
    earlier = Window.partitionBy(key).orderBy("range").rangeBetween(Window.unboundedPreceding, -1)
    both = last.select(key, "range", value, F.lit(False).alias("asks")).union(asked)
    return both.withColumn(value, F.last(value, ignorenulls=True).over(earlier)).where(F.col("asks") & F.col(value).isNotNull()).drop("asks")


def asof_join(left: DataFrame, right: DataFrame, key: str = "session_id", ts: str = "ts", tie: str = "event_id", values: list[str] | None = None, inner: bool = False) -> DataFrame:
    """Each left row with `values` of the latest right row at or before it (struct `found`, null if none).

    Both sides are united and read in time order by key and range, with the last right row before the range as its first;
    never a product. Rights of equal time come in order of `tie`, the last one counts.
    """
    values = values or [c for c in right.columns if c not in (key, ts, tie)]
    found = F.struct(*[F.col(c) for c in values])
    rights = right.select(key, ts, F.col(tie).alias("tie"), found.alias("found"), time_range(ts).alias("range"))
    newest = rights.groupBy(key, "range").agg(F.max_by(F.struct(ts, "tie", "found"), F.struct(ts, "tie")).alias("newest"))
    before = carried(newest, left.select(key, time_range(ts).alias("range")).distinct(), key, "newest")
    rights = rights.union(before.select(key, F.col("newest")[ts], "newest.tie", "newest.found", "range"))
    none = F.lit(None).cast(left.select(F.struct("*").alias("r")).schema["r"].dataType)
    rights = rights.select(key, "range", ts, F.lit(0).alias("side"), "tie", "found", none.alias("row"))
    empty = F.lit(None).cast(rights.schema["found"].dataType)
    lefts = left.select(key, time_range(ts).alias("range"), ts, F.lit(1).alias("side"), F.col(tie).alias("tie"), empty.alias("found"), F.struct(*left.columns).alias("row"))
    w = Window.partitionBy(key, "range").orderBy(ts, "side", "tie").rowsBetween(Window.unboundedPreceding, 0)
    out = rights.union(lefts).withColumn("found", F.last("found", ignorenulls=True).over(w)).where("side = 1").select("row.*", "found")
    return out.where(F.col("found").isNotNull()) if inner else out


def with_previous(rows: DataFrame, columns: list[str], key: str = "session_id", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Inner self join with the previous distinct time: rows of one time are all paired with the last row before it.

    The newest row of all earlier times is a running maximum within a range, whose first row is the last one before the range.
    """
    each = rows.select(key, time_range(ts).alias("range"), F.struct(F.col(ts), F.col(tie), *columns).alias("row"))
    newest = each.groupBy(key, "range").agg(F.max("row").alias("row"))
    before = carried(newest, newest.select(key, "range"), key, "row")
    both = each.withColumn("real", F.lit(True)).union(before.select(key, "range", "row").withColumn("real", F.lit(False)))
    earlier = Window.partitionBy(key, "range").orderBy(F.unix_micros(F.col("row")[ts])).rangeBetween(Window.unboundedPreceding, -1)
    out = both.withColumn("prev", F.max("row").over(earlier)).where("real and prev is not null")
    return out.select(key, F.col("row")[ts].alias(ts), F.struct(*[F.col("row")[c].alias(c) for c in columns]).alias("cur"), "prev")
