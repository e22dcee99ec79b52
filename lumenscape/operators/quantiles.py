"""Exact quantiles of large groups, without one task that holds all values, and what is told beside them.

A first pass counts values in narrow bands of their order, and works out the other aggregates; a second one reads only the
bands that the wanted ranks fall into. Bands follow the logarithm, so they fit whatever range the values have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Bands of each doubling of a value.
BANDS = 64
_MIDDLE = 1_000_000  # above the number of bands on either side of zero


def band(value: Column) -> Column:
    """A number that never falls as the value rises."""
    size = F.lit(_MIDDLE) + F.floor(F.log2(F.abs(value)) * BANDS)
    return F.when(value == 0, F.lit(0)).when(value > 0, size).otherwise(-size).cast("long")


def wanted_bands(counts: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float]], carry: list[str] = ()) -> DataFrame:
    """The bands that hold the wanted ranks: keys, of, band, name, at, lo, hi, before (values in lower bands).

    counts: keys, of (a column's name), band, n. wanted: {name: (column, q)}. Columns of `carry` are numbers of the row of
    each group whose `of` is empty: that row stays, and all rows of the group get its numbers.
    """
    group = [*keys, "of"]
    before = F.sum("n").over(Window.partitionBy(*group).orderBy("band").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.withColumn("before", F.coalesce(before, F.lit(0))).withColumn("total", F.sum("n").over(Window.partitionBy(*group)))
    counts = counts.withColumns({c: F.max(c).over(Window.partitionBy(*keys)) for c in carry}) if carry else counts
    specs = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(c).alias("of"), F.lit(q).alias("q")) for name, (c, q) in wanted.items()])
    ranked = counts.withColumn("s", F.explode_outer(F.filter(specs, lambda s: s["of"] == F.col("of")))).withColumn("at", F.col("s.q") * (F.col("total") - 1))
    ranked = ranked.withColumn("lo", F.floor("at")).withColumn("hi", F.ceil("at"))
    return ranked.where(_inside("lo") | _inside("hi") | (F.col("of") == "")).select(*group, "band", "before", "at", "lo", "hi", F.col("s.name").alias("name"), *carry)


def _inside(rank: str) -> Column:
    return (F.col(rank) >= F.col("before")) & (F.col(rank) < F.col("before") + F.col("n"))


def ranked_values(found: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float]], carry: list[str] = ()) -> DataFrame:
    """keys, carry and the interpolated quantile of each name, from the values of wanted_bands(): its columns, value and n."""
    same = found.groupBy(*keys, "name", "at", "lo", "hi", "band", "before", "value").agg(F.sum("n").alias("n"), *[F.max(c).alias(c) for c in carry])
    within = Window.partitionBy(*keys, "name", "band").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    same = same.withColumn("before", F.col("before") + F.coalesce(F.sum("n").over(within), F.lit(0)))
    ends = same.groupBy(*keys, "name", "at", "lo").agg(*[F.max(F.when(_inside(rank), F.col("value"))).alias(f"v_{rank}") for rank in ("lo", "hi")], *[F.max(c).alias(c) for c in carry])
    value = F.col("v_lo") + (F.col("at") - F.col("lo")) * (F.col("v_hi") - F.col("v_lo"))
    return ends.groupBy(*keys).agg(*[F.max(c).alias(c) for c in carry], *[F.max(F.when(F.col("name") == name, value)).alias(name) for name in wanted])


def null_safe(keys: list[str], left: str, right: str) -> Column:
    same = F.lit(True)
    for k in keys:
        same &= F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return same


def summary_with_quantiles(rows: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float]], aggregates: dict[str, Column], counts: tuple[str, ...] = ()) -> DataFrame:
    """One row for each group: keys, aggregates, and by name the interpolated quantile q of a column: wanted = {name: (column, q)}.

    rows are read twice: for the aggregates and the bands, then for the values of the wanted bands. aggregates are over
    columns of rows, which have a column `one` to count; `counts` names those that are 0, not null, for no rows. Null and
    NaN values have no rank; a group without others has null. Without keys there is always one row.
    """
    columns, inputs = sorted({c for c, _ in wanted.values()}), [c for c in rows.columns if c not in keys]
    entry = lambda of, value: F.struct(F.lit(of).alias("of"), value.cast("double").alias("value"))
    entries = [entry(c, F.col(c)) for c in columns]
    valued = F.filter(F.array(*entries), lambda x: x["value"].isNotNull() & ~F.isnan(x["value"]))
    own = F.array(entry("", F.lit(None)))
    each = rows.withColumn("one", F.lit(1)).select(*keys, *inputs, "one", F.explode(F.concat(own, valued)).alias("x"))
    each = each.select(*keys, "x.of", band(F.col("x.value")).alias("band"), *[F.when(F.col("x.of") == "", F.col(c)).alias(c) for c in (*inputs, "one")])
    carry = [f"__{name}" for name in aggregates]
    bands = each.groupBy(*keys, "of", "band").agg(F.count(F.lit(1)).alias("n"), *[a.alias(f"__{name}") for name, a in aggregates.items()])
    hits = wanted_bands(bands, keys, wanted, carry)
    # of the values only those of the bands found are dealt out again; a row without any stands for a group without any
    values = rows.select(*keys, F.explode(F.when(F.size(valued) > 0, valued).otherwise(own)).alias("x")).select(*keys, "x.of", "x.value", band(F.col("x.value")).alias("band"))
    same = null_safe([*keys, "of", "band"], "v", "h")
    found = values.alias("v").join(hits.alias("h"), same).select(*[f"v.{k}" for k in keys], "h.name", "h.at", "h.lo", "h.hi", "h.band", "h.before", "v.value", F.lit(1).alias("n"), *[f"h.{c}" for c in carry])
    out = ranked_values(found, keys, wanted, carry)
    told = [(F.coalesce(f"__{name}", F.lit(0)) if name in counts else F.col(f"__{name}")).alias(name) for name in aggregates]
    return out.select(*keys, *told, *wanted)
