"""Rows that differ from the last row kept of their key: a fold; long keys are split by ranges of time.

Most keys are short, and each is one sorted stream. A key of more than RANGE_ROWS rows is split into ranges of
neighbouring hours that have about so many rows each, so a sparse key is never split into ranges of a row or two.

What is kept in a range depends on the last row kept before it. Most ranges forget it: once a row is kept whatever came before,
all that follows is the same. So a first pass takes each range on its own, as if its first row were kept, and tells in one
short row: its first and last kept rows, the bounds of its values, and rows that differ from all rows before them in the range. A
second pass follows these short rows through each key and finds what every range starts from. The last pass goes
through the ranges side by side. Where a short row cannot tell, the rest of that key is one range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from lumenscape.operators.asof import time_range
from lumenscape.operators.quantiles import null_safe

#: Rows of one range of a long key, as far as whole hours allow.
RANGE_ROWS = 100_000
#: Rows compared at once, at first and at most; the next change is mostly near.
_NEAR, _SEARCH = 16, 4096
_HOUR, _PART, _GROUP, _STATE = "__hour", "__range", "__group", "__state"
_ROW = pa.list_(pa.list_(pa.float64()))


class Columns:
    """Numbers or vectors of a batch, each as (rows, components) and which are missing; times are milliseconds."""

    def __init__(self, columns: list[pa.Array]):
        self.parts = [_numbers(c) for c in columns]
        self.values, self.missing = (np.hstack(side) for side in zip(*self.parts))
        self.some_missing = bool(self.missing.any())

    def row(self, i: int) -> list[tuple[np.ndarray, np.ndarray]]:
        return [(values[i], missing[i]) for values, missing in self.parts]

    def next_change(self, at: int, end: int, last: list, eps: float, below: bool) -> int:
        """The first row from at on that differs from `last`, a row of any batch, or end."""
        step = _NEAR
        while at < end:
            some = slice(at, min(at + step, end))
            same = [_same(values[some], missing[some], *before, eps, below) for (values, missing), before in zip(self.parts, last)]
            changed = np.flatnonzero(~np.logical_and.reduce(same))
            if len(changed):
                return at + int(changed[0])
            at, step = some.stop, min(2 * step, _SEARCH)
        return end

    def changes(self, at: int, end: int, eps: float, below: bool) -> list[int]:
        """Rows that are kept from at on, which is kept itself."""
        kept, last, step, at = [at], at, _NEAR, at + 1
        while at < end:
            some = slice(at, min(at + step, end))
            gap = np.abs(self.values[some] - self.values[last])
            near = gap < eps if below else gap <= eps
            if self.some_missing:
                near = (near | self.missing[some]) & (self.missing[some] == self.missing[last])
            changed = ~near.all(axis=1)
            first = int(changed.argmax())
            if changed[first]:
                last, at, step = at + first, at + first + 1, _NEAR
                kept.append(last)
            else:
                at, step = some.stop, min(2 * step, _SEARCH)
        return kept


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if pa.types.is_timestamp(column.type):
        values = column.cast(pa.timestamp("us", column.type.tz)).cast(pa.int64()).to_numpy(zero_copy_only=False).astype(float)[:, None] / 1000
    elif pa.types.is_list(column.type):
        lengths = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
        values = np.full((len(column), max(1, int(lengths.max(initial=0)))), np.nan)
        row = np.repeat(np.arange(len(column)), lengths)
        values[row, np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    else:
        values = column.to_numpy(zero_copy_only=False).astype(float)[:, None]
    return np.nan_to_num(values), np.isnan(values)


def _wider(values: np.ndarray, missing: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    more = [(0, 0)] * (values.ndim - 1) + [(0, width - values.shape[-1])]
    return np.pad(values, more), np.pad(missing, more, constant_values=True)


def _same(values: np.ndarray, missing: np.ndarray, last: np.ndarray, gone: np.ndarray, eps: float, below: bool) -> np.ndarray:
    """Which rows are within eps of the last one in all components; a component that only one has differs."""
    width = max(values.shape[-1], len(last))
    (values, missing), (last, gone) = _wider(values, missing, width), _wider(last, gone, width)
    gap = np.abs(values - last)
    return ((gap < eps if below else gap <= eps) & ~missing & ~gone | missing & gone).all(axis=-1)


def differs(a: list, b: list, eps: float, below: bool) -> bool:
    return not all(_same(*x, *y, eps, below) for x, y in zip(a, b))


def _listed(row: list) -> list[list[float | None]]:
    return [[None if m else float(v) for v, m in zip(values, missing)] for values, missing in row]


def _unlisted(row: list[list[float | None]]) -> list[tuple[np.ndarray, np.ndarray]]:
    return [(np.array([v or 0.0 for v in c]), np.array([v is None for v in c], bool)) for c in row]


class Bounds:
    """Least and greatest value of every component, how many rows have it, and how many rows there are."""

    def __init__(self, low: list, high: list, present: list, n: int):
        self.low, self.high, self.present, self.n = low, high, present, n

    @classmethod
    def none(cls, columns: int) -> Bounds:
        return cls(*([np.empty(0) for _ in range(columns)] for _ in range(3)), 0)

    def beyond(self, data: Columns, some: slice, eps: float, below: bool) -> np.ndarray:
        """Which of the rows differ from every row before them, here and in the bounds; then the bounds take them all."""
        count = some.stop - some.start
        out = np.zeros(count, bool)
        for c, (values, missing) in enumerate(data.parts):
            width = max(values.shape[1], len(self.low[c]))
            values, missing = _wider(values[some], missing[some], width)
            fill = lambda a, x: np.pad(a, (0, width - len(a)), constant_values=x)
            low = np.minimum.accumulate(np.vstack([fill(self.low[c], np.inf), np.where(missing, np.inf, values)]))
            high = np.maximum.accumulate(np.vstack([fill(self.high[c], -np.inf), np.where(missing, -np.inf, values)]))
            present = np.cumsum(np.vstack([fill(self.present[c], 0), ~missing]), axis=0)
            rows = (self.n + np.arange(count))[:, None]
            far = lambda gap: gap >= eps if below else gap > eps
            apart = ~missing & (far(values - high[:-1]) | far(low[:-1] - values)) | missing & (present[:-1] == rows)
            out |= (apart & (rows > 0)).any(axis=1)
            self.low[c], self.high[c], self.present[c] = low[-1], high[-1], present[-1]
        self.n += count
        return out

    def within(self, state: list, eps: float, below: bool) -> bool:
        """Whether no row differs from the state."""
        for c, (values, missing) in enumerate(state):
            width = max(len(values), len(self.low[c]))
            values, missing = _wider(values, missing, width)
            fill = lambda a, x: np.pad(a, (0, width - len(a)), constant_values=x)
            gap = np.maximum(np.abs(fill(self.high[c], 0.0) - values), np.abs(fill(self.low[c], 0.0) - values))
            present = fill(self.present[c], 0)
            near = gap < eps if below else gap <= eps
            if not np.where(missing, present == 0, (present == self.n) & near).all():
                return False
        return True


def _runs(batch: pa.RecordBatch, by: list[str]) -> Iterator[tuple[tuple, int, int]]:
    """(group, begin, end) of neighbouring rows of one group."""
    owner = list(zip(*(batch.column(k).to_pylist() for k in by)))
    begins = [i for i in range(len(owner)) if not i or owner[i] != owner[i - 1]]
    for begin, end in zip(begins, [*begins[1:], len(owner)]):
        yield owner[begin], begin, end


def ranges_of(rows: DataFrame, keys: list[str], range_rows: int) -> DataFrame:
    """keys, _HOUR and _PART: which range of about range_rows rows each hour of a key is part of."""
    hours = rows.groupBy(*keys, time_range("ts").alias(_HOUR)).agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy(*keys).orderBy(_HOUR).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(earlier), F.lit(0))
    return hours.select(*keys, _HOUR, F.floor(before / range_rows).alias(_PART))


def keep_changes(rows: DataFrame, keys: list[str], columns: list[str], eps: float, below: bool = False, range_rows: int | None = None) -> DataFrame:
    """Rows that differ from the last row kept of their key (not from the row before) by more than eps in a column.

    Columns are numbers or vectors; one that is missing on one side only differs. below: less than eps is unchanged,
    eps itself is not. Rows are taken in order of ts (and event_id, if there is one), batch by batch.
    """
    names = rows.columns
    order = [c for c in ("ts", "event_id") if c in names]
    most = range_rows or RANGE_ROWS
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    long = F.broadcast(sizes.where(F.col("n") > most).select(*keys))  # at most one of `most` rows
    parted = lambda how: rows.alias("r").join(long.alias("s"), null_safe(keys, "r", "s"), how)
    hourly = parted("left_semi").withColumn(_HOUR, time_range("ts"))
    ranged = hourly.alias("r").join(ranges_of(parted("left_semi"), keys, most).alias("s"), null_safe([*keys, _HOUR], "r", "s")).select(*[F.col(f"r.{c}") for c in names], _PART)
    by = [*keys, _PART]
    told = ranged.select(*dict.fromkeys([*by, *order, *columns])).repartition(*by).sortWithinPartitions(*by, *order)
    typed = {f.name: f.dataType for f in ranged.schema.fields}
    nested = T.ArrayType(T.ArrayType(T.DoubleType()))
    key_fields = [T.StructField(k, typed[k]) for k in by]
    told_type = T.StructType([*key_fields, *[T.StructField(n, nested) for n in ("first", "last", "low", "high", "present")], T.StructField("apart", T.ArrayType(nested)), T.StructField("n", T.LongType())])

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One short row for each key and range."""
        of, first, last, bounds, apart, ends = None, None, None, None, [], None

        def row() -> pa.RecordBatch:
            plain = lambda arrays: [[float(v) if np.isfinite(v) else None for v in a] for a in arrays]
            values = [_listed(first), _listed(last), plain(bounds.low), plain(bounds.high), plain(bounds.present)]
            made = [pa.array([v], _ROW) for v in values]
            return pa.RecordBatch.from_arrays([*ends, *made, pa.array([[_listed(a) for a in apart]], pa.list_(_ROW)), pa.array([bounds.n])], names=[*by, "first", "last", "low", "high", "present", "apart", "n"])

        for batch in batches:
            data = Columns([batch.column(c) for c in columns])
            for group, begin, end in _runs(batch, by):
                at = begin
                if first is None or group != of:
                    if first is not None:
                        yield row()
                    of, first, last, bounds, apart, at = group, data.row(begin), data.row(begin), Bounds.none(len(columns)), [], begin + 1
                    ends = [batch.column(k).slice(begin, 1) for k in by]
                new = np.flatnonzero(bounds.beyond(data, slice(begin, end), eps, below))
                if len(new):  # the first such row and the last
                    apart = [apart[0] if apart else data.row(begin + int(new[0])), data.row(begin + int(new[-1]))]
                if (at := data.next_change(at, end, last, eps, below)) < end:
                    last = data.row(data.changes(at, end, eps, below)[-1])
        if first is not None:
            yield row()

    start_type = T.StructType([*key_fields, T.StructField(_GROUP, T.LongType()), T.StructField(_STATE, nested)])

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each range the row it starts from, and the range that it is read with: itself, or the one since which nothing is sure."""
        of, state, group, lost = None, None, None, False
        for batch in batches:
            groups, states = [], []
            short = {n: batch.column(n).to_pylist() for n in ("first", "last", "low", "high", "present", "apart", "n")}
            owner = list(zip(*(batch.column(k).to_pylist() for k in keys)))
            for i, part in enumerate(batch.column(_PART).to_pylist()):
                if i == 0 and of is None or owner[i] != of:
                    of, state, lost = owner[i], None, False
                group = group if lost else part
                groups.append(group)
                states.append(None if state is None or lost else _listed(state))
                if lost:
                    continue
                numbers = [[np.array([0.0 if v is None else v for v in c]) for c in short[n][i]] for n in ("low", "high", "present")]
                if state is None or differs(_unlisted(short["first"][i]), state, eps, below) or any(differs(_unlisted(a), state, eps, below) for a in short["apart"][i]):
                    state = _unlisted(short["last"][i])
                elif not Bounds(*numbers, short["n"][i]).within(state, eps, below):
                    lost = True
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in by), pa.array(groups, pa.int64()), pa.array(states, _ROW)], names=[*by, _GROUP, _STATE])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, last = None, None
        for batch in batches:
            data, kept = Columns([batch.column(c) for c in columns]), np.zeros(batch.num_rows, bool)
            states = batch.column(_STATE)
            for group, begin, end in _runs(batch, [*keys, _GROUP]):
                at = begin
                if of is None or group != of:
                    of, given = group, states[begin].as_py()
                    last = None if given is None else _unlisted(given)
                if last is None or (at := data.next_change(at, end, last, eps, below)) < end:
                    changed = data.changes(at, end, eps, below)
                    kept[changed] = True
                    last = data.row(changed[-1]) if end == batch.num_rows else last
            yield batch.select(names).filter(pa.array(kept))

    short = told.mapInArrow(tell, told_type)
    starts = short.repartition(*keys).sortWithinPartitions(*by).mapInArrow(follow, start_type)
    joined = ranged.alias("r").join(starts.alias("s"), null_safe(by, "r", "s")).select(*[F.col(f"r.{c}") for c in names], _GROUP, _STATE)
    whole = parted("left_anti").select(*names, F.lit(None).cast("long").alias(_GROUP), F.lit(None).cast(nested).alias(_STATE))
    dealt = whole.union(joined).repartition(*keys, _GROUP).sortWithinPartitions(*keys, _GROUP, *order)
    return dealt.mapInArrow(run, rows.schema)
