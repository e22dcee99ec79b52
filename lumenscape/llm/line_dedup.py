"""Line de-duplication by a segment-partition edit join.

A line is cut into threshold-plus-one segments. Two lines within the threshold share one segment
unchanged, so each line is indexed under its segments (with its length and the segment's number)
and looks up those substrings of itself that can be a segment of a line as long or shorter. Lines
under one key are candidates, confirmed by banded bit-parallel edit distance. Every line but the
first of each group is dropped.

Lines under one key are not compared all with all. The smallest of a key is compared with the others;
keys whose lines then still belong to several groups are divided further, by how each line differs
from that smallest one. Lines within the threshold differ from it in nearly the same grams.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lumenscape.llm.common import connected_components, materialise, mix64, utf8

#: Lines shorter than this many code points (headings, list items, numbers, lone words) are no near copies: within two edits they
#: say other things, and two edits are most of some. Their exact repeats go if the caller asks, which the pipeline does not: a
#: document may be one short line, and clean.
MIN_CHARS, THRESHOLD = 40, 2
#: Letters of the grams that tell lines of a crowded key apart.
GRAM = 3
#: Longs of the sketch of a line's grams.
SKETCH = 4
#: Up to so many lines of a key have their sketches compared at once; dividing the key costs a line as much as some thousand comparisons.
FEW = 1000
#: Bits of the filters that pick rows on the way: 2 MB, whatever the input.
_WORD_BITS = 18
#: Fixed value: the seed that Spark's own 64-bit hash function starts from.
_SEED = 42
_SPACE = " \t\r\x0b\x0c"


def edit_distance_within(a: str, b: str, most: int) -> bool:
    """Whether the edit distance is at most `most`: bit vectors over the 2 * most + 1 diagonals around the main one."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > most:
        return False
    i = _same_start(a, b)
    a, b = a[i:], b[i:]
    j = _same_start(a[::-1], b[::-1])
    a, b = a[: len(a) - j], b[: len(b) - j]
    if not a or len(b) <= most:
        return len(b) <= most
    if most == 0:
        return False
    # rows follow the longer text; the band ends on its last row in the last columns
    rows, width = len(b), 2 * most + 1
    full, lowest = (1 << width) - 1, 1 << (2 * most)
    where: dict[str, int] = {}
    seen = 0  # letters of b whose places are known; only rows of the band are read
    up, down = full & ~((1 << most) - 1), 0  # steps of +1 and -1 between rows column - most .. column + most
    distance = most  # on the lowest row of the band
    for col, c in enumerate(a, 1):
        while seen < min(rows, col + most):
            where[b[seen]] = where.get(b[seen], 0) | 1 << (seen + most)
            seen += 1
        match = (where.get(c, 0) >> (col - 1)) & full
        level = ((((match & up) + up) ^ up) | match | down) & full
        rise, fall = (down | ~(level | up)) & full, level & up
        end = rows - col + most  # the bit of the last row
        if end >= 2 * most:
            distance += not level & lowest
        else:
            distance += (rise >> end & 1) - (fall >> end & 1)
        up, down = (fall | ~((level >> 1) | rise)) & full, (level >> 1) & rise
        if end > 2 * most and distance - up.bit_count() > most:
            return False  # no row of the band is within reach, so no later one is
    return distance <= most


def _same_start(a: str, b: str) -> int:
    """Length of the common start, in steps of slices that halve."""
    n, i, step = min(len(a), len(b)), 0, 64
    while step:
        while i + step <= n and a[i : i + step] == b[i : i + step]:
            i += step
        step >>= 1
    return i


def line_rows(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, line_no, h, line): lines without surrounding white space, of min_chars or more."""
    text = F.col("text").cast("string")
    lines = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.split(text, "\n")).alias("line_no", "raw"))
    lines = lines.select("doc_id", "line_no", _clean("raw").alias("line")).where(F.char_length("line") >= min_chars)
    return lines.select("doc_id", "line_no", F.xxhash64("line").alias("h"), "line")


def _clean(raw: str | Column) -> Column:
    return F.trim(raw, F.lit(_SPACE))


@lru_cache(maxsize=4096)
def segment_places(size: int, threshold: int) -> tuple[list[tuple[int, int, int]], list[bool]]:
    """(start, end, seed) of every substring of a line of `size` that is a key, and whether the line is filed under it.

    A filed line is cut evenly, longer segments last. For a filed line that is `shorter` than the one at hand, segment
    i can start `shift` places from there; the shifts follow from the edits left on either side.
    """
    parts, places, filed = threshold + 1, [], []
    for shorter in range(min(threshold, size) + 1):
        other = size - shorter
        short, longer = divmod(other, parts)
        for i in range(1, parts + 1):
            start = (i - 1) * short + max(0, i - 1 - (parts - longer))
            length = short + (i > parts - longer)
            for shift in range(max(1 - i, shorter - (parts - i)), min(i - 1, shorter + (parts - i)) + 1):
                if 0 <= start + shift and start + shift + length <= size:
                    places.append((start + shift, start + shift + length, other * parts + i))
                    filed.append(shorter == 0 and shift == 0)
    return places, filed


def segment_keys(docs: DataFrame, min_chars: int, threshold: int) -> DataFrame:
    """(bucket, h, indexed): the keys that a line is filed under and those it looks up; equal lines of a batch once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            seen: set[str] = set()
            for text in batch.column(0).to_pylist():
                seen.update(text.split("\n"))
            lines = {c for raw in seen if len(c := raw.strip(_SPACE)) >= min_chars}
            keys, filed, hashes, counts = [], [], [], []
            for line in lines:
                whole = utf8(line)
                places, indexed = segment_places(len(line), threshold)
                if len(whole) == len(line):
                    mine = [digest(whole[start:end], seed) for start, end, seed in places]
                else:
                    mine = [digest(utf8(line[start:end]), seed) for start, end, seed in places]
                if len(set(mine)) < len(mine):  # a line that repeats itself
                    first = {key: any(i for k, i in zip(mine, indexed) if k == key) for key in mine}
                    mine, indexed = list(first), list(first.values())
                keys += mine
                filed += indexed
                counts.append(len(mine))
                hashes.append(xxhash.xxh64_intdigest(whole, _SEED))
                if len(keys) > 200_000:
                    yield _keys_batch(keys, filed, hashes, counts)
                    keys, filed, hashes, counts = [], [], [], []
            yield _keys_batch(keys, filed, hashes, counts)

    texts = docs.where("doc_id is not null and text is not null").select(F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "bucket long, h long, indexed boolean")


def _keys_batch(keys: list[int], filed: list[bool], hashes: list[int], counts: list[int]) -> pa.RecordBatch:
    h = np.repeat(np.array(hashes, np.uint64), np.array(counts, np.int64)).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(h), pa.array(filed, pa.bool_())], names=["bucket", "h", "indexed"])


def _maybe(rows: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """Rows whose hash may be among the wanted ones (one column): a bit table of fixed size keeps most others out of a shuffle."""
    word = lambda c: F.shiftrightunsigned(c, 6).bitwiseAND((1 << _WORD_BITS) - 1)
    bit = lambda c: F.expr(f"shiftleft(1L, cast({c} & 63 as int))")
    (name,) = wanted.columns
    bits = wanted.groupBy(word(F.col(name)).alias("word")).agg(F.bit_or(bit(name)).alias("bits"))
    found = rows.withColumn("word", word(F.col(column))).join(F.broadcast(bits), "word")
    return found.where(F.col("bits").bitwiseAND(bit(column)) != 0).drop("word", "bits")


def line_components(spark: SparkSession, docs: DataFrame, min_chars: int = MIN_CHARS, threshold: int = THRESHOLD) -> DataFrame:
    """(id, component) of line hashes that have a different line within the threshold.

    A key of two lines is a pair. Of a key of more, the smallest is tried with each other one; the
    lines of keys that are still of several components go through divided().
    """
    keyed = segment_keys(docs, min_chars, threshold)
    shared = keyed.groupBy("bucket").agg(F.min("h").alias("lo"), F.max("h").alias("hi"), F.count(F.lit(1)).alias("n"), F.max("indexed").alias("indexed"))
    shared = materialise(spark, shared.where("lo <> hi and indexed").select("bucket", "lo", "hi", "n"), "line-keys")
    crowded = shared.where("n > 2").select("bucket", "lo")
    again = _maybe(segment_keys(docs, min_chars, threshold).select("bucket", F.col("h").alias("id")), "bucket", crowded.select("bucket"))
    members = materialise(spark, again.join(crowded, "bucket").distinct(), "line-members")
    pairs = shared.where("n = 2").select(F.col("lo").alias("a"), F.col("hi").alias("b")).union(members.where("id > lo").select(F.col("lo").alias("a"), F.col("id").alias("b")))
    tested = materialise(spark, pairs.distinct(), "line-pairs")
    wanted = tested.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = materialise(spark, line_texts(docs, min_chars, wanted), "line-texts")
    links = materialise(spark, verified(tested, texts, threshold), "line-links")
    comp = connected_components(spark, links)
    known = members.join(comp, "id", "left").select("bucket", "lo", "id", F.coalesce("component", "id").alias("component"))
    mixed = known.groupBy("bucket").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 <> c1").select("bucket")
    rest = materialise(spark, known.join(mixed, "bucket"), "line-rest")
    if rest.isEmpty():
        return comp
    fresh = divided(spark, rest, texts, threshold).join(tested, ["a", "b"], "left_anti")
    found = materialise(spark, verified(materialise(spark, fresh, "line-pairs"), texts, threshold), "line-links")
    return comp if found.isEmpty() else connected_components(spark, links.union(found))


def line_texts(docs: DataFrame, min_chars: int, wanted: DataFrame) -> DataFrame:
    """(id, line, sketch) of the wanted hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sketches = [parity_sketch(numbered_grams(line)) for line in batch.column(1).to_pylist()]
            longs = pa.array(np.concatenate(sketches)) if sketches else pa.array([], pa.int64())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sketches) + 1, dtype=np.int32) * SKETCH), longs)
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=["id", "line", "sketch"])

    maybe = _maybe(line_rows(docs, min_chars).select(F.col("h").alias("id"), "line"), "id", wanted)
    once = maybe.groupBy("id").agg(F.first("line").alias("line")).join(wanted, "id", "left_semi")
    return once.select("id", "line").mapInArrow(run, "id long, line string, sketch array<long>")


def unlike(a: str, b: str) -> Column:
    """In how many bits two sketches differ."""
    return sum((F.bit_count(F.get(a, i).bitwiseXOR(F.get(b, i))) for i in range(SKETCH)), F.lit(0))


def verified(pairs: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """The (a, b) whose lines are within the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [edit_distance_within(x, y, threshold) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield batch.select([0, 1]).filter(pa.array(near, pa.bool_()))

    left = texts.select(F.col("id").alias("a"), F.col("line").alias("la"), F.col("sketch").alias("sa"))
    right = texts.select(F.col("id").alias("b"), F.col("line").alias("lb"), F.col("sketch").alias("sb"))
    both = pairs.join(left, "a").join(right, "b").where(unlike("sa", "sb") <= 2 * GRAM * threshold)
    close = both.where(F.abs(F.char_length("la") - F.char_length("lb")) <= threshold).select("a", "b", "la", "lb")
    return close.mapInArrow(run, "a long, b long")


def numbered_grams(line: str) -> np.ndarray:
    """Sorted hashes of all grams with their occurrence numbers."""
    letters = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = max(0, len(letters) - GRAM + 1)
    grams = np.zeros(n, np.uint64)
    for k in range(GRAM):
        grams = grams << np.uint64(21) | letters[k : k + n]  # three code points of 21 bits: no two grams are taken for one
    grams.sort()
    places = np.arange(n)
    starts = np.maximum.accumulate(np.where(np.append(True, grams[1:] != grams[:-1])[:n], places, 0))
    hashes = mix64(grams + (places - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    hashes.sort()
    return hashes


def parity_sketch(members: np.ndarray) -> np.ndarray:
    """Bits of how many members (odd or even) fall on each of them: sets that differ in d members differ in at most d bits."""
    odd = np.bincount((members % np.uint64(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def divided(spark: SparkSession, rest: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """(a, b): every pair of one bucket and of different components that can be within the threshold.

    rest: (bucket, lo, id, component). Sketches of a pair differ in at most `most` = 2 * GRAM * threshold bits, since an edit
    changes at most 2 * GRAM grams. In buckets of up to FEW lines that is tried for all of them. In larger ones only
    for lines that share a difference: the differences of a line are the grams that it has and line `lo` lacks, then those
    it lacks, each in a fixed order. Lines with n and m differences share (n + m - most) / 2 at least; the
    first that both have is among the first most / 2 + 1 of the line with fewer and the first most + 1 of the
    other. Lines that need not share any (n + m <= most) meet under their numbers of differences.
    """
    most = 2 * GRAM * threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for b in batches if b.num_rows):
            known: dict[str, np.ndarray] = {}
            keys, places, numbers, counts = [], [], [], []
            for bucket, line, pivot in zip(*(c.to_pylist() for c in batch.columns[3:])):
                if len(known) > 2_000:
                    known.clear()
                for text in (line, pivot):
                    if text not in known:
                        known[text] = numbered_grams(text)
                mine, base = known[line], known[pivot]
                more, less = np.setdiff1d(mine, base, assume_unique=True), np.setdiff1d(base, mine, assume_unique=True)
                n = len(more) + len(less)
                first = np.concatenate([more[: most + 1], less[: most + 1]])[: most + 1]
                sizes = sorted({*([n] if n <= most else []), *range(n, most - n + 1)})
                both = np.concatenate([first, mix64(np.array(sizes, np.uint64))])
                keys.append((both ^ np.uint64(bucket & (1 << 64) - 1)).view(np.int64))
                places.append(np.append(np.arange(len(first)), np.full(len(sizes), -1)))
                counts.append(len(both))
                numbers.append(n)
            row = np.repeat(np.arange(batch.num_rows), counts)
            copied = [c.take(pa.array(row)) for c in batch.columns[:3]]
            made = [pa.array(c) for c in (np.concatenate(keys), np.array(numbers, np.int64)[row], np.concatenate(places))]
            yield pa.RecordBatch.from_arrays([*copied, *made], names=["id", "component", "sketch", "key", "n", "at"])

    sized = rest.join(rest.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")), "bucket")
    both = sized.where(F.col("size") > FEW).join(texts, "id").join(texts.select(F.col("id").alias("lo"), F.col("line").alias("pivot")), "lo")
    keyed = both.select("id", "component", "sketch", "bucket", "line", "pivot").mapInArrow(run, "id long, component long, sketch array<long>, key long, n long, at long")
    zero = F.lit(0).cast("long")
    small = sized.where(F.col("size") <= FEW).join(texts.select("id", "sketch"), "id").select("id", "component", "sketch", F.col("bucket").alias("key"), zero.alias("n"), zero.alias("at"))
    keyed = materialise(spark, keyed.union(small), "line-differences")
    mixed = keyed.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.min("at").alias("first"))
    mixed = mixed.where(f"c0 <> c1 and first <= {most // 2}").select("key")
    left = keyed.join(mixed, "key")
    right = left.select(F.col("key").alias("key2"), *[F.col(c).alias(f"{c}2") for c in ("id", "component", "n", "at", "sketch")])
    shared = 2 * F.least(F.col("n") - F.col("at"), F.col("n2") - F.col("at2")) >= F.col("n") + F.col("n2") - most
    near = (F.col("component") < F.col("component2")) & shared & (unlike("sketch", "sketch2") <= most)
    return left.join(right, (F.col("key") == F.col("key2")) & near).select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct()


def repeated_lines(spark: SparkSession, docs: DataFrame, min_chars: int = MIN_CHARS, threshold: int = THRESHOLD, short_repeats: bool = False) -> DataFrame:
    """(doc_id, line_no, h) of lines that repeat an earlier one, by ascending doc_id and line number.

    short_repeats: lines under min_chars are compared too, for equality; blank ones never are.
    """
    occurrences = materialise(spark, line_rows(docs, 1 if short_repeats else min_chars).select("doc_id", "line_no", "h"), "occurrences")
    comp = line_components(spark, docs, min_chars, threshold).withColumnRenamed("id", "h")
    place = F.struct("doc_id", "line_no")
    first = occurrences.groupBy("h").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).join(comp, "h", "left").where("n > 1 or component is not null")
    first = materialise(spark, first.withColumn("component", F.coalesce("component", "h")), "line-firsts")
    keep = first.groupBy("component").agg(F.min("first").alias("keep"))
    groups = first.select("h", "component").join(keep, "component").select("h", "keep")
    return occurrences.join(groups, "h").where(place != F.col("keep")).select("doc_id", "line_no", "h")


def dropped_by_document(repeated: DataFrame) -> DataFrame:
    """(doc_id, dropped): sorted array of (line_no, h); at most a document's own lines."""
    return repeated.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("line_no", "h"))).alias("dropped"))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, min_chars: int = MIN_CHARS, threshold: int = THRESHOLD, short_repeats: bool = False, count_col: str = "n_dropped") -> DataFrame:
    """docs with the lines of repeated_lines() taken out of text, and their number added as count_col.

    Defined cases: null texts and rows with a null doc_id pass unchanged and their lines stand for no other; an empty
    text has one empty line, never dropped; a very long text or line is compared whole; of lines that are equally early
    (rows that repeat a doc_id with other texts) each is kept; rows that repeat a doc_id are one document, each loses
    the same lines; an empty table gives an empty result; other columns pass, whatever their names,
    but for count_col, which is replaced.
    """
    dropped = dropped_by_document(repeated_lines(spark, docs, min_chars, threshold, short_repeats))
    columns = [F.col(f"d.`{c}`") for c in docs.columns if c.lower() not in ("text", count_col.lower())]
    joined = docs.alias("d").join(dropped.alias("r"), F.col("d.doc_id").cast("long") == F.col("r.doc_id"), "left")
    kept = F.filter(F.split("d.text", "\n"), lambda raw, i: ~F.array_contains("r.dropped", F.struct(i.alias("line_no"), F.xxhash64(_clean(raw)).alias("h"))))
    text = F.when(F.col("r.dropped").isNull(), F.col("d.text")).otherwise(F.array_join(kept, "\n")).alias("text")
    n = F.coalesce(F.size("r.dropped"), F.lit(0)).cast("long").alias(count_col)
    out = joined.select(*columns, text, n)
    return out.select(*[f"`{c}`" for c in docs.columns if c.lower() != count_col.lower()], f"`{count_col}`")


def line_report(spark: SparkSession, docs: DataFrame, min_chars: int = MIN_CHARS, threshold: int = THRESHOLD, short_repeats: bool = False) -> DataFrame:
    """doc_id, n_lines, n_dropped and the dropped line numbers, for every row; null texts have no lines. Cases as above."""
    dropped = dropped_by_document(repeated_lines(spark, docs, min_chars, threshold, short_repeats))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.size(F.split(F.col("text").cast("string"), "\n")), F.lit(0)).cast("long").alias("n_lines"))
    out = rows.withColumn("n_lines", F.greatest("n_lines", F.lit(0))).join(dropped, "doc_id", "left")
    numbers = F.array_join(F.transform("dropped", lambda d: d["line_no"].cast("string")), ",")
    return out.select("doc_id", "n_lines", F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"), F.coalesce(numbers, F.lit("")).alias("dropped_lines"))
