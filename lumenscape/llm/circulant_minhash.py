"""MinHash near-duplicate detection by circulant permutations.

Two permutations make every coordinate: sigma spreads the shingles over 2**32 places once, and
coordinate k is the smallest pi(sigma(x) - k), pi shifted circularly by k places. Coordinates are
banded; texts that share a band are candidates, confirmed by exact Jaccard on full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lumenscape.llm.common import WordHashes, ascii_words, connected_components, link_buckets, materialise, mix64, prefix_pairs, shingle_set

#: 24 bands of 5: a pair at Jaccard 0.85 is missed with probability 1e-6, at 0.8 with 1e-4.
BANDS, ROWS = 24, 5
_SLICE = 4096


def _pi(x: np.ndarray) -> np.ndarray:
    """The second permutation: a bijection on 32-bit integers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    """All coordinates of one set; shingles are 64-bit hashes."""
    sigma = (mix64(shingles) >> np.uint64(32)).astype(np.uint32)
    shifts = np.arange(1, coordinates + 1, dtype=np.uint32)[:, None]
    best = np.full(coordinates, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(sigma), _SLICE):
        np.minimum(best, _pi(sigma[None, i : i + _SLICE] - shifts).min(axis=1), out=best)
    return best


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    acc = np.arange(1, bands + 1, dtype=np.uint64)
    for row in sig.reshape(bands, rows).T:
        acc = mix64(acc * np.uint64(0x9E3779B97F4A7C15) + row)
    return acc.view(np.int64)


FEATURES = "id long, n_shingles long, d1 long, d2 long, bands array<long>"


def features(docs: DataFrame, id_col: str, text_col: str, shingle_words: int, bands: int, rows: int) -> DataFrame:
    """One row per input row: set size, a 128-bit digest of the set, and its band keys (empty for no words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        cache = WordHashes()
        for batch in batches:
            n, digests, keys = [], [], []
            for text in batch.column(1):
                s = shingle_set(ascii_words(text.as_py()), shingle_words, cache)
                n.append(len(s))
                digests.append(np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64))
                keys.append(band_keys(signature(s, bands * rows), bands, rows) if len(s) else np.empty(0, np.int64))
            d = np.array(digests, dtype=np.int64).reshape(-1, 2)
            offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            values = np.concatenate(keys) if keys else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=["id", "n_shingles", "d1", "d2", "bands"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, FEATURES)


def shingle_table(docs: DataFrame, shingle_words: int) -> DataFrame:
    """(id, text) -> (id, s): the whole set as an array of 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                sets = [shingle_set(ascii_words(t.as_py()), shingle_words, cache).view(np.int64) for t in part.column(1)]
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets)))], names=["id", "s"])

    return docs.mapInArrow(run, "id long, s array<long>")


def near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of docs.

    Links: 100 * |A & B| >= percent * |A | B| on distinct word shingles. Equal sets are one class from
    the start; only class representatives are banded and compared. Defined cases: a null, empty or
    white-space text has no shingles and links with nothing; a null id is never linked, its
    component_id is null and it is kept; repeated rows of one id come out once each, with the
    component of that id; an empty table gives an empty result; other columns are ignored.
    """
    feats = materialise(spark, features(docs, id_col, text_col, shingle_words, bands, rows), "features")
    filled = feats.where("n_shingles > 0 and id is not null")
    classes = materialise(spark, filled.groupBy("d1", "d2", "n_shingles").agg(F.min("id").alias("rep"), F.min("bands").alias("bands")), "classes")
    # an id with several texts belongs to several classes: they are linked by the shared id
    same_id = filled.groupBy("id").agg(F.min("d1").alias("lo"), F.max("d1").alias("hi")).where("lo <> hi")
    repeated = not same_id.isEmpty()
    keyed = classes.select("rep", F.explode(F.array_distinct("bands")).alias("bucket")).distinct() if repeated else classes.select("rep", F.explode(F.array_distinct("bands")).alias("bucket"))
    shared = keyed.groupBy("bucket").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo <> hi").select("bucket")
    members = materialise(spark, keyed.join(shared, "bucket").select("bucket", F.col("rep").alias("id")), "members")
    wanted = members.select("id").distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # an id with several texts has a set for each; one that matches is a link
    sets = materialise(spark, shingle_table(texts.join(wanted, "id", "left_semi"), shingle_words), "sets")

    def verify(pairs: DataFrame) -> DataFrame:
        sized = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
        small, large = F.least(F.size("sa"), F.size("sb")), F.greatest(F.size("sa"), F.size("sb"))
        both = F.size(F.array_intersect("sa", "sb"))
        near = sized.where(small * 100 >= large * percent).select("a", "b", both.alias("both"), (F.size("sa") + F.size("sb")).alias("total"))
        return near.where(F.col("both") * 100 >= (F.col("total") - F.col("both")) * percent).select("a", "b")

    def reach(left: Column, n: Column, m: Column) -> Column:
        return (left * (100 + percent) >= (n + m) * percent) & (F.least(n, m) * 100 >= F.greatest(n, m) * percent)

    comp = link_buckets(spark, members, verify, lambda open_: prefix_pairs(spark, open_, sets, lambda n: F.ceil(n * percent / 100), reach))
    if repeated:
        ties = filled.join(same_id.select("id"), "id").join(classes.drop("bands"), ["d1", "d2", "n_shingles"]).select(F.col("id").alias("a"), F.col("rep").alias("b")).where("a <> b")
        comp = connected_components(spark, comp.select(F.col("id").alias("a"), F.col("component").alias("b")).union(ties))
    heads = (classes.drop("bands").join(comp.withColumnRenamed("id", "rep"), "rep", "left").select("d1", "d2", "n_shingles", F.coalesce("component", "rep").alias("component_id")))
    joined = feats.drop("bands").join(heads, ["d1", "d2", "n_shingles"], "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "id")).otherwise(F.col("id"))
    component = F.when(F.col("id").isNull(), F.lit(None).cast("long")).otherwise(component)
    return joined.select("id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))
