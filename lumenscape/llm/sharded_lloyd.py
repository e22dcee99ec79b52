"""Centroid clustering of integer vectors, sharded by dimensions.

A table holds each vector once, in column blocks: every block is a column of its own, so a task on one block reads that
column alone. In each round tasks of a block give exact partial squared distances to the centroids' slices of it; a sum by
vector adds the blocks and takes the nearest centroid; then tasks of each block meet the assignments of
their vectors and sum up their own slice of the new centroids.

The table and the assignments are bucketed by vector alike, so a round moves only the partial distances:
blocks times (centroids + 1) numbers a vector. All arithmetic is on 64-bit integers.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lumenscape.llm.common import forget, materialise, new_folder

#: Components are kept as floor(SCALE * x).
SCALE = 1024
#: Beyond this a squared distance of 64 components would not fit in 64 bits.
LARGEST = 1 << 27
#: Dimensions of one column block.
BLOCK = 32


@dataclass
class Shards:
    """A bucketed table (row, vec_id, p0, p1, ...): integer slices of every vector; its name, folder, buckets and block widths."""

    spark: SparkSession
    name: str
    folder: str
    buckets: int
    widths: list[int]

    def block(self, b: int, bucketed: bool) -> DataFrame:
        """One column; by buckets, or dealt out by size where buckets are of no use."""
        rows = self.spark.table(self.name) if bucketed else self.spark.read.schema(self.spark.table(self.name).schema).parquet(self.folder)
        return rows.select("row", F.col(f"p{b}").alias("part"))


def kept_vectors(vectors: DataFrame, dim: int, vector_col: str = "embedding") -> DataFrame:
    """vec_id and integer components of the vectors with dim components, all finite and within LARGEST / SCALE."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    sound = (F.size(v) == dim) & F.forall(v, lambda x: F.coalesce(F.abs(x) <= LARGEST / SCALE, F.lit(False)) & ~F.isnan(x))
    rows = vectors.where(F.coalesce(sound, F.lit(False)))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x * SCALE).cast("long")).alias("components"))


def first_centroids(kept: DataFrame, k: int, seed: str) -> np.ndarray:
    """(k, dim): the vectors with the smallest sha256 of seed and id; ties by components. k rows reach the driver."""
    order = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = kept.where("vec_id is not null").select(order.alias("h"), "components").orderBy("h", "components").limit(k)
    return np.array([r["components"] for r in first.collect()], dtype=np.int64)


def _bucketed(spark: SparkSession, df: DataFrame, buckets: int, what: str, folder: str | None = None) -> str:
    """df as a table in the shared folder, one file a bucket of its rows."""
    name = f"lumenscape_{what}_{uuid.uuid4().hex}"
    df.write.format("parquet").option("path", folder or new_folder(spark, what)).bucketBy(buckets, "row").sortBy("row").saveAsTable(name)
    return name


def _drop(spark: SparkSession, name: str) -> None:
    files = spark.table(name)
    forget(spark, files)
    spark.sql(f"DROP TABLE {name}")


def shard(spark: SparkSession, kept: DataFrame, dim: int, width: int) -> Shards:
    """Column blocks of the vectors, bucketed. Rows are numbered by the table that is read here, so a lost task gives the same numbers."""
    numbered = materialise(spark, kept.select(F.monotonically_increasing_id().alias("row"), "vec_id", "components"), "vectors")
    cuts = list(range(0, dim, width))
    parts = [F.slice("components", at + 1, min(width, dim - at)).alias(f"p{b}") for b, at in enumerate(cuts)]
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = new_folder(spark, "shards")
    name = _bucketed(spark, numbered.repartition(buckets, "row").select("row", "vec_id", *parts), buckets, "shards", folder)
    forget(spark, numbered)
    return Shards(spark, name, folder, buckets, [min(width, dim - at) for at in cuts])


def partial_distances(shards: Shards, b: int, slices: np.ndarray) -> DataFrame:
    """row, d0, d1, ...: squared distances within block b to each centroid's slice."""
    width, k = shards.widths[b], len(slices)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            columns = []
            for c in slices:
                gap = part - c
                columns.append(pa.array(np.einsum("ij,ij->i", gap, gap)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["row", *(f"d{j}" for j in range(k))])

    return shards.block(b, bucketed=False).mapInArrow(run, ", ".join(["row long", *(f"d{j} long" for j in range(k))]))


def assign(shards: Shards, centroids: np.ndarray) -> str:
    """Name of a bucketed table (row, cluster, distance): the nearest centroid, the smaller number of equal ones."""
    ends = np.cumsum(shards.widths)
    blocks = [partial_distances(shards, b, centroids[:, end - w : end]) for b, (end, w) in enumerate(zip(ends, shards.widths))]
    names = [f"d{j}" for j in range(len(centroids))]
    summed = reduce(DataFrame.union, blocks).groupBy("row").agg(*[F.sum(n).alias(n) for n in names])
    least = F.array_min(F.array(*names))
    nearest = summed.select("row", (F.array_position(F.array(*names), least) - 1).cast("int").alias("cluster"), least.alias("distance"))
    return _bucketed(shards.spark, nearest, shards.buckets, "assigned")


def _sums(shards: Shards, b: int, assigned: str) -> DataFrame:
    """Block b, cluster, its count and the sums of its components; every task adds up its own vectors first."""
    mine = shards.block(b, bucketed=True).join(shards.spark.table(assigned).select("row", "cluster"), "row")
    totals = [F.sum(F.col("part")[i]) for i in range(shards.widths[b])]
    return mine.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.array(*totals).alias("totals")).select(F.lit(b).alias("block"), "cluster", "n", "totals")


def update(shards: Shards, assigned: str, centroids: np.ndarray) -> np.ndarray:
    """Exact floor of the mean of every centroid that has vectors; the others stay. centroids x dimensions numbers reach the driver."""
    slices = [_sums(shards, b, assigned) for b in range(len(shards.widths))]
    out, begins = centroids.copy(), np.cumsum(shards.widths) - shards.widths
    for r in reduce(DataFrame.union, slices).collect():
        at = begins[r["block"]]
        out[r["cluster"], at : at + len(r["totals"])] = [t // r["n"] for t in r["totals"]]
    return out


def lloyd(spark: SparkSession, vectors: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, seed: str = "3:", width: int = BLOCK, vector_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every kept vector.

    Defined cases: vectors that are null, of another length, or hold a null, non-finite or too large component (LARGEST)
    are left out; with fewer than k kept ids there are fewer centroids, without any none and no rows; equal vectors
    are centroids of their own, and the smaller number takes all; rows of one vec_id count each and come out each;
    a null vec_id is clustered but is no first centroid; an empty table gives an empty result; other columns are ignored.
    """
    kept = kept_vectors(vectors, dim, vector_col)
    centroids = first_centroids(kept, k, seed)
    shape = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        return spark.createDataFrame([], shape)
    shards = shard(spark, kept, dim, width)
    for _ in range(rounds):
        assigned = assign(shards, centroids)
        moved = update(shards, assigned, centroids)
        _drop(spark, assigned)
        centroids = moved
    assigned = assign(shards, centroids)
    found = materialise(spark, spark.table(shards.name).select("row", "vec_id").join(spark.table(assigned), "row").select("vec_id", "cluster", "distance"), "clusters")
    _drop(spark, assigned)
    _drop(spark, shards.name)
    sums = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]

    def by_cluster(values: list) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), F.col("cluster") + 1)

    inertia = by_cluster([sums.get(j, 0) for j in range(len(centroids))]).cast("long")
    return found.select("vec_id", "cluster", "distance", inertia.alias("cluster_inertia"), F.lit(sum(sums.values())).cast("long").alias("inertia"), by_cluster(names).alias("centroid_sha256"))


def lloyd_sql(k: int = 8, rounds: int = 10, dim: int = 64, seed: str = "3:") -> str:
    """DuckDB text for lloyd() with its default parameters, over embeddings with one row an id."""
    steps = [
        f"kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings"
        f" WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "cells AS MATERIALIZED (SELECT vec_id, generate_subscripts(v, 1) AS d, unnest(v) AS x FROM kept)",
        f"firsts AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('{seed}' || vec_id)) - 1 AS c FROM kept QUALIFY c < {k})",
        "c0 AS MATERIALIZED (SELECT c, d, x FROM firsts JOIN cells USING (vec_id))",
    ]
    for r in range(rounds + 1):
        steps.append(
            f"a{r} AS MATERIALIZED (SELECT vec_id, arg_min(c, (far, c)) AS c, min(far) AS far FROM (SELECT vec_id, c, CAST(sum((m.x - n.x) * (m.x - n.x)) AS BIGINT) AS far"
            f" FROM cells m JOIN c{r} n USING (d) GROUP BY vec_id, c) GROUP BY vec_id)"
        )
        if r < rounds:
            steps.append(f"s{r} AS (SELECT c, d, CAST(sum(x) AS BIGINT) AS total, count(*) AS n FROM cells JOIN a{r} USING (vec_id) GROUP BY c, d)")
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c, d, CASE WHEN s.n IS NULL THEN o.x ELSE (total - ((total % s.n) + s.n) % s.n) // s.n END AS x FROM c{r} o LEFT JOIN s{r} s USING (c, d))")
    steps.append(f"named AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY d)) AS h FROM c{rounds} GROUP BY c)")
    return (
        "WITH " + ",\n".join(steps) + f"\nSELECT vec_id, CAST(c AS INTEGER) AS cluster, far AS distance, CAST(sum(far) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,"
        f" CAST(sum(far) OVER () AS BIGINT) AS inertia, h AS centroid_sha256 FROM a{rounds} JOIN named USING (c)"
    )
