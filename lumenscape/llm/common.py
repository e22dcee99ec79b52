"""Shared pieces of the corpus operators: shared-folder tables, text hashing, graph components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# What ASCII white space is in the word contracts.
ASCII_SPACE = " \t\n\x0b\x0c\r"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local session, as in tests, may leave it unset."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = "file://" + tempfile.mkdtemp(prefix="lumenscape-")
        spark.conf.set("spark.checkpoint.dir", configured)
    return f"{configured.rstrip('/')}/lumenscape-{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def fresh_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def materialise(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, df: DataFrame) -> None:
    """Delete a table made by materialise() that no later step reads; asks its own file system, so any store works."""
    jvm = spark.sparkContext._jvm
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/lumenscape-" not in parent:
            continue
        path = jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def id_crc32(column: str) -> Column:
    """crc32 of an id written as text: the fold key of the labelled operators."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def arrow_batches(schema: pa.Schema, make: Callable[[pa.RecordBatch], dict]) -> Callable:
    """A mapInArrow function that turns each batch into columns by make(batch)."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                columns = make(batch)
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name] for f in schema], schema=schema)

    return run


class WordHashes(dict):
    """bytes -> 64-bit hash, remembered; emptied when large, which changes no value."""

    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def utf8(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def ascii_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased; bytes methods touch ASCII only."""
    return utf8(text).lower().split() if text else []


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalising bijection on 64-bit integers."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def shingle_set(words: list[bytes], size: int, cache: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of `size` words; fewer words: the whole sequence as one."""
    if not words:
        return np.empty(0, np.uint64)
    h = np.array([cache[w] for w in words], dtype=np.uint64)
    width = min(size, len(h))
    n = len(h) - width + 1
    acc = np.full(n, np.uint64(width), np.uint64)
    for j in range(width):
        acc = (acc ^ h[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        acc ^= acc >> np.uint64(29)
    return np.unique(mix64(acc))


def connected_components(spark: SparkSession, edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(a, b) links -> (id, component): the smallest id reachable, for every id with a link.

    Alternating large and small stars, each a grouped minimum and a join; edges shrink to one star
    per component. Hubs are split by adaptive skew joins; nothing is collected.
    """
    pairs = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    e = materialise(spark, pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc-edges")

    def stars(df: DataFrame) -> bool:
        """Every node hangs on one centre, and no centre hangs on another."""
        roles = df.select(F.col("u").alias("x"), F.lit(1).alias("leaf"), F.lit(0).alias("centre")).union(df.select("v", F.lit(0), F.lit(1)))
        return roles.groupBy("x").agg(F.sum("leaf").alias("leaf"), F.max("centre").alias("centre")).where("leaf > 1 or leaf = 1 and centre = 1").isEmpty()

    for _ in range(max_rounds):
        if stars(e):
            break
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = materialise(spark, large, "cc-large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        new = materialise(spark, small, "cc-edges")
        forget(spark, e)
        forget(spark, large)
        e = new
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    centres = e.select(F.col("v").alias("id")).distinct()
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(centres.select("id", F.col("id").alias("component")))


def link_buckets(spark: SparkSession, members: DataFrame, verify: Callable[[DataFrame], DataFrame], rest: Callable[[DataFrame], DataFrame] | None = None, star_rounds: int = 4) -> DataFrame:
    """Components of ids that share buckets and pass verify(), without all pairs of a bucket.

    members: a table of (bucket, id) without repeats, buckets of two ids or more. verify: (a, b) pairs -> the linked ones.
    A first star round tests each bucket's smallest id against its other ids; ids of one component
    need no further test. Without rest() more star rounds follow, whose pivots come from other components
    than the bucket's first one. The last round tests what rest() proposes for the (bucket, id, component, c0) rows of buckets that still
    hold several components: every pair that can be a link, of different components. Without rest()
    that is every such pair of a bucket. So no link is lost; a group of near copies is one component by then.
    Returns (id, component) for linked ids.
    """
    sizes = members.groupBy("bucket").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    pairs = members.join(sizes, "bucket").where("id > a").select("a", F.col("id").alias("b")).distinct()
    tested = materialise(spark, pairs, "tested")
    links = materialise(spark, verify(tested), "links")
    comp = connected_components(spark, links)
    star, round_no = rest is None, 0
    while True:
        known = members.join(comp, "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("component"))
        spread = known.groupBy("bucket").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 <> c1")
        open_ = materialise(spark, known.join(spread.select("bucket", "c0"), "bucket"), "open")
        if open_.isEmpty():
            break
        round_no += 1
        star = star and round_no < star_rounds
        if star or rest is None:
            others = open_.where("component <> c0").select("bucket", F.col("id").alias("x"), F.col("component").alias("cx"))
            if star:
                others = others.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("x", F.lit(round_no)).alias("h"), "x", "cx")).alias("p")).select("bucket", "p.x", "p.cx")
            cross = open_.join(others, "bucket").where("component <> cx").select("x", F.col("id").alias("y"))
        else:
            cross = rest(open_)
        pairs = cross.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct().join(tested, ["a", "b"], "left_anti")
        fresh = materialise(spark, pairs, "tested")
        forget(spark, open_)
        if fresh.isEmpty():
            if not star:
                break
            star = False
            continue
        tested = tested.union(fresh)
        found = materialise(spark, verify(fresh), "links")
        if not found.isEmpty():
            links = links.union(found)
            comp = connected_components(spark, links)
        if not star:
            break
    return comp


def prefix_pairs(spark: SparkSession, rows: DataFrame, sets: DataFrame, least: Callable[[Column], Column], reach: Callable[[Column, Column, Column], Column], alike: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(x, y) of different components whose sets can be near enough, by exact prefix and position filters.

    rows: (id, component); sets: (id, s). least(n): members that a set of n has to share. reach(left,
    n, m): whether sets of n and m can be near if they share at most `left`. alike(a, b): whether sets
    with these values of a column `sketch` can be near, checked within the join. Members are ranked rarest
    first; near sets share a member of their prefixes, and enough of what follows it. Sets with many
    members of their own drop out here, so the edges of a large group are not compared with all of it.
    """
    ids = rows.groupBy("id").agg(F.min("component").alias("component"))
    each = materialise(spark, sets.join(ids, "id").select("id", "component", F.size("s").alias("n"), F.explode("s").alias("token")), "tokens")
    common = each.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("token", "df")
    ranked = each.join(common, "token").groupBy("id", "component", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("t"))
    own = F.col("n") - F.size("t")  # members that no other set has, ahead of all others in rank
    cut = F.slice("t", F.lit(1), F.greatest(F.lit(0), (F.col("n") - least(F.col("n")) + 1 - own).cast("int")))
    prefixes = ranked.select("id", "component", "n", own.alias("own"), F.posexplode(cut).alias("i", "t"))
    prefixes = materialise(spark, prefixes.select("id", "component", "n", (F.col("own") + F.col("i")).alias("at"), F.col("t.token").alias("token")), "prefixes")
    sketch: list[str] = []
    if alike is not None:
        sketch = ["sketch"]
        prefixes = prefixes.join(sets.select("id", "sketch"), "id")
    first = prefixes.groupBy("token").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 <> c1").select("token", "c0")
    other = prefixes.join(first, "token").where("component <> c0").select(F.col("token").alias("t2"), F.col("id").alias("x"), F.col("component").alias("cx"), F.col("n").alias("nx"), F.col("at").alias("ax"), *[F.col(c).alias("sx") for c in sketch])
    left = F.least(F.col("n") - F.col("at"), F.col("nx") - F.col("ax"))
    near = (F.col("component") != F.col("cx")) & reach(left, F.col("n"), F.col("nx"))
    if alike is not None:
        near &= alike(F.col("sx"), F.col("sketch"))
    return other.join(prefixes, (F.col("t2") == F.col("token")) & near).select("x", F.col("id").alias("y"))
