"""Embedding near-duplicates over a robust-pruned flat graph.

Vectors go to the shards of their nearest centroids, so shards overlap. Each shard builds its own
pruned neighbour graph; adjacency lists of a vector from all its shards are united, and edges run both ways. A
range-expanding greedy search then starts at each shard's medoid and at the vector looked for, if it is there, and
spreads from what it finds over all neighbours within the range. Every link is a cosine in double precision. A link
counts in the first shard that both vectors are in; tasks give counts and the edges of a spanning forest, never all
pairs. The counts are audited against brute force on a bounded set of probes; a low recall repeats the build with
twice the overlap, and ends in an error where even shards that hold everything miss too much.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lumenscape.llm.common import connected_components, materialise

#: Bounded sample that centroids are fitted on, probes of the audit, and vectors of one shard task.
CENTROID_SAMPLE, PROBES, SHARD_ROWS = 8192, 512, 1200
DEGREE, BEAM, ALPHA = 24, 16, 1.2
#: How far below the range a found vector is still expanded.
SLACK = 0.05
OVERLAP, WANTED_RECALL = 3, 0.95


def valid_vector(v: Column) -> Column:
    """Not null, no null or non-finite component, not zero; of double components."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Unit length in double precision; scaled first so that tiny or huge components neither vanish nor overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def fit_centroids(sample: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """Spherical k-means with a fixed start."""
    centres = sample[np.linspace(0, len(sample) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = np.concatenate([np.argmax(sample[i : i + 1024] @ centres.T, axis=1) for i in range(0, len(sample), 1024)])
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        size = np.linalg.norm(sums, axis=1)
        centres[size > 1e-9] = sums[size > 1e-9] / size[size > 1e-9, None]
    return centres


def spread_out(centres: np.ndarray, least: float) -> np.ndarray:
    """Centroids of which no two are as near as a link: a dense group stays one (crowded) shard instead of being cut up."""
    kept: list[int] = []
    for i in range(len(centres)):
        if not kept or (centres[kept] @ centres[i]).max() < least:
            kept.append(i)
    return centres[kept]


def robust_prune(x: np.ndarray, order: np.ndarray, sims: np.ndarray, degree: int, alpha: float) -> list[int]:
    """Keep the nearest candidate, drop those that it covers (alpha times nearer to it), go on."""
    kept: list[int] = []
    alive = np.ones(len(order), bool)
    far = 1.0 - sims
    among = 1.0 - x[order] @ x[order].T
    for j in range(len(order)):
        if not alive[j]:
            continue
        kept.append(int(order[j]))
        if len(kept) == degree:
            break
        alive &= alpha * among[j] > far
    return kept


def shard_graph(x: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Adjacency (rows x degree, padded by -1) of one shard: its nearest and some others, pruned.

    The others, picked at random, are what leads out of a dense group, whose nearest are all of the group.
    """
    n = len(x)
    out = np.full((n, degree), -1, np.int32)
    pool = min(n - 1, 3 * degree)
    if pool <= 0:
        return out
    far = np.random.default_rng(7).integers(0, n, (n, degree))
    for at in range(0, n, 512):
        s = x[at : at + 512] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        best = np.argpartition(-s, pool - 1, axis=1)[:, :pool]
        for i in range(len(s)):
            some = np.union1d(best[i], far[at + i])
            some = some[np.argsort(-s[i, some], kind="stable")]
            some = some[s[i, some] > -np.inf]
            kept = robust_prune(x, some, s[i, some], degree, alpha)
            out[at + i, : len(kept)] = kept
    return out


def greedy_search(x: np.ndarray, adj: np.ndarray, queries: np.ndarray, start: int, beam: int = BEAM) -> np.ndarray:
    """Beam search of all queries in step; the ids of each beam, best first."""
    q, n = len(queries), len(x)
    ids = np.full((q, beam), -1, np.int64)
    sim = np.full((q, beam), -np.inf)
    done = np.zeros((q, beam), bool)
    seen = np.zeros((q, n), bool)
    ids[:, 0], sim[:, 0], seen[:, start] = start, queries @ x[start], True
    for _ in range(4 * beam + 32):
        todo = np.where(done | (ids < 0), -np.inf, sim)
        pick = todo.argmax(axis=1)
        act = np.flatnonzero(todo[np.arange(q), pick] > -np.inf)
        if not act.size:
            break
        done[act, pick[act]] = True
        new = adj[ids[act, pick[act]]]
        fresh = (new >= 0) & ~seen[act[:, None], np.maximum(new, 0)]
        safe = np.where(fresh, new, 0)
        got = np.where(fresh, np.einsum("qrd,qd->qr", x[safe], queries[act]), -np.inf)
        rows, cols = np.nonzero(fresh)
        seen[act[rows], new[rows, cols]] = True
        got = _first_of_equals(new, got)
        all_ids, all_sim = np.concatenate([ids[act], new], 1), np.concatenate([sim[act], got], 1)
        all_done = np.concatenate([done[act], np.zeros(new.shape, bool)], 1)
        top = np.argsort(-all_sim, axis=1, kind="stable")[:, :beam]
        ids[act], sim[act], done[act] = (np.take_along_axis(a, top, 1) for a in (all_ids, all_sim, all_done))
        ids[act] = np.where(np.isinf(sim[act]), -1, ids[act])
    return ids


def _first_of_equals(ids: np.ndarray, sims: np.ndarray) -> np.ndarray:
    order = np.argsort(ids, axis=1, kind="stable")
    ranked = np.take_along_axis(ids, order, 1)
    again = np.zeros(ids.shape, bool)
    again[:, 1:] = ranked[:, 1:] == ranked[:, :-1]
    back = np.empty_like(again)
    np.put_along_axis(back, order, again, 1)
    return np.where(back, -np.inf, sims)


def range_expand(x: np.ndarray, adj: np.ndarray, queries: np.ndarray, beams: np.ndarray, least: float, slack: float = SLACK) -> tuple[np.ndarray, np.ndarray]:
    """(query row, found row) pairs with cosine >= least, spreading from the beams over in-range neighbours."""
    seen = np.zeros((len(queries), len(x)), bool)
    qi, vi = np.nonzero(beams >= 0)
    vi = beams[qi, vi]
    out_q, out_v = [], []
    while len(qi):
        code = np.unique(qi.astype(np.int64) * len(x) + vi)
        qi, vi = code // len(x), code % len(x)
        new = ~seen[qi, vi]
        qi, vi = qi[new], vi[new]
        seen[qi, vi] = True
        s = np.concatenate([np.einsum("ij,ij->i", queries[qi[i : i + 65536]], x[vi[i : i + 65536]]) for i in range(0, len(qi), 65536)]) if len(qi) else np.empty(0)
        hit = s >= least
        out_q.append(qi[hit])
        out_v.append(vi[hit])
        grow = s >= least - slack
        qi, vi = qi[grow], vi[grow]
        next_q, next_v = [], []
        for i in range(0, len(qi), 32768):  # bounded expansion; what was seen goes at once
            nb = adj[vi[i : i + 32768]]
            qq = np.repeat(qi[i : i + 32768], nb.shape[1]).reshape(nb.shape)
            ok = (nb >= 0) & ~seen[qq, np.maximum(nb, 0)]
            c = np.unique(qq[ok].astype(np.int64) * len(x) + nb[ok])
            next_q.append(c // len(x))
            next_v.append(c % len(x))
        qi = np.concatenate(next_q) if next_q else np.empty(0, np.int64)
        vi = np.concatenate(next_v) if next_v else np.empty(0, np.int64)
    return (np.concatenate(out_q), np.concatenate(out_v)) if out_q else (np.empty(0, np.int64), np.empty(0, np.int64))


def _vectors(column: pa.Array) -> np.ndarray:
    width = len(column[0])
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _frame_vectors(pdf: pd.DataFrame) -> np.ndarray:
    return np.array(pdf["vec"].tolist(), dtype=np.float64)


def spanning_edges(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(x, root) for every id of the links (a, b) that is not the smallest of its group: as connected as the links."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        new = new[new]
        if (new == label).all() and (label[left] == label[right]).all():
            return ids[label != np.arange(len(ids))], ids[label[label != np.arange(len(ids))]]
        label = new


def first_common(mine: np.ndarray, theirs: np.ndarray) -> np.ndarray:
    """Smallest shard in both of two lists of shards, by row; each pair here has one."""
    return np.where((mine[:, :, None] == theirs[:, None, :]).any(axis=2), mine, np.iinfo(np.int64).max).min(axis=1)


def near_vectors(spark: SparkSession, table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.9, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept, audit_recall) for every row.

    n_links: other vectors with cosine >= least. Equal vectors are one class, searched once. Vectors of
    different lengths have no cosine and do not link; each length has its own shards. Defined cases: null,
    empty, zero and non-finite vectors link with nothing; a null id is never linked, has a null component and
    is kept; repeated rows of one id come out once each, do not count as links of each other, and are of one component
    even where their vectors differ (n_links is then the largest); a cosine of exactly `least` links; vectors may be of
    any length; an empty table gives an empty result; other columns are ignored.
    """
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = table.select(F.col(id_col).cast("long").alias("id"), v.alias("vec"))
    good = rows.where(F.col("id").isNotNull() & valid_vector(F.col("vec")))
    classes = materialise(spark, good.groupBy("vec").agg(F.min("id").alias("id"), F.countDistinct("id").alias("copies"), F.max("id").alias("hi")), "classes")
    # an id with several vectors is of several classes; a class is known by its smallest id and its vector
    classes = classes.withColumn("node", F.xxhash64("id", "vec")).withColumn("r", F.xxhash64("node", F.lit(9)))
    sizes = {row["d"]: row["n"] for row in classes.groupBy(F.size("vec").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(sizes.values())
    if total == 0:
        return rows.select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"), F.lit(None).cast("double").alias("audit_recall"))

    share = (CENTROID_SAMPLE + 6 * CENTROID_SAMPLE**0.5 + 8) / total
    picked = classes.where((F.col("r").cast("double") + 2.0**63) / 2.0**64 < share).select("r", "node", "vec").toPandas().sort_values(["r", "node"])[:CENTROID_SAMPLE]
    plans: dict[int, dict] = {}
    for d in sizes:
        mine = picked[picked["vec"].map(len) == d]
        sample = unit_rows(_frame_vectors(mine)) if len(mine) else np.empty((0, d))
        k = int(np.clip(sizes[d] // (shard_rows // 2), 1, max(1, len(sample))))
        probes = max(1, PROBES * len(mine) // len(picked)) if len(mine) else 0
        plans[d] = {"centres": spread_out(fit_centroids(sample, k), least) if len(sample) else np.ones((1, d)), "nodes": mine["node"].to_numpy()[:probes], "probes": sample[:probes]}
    shared = spark.sparkContext.broadcast(plans)
    widest = max(len(p["centres"]) for p in plans.values())

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, at, x in _by_length(batch.column(2)):
                plan = shared.value[d]
                if len(plan["probes"]):
                    hits = x @ plan["probes"].T >= least
                    hits &= batch.column(0).to_numpy()[at][:, None] != plan["nodes"][None, :]
                    links = batch.column(1).to_numpy()[at] @ hits
                    yield pa.RecordBatch.from_arrays([pa.array(plan["nodes"]), pa.array(links.astype(np.int64))], names=["node", "true_links"])

    truth = classes.select("node", "copies", "vec").mapInArrow(exact, "node long, true_links long").groupBy("node").agg(F.sum("true_links").alias("true_links")).where("true_links > 0")
    truth = materialise(spark, truth, "truth")
    overlap = OVERLAP
    while True:
        found = _search(spark, classes, shared, min(overlap, widest), least, shard_rows)
        counts = materialise(spark, found.where("links > 0").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links")), "counts")
        got = F.least(F.coalesce("links", F.lit(0)), F.col("true_links"))
        audit = truth.join(counts, "node", "left").agg(F.sum(got) / F.sum("true_links"), F.avg(got / F.col("true_links"))).first()
        recall = 1.0 if audit[0] is None else min(audit)
        if recall >= WANTED_RECALL:
            break
        if overlap >= widest:
            raise RuntimeError(f"audited recall is {recall:.3f}, less than {WANTED_RECALL}, with every vector in every shard")
        overlap *= 2
    of = classes.select("node", "id")
    edges = found.where("b is not null").join(of.select(F.col("node").alias("a"), F.col("id").alias("ia")), "a").join(of.select(F.col("node").alias("b"), F.col("id").alias("ib")), "b").select(F.col("ia").alias("a"), F.col("ib").alias("b"))
    represented = good.join(classes.select("vec", F.col("id").alias("rep")), "vec").select("id", "rep")
    several = represented.groupBy("id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo <> hi")
    tied = represented.join(several.select("id"), "id", "left_semi")
    comp = connected_components(spark, edges.union(tied.select(F.col("id").alias("a"), F.col("rep").alias("b"))))
    state = classes.join(counts, "node", "left").join(comp, "id", "left")
    state = state.select("vec", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component"))
    state = materialise(spark, good.join(state, "vec").select("id", "n_links", "component"), "state").groupBy("id").agg(F.max("n_links").alias("n_links"), F.min("component").alias("component"))
    out = rows.select("id").join(state, "id", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"), F.lit(float(recall)).alias("audit_recall"))


def _by_length(vectors: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row numbers, unit vectors) of a batch, in pieces of 4,096 rows."""
    offsets = vectors.offsets.to_numpy()
    values, lengths = vectors.flatten().to_numpy(zero_copy_only=False), np.diff(offsets)
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        for at in range(0, len(rows), 4096):
            some = rows[at : at + 4096]
            yield int(d), some, unit_rows(values[(offsets[some] - offsets[0])[:, None] + np.arange(d)].astype(np.float64))


def _search(spark: SparkSession, classes: DataFrame, shared, overlap: int, least: float, shard_rows: int) -> DataFrame:
    """(a, b, links): either a link count of node a in one task (b null), or an edge of a task's spanning forest (links 0)."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, at, x in _by_length(batch.column(2)):
                centres = shared.value[d]["centres"]
                width = min(overlap, len(centres))
                near = np.sort(np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :width], axis=1) + (d << 32)
                take = np.repeat(at, width)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(take) + 1, dtype=np.int32) * width), pa.array(np.repeat(near, width, axis=0).ravel()))
                copied = [c.take(pa.array(take)) for c in batch.columns]
                yield pa.RecordBatch.from_arrays([pa.array(near.ravel()), *copied, lists], names=["shard", "node", "copies", "vec", "shards"])

    assigned = materialise(spark, classes.select("node", "copies", "vec").mapInArrow(assign, "shard long, node long, copies long, vec array<double>, shards array<long>"), "shards")
    # a crowded shard is dealt into parts of shard_rows; its vectors are looked for in each part
    sizes = assigned.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / F.lit(shard_rows)).cast("long").alias("parts"))
    dealt = assigned.join(sizes, "shard").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))

    def build(key, pdf: pd.DataFrame) -> pd.DataFrame:
        adj = shard_graph(unit_rows(_frame_vectors(pdf)))
        ids = pdf["node"].to_numpy()
        return pd.DataFrame({"node": ids, "neighbours": [ids[a[a >= 0]] for a in adj]})

    graphs = dealt.groupBy("shard", "part").applyInPandas(build, "node long, neighbours array<long>")
    united = materialise(spark, graphs.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("neighbours"))).alias("neighbours")), "graph")
    nodes = dealt.join(united, "node").select("shard", "part", "node", "copies", "vec", "shards", "neighbours")
    askers = dealt.select("shard", "node", "vec", "shards", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.pmod(F.xxhash64("node", F.lit(7)), F.col("parts")).alias("block"))
    blocks = askers.select("shard", "part", "block").distinct()
    nodes = nodes.join(blocks, ["shard", "part"]).select(*[F.col(c).alias(c) for c in ("shard", "part", "block", "node", "copies", "vec", "shards", "neighbours")])
    askers = askers.select(*[F.col(c).alias(c) for c in ("shard", "part", "block", "node", "vec", "shards")])

    def search(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"a": pd.array([], "Int64"), "b": pd.array([], "Int64"), "links": pd.array([], "Int64")})
        ids, x = left["node"].to_numpy(), unit_rows(_frame_vectors(left))
        lists = left["neighbours"].tolist()
        adj, both_ways = adjacency(ids, lists, False), adjacency(ids, lists, True)
        medoid = int(np.argmax(x @ x.mean(axis=0)))
        mine, q = right["node"].to_numpy(), unit_rows(_frame_vectors(right))
        order = np.argsort(ids)
        own = order[np.minimum(np.searchsorted(ids, mine, sorter=order), len(ids) - 1)]
        own = np.where(ids[own] == mine, own, -1)
        shards, asking = np.array(left["shards"].tolist(), np.int64), np.array(right["shards"].tolist(), np.int64)
        copies, links, trees = left["copies"].to_numpy(), np.zeros(len(q)), []
        for i in range(0, len(q), 512):
            beams = np.column_stack([greedy_search(x, adj, q[i : i + 512], medoid), own[i : i + 512]])
            a, b = range_expand(x, both_ways, q[i : i + 512], beams, least)
            a, other = a + i, mine[a + i] != ids[b]
            a, b = a[other], b[other]
            for at in range(0, len(a), 65536):
                some = slice(at, at + 65536)
                here = first_common(asking[a[some]], shards[b[some]]) == key[0]
                links += np.bincount(a[some], copies[b[some]] * here, len(q))
            trees.append(spanning_edges(mine[a], ids[b]))
        xs, roots = (np.concatenate([t[j] for t in trees]) for j in (0, 1))
        xs, roots = spanning_edges(xs, roots)
        counted = np.flatnonzero(links)
        a, n = np.concatenate([mine[counted], xs]), np.concatenate([links[counted].astype(np.int64), np.zeros(len(xs), np.int64)])
        b = pd.array(np.concatenate([np.zeros(len(counted), np.int64), roots]), "Int64")
        b[: len(counted)] = pd.NA
        return pd.DataFrame({"a": a, "b": b, "links": n})

    keys = ["shard", "part", "block"]
    found = nodes.groupBy(*keys).cogroup(askers.groupBy(*keys)).applyInPandas(search, "a long, b long, links long")
    return materialise(spark, found, "found")


def adjacency(ids: np.ndarray, lists: list, both_ways: bool) -> np.ndarray:
    """Neighbours that are here by row number, padded by -1."""
    order = np.argsort(ids)
    source = np.repeat(np.arange(len(ids)), [len(near) for near in lists])
    named = np.concatenate([np.asarray(near, np.int64) for near in lists]) if len(lists) else np.empty(0, np.int64)
    target = order[np.minimum(np.searchsorted(ids, named, sorter=order), len(ids) - 1)]
    here = (ids[target] == named) & (target != source)
    code = source[here] * len(ids) + target[here]
    if both_ways:
        code = np.unique(np.concatenate([code, target[here] * len(ids) + source[here]]))
    source, target = code // len(ids), code % len(ids)
    count = np.bincount(source, minlength=len(ids))
    adj = np.full((len(ids), max(1, int(count.max(initial=0)))), -1, np.int64)
    adj[source, np.arange(len(source)) - np.repeat(np.cumsum(count) - count, count)] = target
    return adj
