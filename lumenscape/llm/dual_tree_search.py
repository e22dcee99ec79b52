"""Ranked lexical search of many items over all documents, by dual trees.

Items and documents are points with a coordinate for every term: an item has the term's weight, a document its saturated
count. The score is their dot product. Both sides are grouped into trees whose nodes hold coordinate maxima, so the dot
product of two nodes bounds every score below them. A pair of nodes whose bound is under the weakest kth score
of the node's items is left out with all that hangs on it; what is left is scored exactly. Nothing else is left out, so
the ranks are those of a full comparison.

Documents are searched where they lie: each task grows trees over its own rows and keeps k of an item. A sixty-fourth of the
documents goes first; the kth scores found there are where the search of the others starts, so that their tasks give
few rows, however many tasks there are.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lumenscape.llm.common import forget, materialise, new_folder

#: Items are taken in blocks of about so many distinct item terms; what reaches the driver and each task is one block.
BLOCK_TERMS = 200_000
#: Children of a node; documents of a leaf.
FANOUT, LEAF = 8, 32
#: Candidates that an item gathers before they are cut to the k best.
GATHER = 1024
#: Share of the documents that is searched first.
FIRST = 1 / 64

# The term separators are all ASCII but digits and letters; A-Z are lower-cased.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """Maximal runs of letters, digits and characters beyond ASCII, only A-Z lower-cased."""
    return text.translate(_TERM_BYTES).split() if text else []


@dataclass
class Nodes:
    """Sparse points, one after the other: where each begins, and its sorted terms and coordinates."""

    begins: np.ndarray
    terms: np.ndarray
    values: np.ndarray

    def __len__(self) -> int:
        return len(self.begins) - 1

    def parents(self, fanout: int) -> Nodes:
        """Coordinate maxima of every `fanout` neighbours."""
        n = -(-len(self) // fanout)
        owner = np.repeat(np.arange(len(self)) // fanout, np.diff(self.begins))
        order = np.lexsort((self.terms, owner))
        owner, t, v = owner[order], self.terms[order], self.values[order]
        new = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (t[1:] != t[:-1])]) if len(t) else np.empty(0, np.int64)
        begins = np.searchsorted(owner[new], np.arange(n + 1))
        return Nodes(begins, t[new], np.maximum.reduceat(v, new) if len(new) else v)

    def take(self, order: np.ndarray) -> Nodes:
        at, begins = _ragged(self.begins, order)
        return Nodes(begins, self.terms[at], self.values[at])


def _ragged(begins: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the chosen rows' cells one after the other, and where each row begins among them."""
    lengths = begins[chosen + 1] - begins[chosen]
    ends = np.cumsum(lengths)
    return np.repeat(begins[chosen] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0), np.r_[0, ends]


def _row_sums(cells: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Sums of consecutive cells (last axis), rows without cells too; exact in 64-bit integers."""
    padded = np.concatenate([cells, np.zeros((*cells.shape[:-1], 1), np.int64)], axis=-1)
    sums = np.add.reduceat(padded, begins[:-1], axis=-1)
    return np.where(begins[1:] > begins[:-1], sums, 0)


def _levels(points: Nodes, first: int) -> list[Nodes]:
    """Points, then their ancestors up to a level of few nodes."""
    out = [points, points.parents(first)]
    while len(out[-1]) > FANOUT:
        out.append(out[-1].parents(FANOUT))
    return out


@dataclass
class Block:
    """Items of one block: ids, their tree (neighbours share their weightiest terms), and the weight of every term of the block."""

    ids: list
    levels: list[Nodes]
    weights: np.ndarray

    @classmethod
    def of(cls, ids: list, item_terms: list[np.ndarray], weights: np.ndarray) -> Block:
        ranked = [sorted(t.tolist(), key=lambda x: (-weights[x], x))[:4] for t in item_terms]
        order = sorted(range(len(ids)), key=ranked.__getitem__)
        rows = [np.sort(item_terms[i]) for i in order]
        flat = np.concatenate(rows) if rows else np.empty(0, np.int64)
        points = Nodes(np.r_[0, np.cumsum([len(r) for r in rows])].astype(np.int64), flat.astype(np.int64), weights[flat] if len(flat) else np.empty(0, np.int64))
        return cls([ids[i] for i in order], _levels(points, FANOUT), weights)


class Search:
    """The k best documents of every item of a block, over the batches of one task."""

    def __init__(self, block: Block, k: int, floor: np.ndarray):
        self.block, self.k = block, k
        self.least = np.maximum(floor, 1)  # scores below this cannot be among the k best
        self.found: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = [[] for _ in block.ids]
        self.waiting = np.zeros(len(block.ids), np.int64)
        self.at = np.zeros(len(block.weights), np.int64)  # a node's coordinates; zero between uses
        self.scored = 0

    def reached(self, doc: Nodes, node: int, items: np.ndarray) -> np.ndarray:
        """Those of the items whose bound against a node of documents is not under their weakest kth score."""
        own = slice(doc.begins[node], doc.begins[node + 1])
        self.at[doc.terms[own]] = doc.values[own]
        for depth in range(len(self.block.levels) - 1, -1, -1):
            level, under = self.block.levels[depth], FANOUT**depth
            groups, begins = np.unique(items // under, return_index=True)
            if not len(groups):
                break
            weakest = np.minimum.reduceat(self.least[items], begins)
            cells, ends = _ragged(level.begins, groups)
            bound = _row_sums(level.values[cells] * self.at[level.terms[cells]], ends)
            items = items[np.repeat(bound >= weakest, np.diff(np.r_[begins, len(items)]))]
        self.at[doc.terms[own]] = 0
        return items

    def score(self, docs: Nodes, first: int, last: int, items: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        """Exact scores of documents first to last against items, kept where they can be among the k best."""
        own = slice(docs.begins[first], docs.begins[last])
        used, column = np.unique(docs.terms[own], return_inverse=True)
        dense = np.zeros((last - first, len(used) + 1), np.int64)
        dense[np.repeat(np.arange(last - first), np.diff(docs.begins[first : last + 1])), column] = docs.values[own]
        self.at[used] = np.arange(1, len(used) + 1)
        points = self.block.levels[0]
        cells, begins = _ragged(points.begins, items)
        place = self.at[points.terms[cells]] - 1  # -1: no document of the leaf has the term
        self.at[used] = 0
        some = place >= 0
        begins = np.r_[0, np.cumsum(some)][begins]
        scores = _row_sums(dense[:, place[some]] * points.values[cells][some], begins)
        self.scored += scores.size
        good = scores >= self.least[items]
        for j in np.flatnonzero(good.any(axis=0)):
            rows, item = np.flatnonzero(good[:, j]), items[j]
            self.found[item].append((scores[rows, j], ids[first + rows], missing[first + rows]))
            self.waiting[item] += len(rows)
            if self.waiting[item] >= GATHER:
                self.cut(item)

    def cut(self, item: int) -> None:
        """Keep the k best: by score, then smaller id, ids that are missing last."""
        score, ids, missing = (np.concatenate(x) for x in zip(*self.found[item]))
        best = np.lexsort((ids, missing, -score))[: self.k]
        self.found[item] = [(score[best], ids[best], missing[best])]
        self.waiting[item] = len(best)
        if len(best) == self.k:
            self.least[item] = max(self.least[item], score[best[-1]])

    def add(self, docs: Nodes, ids: np.ndarray, missing: np.ndarray) -> None:
        """Search a batch: its documents are ordered by their weightiest coordinate, grouped into a tree, and met from the top."""
        worth = docs.values * self.block.weights[docs.terms]
        owner = np.repeat(np.arange(len(docs)), np.diff(docs.begins))
        by_worth = np.lexsort((-worth, owner))
        head = np.full(len(docs), -1, np.int64)
        filled = docs.begins[1:] > docs.begins[:-1]
        head[filled] = docs.terms[by_worth][docs.begins[:-1][filled]]
        order = np.lexsort((ids, head))
        docs, ids, missing = docs.take(order), ids[order], missing[order]
        levels = _levels(docs, LEAF)[1:]
        everyone = np.arange(len(self.block.ids))
        stack = [(len(levels) - 1, node, everyone) for node in range(len(levels[-1]))]
        while stack:
            depth, node, items = stack.pop()
            items = self.reached(levels[depth], node, items)
            if not len(items):
                continue
            if depth:
                children = range(node * FANOUT, min((node + 1) * FANOUT, len(levels[depth - 1])))
                stack.extend((depth - 1, child, items) for child in children)
            else:
                self.score(docs, node * LEAF, min((node + 1) * LEAF, len(docs)), items, ids, missing)
        for item in np.flatnonzero(self.waiting > self.k):
            self.cut(item)


def _counted(spark: SparkSession, docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms with repeats), the block's terms in it with their counts, and whether it is searched first."""
    known = spark.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = known.value
        for batch in batches:
            n, found, tf = [], [], []
            for text in batch.column(1).to_pylist():
                words = terms(text)
                held = [(number[w], c) for w, c in Counter(words).items() if w in number]
                n.append(len(words))
                found.append([t for t, _ in held])
                tf.append([c for _, c in held])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(found, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.int64()))], names=["doc_id", "n", "terms", "tf"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    place = (F.xxhash64("doc_id", F.lit(12)).cast("double") + 2.0**63) / 2.0**64
    return rows.mapInArrow(run, "doc_id long, n long, terms array<int>, tf array<long>").withColumn("first", place < FIRST)


def _best_of_tasks(spark: SparkSession, counted: DataFrame, block: Block, k: int, floor: np.ndarray, n_docs: int, n_terms: int) -> DataFrame:
    """item (its number in the block), doc_id, score: what each task found."""
    shared = spark.sparkContext.broadcast((block, floor))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(shared.value[0], k, shared.value[1])
        for batch in batches:
            if not batch.num_rows:
                continue
            lists, tf = batch.column(2), batch.column(3).flatten().to_numpy().astype(np.int64)
            begins = np.r_[0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))].astype(np.int64)
            m = 50 + (50 * batch.column(1).to_numpy() * n_docs) // n_terms
            impact = (1_000_000_000 * tf) // (1000 * tf + 20 * np.repeat(m, np.diff(begins)))
            ids = batch.column(0)
            missing = ids.is_null().to_numpy(zero_copy_only=False)
            search.add(Nodes(begins, lists.flatten().to_numpy().astype(np.int64), impact), ids.fill_null(0).to_numpy(), missing)
        for item, found in enumerate(search.found):
            if found:
                search.cut(item)
                score, ids, missing = search.found[item][0]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), item, np.int32)), pa.array(ids, mask=missing), pa.array(score)], names=["item", "doc_id", "score"])

    return counted.select("doc_id", "n", "terms", "tf").mapInArrow(run, "item int, doc_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def item_terms(items: DataFrame) -> DataFrame:
    """item_id and its distinct terms; rows of one id are one item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(set(terms(t))) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.binary()))], names=["item_id", "terms"])

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").cast("binary").alias("text"))
    each = rows.mapInArrow(run, "item_id long, terms array<binary>")
    return each.groupBy("item_id").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms")).where(F.size("terms") > 0)


def search(spark: SparkSession, docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k best documents with a score above 0, ties by ascending doc_id.

    Defined cases: null and blank texts have no terms: such documents are found by no item and count for nothing, such items find
    nothing; rows of one item_id are one item with the terms of all, a null item_id too; every row of documents is a
    document of its own, repeated ids come out once a row; a null doc_id comes after equal scores; a very long text is
    counted whole; without items or documents the result is empty; other columns are ignored.
    """
    shape = "item_id long, rank int, doc_id long, score long"
    wanted = materialise(spark, item_terms(items), "items")
    total = wanted.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_TERMS))
    results = []
    for number in range(blocks):
        mine = wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == number) if blocks > 1 else wanted
        rows = sorted(mine.collect(), key=lambda r: (r["item_id"] is None, r["item_id"] or 0))
        if not rows:
            continue
        vocabulary: dict[bytes, int] = {}
        numbered = [np.array([vocabulary.setdefault(bytes(t), len(vocabulary)) for t in r["terms"]], np.int64) for r in rows]
        folder = new_folder(spark, "counted")
        _counted(spark, docs, vocabulary).write.partitionBy("first").parquet(folder)
        counted = spark.read.schema("doc_id long, n long, terms array<int>, tf array<long>, first boolean").parquet(folder)
        stats = counted.where("n > 0").agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("l")).first()
        if not stats["n"]:
            continue
        df = np.zeros(len(vocabulary), np.int64)
        for r in counted.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).collect():
            df[r["t"]] = r["df"]
        weights = np.array([math.floor(1000 * math.log((2 * stats["n"] + 2) / (2 * int(d) + 1))) for d in df], np.int64)
        block = Block.of([r["item_id"] for r in rows], numbered, weights)
        floor = np.zeros(len(rows), np.int64)
        first = materialise(spark, _ranked(_best_of_tasks(spark, counted.where("first"), block, k, floor, stats["n"], stats["l"]), k), "first")
        for r in first.where(F.col("rank") == k).collect():
            floor[r["item"]] = r["score"]
        others = _best_of_tasks(spark, counted.where("not first"), block, k, floor, stats["n"], stats["l"])
        best = _ranked(first.select("item", "doc_id", "score").union(others), k)
        name = F.element_at(F.array(*[F.lit(i).cast("long") for i in block.ids]), F.col("item") + 1) if len(rows) <= 1000 else None
        if name is None:
            names = spark.createDataFrame(pa.table({"item": pa.array(range(len(rows)), pa.int32()), "item_id": pa.array(block.ids, pa.int64())}))
            best = best.join(names, "item")
        else:
            best = best.withColumn("item_id", name)
        results.append(materialise(spark, best.select("item_id", "rank", "doc_id", "score"), "ranked"))
        forget(spark, counted)
    out = spark.createDataFrame([], shape)
    for found in results:
        out = found if found is results[0] else out.union(found)
    return out


def search_sql(k: int = 50) -> str:
    """DuckDB text for search() over documents and benchmark with one row an id."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

    def cut(column: str) -> str:
        return f"unnest(regexp_extract_all(translate({column}, '{letters}', '{letters.lower()}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'))"

    return f"""WITH held AS MATERIALIZED (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, {cut("text")} AS t FROM documents) GROUP BY doc_id, t),
sizes AS MATERIALIZED (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM held GROUP BY doc_id),
whole AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM sizes),
wanted AS (SELECT DISTINCT item_id, t FROM (SELECT item_id, {cut("text")} AS t FROM benchmark)),
weights AS (SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT t, count(*) AS df FROM held GROUP BY t), whole),
lengths AS (SELECT doc_id, 50 + (50 * n * n_docs) // n_terms AS m FROM sizes, whole),
scores AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
FROM wanted JOIN held USING (t) JOIN weights USING (t) JOIN lengths USING (doc_id) GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= {k}"""
