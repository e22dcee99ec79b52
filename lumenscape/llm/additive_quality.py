"""Document quality by a generalised additive model with pairwise interactions.

Every document becomes a few numbers about its whole text. The model is an intercept, one lookup table for each number and
one for each of a few pairs of numbers, over bins of them. The tables are learnt by cyclic boosting: in turn each number
(then each pair) gets one shallow tree, grown on its bins alone, and the tree's leaves are added to its table. A score is
the logistic of the sum of the looked-up values, so what each number adds can be read off its table.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import combinations
from operator import eq
import unicodedata

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from lumenscape.llm.common import id_crc32, utf8

#: Bound of the fit: labelled documents of each class.
TRAIN_DOCS = 4000
#: Bins of a number, of each side of a pair, and how many pairs.
BINS, PAIR_BINS, PAIRS = 64, 12, 6
#: Boosting: passes over all tables at most, passes without gain on the held-back fold until it ends, step, leaves of a tree, least weight of a leaf.
PASSES, PATIENCE, RATE, LEAVES, LEAST = 300, 30, 0.15, 4, 6.0

FEATURES = [
    "log_chars", "log_words", "word_chars", "upper_share", "letter_share", "digit_share", "mark_share", "distinct_share", "commonest_share", "repeat_share", "run_share", "sentence_ends",
    "odd_ends", "bare_share", "line_words", "line_repeats", "char_entropy", "capital_words",
]


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """0 other, 1 upper case, 2 other letter, 3 digit, 4 white space, 5 mark, for each code point of the basic plane; then one for the rest."""

    def kind(c: str) -> int:
        if c.isspace():
            return 4
        group = unicodedata.category(c)
        return {"L": 1 if group == "Lu" else 2, "N": 3, "P": 5, "S": 5}.get(group[0], 0)

    return np.array([*(kind(chr(i)) for i in range(0x10000)), 0], np.int8)


def features(text: str | None) -> list[float]:
    """The numbers of FEATURES. Without words all are 0, which no other text has for log_chars and log_words."""
    words = text.split() if text else []
    if not words:
        return [0.0] * len(FEATURES)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = np.bincount(_classes()[np.minimum(codes, 0x10000)], minlength=6)
    seen = kinds.sum() - kinds[4]
    letters = max(1, kinds[1] + kinds[2])
    counts = Counter(words)
    n = len(words)
    runs = len(set(zip(words, words[1:], words[2:]))) if n > 2 else 1
    ends = Counter(w[-1] for w in words)
    sentence = sum(ends[c] for c in ".,;:!?")
    plain = sum(c for e, c in ends.items() if e.isalnum())
    lines = [x for x in text.split("\n") if x.strip()]
    chars = np.unique(codes, return_counts=True)[1] / len(codes)
    bare = sum(c for w, c in counts.items() if not any(map(str.isalnum, w)))
    capital = sum(c for w, c in counts.items() if w[0].isupper())
    return [
        np.log1p(len(codes)), np.log1p(n), seen / n, kinds[1] / letters, (kinds[1] + kinds[2]) / seen if seen else 0.0, kinds[3] / seen if seen else 0.0, kinds[5] / seen if seen else 0.0,
        len(counts) / n, max(counts.values()) / n, sum(map(eq, words, words[1:])) / n, 1 - runs / max(1, n - 2), sentence / n,
        (n - plain - sentence) / n, bare / n, np.log1p(n / len(lines)), 1 - len(set(lines)) / len(lines), float(-(chars * np.log2(chars)).sum()), capital / n,
    ]


@dataclass
class Additive:
    """Bin edges of every number; a table for each; for each pair its numbers, coarser edges' positions and table."""

    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)
    intercept: float = 0.0

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)]

    def evidence(self, x: np.ndarray) -> np.ndarray:
        """Intercept plus one looked-up value for each number and each pair, row by row."""
        at = self.bins(x)
        out = np.full(len(x), self.intercept)
        for f, table in enumerate(self.tables):
            out += table[at[f]]
        for (f, g), table in zip(self.pairs, self.pair_tables):
            out += table[self.coarse[f][at[f]], self.coarse[g][at[g]]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.evidence(x), -40, 40)))


def _edges(values: np.ndarray) -> np.ndarray:
    """Cuts between neighbouring distinct values at quantiles, and on either side of a value that many documents share."""
    distinct, counts = np.unique(values, return_counts=True)
    if len(distinct) < 2:
        return np.empty(0)
    below = np.cumsum(counts)[:-1] / len(values)
    middle = (distinct[:-1] + distinct[1:]) / 2
    wanted = np.searchsorted(below, np.arange(1, BINS) / BINS)
    often = np.flatnonzero(counts > len(values) / BINS)
    chosen = np.unique(np.clip(np.concatenate([wanted, often - 1, often]), 0, len(middle) - 1))
    return middle[chosen]


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def tree_1d(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values by bin of a tree of LEAVES leaves at most: each split is the best one that leaves both sides enough weight."""
    sums_g, sums_h = np.r_[0.0, np.cumsum(g)], np.r_[0.0, np.cumsum(h)]
    leaves, out = [(0, len(g))], np.zeros(len(g))

    def best(lo: int, hi: int) -> tuple[float, int]:
        cuts = np.arange(lo + 1, hi)
        lg, lh = sums_g[cuts] - sums_g[lo], sums_h[cuts] - sums_h[lo]
        rg, rh = sums_g[hi] - sums_g[cuts], sums_h[hi] - sums_h[cuts]
        gains = np.where((lh >= LEAST / 4) & (rh >= LEAST / 4), _gain(lg, lh) + _gain(rg, rh) - _gain(lg + rg, lh + rh), -1.0)
        return (float(gains.max()), int(cuts[gains.argmax()])) if len(cuts) else (-1.0, lo)

    while len(leaves) < LEAVES:
        gain, cut, leaf = max((*best(*leaf), leaf) for leaf in leaves)
        if gain <= 1e-9:
            break
        leaves.remove(leaf)
        leaves += [(leaf[0], cut), (cut, leaf[1])]
    for lo, hi in leaves:
        out[lo:hi] = (sums_g[hi] - sums_g[lo]) / (sums_h[hi] - sums_h[lo] + 1.0)
    return out


def tree_2d(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of a two-level tree over a grid: one number is cut once, each side by the other number."""

    def sides(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For every first cut the gain of the best second cuts of the upper part of the grid, that cut, and whether there is one."""
        cg, ch = np.cumsum(np.cumsum(g, 0), 1), np.cumsum(np.cumsum(h, 0), 1)
        gains = _gain(cg[:, :-1], ch[:, :-1]) + _gain(cg[:, -1:] - cg[:, :-1], ch[:, -1:] - ch[:, :-1])
        enough = (ch[:, :-1] >= LEAST / 4) & (ch[:, -1:] - ch[:, :-1] >= LEAST / 4)
        gains = np.where(enough, gains, _gain(cg[:, -1:], ch[:, -1:]))
        return gains.max(1), gains.argmax(1), enough[np.arange(len(g)), gains.argmax(1)]

    total = _gain(g.sum(), h.sum())
    best, values = 0.0, np.zeros(g.shape)
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        if min(a.shape) < 2:
            continue
        upper, upper_cut, upper_is = (x[:-1] for x in sides(a, b))
        lower, lower_cut, lower_is = (x[::-1][1:] for x in sides(a[::-1], b[::-1]))
        row = int((upper + lower).argmax())
        gain = float(upper[row] + lower[row] - total)
        if gain > best + 1e-9:
            best, out = gain, np.zeros(a.shape)
            for rows, cut, is_cut in ((slice(0, row + 1), upper_cut[row], upper_is[row]), (slice(row + 1, None), lower_cut[row], lower_is[row])):
                for columns in (slice(0, cut + 1), slice(cut + 1, None)) if is_cut else (slice(None),):
                    out[rows, columns] = a[rows, columns].sum() / (b[rows, columns].sum() + 1.0)
            values = out.T if turned else out
    return best, values


class Booster:
    """Cyclic boosting of one model on weighted rows; a fold held back tells when to stop."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weights: np.ndarray, held: np.ndarray):
        self.y, self.w, self.held = y.astype(np.float64), weights, held
        edges = [_edges(x[~held, f]) for f in range(x.shape[1])]
        self.model = Additive(edges, [np.zeros(len(e) + 1) for e in edges])
        self.model.coarse = [np.arange(len(e) + 1) * min(PAIR_BINS, len(e) + 1) // (len(e) + 1) for e in edges]
        self.at = self.model.bins(x)
        self.wide = [c[a] for c, a in zip(self.model.coarse, self.at)]
        p = np.clip((self.w * self.y)[~held].sum() / self.w[~held].sum(), 1e-6, 1 - 1e-6)
        self.model.intercept = float(np.log(p / (1 - p)))
        self.f = np.full(len(y), self.model.intercept)

    def slopes(self) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-self.f))
        use = self.w * ~self.held
        return use * (self.y - p), use * np.maximum(p * (1 - p), 1e-6)

    def loss(self) -> float:
        rows = self.held if self.held.any() else ~self.held
        f = self.f[rows]
        return float((self.w[rows] * (np.logaddexp(0, f) - self.y[rows] * f)).sum() / self.w[rows].sum())

    def grid(self, f: int, g: int, values: np.ndarray) -> np.ndarray:
        shape = (self.model.coarse[f][-1] + 1, self.model.coarse[g][-1] + 1)
        return np.bincount(self.wide[f] * shape[1] + self.wide[g], values, shape[0] * shape[1]).reshape(shape)

    def choose_pairs(self) -> None:
        """The pairs whose two-level tree takes most of what the single tables leave."""
        g, h = self.slopes()
        gains = {(a, b): tree_2d(self.grid(a, b, g), self.grid(a, b, h))[0] for a, b in combinations(range(len(self.at)), 2)}
        self.model.pairs = sorted(gains, key=lambda p: (-gains[p], p))[:PAIRS]
        self.model.pair_tables = [np.zeros((self.model.coarse[a][-1] + 1, self.model.coarse[b][-1] + 1)) for a, b in self.model.pairs]

    def single(self, f: int) -> None:
        g, h = self.slopes()
        n = len(self.model.tables[f])
        step = RATE * tree_1d(np.bincount(self.at[f], g, n), np.bincount(self.at[f], h, n))
        self.model.tables[f] += step
        self.f += step[self.at[f]]

    def pair(self, i: int) -> None:
        a, b = self.model.pairs[i]
        g, h = self.slopes()
        step = RATE * tree_2d(self.grid(a, b, g), self.grid(a, b, h))[1]
        self.model.pair_tables[i] += step
        self.f += step[self.wide[a], self.wide[b]]

    def boost(self, tables: list[np.ndarray], step, passes: int) -> None:
        """Passes over the tables until the held-back fold gains no more; the best state stays."""
        best, since = (self.loss(), [t.copy() for t in tables], self.f.copy()), 0
        for _ in range(passes):
            for i in range(len(tables)):
                step(i)
            loss = self.loss()
            since = 0 if loss < best[0] - 1e-6 else since + 1
            if not since:
                best = (loss, [t.copy() for t in tables], self.f.copy())
            if since >= PATIENCE:
                break
        for table, kept in zip(tables, best[1]):
            table[:] = kept
        self.f = best[2]


def fit(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> Additive:
    """A model of labels 0 and 1; every fifth row is held back to end the boosting."""
    if len(set(y.tolist())) < 2:
        empty = [np.empty(0)] * len(FEATURES)
        return Additive(empty, [np.zeros(1) for _ in empty], [np.zeros(1, np.int64) for _ in empty], intercept=8.0 if len(y) and y[0] == 1 else -8.0)
    held = np.arange(len(y)) % 5 == 4
    if len(set(y[~held].tolist())) < 2:
        held[:] = False
    booster = Booster(x, y, weights, held)
    booster.boost(booster.model.tables, booster.single, PASSES)
    booster.choose_pairs()
    booster.boost(booster.model.pair_tables, booster.pair, PASSES)
    return booster.model


def fit_on_documents(docs: DataFrame, labels: DataFrame, eligible: Column) -> Additive:
    """Fit on at most TRAIN_DOCS labelled documents of each class, weighted by how many of the class there are.

    They are picked by a hash of their ids, thinned by the count of the class in every task alike; the driver gets
    their numbers, no texts. Equal texts of one label count once.
    """
    known = labels.where(F.col("quality").isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.where("doc_id is not null").where(eligible)
    n = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = {y: (TRAIN_DOCS + 6 * TRAIN_DOCS**0.5 + 8) / c for y, c in n.items()}  # six deviations more than wanted
    place = (F.col("r").cast("double") + 2.0**63) / 2.0**64
    chosen = known.withColumn("r", F.xxhash64("doc_id", F.lit(11))).where((F.col("quality") == 0) & (place < share.get(0, 0.0)) | (F.col("quality") == 1) & (place < share.get(1, 0.0)))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(3).to_pylist()
            hashes = pa.array([xxhash.xxh64_intdigest(utf8(t or "")) - (1 << 63) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], hashes, pa.array([features(t) for t in texts], pa.list_(pa.float64()))], names=["r", "doc_id", "quality", "text_hash", "x"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    picked = texts.join(F.broadcast(chosen), "doc_id").select("r", "doc_id", "quality", "text")
    got = picked.mapInArrow(measure, "r long, doc_id long, quality int, text_hash long, x array<double>").toArrow().combine_chunks()
    r, ids, y, text = (got.column(i).to_numpy() for i in range(4))
    order, seen, taken = [], set(), Counter()
    for i in np.lexsort((text, y, ids, r)):
        if (text[i], y[i]) not in seen and taken[int(y[i])] < TRAIN_DOCS:
            seen.add((text[i], y[i]))
            taken[int(y[i])] += 1
            order.append(i)
    x = np.array([got.column(4)[int(i)].as_py() for i in order], np.float64).reshape(-1, len(FEATURES))
    y = y[order].astype(np.int64)
    weight = {k: n[k] / taken[k] for k in taken}
    most = max(weight.values(), default=1.0)
    return fit(x, y, np.array([weight[int(k)] / most for k in y]))


def score_documents(spark: SparkSession, docs: DataFrame, model: Additive, score_col: str = "score") -> DataFrame:
    """docs with a score (0 to 1) added."""
    shared = spark.sparkContext.broadcast(model)
    text_at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t) for t in batch.column(text_at).to_pylist()], np.float64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.score(x))], names=[*batch.schema.names, score_col])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())]))


def quality(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs.

    Labels are learnt only from rows whose crc32(doc_id) mod 3 is not 1. Defined cases: null, empty and blank texts
    share the score of a text without words; a very long text is measured whole; equal texts score alike; a score of exactly
    one half counts as 1; a null doc_id is not held out; labels other than 0 and 1 are ignored; without labels of
    both classes every score is that of the class there is (of no labels: 0); a document with labels of both classes is
    learnt as both; repeated rows come out once each; an empty table gives an empty result; other columns are ignored.
    """
    fold = F.coalesce(id_crc32("doc_id") % 3, F.lit(0))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = fit_on_documents(rows, labels, fold != 1)
    scored = score_documents(spark, rows, model)
    return scored.select("doc_id", (fold == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
