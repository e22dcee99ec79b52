"""Language identification by a byte convolutional network.

Filters of several widths slide over the bytes of a fixed-length window; each keeps its largest
response, and a softmax layer reads those. A filter of width w is w tables of one weight per byte,
so a response is a sum of table look-ups; for prediction the tables of byte pairs are added up
beforehand. Whole texts are cut into windows; a text's language is that of the mean probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lumenscape.llm.common import id_crc32, utf8

WIDTHS, FILTERS, WINDOW = (2, 3, 4), 12, 256
#: Bounds of the fit: documents of each language, of all together (each language has one at least), and windows of each.
TRAIN_DOCS, TRAIN_ALL, TRAIN_WINDOWS = 400, 100_000, 6
UNKNOWN = "und"


def windows_of(text: str) -> np.ndarray:
    """(n, WINDOW) bytes, A-Z lower-cased, the last window filled up with zeros; no text, no window."""
    raw = np.frombuffer(utf8(text).lower(), np.uint8)
    n = -(-len(raw) // WINDOW)
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(raw)] = raw
    return out.reshape(n, WINDOW)


@dataclass
class Network:
    langs: list[str]
    tables: list[np.ndarray]  # for each width (width, 256, FILTERS)
    biases: list[np.ndarray]
    dense: np.ndarray  # (filters of all widths + 1, languages)

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Largest responses (n, filters) and where they are; for training."""
        values, places = [], []
        for w, table, bias in zip(WIDTHS, self.tables, self.biases):
            span = x.shape[1] - w + 1
            r = sum(table[j][x[:, j : j + span]] for j in range(w))
            at = r.argmax(axis=1)
            values.append(np.maximum(np.take_along_axis(r, at[:, None, :], 1)[:, 0] + bias, 0))
            places.append(at)
        return np.concatenate(values, 1), places

    def probabilities(self, h: np.ndarray) -> np.ndarray:
        z = h @ self.dense[:-1] + self.dense[-1]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def fit_network(x: np.ndarray, y: np.ndarray, langs: list[str], epochs: int = 14, rate: float = 0.01, seed: int = 11) -> Network:
    """Softmax regression through the pooled filters, by Adam on batches of windows."""
    rng = np.random.default_rng(seed)
    net = Network(langs, [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS], [np.zeros(FILTERS, np.float32) for _ in WIDTHS], rng.normal(0, 0.1, (FILTERS * len(WIDTHS) + 1, len(langs))).astype(np.float32))
    params = [*net.tables, *net.biases, net.dense]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 64):
            rows = order[at : at + 64]
            xb, yb = x[rows], y[rows]
            h, places = net.pooled(xb)
            p = net.probabilities(h)
            p[np.arange(len(rows)), yb] -= 1
            p /= len(rows)
            back = (p @ net.dense[:-1].T) * (h > 0)
            grads = []
            for k, w in enumerate(WIDTHS):
                g = back[:, k * FILTERS : (k + 1) * FILTERS]
                table = np.zeros_like(net.tables[k])
                for j in range(w):
                    byte = np.take_along_axis(xb, places[k] + j, 1)
                    np.add.at(table[j], (byte.ravel(), np.tile(np.arange(FILTERS), len(rows))), g.ravel())
                grads.append(table)
            grads += [back[:, k * FILTERS : (k + 1) * FILTERS].sum(axis=0) for k in range(len(WIDTHS))]
            grads.append(np.concatenate([h.T @ p, p.sum(axis=0)[None]]))
            step += 1
            for i, (param, g) in enumerate(zip(params, grads)):
                m[i] += 0.1 * (g - m[i])
                v[i] += 0.01 * (g * g - v[i])
                param -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
    return net


class Predictor:
    """Window probabilities with tables of byte pairs."""

    def __init__(self, net: Network):
        self.net = net
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, -1).astype(np.float32)
        t2, t3, t4 = net.tables
        self.two, self.three, self.four = pair(t2[0], t2[1]), (pair(t3[0], t3[1]), t3[2]), (pair(t4[0], t4[1]), pair(t4[2], t4[3]))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.net.langs)))
        for at in range(0, len(x), 64):
            b = x[at : at + 64]
            pairs = b[:, :-1].astype(np.int32) * 256 + b[:, 1:]
            best = [self.two[pairs].max(axis=1)]
            r = self.three[0][pairs[:, :-1]]
            r += self.three[1][b[:, 2:]]
            best.append(r.max(axis=1))
            r = self.four[0][pairs[:, :-2]]
            r += self.four[1][pairs[:, 2:]]
            best.append(r.max(axis=1))
            h = np.concatenate([np.maximum(v + bias, 0) for v, bias in zip(best, self.net.biases)], 1)
            out[at : at + 64] = self.net.probabilities(h)
        return out


def fit_on_documents(docs: DataFrame, eligible: Column) -> Network | None:
    """Fit on windows of at most TRAIN_DOCS documents of every language, picked by a hash of their ids.

    A language's documents are thinned by its count to little more than what is wanted, in every task alike, so no task
    and no driver holds more of a frequent language. Windows are cut where the texts are.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            windows = []
            for text in batch.column(3).to_pylist():
                w = windows_of(text) if any(map(str.isalpha, text)) else np.empty((0, WINDOW), np.uint8)
                windows.append(w[np.unique(np.linspace(0, len(w) - 1, min(TRAIN_WINDOWS, len(w))).astype(int))].tobytes() if len(w) else b"")
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(windows, pa.binary())], names=["lang", "r", "doc_id", "windows"])

    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & eligible & F.col("text").isNotNull())
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    names = sorted(row["lang"] for row in counts.select("lang").collect())
    each = max(1, min(TRAIN_DOCS, TRAIN_ALL // max(1, len(names))))
    share = (each + 6 * each**0.5 + 8) / F.col("n")  # six deviations more than wanted
    thinned = known.join(F.broadcast(counts.select(F.col("lang").alias("l"), share.alias("share"))), F.col("lang") == F.col("l"))
    thinned = thinned.withColumn("r", F.xxhash64("doc_id", F.lit(6))).where((F.col("r").cast("double") + 2.0**63) / 2.0**64 < F.col("share"))
    rows: dict[str, list] = {}
    for row in thinned.select("lang", "r", "doc_id", "text").mapInArrow(cut, "lang string, r long, doc_id long, windows binary").collect():
        rows.setdefault(row["lang"], []).append((row["r"], row["doc_id"], bytes(row["windows"])))
    xs = [(names.index(lang), np.frombuffer(w, np.uint8).reshape(-1, WINDOW)) for lang in sorted(rows) for _, _, w in sorted(set(rows[lang]))[:each] if w]
    if not xs:
        return None
    return fit_network(np.concatenate([w for _, w in xs]), np.concatenate([np.full(len(w), lang) for lang, w in xs]), names)


def predict(spark: SparkSession, docs: DataFrame, net: Network | None) -> DataFrame:
    """(doc_id, text) -> (doc_id, lang_pred, score)."""
    shared = spark.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        score_windows = Predictor(model) if model else None
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                batch = whole.slice(at, 200)
                texts = batch.column(1).to_pylist()
                cut = [windows_of(t) if model and t and any(map(str.isalpha, t)) else np.empty((0, WINDOW), np.uint8) for t in texts]
                x = np.concatenate(cut)
                p = score_windows(x) if len(x) else np.empty((0, 1))
                weight = (x != 0).sum(axis=1)
                names, scores, end = [], [], 0
                for c in cut:
                    begin, end = end, end + len(c)
                    if not len(c):
                        names.append(UNKNOWN)
                        scores.append(0.0)
                        continue
                    mean = weight[begin:end] @ p[begin:end] / max(1, weight[begin:end].sum())
                    names.append(model.langs[int(mean.argmax())])
                    scores.append(float(min(1.0, mean.max())))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.mapInArrow(run, "doc_id long, lang_pred string, score double")


def languages(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs.

    Learns only from text and non-null lang of rows whose crc32(doc_id) mod 4 is not 2. Defined cases:
    a text that is null or has no letter, and every text if there is nothing to learn from: `und` with
    score 0; of languages that tie the first by name; a very long text is read whole, window by window; a null doc_id is
    never learnt from and not held out; repeated rows come out once each; an empty table gives an empty result; other
    columns are ignored.
    """
    fold = F.coalesce(id_crc32("doc_id") % 4, F.lit(0))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    net = fit_on_documents(rows, fold != 2)
    return predict(spark, rows.select("doc_id", "text"), net).select("doc_id", (fold == 2).alias("held_out"), "lang_pred", "score")
