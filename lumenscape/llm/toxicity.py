"""Toxic spans by a linear-chain conditional random field.

Two states per token (clean, toxic). A token's evidence is a sum of weights of its word, prefixes
and suffixes; transition weights tie neighbours. Token labels come from document labels: every token of a clean
document is clean, and at least one of a toxic document is toxic. Which one, the field finds out: a first
fit takes words and prefixes that are far more frequent in toxic documents, later ones the marginals of the
field itself, given that some token is toxic. Forward-backward marginals give each token's chance of being
toxic; they are folded into a document score (calibrated on documents that the field was not fitted on)
and the offsets of toxic runs.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from lumenscape.llm.common import id_crc32, utf8

#: Bounds of the fit: labelled documents of each class, and their length.
TRAIN_DOCS, TRAIN_CHARS = 4000, 12_000
#: Tokens of one training window.
WINDOW = 64
#: What makes a word or prefix a first label: in how many toxic documents it is (near copies count once), and log-odds.
LEAST_DOCS, LEAST_ODDS = 4, 3.0
#: Most fits after the first one, with labels from the field's own marginals. More of them spread the label over the words around.
ROUNDS = 2
#: Ways to fit (ridge; steps and rate of a later fit). Way and number of fits are chosen by the loss on the fold of the calibration.
WAYS = ((1e-6, 15, 0.2), (1e-5, 25, 0.05))
_TABLE = 1 << 18
#: Steps of one recursion in prediction; messages between these are exact.
CHUNK = 256

_TOKEN = re.compile(r"\w+")


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall(text) if text else []


def token_features(word: str) -> list[int]:
    w = word.lower()
    named = ["w" + w, "p3" + w[:3], "p4" + w[:4], "p5" + w[:5], "p6" + w[:6], "s3" + w[-3:], "s4" + w[-4:]]
    return [zlib.crc32(f.encode("utf-8", "surrogatepass")) % _TABLE for f in named]


@dataclass
class Field:
    """weights of features; trans[i, j] from state i to j, trans[0, 0] = 0; start for the toxic state."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(_TABLE))
    trans: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    start: float = 0.0
    bias: float = 0.0
    calibration: np.ndarray = field(default_factory=lambda: np.zeros(4))

    def factors(self) -> tuple[float, float, float, float]:
        """exp of the weights 0->1, 1->1, 1->0 and of the start."""
        return (*np.exp([self.trans[0, 1], self.trans[1, 1], self.trans[1, 0], self.start]),)


class Emissions(dict):
    """token -> evidence for the toxic state, remembered; emptied when large, which changes no value."""

    LIMIT = 300_000

    def __init__(self, model: Field):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = float(self.model.weights[token_features(word)].sum() + self.model.bias)
        return value


def forward_backward(e: np.ndarray, first: np.ndarray, last: np.ndarray, model: Field, before: np.ndarray | float = 1.0, after: np.ndarray | float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Forward odds and backward ratios of toxic to clean, (rows, steps) each.

    first, last: where chains begin and end. before: forward odds ahead of a row; after: evidence times ratio behind it.
    """
    a, b, c, s = model.factors()
    g = np.exp(np.clip(e, -30, 30))
    o, r = np.empty_like(g), np.empty_like(g)
    for i in range(g.shape[1]):
        x = o[:, i - 1] if i else before
        o[:, i] = g[:, i] * np.where(first[:, i], s, (a + b * x) / (1 + c * x))
    for i in range(g.shape[1] - 1, -1, -1):
        u = g[:, i + 1] * r[:, i + 1] if i + 1 < g.shape[1] else after
        r[:, i] = np.where(last[:, i], 1.0, (c + b * u) / (1 + a * u))
    return o, r


def marginals(e: np.ndarray, first: np.ndarray, last: np.ndarray, model: Field) -> np.ndarray:
    """Chance of the toxic state for every token; e, first, last: (rows, steps)."""
    o, r = forward_backward(e, first, last, model)
    return o * r / (1 + o * r)


def _through(g: np.ndarray, step: tuple, stop: np.ndarray, at_stop: np.ndarray) -> np.ndarray:
    """What a row of steps makes of a ratio x that enters it: (p + q x) / (r + s x), as (p, q, r, s).

    step: the 2 x 2 matrix of one step ahead of its evidence g; where stop is set the ratio is at_stop whatever came in.
    """
    n = len(g)
    p, q, r, s = np.zeros(n), np.ones(n), np.ones(n), np.zeros(n)
    (k00, k01), (k10, k11) = step
    for i in range(g.shape[1]):
        p, q, r, s = g[:, i] * (k00 * r + k01 * p), g[:, i] * (k00 * s + k01 * q), k10 * r + k11 * p, k10 * s + k11 * q
        end = stop[:, i]
        if end.any():
            p, q, r, s = np.where(end, at_stop[:, i], p), np.where(end, 0.0, q), np.where(end, 1.0, r), np.where(end, 0.0, s)
        if i % 4 == 3:
            scale = np.maximum(np.maximum(p, q), np.maximum(r, s))
            p, q, r, s = p / scale, q / scale, r / scale, s / scale
    return np.stack([p, q, r, s])


def stream_marginals(e: np.ndarray, lengths: np.ndarray, model: Field) -> np.ndarray:
    """marginals() of concatenated documents, each cut into chunks from its own start; messages pass between chunks whole."""
    if not len(e):
        return e
    begins = np.cumsum(lengths) - lengths
    chunks = -(-lengths // CHUNK)  # of each document
    total = int(chunks.sum())
    owner = np.repeat(np.arange(len(lengths)), chunks)
    number = np.arange(total) - np.repeat(np.cumsum(chunks) - chunks, chunks)  # of each chunk in its document
    place = number[:, None] * CHUNK + np.arange(CHUNK)[None, :]
    inside = place < lengths[owner][:, None]
    values = e[np.minimum(begins[owner][:, None] + place, len(e) - 1)]
    first, last = place == 0, place >= lengths[owner][:, None] - 1
    before, after = np.ones(total), np.ones(total)
    tail = np.flatnonzero(number > 0)
    if len(tail):
        a, b, c, s = model.factors()
        g = np.exp(np.clip(values, -30, 30))
        heads = tail - 1  # each has a chunk of its document behind it
        p, q, r, t = _through(g[heads], ((a, b), (1.0, c)), first[heads], g[heads] * s)
        # backward the ratio is taken times its evidence, so that a step is the same matrix on either side
        ends = ~inside[tail] | last[tail]
        back = _through(g[tail][:, ::-1], ((c, b), (1.0, a)), ends[:, ::-1], g[tail][:, ::-1])
        for k in range(1, int(number.max()) + 1):
            here = np.flatnonzero(number[tail] == k)
            x = before[heads[here]]
            before[tail[here]] = (p[here] + q[here] * x) / (r[here] + t[here] * x)
        for k in range(int(number.max()), 0, -1):
            here = np.flatnonzero(number[tail] == k)
            x = after[tail[here]]
            after[heads[here]] = (back[0][here] + back[1][here] * x) / (back[2][here] + back[3][here] * x)
    o, r = forward_backward(values, first, last, model, before, after)
    return (o * r / (1 + o * r))[inside]


def summaries(p: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Per document: 1, its largest marginal, log of one plus their sum, that sum's share of the tokens."""
    ends = np.cumsum(lengths)
    out = np.zeros((len(lengths), 4))
    out[:, 0] = 1.0
    some = lengths > 0
    if some.any():
        starts = (ends - lengths)[some]
        total = np.add.reduceat(p, starts)
        out[some, 1] = np.maximum.reduceat(p, starts)
        out[some, 2] = np.log1p(total)
        out[some, 3] = total / lengths[some]
    return out


@dataclass
class Sample:
    """Documents of the fit: word numbers one after the other, their lengths, labels and near-copy groups, and the words."""

    words: np.ndarray
    lengths: np.ndarray
    toxic: np.ndarray
    groups: np.ndarray
    vocabulary: list[str]

    def part(self, chosen: np.ndarray) -> Sample:
        return Sample(self.words[np.repeat(chosen, self.lengths)], self.lengths[chosen], self.toxic[chosen], self.groups[chosen], self.vocabulary)


def telling_words(sample: Sample) -> np.ndarray:
    """For every word whether it, or its first five or six letters, is far more frequent in toxic documents."""
    owner = np.repeat(np.arange(len(sample.lengths)), sample.lengths)
    toxic = sample.toxic[owner] == 1
    n_toxic, n_clean = max(1, (sample.toxic == 1).sum()), max(1, (sample.toxic == 0).sum())
    out = np.zeros(len(sample.vocabulary), bool)
    for letters in (None, 5, 6):
        number: dict[str, int] = {}
        key = np.array([number.setdefault(w[:letters], len(number)) if letters is None or len(w) >= letters else -1 for w in sample.vocabulary], dtype=np.int64)
        of, ids = key[sample.words], np.arange(len(sample.lengths))

        def held(where: np.ndarray, by: np.ndarray) -> np.ndarray:
            some, width = where & (of >= 0), len(ids)
            return np.bincount(np.unique(of[some] * width + by[owner[some]]) // width, minlength=len(number))

        odds = np.log((held(toxic, ids) + 0.1) / n_toxic) - np.log((held(~toxic, ids) + 0.1) / n_clean)
        telling = (held(toxic, sample.groups) >= LEAST_DOCS) & (odds >= LEAST_ODDS)
        out |= (key >= 0) & telling[np.maximum(key, 0)]
    return out


def _windows(sample: Sample) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers (windows, WINDOW), how many each has, and the document of each."""
    counts = -(-sample.lengths // WINDOW)
    owner = np.repeat(np.arange(len(counts)), counts)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    place = number[:, None] * WINDOW + np.arange(WINDOW)[None, :]
    n = np.minimum(WINDOW, sample.lengths[owner] - number * WINDOW)
    begins = np.cumsum(sample.lengths) - sample.lengths
    at = np.minimum(begins[owner][:, None] + place, max(0, len(sample.words) - 1))
    return (sample.words[at] if len(sample.words) else np.zeros(place.shape, np.int32)), n, owner


class Trainer:
    """Maximum likelihood of soft token labels by full-batch Adam; the gradient is labels less marginals."""

    BLOCK = 8192

    def __init__(self, sample: Sample, ridge: float):
        self.ridge = ridge
        self.x, self.n, self.owner = _windows(sample)
        self.toxic = sample.toxic[self.owner] == 1
        self.valid = np.arange(WINDOW)[None, :] < self.n[:, None]
        self.first = np.zeros(self.valid.shape, bool)
        self.first[:, 0] = True
        self.last = np.arange(WINDOW)[None, :] >= (self.n - 1)[:, None]
        self.features = np.array([token_features(w) for w in sample.vocabulary], dtype=np.int32).reshape(-1, 7)
        self.docs = len(sample.lengths)
        self.model = Field(bias=-3.0)

    def blocks(self) -> Iterator[slice]:
        return (slice(at, at + self.BLOCK) for at in range(0, len(self.x), self.BLOCK))  # temporary arrays stay small

    def evidence(self) -> np.ndarray:
        return self.model.weights[self.features].sum(axis=1) + self.model.bias

    def fit(self, y: np.ndarray, pairs: np.ndarray, used: np.ndarray, steps: int, rate: float) -> None:
        """y: chance of toxic by token; pairs: expected counts of 0->1, 1->1, 1->0; used: windows that count."""
        model = self.model
        valid = self.valid & used[:, None]
        scale = 1.0 / max(1, valid.sum())
        small = np.array([model.bias, model.start, model.trans[0, 1], model.trans[1, 1], model.trans[1, 0]])
        m, v = [np.zeros(_TABLE), np.zeros(5)], [np.zeros(_TABLE), np.zeros(5)]
        for step in range(1, steps + 1):
            evidence = self.evidence()
            per_token, sums, inside = np.zeros(len(self.features)), np.zeros(2), np.zeros(3)
            for b in self.blocks():
                p = marginals(evidence[self.x[b]], self.first[b], self.last[b], model) * valid[b]
                inside += pair_expectations(p, model, valid[b][:, 1:])[1]
                gap = (y[b] - p) * valid[b] * scale
                per_token += np.bincount(self.x[b].ravel(), gap.ravel(), len(self.features))
                sums += gap.sum(), gap[:, 0].sum()
            g = [np.bincount(self.features.ravel(), np.repeat(per_token, 7), _TABLE) - self.ridge * model.weights, np.array([*sums, *((pairs - inside) * scale)])]
            for k, param in enumerate((model.weights, small)):
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                param += rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
            small[2:] = np.clip(small[2:], -3.0, 3.0)
            model.bias, model.start = small[0], small[1]
            model.trans = np.array([[0.0, small[2]], [small[4], small[3]]])

    def given_some_toxic(self) -> tuple[np.ndarray, np.ndarray]:
        """Marginals and pair counts of toxic documents, given that one token at least is toxic; none in clean ones.

        All-clean is one labelling of a document, of weight 1 of all Z; what is left is divided by 1 - 1/Z.
        """
        model, evidence = self.model, self.evidence()
        _, _, c, _ = model.factors()
        y, log_z, windows = np.zeros(self.x.shape), np.zeros(self.docs), np.zeros((len(self.x), 3))
        for b in self.blocks():
            o, r = forward_backward(evidence[self.x[b]], self.first[b], self.last[b], model)
            valid = self.valid[b]
            y[b] = o * r / (1 + o * r) * valid
            z = (np.log1p(c * o) * (valid & ~self.last[b])).sum(axis=1) + (np.log1p(o) * (valid & self.last[b])).sum(axis=1)
            log_z += np.bincount(self.owner[b], z, self.docs)
            windows[b] = pair_expectations(y[b], model, valid[:, 1:])[0]
        share = np.where(self.toxic, 1 / np.maximum(-np.expm1(-log_z), 1e-9)[self.owner], 0.0)
        return np.minimum(1.0, y * share[:, None]), (windows * share[:, None]).sum(axis=0)


def pair_expectations(p: np.ndarray, model: Field, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expected counts of the transitions 0->1, 1->1 and 1->0, by row and altogether.

    A pair's log odds ratio is that of its transition weights, which with both marginals fixes the pair.
    """
    t = model.trans
    odds = np.exp(np.clip(t[1, 1] - t[1, 0] - t[0, 1], -30, 30))
    a, b = p[:, :-1], p[:, 1:]
    if abs(odds - 1) < 1e-9:
        both = a * b
    else:
        s = 1 + (odds - 1) * (a + b)
        both = (s - np.sqrt(np.maximum(s * s - 4 * odds * (odds - 1) * a * b, 0))) / (2 * (odds - 1))
    rows = np.stack([((b - both) * valid).sum(axis=1), (both * valid).sum(axis=1), ((a - both) * valid).sum(axis=1)], axis=1)
    return rows, rows.sum(axis=0)


def fit(sample: Sample) -> Field:
    """Two thirds of the documents fit the field, the rest its calibration, and how it is fitted."""
    kinds = set(sample.toxic.tolist())
    if len(kinds) < 2:
        model = Field(bias=-3.0)
        model.calibration = np.array([8.0 if kinds == {1} else -8.0, 0, 0, 0])
        return model
    fold = np.arange(len(sample.lengths)) % 3
    inner, rest, telling = sample.part(fold < 2), sample.part(fold == 2), telling_words(sample)
    best: tuple[float, Field] | None = None
    for ridge, steps, rate in WAYS:
        trainer = Trainer(inner, ridge)
        y = (telling[trainer.x] & trainer.valid & trainer.toxic[:, None]).astype(np.float64)
        pairs = np.array([((1 - y[:, :-1]) * y[:, 1:]).sum(), (y[:, :-1] * y[:, 1:]).sum(), (y[:, :-1] * (1 - y[:, 1:]) * trainer.valid[:, 1:]).sum()])
        # at first a toxic document without a telling word says nothing about its tokens
        told = np.bincount(trainer.owner, y.sum(axis=1), trainer.docs) > 0
        trainer.fit(y, pairs, ~trainer.toxic | told[trainer.owner], 40, 0.2)
        for after in range(ROUNDS + 1):
            if after:
                trainer.fit(*trainer.given_some_toxic(), np.ones(len(trainer.x), bool), steps, rate)
            model = trainer.model
            e = (model.weights[trainer.features].sum(axis=1) + model.bias)[rest.words]
            loss, calibration = calibrated(summaries(stream_marginals(e, rest.lengths, model), rest.lengths), rest.toxic)
            if best is None or loss < best[0]:
                best = loss, Field(model.weights.copy(), model.trans.copy(), model.start, model.bias, calibration)
    return best[1]


def calibrated(x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean loss and weights of a ridge logistic regression, by Newton steps."""
    c = np.zeros(x.shape[1])
    for _ in range(200):
        q = 1 / (1 + np.exp(-x @ c))
        grad = x.T @ (y - q) - 0.05 * c
        hess = (x * (q * (1 - q))[:, None]).T @ x + 0.05 * np.eye(x.shape[1])
        move = np.linalg.solve(hess, grad)
        c += move
        if np.abs(move).max() < 1e-8:
            break
    z = x @ c
    return float((np.logaddexp(0, z) - y * z).mean()) if len(y) else 0.0, c


def fit_on_documents(docs: DataFrame, labels: DataFrame, eligible: Column) -> Field:
    """Fit on at most TRAIN_DOCS labelled documents of each class, of at most TRAIN_CHARS characters.

    They are picked by a hash of their ids, thinned by the count of the class in every task alike. Equal texts count
    once. Words are cut and numbered where the texts are; the driver gets numbers and each word once.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [[w.lower() for w in tokens(t)] for t in batch.column(3).to_pylist()]
            hashes = [np.array([xxhash.xxh3_64_intdigest(utf8(w)) for w in d], np.uint64) for d in words]
            # near copies mostly have the same smallest run of three words
            least = [int((h[:-2] * np.uint64(3) ^ h[1:-1] * np.uint64(5) ^ h[2:] * np.uint64(7)).min()) - (1 << 63) if len(h) > 2 else int(h.sum()) - (1 << 63) for h in hashes]
            columns = [pa.array([xxhash.xxh64_intdigest(utf8(t)) - (1 << 63) for t in batch.column(3).to_pylist()], pa.int64()), pa.array(least, pa.int64())]
            lists = pa.array([h.view(np.int64) for h in hashes], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns, lists, pa.array(words, pa.list_(pa.string()))], names=["r", "doc_id", "toxic", "text_hash", "group", "numbers", "words"])

    known = labels.where(F.col("toxic").isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null").where(eligible)
    n = {row["toxic"]: row["n"] for row in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = {y: (TRAIN_DOCS + 6 * TRAIN_DOCS**0.5 + 8) / c for y, c in n.items()}  # six deviations more than wanted
    place = (F.col("r").cast("double") + 2.0**63) / 2.0**64
    chosen = known.withColumn("r", F.xxhash64("doc_id", F.lit(5))).where((F.col("toxic") == 0) & (place < share.get(0, 0.0)) | (F.col("toxic") == 1) & (place < share.get(1, 0.0)))
    texts = docs.where(F.char_length("text") <= TRAIN_CHARS).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    picked = texts.join(F.broadcast(chosen), "doc_id").select("r", "doc_id", "toxic", "text")
    cut_docs = picked.mapInArrow(cut, "r long, doc_id long, toxic int, text_hash long, group long, numbers array<long>, words array<string>")
    got = cut_docs.select("r", "doc_id", "toxic", "text_hash", "group", "numbers").toArrow().combine_chunks()
    words = cut_docs.select(F.explode(F.arrays_zip("numbers", "words")).alias("z")).select("z.numbers", "z.words").distinct().toArrow()
    number = dict(zip(words.column(0).to_pylist(), words.column(1).to_pylist()))
    return fit(_sample(got, number))


def _sample(got: pa.Table, number: dict[int, str]) -> Sample:
    """At most TRAIN_DOCS documents of each class, in the order of their hashes, whatever order they arrive in."""
    r, ids, toxic, texts, groups = (got.column(i).to_numpy() for i in range(5))
    order, taken, seen = [], {0: 0, 1: 0}, set()
    for i in np.lexsort((texts, toxic, ids, r)):
        if (texts[i], toxic[i]) not in seen and taken[int(toxic[i])] < TRAIN_DOCS:
            seen.add((texts[i], toxic[i]))
            taken[int(toxic[i])] += 1
            order.append(i)
    lists = got.column(5).combine_chunks()
    flat, offsets = (lists.flatten().to_numpy(), lists.offsets.to_numpy()) if got.num_rows else (np.empty(0, np.int64), np.zeros(1, np.int32))
    begins, lengths = offsets[:-1][order] - offsets[0], np.diff(offsets)[order]
    keys = np.array(sorted(number), dtype=np.int64)
    rows = [np.searchsorted(keys, flat[b : b + n]).astype(np.int32) for b, n in zip(begins, lengths)]
    return Sample(np.concatenate(rows) if rows else np.empty(0, np.int32), lengths.astype(np.int64), toxic[order].astype(np.int64), np.unique(groups[order], return_inverse=True)[1], [number[int(k)] for k in keys])


def score_documents(spark: SparkSession, docs: DataFrame, model: Field, score_col: str = "score", spans_col: str = "spans") -> DataFrame:
    """docs with a score (0 to 1) and spans (code points of toxic runs, end exclusive) added."""
    shared = spark.sparkContext.broadcast(model)
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("chance", pa.float64())]))
    text_at = docs.columns.index("text")
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("chance", T.DoubleType())])
    schema = T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType()), T.StructField(spans_col, T.ArrayType(span))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field_ = shared.value
        evidence = Emissions(field_)
        for whole in batches:
            for at in range(0, whole.num_rows, 400):
                batch = whole.slice(at, 400)
                texts = batch.column(text_at).to_pylist()
                words = [tokens(t) for t in texts]
                lengths = np.array([len(w) for w in words])
                e = np.array([v for w in words for v in map(evidence.__getitem__, w)], dtype=np.float64)
                p = stream_marginals(e, lengths, field_)
                score = 1 / (1 + np.exp(-np.clip(summaries(p, lengths) @ field_.calibration, -40, 40)))
                ends, spans = np.cumsum(lengths), []
                hot = np.flatnonzero(p >= 0.5)
                owner = np.searchsorted(ends, hot, side="right")
                for i, text in enumerate(texts):
                    mine = hot[owner == i] - (ends[i] - lengths[i]) if len(hot) else ()
                    spans.append(_spans(text, set(mine), p[ends[i] - lengths[i] : ends[i]]) if len(mine) else [])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array(spans, span_type)], names=[*batch.schema.names, score_col, spans_col])

    return docs.mapInArrow(run, schema)


def _spans(text: str, toxic: set[int], p: np.ndarray) -> list[dict]:
    out: list[dict] = []
    for i, match in enumerate(_TOKEN.finditer(text)):
        if i in toxic:
            if out and i - 1 in toxic:
                out[-1] |= {"end": match.end(), "chance": max(out[-1]["chance"], float(p[i]))}
            else:
                out.append({"start": match.start(), "end": match.end(), "chance": float(p[i])})
    return out


def toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, spans for every row of docs.

    Labels are learnt only from rows whose crc32(doc_id) mod 5 is not 0. Defined cases: a null or
    empty text gets the score of no evidence and no spans; a very long text is scored whole, and equal texts alike
    whatever is read beside them; a chance of exactly one half counts as toxic; a null doc_id is not held out; labels
    other than 0 and 1 are ignored; without labels of both classes every score is that of the class there is
    (of no labels: clean); repeated rows come out once each; an empty table gives an empty result;
    other columns are ignored.
    """
    fold = F.coalesce(id_crc32("doc_id") % 5, F.lit(1))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = fit_on_documents(rows, labels, fold != 0)
    scored = score_documents(spark, rows, model)
    return scored.select("doc_id", (fold == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")
