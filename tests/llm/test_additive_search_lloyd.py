"""Additive quality, dual-tree search and sharded Lloyd against plain forms."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenscape.llm import additive_quality as Q, dual_tree_search as D, sharded_lloyd as L
from lumenscape.llm.queries import queries
from tests.llm.helpers import CLASHES, corpus, odd_rows, sentence, table

# ---- sharded Lloyd


def plain_lloyd(rows, k=8, rounds=10, dim=64):
    """vec_id -> (cluster, distance, inertia of it, inertia, hash), one entry a row."""
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centres = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in kept]
        for j in set(of):
            mine = [v for (_, v), c in zip(kept, of) if c == j]
            centres[j] = [sum(x) // len(mine) for x in zip(*mine)]
    last = [(i, *nearest(v)) for i, v in kept]
    by = defaultdict(int)
    for _, d, j in last:
        by[j] += d
    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, j, d, by[j], sum(by.values()), name[j]) for i, d, j in last), key=repr)


def vectors(spark, rows, kind="float"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    for name in ("row", "part", "cluster", "distance", "components", "d0", "h"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def random_vectors(n, dim, seed=3):
    rng = np.random.default_rng(seed)
    return [(i * 7, [float(x) for x in rng.normal(i % 5, 0.3, dim).astype(np.float32)]) for i in range(n)]


@pytest.mark.parametrize(("width", "dim"), [(32, 64), (5, 12), (64, 64)])
def test_lloyd_equals_plain(spark, width, dim):
    rows = random_vectors(60, dim)
    rows += [(1, None), (2, rows[0][1][:-1]), (3, [*rows[0][1][:-1], None]), (4, [*rows[0][1][:-1], math.nan]), (5, [*rows[0][1][:-1], -math.inf]), (None, rows[3][1]), (6, []), rows[0], rows[0], (7, rows[0][1])]
    got = L.lloyd(spark, vectors(spark, rows), dim=dim, width=width)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_lloyd(rows, dim=dim)


def test_lloyd_of_few_equal_and_no_vectors(spark):
    one = [0.25] * 64
    rows = [(i, one) for i in range(3)]
    got = L.lloyd(spark, vectors(spark, rows)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_lloyd(rows) and {r.cluster for r in got} == {0}
    assert L.lloyd(spark, vectors(spark, [])).count() == 0
    assert L.lloyd(spark, vectors(spark, [(1, None), (2, [1e300] * 64)], "double")).count() == 0


def test_lloyd_query_equals_plain(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = queries()["op13_sharded_lloyd"](spark, sf).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_lloyd(rows)


# ---- dual-tree search

_TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def plain_terms(text):
    lower = {c: c + 32 for c in range(65, 91)}
    return _TERM.findall((text or "").translate(lower))


def plain_search(docs, items, k=50):
    counted = [(i, Counter(plain_terms(t))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    n_docs, n_terms = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    wanted = defaultdict(set)
    for i, t in items:
        wanted[i] |= set(plain_terms(t))
    out = []
    for item, terms in wanted.items():
        found = []
        for i, c, n in counted:
            m = 50 + (50 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def searched(spark, docs, items, k=50):
    d = table(spark, [(*r, "en", "s", 0) for r in docs], clashing=True)
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("clash")).withColumn("terms", F.lit("clash"))
    return sorted((tuple(r) for r in D.search(spark, d, i, k).collect()), key=repr)


@pytest.mark.parametrize("k", [1, 3, 50])
def test_search_equals_plain(spark, monkeypatch, k):
    rng = random.Random(8)
    docs = [(r[0], r[1]) for r in corpus(300) + odd_rows()] + [(9_000 + i, "alpha alpha beta") for i in range(60)] + [(None, "alpha beta"), (None, "alpha beta")]
    items = [(i, sentence(rng, rng.randint(1, 12))) for i in range(30)] + [(40, None), (41, ""), (42, "- ! ,"), (43, "nosuchterm"), (44, "alpha"), (44, "beta"), (None, "gamma"), (45, "Größe ÜNÏ 12345"), (46, " ".join(t for t in docs[3][1].split()))]
    want = plain_search(docs, items, k)
    assert searched(spark, docs, items, k) == want
    monkeypatch.setattr(D, "BLOCK_TERMS", 40)  # several blocks of items
    assert searched(spark, docs, items, k) == want


def test_search_of_nothing(spark):
    assert searched(spark, [], [(1, "a")]) == [] and searched(spark, [(1, "a")], []) == [] and searched(spark, [(1, None), (2, "...")], [(1, "a")]) == []


def test_trees_leave_out_what_cannot_be_among_the_best():
    """Topics of their own words: an item is compared with few documents, and finds what a full comparison finds."""
    rng = np.random.default_rng(1)
    topics, words, n = 40, 25, 8000
    docs = np.sort(rng.integers(0, topics, n))[:, None] * words + np.argsort(rng.random((n, words)), axis=1)[:, :6]
    docs = np.sort(docs[rng.permutation(n)], axis=1)
    impact = rng.integers(1, 1000, docs.shape)
    weights = rng.integers(1, 50, topics * words)
    items = [np.arange(t * words, t * words + 8) for t in range(topics)]
    block = D.Block.of(list(range(topics)), items, weights)
    search = D.Search(block, 10, np.zeros(topics, np.int64))
    for at in range(0, n, 2000):
        part = slice(at, at + 2000)
        search.add(D.Nodes(np.arange(0, 12_001, 6), docs[part].ravel(), impact[part].ravel()), np.arange(n)[part], np.zeros(2000, bool))
    assert search.scored < n * topics / 10
    for item, found in zip(block.ids, search.found):
        scores = (impact * weights[docs] * np.isin(docs, items[item])).sum(axis=1)
        best = sorted((-s, i) for i, s in enumerate(scores) if s > 0)[:10]
        assert [(-s, i) for s, i in zip(found[0][0], found[0][1])][:10] == best


# ---- additive quality


def test_quality_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    found = queries()["op11_additive_quality"](spark, sf)
    truth = spark.read.parquet(f"{sf}/labels.parquet")
    rows = found.join(truth, "doc_id").where("held_out").select("score", "predicted", "quality").collect()
    right = [r.predicted == r.quality for r in rows]
    assert len(rows) > 1000 and sum(right) / len(rows) >= 0.99
    good = [r.predicted for r in rows if r.quality == 1]
    assert sum(good) / len(good) >= 0.995  # clean documents are left alone


def test_quality_of_odd_documents(spark):
    labels = spark.createDataFrame([(i * 3, int(i % 4 != 0), 0) for i in range(100)] + [(7, 1, 0), (8, 0, 0), (8, 1, 0), (9, 5, 0), (None, 1, 0), (10, None, 0)], "doc_id long, quality int, toxic int")
    rows = corpus() + odd_rows()
    found = Q.quality(spark, table(spark, rows, clashing=True), labels).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    by = {r.doc_id: r.score for r in found}
    assert by[1] == by[2] == by[3] and by[7] == by[8] and by[4] == by[5]
    assert Q.quality(spark, table(spark, []), labels).count() == 0
    for y in (0, 1):
        only = Q.quality(spark, table(spark, rows), labels.where(f"quality = {y}")).collect()
        assert {r.predicted for r in only} == {y}
    assert {r.predicted for r in Q.quality(spark, table(spark, rows), labels.limit(0)).collect()} == {0}


def test_labels_of_held_out_documents_are_not_read(spark):
    rows = corpus()
    labels = [(r[0], int(i % 3 != 0), 0) for i, r in enumerate(rows)]
    fold = {r.doc_id: r.held_out for r in Q.quality(spark, table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    score = lambda ls: {r.doc_id: r.score for r in Q.quality(spark, table(spark, rows), spark.createDataFrame(ls, "doc_id long, quality int, toxic int")).collect()}
    assert any(fold.values()) and score(labels) == score([(i, 1 - y if fold[i] else y, t) for i, y, t in labels])


def test_pairs_learn_what_single_tables_cannot():
    """Labels by the exclusive or of two numbers; the score is the sum of looked-up values."""
    rng = np.random.default_rng(0)
    x = rng.random((3000, len(Q.FEATURES)))
    y = ((x[:, 2] > 0.5) ^ (x[:, 5] > 0.5)).astype(np.int64)
    model = Q.fit(x[:2000], y[:2000], np.ones(2000))
    assert (2, 5) in model.pairs
    assert ((model.score(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.95
    row, at = x[2500], [int(b[0]) for b in model.bins(x[2500:2501])]
    total = model.intercept + sum(t[b] for t, b in zip(model.tables, at)) + sum(t[model.coarse[f][at[f]], model.coarse[g][at[g]]] for (f, g), t in zip(model.pairs, model.pair_tables))
    assert np.isclose(model.evidence(row[None])[0], total)


def test_trees_split_where_the_gain_is():
    g, h = np.array([1.0] * 10 + [-1.0] * 20), np.full(30, 2.0)
    values = Q.tree_1d(g, h)
    assert np.allclose(values[:10], 10 / 21, atol=0.1) and (values[10:] < 0).all()
    grid = np.where((np.arange(6)[:, None] < 3) ^ (np.arange(6)[None, :] < 2), 1.0, -1.0)
    gain, out = Q.tree_2d(grid, np.full((6, 6), 2.0))
    assert gain > 0 and (np.sign(out) == np.sign(grid)).all()


def test_numbers_of_a_text():
    assert Q.features(None) == Q.features(" \n") == [0.0] * len(Q.FEATURES)
    f = dict(zip(Q.FEATURES, Q.features("AB cd cd! 12 |")))
    assert np.isclose(f["upper_share"], 2 / 6) and np.isclose(f["distinct_share"], 1.0) and np.isclose(f["bare_share"], 0.2) and np.isclose(f["sentence_ends"], 0.2) and np.isclose(f["odd_ends"], 0.2)
    assert dict(zip(Q.FEATURES, Q.features("a a a b")))["repeat_share"] == 0.5
    assert len(CLASHES) > 30
