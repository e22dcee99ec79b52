"""Near copies of texts, lines and vectors against brute force."""

import math
import random
import re
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lumenscape.llm import graph_dedup, line_dedup
from lumenscape.llm.circulant_minhash import near_duplicates, signature
from lumenscape.llm.common import connected_components
from tests.llm.helpers import Groups, corpus, odd_rows, table


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def expected_components(rows, percent):
    groups, sets = Groups(), [(r[0], shingles(r[1])) for r in rows if r[0] is not None]
    for (a, s), (b, t) in combinations(sets, 2):
        groups.root(a), groups.root(b)
        if s and t and 100 * len(s & t) >= percent * len(s | t):
            groups.link(a, b)
    return {a: groups.root(a) for a, _ in sets}


@pytest.mark.parametrize("rows", [corpus(), odd_rows(), corpus(60, 9) + odd_rows()[:1]])
def test_near_duplicates(spark, rows):
    got = near_duplicates(spark, table(spark, rows, clashing=True), percent=85).collect()
    want, sizes = expected_components(rows, 85), {r[0]: len(shingles(r[1])) for r in rows}
    assert len(got) == len(rows)
    for r in got:
        assert r.n_shingles == sizes[r.id]
        if r.id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == want[r.id] and r.kept == (r.id == want[r.id])


def test_large_group_of_near_copies(spark):
    """Star rounds and prefix filters must lose no link at the edges of a group."""
    rng = random.Random(2)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(90):
        words = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4, 8])):
            words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(words), "en", "s", 1))
    got = {r.id: r.component_id for r in near_duplicates(spark, table(spark, rows), percent=85).collect()}
    assert got == expected_components(rows, 85)


def test_empty_tables(spark):
    empty = table(spark, [])
    assert near_duplicates(spark, empty).count() == 0
    assert line_dedup.line_report(spark, empty).count() == 0
    assert line_dedup.without_repeated_lines(spark, empty).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert graph_dedup.near_vectors(spark, vectors).count() == 0


def test_signature_estimates_jaccard():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 400).astype(np.uint64)
    b = np.concatenate([a[:300], rng.integers(0, 2**63, 100).astype(np.uint64)])
    same = (signature(a, 512) == signature(b, 512)).mean()
    assert abs(same - 300 / 500) < 0.08


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 130)]
    groups = Groups()
    for a, b in edges:
        if a != b:
            groups.link(a, b)
    got = connected_components(spark, spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.id: r.component for r in got} == {x: groups.root(x) for x in groups}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=12), st.text("abc", max_size=12), st.integers(0, 3))
def test_banded_edit_distance(a, b, most):
    assert line_dedup.edit_distance_within(a, b, most) == (distance(a, b) <= most)


def expected_lines(rows, least=40, most=2):
    seen, first = [], {}
    for doc, text, *_ in sorted((r for r in set(rows) if r[0] is not None and r[1] is not None), key=lambda r: (r[0], r[1])):
        for n, raw in enumerate(text.split("\n")):
            line = raw.strip(" \t\r\x0b\x0c")
            if len(line) >= least:
                seen.append((doc, n, line))
                first.setdefault(line, (doc, n))
    groups, lines = Groups(), list(first)
    number = {x: i for i, x in enumerate(lines)}
    for a, b in combinations(lines, 2):
        if abs(len(a) - len(b)) <= most and distance(a[:600], b[:600]) <= most and line_dedup.edit_distance_within(a, b, most):
            groups.link(number[a], number[b])
    keep: dict = {}
    for line in lines:
        g = groups.root(number[line])
        keep[g] = min(keep.get(g, first[line]), first[line])
    dropped: dict = {}
    for doc, n, line in seen:
        if (doc, n) != keep[groups.root(number[line])]:
            dropped.setdefault(doc, set()).add(n)
    return dropped


def test_repeated_lines(spark):
    rng = random.Random(8)
    rows = corpus(50, 3)
    for i, (doc, text, *rest) in enumerate(corpus(25, 4)):  # lines within one or two edits of others
        line = list(rng.choice(rows)[1].split("\n")[0])
        for _ in range(rng.randint(1, 3)):
            line[rng.randrange(len(line))] = rng.choice("xyz")
        rows.append((1000 + i, "".join(line) + "\n" + text, *rest))
    got = {r.doc_id: {int(x) for x in r.dropped_lines.split(",") if x} for r in line_dedup.line_report(spark, table(spark, rows, clashing=True)).collect()}
    want = expected_lines(rows)
    assert {d: s for d, s in got.items() if s} == want
    kept = {r.doc_id: r.text for r in line_dedup.without_repeated_lines(spark, table(spark, rows)).collect()}
    for doc, text, *_ in rows:
        assert kept[doc] == "\n".join(x for n, x in enumerate(text.split("\n")) if n not in want.get(doc, ()))


def test_lines_of_odd_documents(spark):
    rows = odd_rows()
    out = line_dedup.without_repeated_lines(spark, table(spark, rows)).collect()
    assert len(out) == len(rows)
    texts = {r.doc_id: r.text for r in out}
    assert texts[1] is None and texts[2] == "" and texts[4] == texts[5] == "word" and texts[8] == "" and texts[7]
    assert texts[None].startswith("a text without an id")


@pytest.mark.parametrize("shard_rows", [1200, 24])
def test_near_vectors(spark, shard_rows):
    """One shard, and many overlapping ones with crowded ones in parts."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 16))
    x = np.concatenate([base, base[:20] + rng.normal(scale=0.08, size=(20, 16)), np.repeat(base[:1], 40, 0) + rng.normal(scale=0.05, size=(40, 16)), base[5:8] * 3.0])
    rows = [(int(i), [float(v) for v in row], 0) for i, row in enumerate(x)]
    odd = [(500, None, 0), (501, [0.0] * 16, 0), (502, [float("nan")] + [1.0] * 15, 0), (503, [None] + [1.0] * 15, 0), (504, [float("inf")] * 16, 0), (505, [], 0)]
    other = [(600, [1.0, 2.0], 0), (601, [1.0, 2.1], 0), (602, [-1.0, 2.0], 0), (603, [3.0, 6.0], 0)]  # vectors of another length
    twice = [(None, rows[0][1], 0), (0, rows[0][1], 1)]
    df = spark.createDataFrame(rows + odd + other + twice, "vec_id long, embedding array<double>, label int").withColumnRenamed("label", "id").withColumn("vec", F.lit("clash"))
    got = graph_dedup.near_vectors(spark, df, shard_rows=shard_rows).collect()
    assert len(got) == len(rows) + len(odd) + len(other) + len(twice)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    groups = Groups()
    for a, b in zip(*np.nonzero(near)):
        groups.link(int(a), int(b))
    recall = [r.n_links / near[r.vec_id].sum() for r in got if r.vec_id is not None and r.vec_id < 500 and near[r.vec_id].any()]
    assert np.mean(recall) >= 0.98 and max(recall) <= 1 and (shard_rows < 1200 or min(recall) == 1)
    for r in got:
        if r.vec_id is None:
            assert r.component_id is None and r.kept and r.n_links == 0
        elif r.vec_id >= 600:
            assert (r.n_links, r.component_id) == ((0, 602) if r.vec_id == 602 else (2, 600))
        elif r.vec_id >= 500:
            assert (r.n_links, r.component_id, r.kept) == (0, r.vec_id, True)
        else:
            assert r.component_id == groups.root(r.vec_id)


def test_vectors_of_one_id_are_of_one_component(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 1.0]), (4, [-1.0, 0.0])]
    got = {(r.vec_id, r.n_links, r.component_id) for r in graph_dedup.near_vectors(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {(1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 0, 4)}


def test_spanning_edges_connect_what_links_connect():
    rng = np.random.default_rng(8)
    a, b = rng.integers(0, 90, 70), rng.integers(0, 90, 70)
    groups = Groups()
    for x, y in zip(a.tolist(), b.tolist()):
        groups.root(x), groups.root(y), groups.link(x, y)
    xs, roots = graph_dedup.spanning_edges(a, b)
    assert dict(zip(xs.tolist(), roots.tolist())) == {x: groups.root(x) for x in groups if groups.root(x) != x}


def test_greedy_search_finds_the_query():
    rng = np.random.default_rng(6)
    x = graph_dedup.unit_rows(rng.normal(size=(400, 12)))
    adj = graph_dedup.shard_graph(x)
    assert (adj < 400).all() and adj.shape[1] == graph_dedup.DEGREE
    beams = graph_dedup.greedy_search(x, adj, x, 0)
    assert (beams[:, 0] == np.arange(400)).mean() > 0.9 and math.isclose(np.linalg.norm(x[0]), 1)
