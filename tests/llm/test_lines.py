"""Lines of one template, short lines, and clashing columns, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from lumenscape.llm import line_dedup
from tests.llm.helpers import sentence, table
from tests.llm.test_dedup import expected_lines


def template_rows(n, seed):
    """One long line with random words put in, taken out or respelt: most copies are further apart than the threshold."""
    rng = random.Random(seed)
    words = sentence(rng, 30).split()
    rows = []
    for i in range(n):
        mine = list(words)
        for _ in range(rng.choice([0, 1, 1, 1, 2, 3])):
            at = rng.randrange(len(mine))
            mine[at] = rng.choice(["", "a", mine[at][1:], mine[at] + "s", "".join(rng.choices("abcdef", k=rng.randint(1, 7)))])
        rows.append((i, " ".join(mine), "en", "s", 1))
    return rows


def dropped(spark, rows, **options):
    got = line_dedup.line_report(spark, table(spark, rows), **options).collect()
    return {r.doc_id: {int(x) for x in r.dropped_lines.split(",")} for r in got if r.dropped_lines}


@pytest.mark.parametrize("few", [32, 0])
def test_template_of_one_key(spark, monkeypatch, few):
    monkeypatch.setattr(line_dedup, "FEW", few)
    rows = template_rows(160, 7)
    assert dropped(spark, rows) == expected_lines(rows)


@pytest.mark.parametrize("few", [32, 0])
@pytest.mark.parametrize("most", [1, 3])
def test_short_lines_and_other_thresholds(spark, monkeypatch, few, most):
    monkeypatch.setattr(line_dedup, "FEW", few)
    rng = random.Random(11)
    rows = [(i, "\n".join("".join(rng.choices("abé", k=rng.randint(1, 12))) for _ in range(3)), "en", "s", 1) for i in range(25)]
    rows += [(100 + i, "ab" * 30 + "c" * (i % 3) + "ba" * i, "en", "s", 1) for i in range(12)]
    assert dropped(spark, rows, min_chars=1, threshold=most) == expected_lines(rows, 1, most)


def test_short_repeats_are_the_callers_choice(spark):
    rows = [(1, "menu\n\nfirst", "en", "s", 1), (2, "menu\n\nsecond", "en", "s", 1)]
    assert dropped(spark, rows) == {}
    assert dropped(spark, rows, short_repeats=True) == {2: {0}}


def test_clashing_columns(spark):
    long = "a line of more than forty letters that comes twice in this table"
    docs = table(spark, [(1, long + "\nx", "en", "s", 1), (2, long + "\ny", "en", "s", 1)])
    for name in ("dropped", "n_dropped", "h", "line", "raw", "Id", "a.b"):
        docs = docs.withColumn(name, F.lit("mine"))
    out = line_dedup.without_repeated_lines(spark, docs, count_col="gone").orderBy("doc_id").collect()
    assert out[0].asDict().keys() == {*docs.columns, "gone"} and [r.gone for r in out] == [0, 1]
    assert [r.text for r in out] == [long + "\nx", "y"] and all(r.dropped == r.n_dropped == r["a.b"] == "mine" for r in out)
