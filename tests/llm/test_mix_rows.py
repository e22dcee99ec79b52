"""The mix stage gives every row that was charged to a quota, whatever its id."""

import random
from collections import Counter

import corpus_pipeline
from lumenscape.llm.mixing import document_items, mix
from tests.llm.helpers import sentence, table


def test_every_read_row_comes_out(spark):
    rng = random.Random(4)
    rows = [(rng.choice([None, 1, 2, 100 + i]), sentence(rng, rng.randint(2, 30)), "en", f"src{i % 3}", 1) for i in range(60)]
    rows += [(None, "equal rows with no id", "en", "src0", 1)] * 3
    docs = table(spark, rows)
    read = Counter((r.id, r.take_tokens) for r in mix(spark, document_items(docs), corpus_pipeline.MIX).collect())
    got = corpus_pipeline.mix_stage(spark, docs, "").collect()
    assert None in {i for i, _ in read} and max(Counter(r[0] for r in rows).values()) > 1
    assert Counter((r.doc_id, len(r.text.split())) for r in got) == read
    assert all(any(r[0] == g.doc_id and r[1].startswith(g.text) for r in rows) for g in got)
