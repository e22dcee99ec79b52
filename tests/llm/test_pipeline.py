"""The stages one after the other, each against what it should do to its own input."""

import duckdb
from pyspark.sql import functions as F

import corpus_pipeline
from lumenscape.llm import queries as Q
from lumenscape.llm.common import materialise
from tests.llm.helpers import corpus, odd_rows, table
from tests.llm.test_dedup import expected_components, expected_lines


def test_stages(spark, tmp_path):
    rows = corpus(70, 12) + [(5000 + i, *r[1:]) for i, r in enumerate(odd_rows()) if i not in (10, 11)]
    toxic = [(9000 + i, f"vilewort rotgrub scornling number {i} is in this text for the toxicity stage", "en", "src1", 60) for i in range(60)]
    table(spark, rows + toxic, clashing=True).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(r[0], 1, 0) for r in rows] + [(r[0], 1, 1) for r in toxic[:50]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    outs = {}
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.collect()]
        docs = materialise(spark, stage(spark, docs, str(tmp_path)), name)
        outs[name] = (before, docs)
    before, after = outs["toxicity"]
    kept = {r.doc_id for r in after.collect()}
    assert after.columns == columns and not kept & {r[0] for r in toxic} and len(kept) >= 0.95 * len({r[0] for r in rows})
    before, after = outs["line_dedup"]
    dropped = expected_lines(before)
    got = {r.doc_id: r.text for r in after.collect()}
    for doc, text, *_ in before:
        if doc is not None and text is not None:
            left = "\n".join(x for n, x in enumerate(text.split("\n")) if n not in dropped.get(doc, ()))
            assert got.get(doc) == left or (not left.strip() and doc in dropped and doc not in got)
    before, after = outs["near_dedup"]
    comp = expected_components(before, 80)
    assert {r.doc_id for r in after.collect()} == {d for d, c in comp.items() if d == c} | ({None} if any(r[0] is None for r in before) else set())
    before, after = outs["mix"]
    texts = {r[0]: r[1] for r in before}
    words = sum(len((r[1] or "").split()) for r in before)
    mixed = after.collect()
    assert all(texts[r.doc_id].startswith(r.text) for r in mixed) and after.columns == columns
    assert sum(len(r.text.split()) for r in mixed) == words * corpus_pipeline.MIX.percent // 100
    before, after = outs["pack"]
    assert {r.doc_id for r in after.collect()} == {r[0] for r in before}
    assert after.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").isEmpty()


def test_empty_corpus(spark, tmp_path):
    table(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_queries_with_sql(spark, sf):
    con = duckdb.connect()
    for name in ("documents", "benchmark", "embeddings"):
        con.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
    for name, sql in Q.oracle_sql().items():
        got = Q.queries()[name](spark, sf)
        cursor = con.execute(sql)
        names = [d[0] for d in cursor.description]
        assert sorted(names) == sorted(got.columns)
        want = sorted(map(repr, (tuple(r[names.index(c)] for c in got.columns) for r in cursor.fetchall())))
        assert sorted(repr(tuple(r)) for r in got.collect()) == want
