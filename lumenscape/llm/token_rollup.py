"""Token count rollups kept up to date by signed deltas.

A batch holds signed rows: +1 for an inserted document, -1 for a deleted one, and for a revised count the old
row with -1 and the new one with +1. Batches are summed by source, language and tokenizer version
and added to the current totals. Totals are written beside the old ones; one commit record then
names the batch, what it held and its totals, so a batch counts once however often it is sent, and a batch that
broke off before its record never counted. Another content under a known batch id is an error.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lumenscape.llm.tokenizers import default_path, encoder

KEYS = ["source", "lang", "tokenizer_version"]
TOTALS = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"
COMMITS = "seq long, batch_id string, content string, totals string"


def deltas(rows: DataFrame, tokenizer_version: str, n_tokens: Column, sign: int) -> DataFrame:
    """Signed rows of one kind from a table with doc_id, source and lang."""
    return rows.select("doc_id", "source", "lang", F.lit(tokenizer_version).alias("tokenizer_version"), n_tokens.cast("long").alias("n_tokens"), F.lit(sign).alias("sign"))


def revisions(rows: DataFrame, tokenizer_version: str, old: Column, new: Column) -> DataFrame:
    """Old counts with -1 and new ones with +1, where they differ."""
    changed = rows.where(~old.eqNullSafe(new))
    return deltas(changed, tokenizer_version, old, -1).unionByName(deltas(changed, tokenizer_version, new, 1))


class Rollup:
    """Totals under one folder that driver and executors share; one writer at a time."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def commits(self) -> DataFrame:
        try:
            return self.spark.read.schema(COMMITS).parquet(f"{self.folder}/commits")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], COMMITS)

    def totals(self) -> DataFrame:
        """Totals of all committed batches; groups without documents and tokens are absent."""
        last = self.commits().orderBy(F.desc("seq")).first()
        if last is None:
            return self.spark.createDataFrame([], TOTALS)
        return self.spark.read.schema(TOTALS).parquet(last["totals"])

    def apply(self, batch_id: str, batch: DataFrame) -> bool:
        """Add a batch; False if it was committed before, ValueError if another content was.

        Rows with a null sign count for nothing, null counts are 0, null keys are groups of their own; rows may
        repeat and come in any order.
        """
        sign = F.coalesce(F.signum(F.col("sign").cast("double")).cast("long"), F.lit(0))
        change = batch.select(*KEYS, sign.alias("n_docs"), (sign * F.coalesce("n_tokens", F.lit(0))).cast("long").alias("n_tokens"))
        content = _content(batch)
        done = self.commits()
        before = done.where(F.col("batch_id") == batch_id).first()
        if before is not None:
            if before["content"] != content:
                raise ValueError(f"batch {batch_id} was committed with another content")
            return False
        # the batch is summed before it meets the totals: a hot source is one row of each task
        change = change.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        new = self.totals().unionByName(change).groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        path = f"{self.folder}/totals/{uuid.uuid4().hex}"
        new.where("n_docs <> 0 or n_tokens <> 0").write.parquet(path)
        seq = done.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0] + 1
        self.spark.createDataFrame([(seq, batch_id, content, path)], COMMITS).coalesce(1).write.mode("append").parquet(f"{self.folder}/commits")
        return True


def _content(batch: DataFrame) -> str:
    """What a batch holds, whatever the order of its rows: their number and two sums of hashes."""
    rows = [F.xxhash64(F.lit(seed), *batch.columns).cast("decimal(38,0)") for seed in (1, 2)]
    return ":".join(str(x) for x in batch.agg(F.count(F.lit(1)), *[F.coalesce(F.sum(h), F.lit(0)) for h in rows]).first())


# Fixed value: what a word is.
WORDS = r"[^\x20\x09-\x0D]+"


def count_matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def count_tokens(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, source, lang, bpe (ids of a tokenizer file), bytes (ids of byte-level models) and words of every row.

    Defined cases: a null or empty text has none; very long texts are counted whole; repeated rows are counted once each;
    null keys stay null; an empty table gives an empty result; other columns are ignored.
    """
    path = tokenizer or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            n = pa.array([len(encode(t.as_py())) if t.is_valid else 0 for t in batch.column(3)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], n, *batch.columns[4:]], names=["doc_id", "source", "lang", "bpe", "bytes", "words"])

    text = F.col("text").cast("string")
    n_bytes, n_words = F.coalesce(F.octet_length(text), F.lit(0)).cast("long"), F.coalesce(count_matches(text, WORDS), F.lit(0))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), text.alias("text"), n_bytes.alias("bytes"), n_words.alias("words"))
    return rows.mapInArrow(run, "doc_id long, source string, lang string, bpe long, bytes long, words long")


def document_rollup(rollup: Rollup, counted: DataFrame, version: str = "byte_bpe/1", column: str = "bpe") -> DataFrame:
    """Totals after a history of four batches over a table of documents.

    counted: a table made by count_tokens(). Batch 1 inserts all documents under a version, whose counts are in a column; batch
    2 inserts them under bytes/1; batch 3 revises the first, whose documents now end with one more id; batch 4 deletes
    documents of under three words. Batches 2 and 4 are sent again and do not count twice. Defined cases: a null text
    has no tokens but the last id; null source or lang is a group; repeated rows count once each; very long texts are
    counts like others; an empty table has no totals; other columns are ignored.
    """
    ended = F.col(column) + 1
    junk = counted.where("words < 3")
    bytes_in = deltas(counted, "bytes/1", F.col("bytes"), 1)
    junk_out = deltas(junk, version, ended, -1).unionByName(deltas(junk, "bytes/1", F.col("bytes"), -1))
    history = [
        ("1", deltas(counted, version, F.col(column), 1)),
        ("2", bytes_in),
        ("3", revisions(counted, version, F.col(column), ended)),
        ("2", bytes_in),
        ("4", junk_out),
        ("4", junk_out),
    ]
    for batch_id, batch in history:
        rollup.apply(batch_id, batch)
    return rollup.totals()


def rollup_sql() -> str:
    """DuckDB text for document_rollup() over documents where the first version counts words: words/1."""
    return f"""
WITH counted AS (
  SELECT source, lang, octet_length(encode(coalesce(text, ''))) AS bytes, len(regexp_extract_all(coalesce(text, ''), '{WORDS}')) AS words FROM documents)
SELECT source, lang, tokenizer_version, CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens
FROM (SELECT source, lang, 'words/1' AS tokenizer_version, words + 1 AS n FROM counted WHERE words >= 3 UNION ALL SELECT source, lang, 'bytes/1', bytes FROM counted WHERE words >= 3)
GROUP BY source, lang, tokenizer_version"""
