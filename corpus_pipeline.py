"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet in the shared folder and
read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lumenscape.llm.circulant_minhash import near_duplicates
from lumenscape.llm.common import fresh_name, id_crc32, materialise, read_table
from lumenscape.llm.line_dedup import without_repeated_lines
from lumenscape.llm.mixing import PLAN, Plan, document_items, mix
from lumenscape.llm.packing import pack_documents
from lumenscape.llm.toxicity import fit_on_documents, score_documents

#: The mix of one pass over the corpus: no document is read twice, four fifths of the tokens are kept.
MIX = Plan(PLAN.weights, max_epochs=1, seed=PLAN.seed, percent=80)
#: What the mix calls the key of a row, beside its own columns.
_MIX_KEY = "row_key"


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is 0.5 or more go.

    Defined cases: null and empty texts have the score of no evidence, like a clean document; a null doc_id is scored like
    any other; repeated rows stay or go together; very long texts are scored whole; an empty table stays empty.
    """
    score, spans = fresh_name(docs, "score"), fresh_name(docs, "spans")
    model = fit_on_documents(docs, read_table(spark, sf_dir, "labels"), F.coalesce(id_crc32("doc_id") % 5, F.lit(1)) != 0)
    scored = score_documents(spark, docs, model, score, spans)
    return scored.where(F.col(score) < 0.5).select(*_all(docs))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines seen before go; so does a document that nothing is left of. n_chars follows the text.

    Defined cases: rows with a null doc_id or text pass unchanged, blank documents that lose no line too; rows of one doc_id
    lose the same lines; very long lines are compared whole; an empty table stays empty.
    """
    n_dropped = fresh_name(docs, "n_dropped")
    out = without_repeated_lines(spark, docs, count_col=n_dropped)
    changed = F.col(n_dropped) > 0
    blank = F.coalesce(F.trim(F.col("text"), F.lit(" \t\r\n\x0b\x0c")) == "", F.lit(False))
    return out.where(~(blank & changed)).withColumn("n_chars", _chars(docs, changed)).select(*_all(docs))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (word shingles, Jaccard 0.8) the document with the smallest doc_id stays.

    Defined cases: rows with a null doc_id, and texts without words, stay; all rows of the doc_id that stays do, so rows
    that repeat it come out once each; very long texts are compared whole; an empty table stays empty.
    """
    gone = near_duplicates(spark, docs, percent=80).where("not kept").select("id").distinct()
    return docs.alias("d").join(gone.alias("g"), F.col("d.doc_id").cast("long") == F.col("g.id"), "left_anti")


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by target weights; the one at which a leaf's quota ends is cut to its token prefix.

    Every row that the mix reads comes out once with its own tokens: null and repeated ids too. Rows are
    told apart by a hash of all columns; equal rows come out as often as they are read. Defined cases: null and empty
    texts have no tokens and are not read; null languages and sources are leaves of their own; ties in the seeded order
    are settled by that hash; a very long text is cut like any other; an empty table stays empty.
    """
    key, take, n = (fresh_name(docs, x) for x in ("key", "take", "n"))
    keyed = docs.withColumn(key, F.sha2(F.to_json(F.struct(*_all(docs))), 256))
    items = document_items(keyed.select("doc_id", "text", "lang", "source", F.col(key).alias(_MIX_KEY)), (_MIX_KEY,))
    read = mix(spark, items, MIX, (_MIX_KEY,)).select(F.col(_MIX_KEY).alias(key), F.col("take_tokens").alias(take), F.col("n_tokens").alias(n))
    out = keyed.dropDuplicates([key]).join(read, key)
    cut = F.col(take) < F.col(n)
    words = F.split("text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    prefix = F.array_join(F.slice(words, F.lit(1), F.col(take).cast("int")), "")
    return out.withColumn("text", F.when(cut, prefix).otherwise(F.col("text"))).withColumn("n_chars", _chars(docs, cut)).select(*_all(docs))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, with their ids. Defined cases: those of pack_documents(); here null texts are single tokens."""
    return pack_documents(docs, with_ids=True)


def _all(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def _chars(docs: DataFrame, changed):
    return F.when(changed, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("mix", mix_stage),
    ("pack", pack_stage),
]

#: The learnt scores, signatures and tokenizer of the stages have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(spark, stage(spark, docs, sf_dir), name)
    return docs
