"""The registered queries of the corpus operators: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lumenscape.llm.additive_quality import quality
from lumenscape.llm.circulant_minhash import near_duplicates
from lumenscape.llm.common import materialise, new_folder, read_table
from lumenscape.llm.dual_tree_search import search, search_sql
from lumenscape.llm.graph_dedup import near_vectors
from lumenscape.llm.language_id import languages
from lumenscape.llm.line_dedup import line_report
from lumenscape.llm.mixing import document_items, document_sql, mix
from lumenscape.llm.order_minhash import order_minhash
from lumenscape.llm.packing import pack_documents
from lumenscape.llm.secret_ledger import BASE_RULES, scan_versions
from lumenscape.llm.sharded_lloyd import lloyd, lloyd_sql
from lumenscape.llm.token_rollup import Rollup, count_tokens, document_rollup, rollup_sql
from lumenscape.llm.toxicity import toxicity


def op1_graph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark, read_table(spark, sf_dir, "embeddings"))


def op4_hierarchical_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark, document_items(read_table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


def op5_crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity(spark, read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted", F.size("spans").cast("long").alias("n_spans"))


def op2_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = scan_versions(spark, docs, new_folder(spark, "ledger"), ["doc_id"])
    kinds = [r.kind for r in BASE_RULES]
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("found", lambda s: s["kind"].isin(kinds))

    def count(kind: str):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, kinds), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def op3_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"))


def op6_byte_cnn_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(spark, read_table(spark, sf_dir, "documents"))


def op7_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark, read_table(spark, sf_dir, "documents"), percent=85)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


def op8_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash(read_table(spark, sf_dir, "documents"))


def op9_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = materialise(spark, count_tokens(read_table(spark, sf_dir, "documents")), "counted")
    return document_rollup(Rollup(spark, new_folder(spark, "rollup")), counted)


def token_rollup_of_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rollup of op9 over counts that SQL can make: words and bytes."""
    counted = materialise(spark, count_tokens(read_table(spark, sf_dir, "documents")), "counted")
    return document_rollup(Rollup(spark, new_folder(spark, "rollup")), counted, "words/1", "words")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(spark, read_table(spark, sf_dir, "documents"), short_repeats=True)


def op11_additive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(spark, read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op12_dual_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark, read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op13_sharded_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd(spark, read_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_graph_dedup": op1_graph_dedup,
        "op2_secret_ledger": op2_secret_ledger,
        "op3_vector_packing": op3_vector_packing,
        "op4_hierarchical_mix": op4_hierarchical_mix,
        "op5_crf_toxicity": op5_crf_toxicity,
        "op6_byte_cnn_language": op6_byte_cnn_language,
        "op7_circulant_minhash": op7_circulant_minhash,
        "op8_order_minhash": op8_order_minhash,
        "op9_token_rollup": op9_token_rollup,
        "token_rollup_of_words": token_rollup_of_words,
        "op10_line_dedup": op10_line_dedup,
        "op11_additive_quality": op11_additive_quality,
        "op12_dual_tree_search": op12_dual_tree_search,
        "op13_sharded_lloyd": op13_sharded_lloyd,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_hierarchical_mix": document_sql(), "token_rollup_of_words": rollup_sql(), "op12_dual_tree_search": search_sql(), "op13_sharded_lloyd": lloyd_sql()}
