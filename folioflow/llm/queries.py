"""The operators bound to the given tables, one query each, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioflow.llm import audit, coding, graphann, language, licenses, mixing, multiindex, oddsketch, packing, prefixhash, quality, toxicity, trie
from folioflow.llm.common import fold, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def register(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = build
        if sql:
            ORACLE_SQL[name] = sql
        return build

    return register


@query("op1_language_id")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    return language.identify(docs, language.train(docs.where(~held_out)), held_out)


@query("op2_mixing", mixing.SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).drop("source")


@query("op3_quality")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    model = quality.train(docs, labels.where(~held_out).select("doc_id", F.col("quality").alias("label")))
    return quality.grade(docs, model, {"doc_id": F.col("doc_id"), "held_out": held_out})


@query("op4_token_files")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coding.token_files(table(spark, sf_dir, "documents"))


@query("op5_embedding_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiindex.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op6_minhash_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oddsketch.near_duplicates(table(spark, sf_dir, "documents"))


@query("op7_best_fit_packing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(table(spark, sf_dir, "documents"))


@query("op8_licenses", licenses.SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").select("doc_id", licenses.document_path().alias("path"), "text")
    return licenses.scan(files).withColumn("score", F.round("score", 6))


@query("op9_toxicity")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    model = toxicity.train(docs, labels.where(~held_out).select("doc_id", F.col("toxic").alias("label")))
    return toxicity.severity(docs, model, {"doc_id": F.col("doc_id"), "held_out": held_out})


@query("op10_graph_search")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return graphann.nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))


@query("op11_fingerprints")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixhash.edited_fingerprints(table(spark, sf_dir, "documents"))


@query("op12_filter_audit", audit.SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op13_prefix_trie", trie.SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.conversation_trie(table(spark, sf_dir, "conversations"))


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
