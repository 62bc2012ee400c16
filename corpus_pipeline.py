"""Five stages from raw documents to packed token sequences: filter, filter, deduplicate, mix, pack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioflow.llm import mixing, oddsketch, packing, quality, toxicity
from folioflow.llm.common import fold, table
from folioflow.session import materialise


def plainly_named(docs: DataFrame) -> DataFrame:
    """``docs`` with names that no operator uses for the columns that none reads, so that any name may come."""
    return docs.toDF(*[c if c in ("doc_id", "text", "source") else f"_kept_{i}" for i, c in enumerate(docs.columns)])


def named_as(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``plainly_named(docs)`` under their own names again."""
    return rows.select(*plainly_named(docs).columns).toDF(*docs.columns)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; rows of the held-out fold are not learned from."""
    labels = table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0)
    plain = plainly_named(docs)
    model = quality.train(plain, labels.select("doc_id", F.col("quality").alias("label")))
    return named_as(quality.grade(plain, model, {c: F.col(c) for c in plain.columns}).where("predicted = 1"), docs)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are likelier not toxic; rows of the held-out fold are not learned from."""
    labels = table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0)
    plain = plainly_named(docs)
    model = toxicity.train(plain, labels.select("doc_id", F.col("toxic").alias("label")))
    return named_as(toxicity.severity(plain, model, {c: F.col(c) for c in plain.columns}).where("predicted = 0"), docs)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, of the smallest id, of every group of near-duplicates; ids may be null or repeat."""
    return named_as(oddsketch.one_of_each(plainly_named(docs)), docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: no, one or two copies of a row."""
    plain = plainly_named(docs)
    taken = mixing.mix_sources(plain, keep=[c for c in plain.columns if c not in ("doc_id", "source")]).where("copies > 0")
    return named_as(taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences; a row for each copy of a document."""
    return packing.best_fit_packing(docs)


STAGES = [
    ("quality", good_quality),
    ("toxicity", not_toxic),
    ("near_duplicates", one_of_near_duplicates),
    ("mixing", mixed),
    ("packing", packed),
]

# Trained models, MinHash candidates and a tokenizer have no SQL; tests/llm holds the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a Parquet table in the shared folder that the next one reads."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
