"""Sinks. A table that replaces another is complete before the other goes, see ``staging``."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from folioflow.functions import text as T
from folioflow.operators.aggregates import dedupe_labels, upsert_keep_last
from folioflow.sources.readers import LABEL_SCHEMA, label_order, scan_labels
from folioflow.sources.staging import recover, replace_table


def write_predictions(predictions: DataFrame, vector_columns: Sequence[str], path: str) -> None:
    predictions.drop(*vector_columns).write.mode("overwrite").parquet(path)


def read_label_month(spark: SparkSession, path: str) -> DataFrame | None:
    """The month's labels, or None when it has none yet."""
    recover(spark, path)
    try:
        return spark.read.schema(LABEL_SCHEMA).option("header", True).csv(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def write_label_month(patch: DataFrame, directory: str, as_of: datetime, order: Sequence[Column]) -> str:
    """Create or update the label CSV of ``as_of``'s month; returns its path.

    The last row of an id wins: of the patch in ``order``, of the file by its position in it. The merged
    month is complete before it takes the place of the old one.
    """
    path = f"{directory}/{as_of:%Y-%m}.csv"
    spark = patch.sparkSession
    if read_label_month(spark, path) is None:
        merged = dedupe_labels(patch, order)
    else:
        merged = upsert_keep_last(scan_labels(spark, path), patch, label_order(), order)
    replace_table(spark, path, lambda staged: merged.orderBy("id").write.mode("overwrite").option("header", True).csv(staged))
    return path


def request_lines(requests: DataFrame) -> DataFrame:
    """One JSON object per row, characters unescaped."""
    return requests.select(F.to_json("request").alias("value"))


def write_requests_jsonl(requests: DataFrame, path: str) -> None:
    request_lines(requests).write.mode("overwrite").text(path)


def render_pages(published: DataFrame) -> DataFrame:
    """``id, page``; rows without an id cannot be named and are left out."""
    return published.where(F.col("id").isNotNull()).select("id", T.render_page().alias("page"))


def write_pages(published: DataFrame, path: str) -> None:
    """Pages as a table instead of one file per row, in the place of the old one. Rows stay where they are."""
    pages = render_pages(published)
    replace_table(published.sparkSession, path, lambda staged: pages.write.mode("overwrite").parquet(staged))
