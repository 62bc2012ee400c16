"""Predicates and row-wise projections over papers, posts and labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from folioflow.config import Settings
from folioflow.functions import posts as P
from folioflow.functions import text as T
from folioflow.functions import vectors as V

PAPER_ID_PATTERN = r"^\d{4}\.\d{4,5}v?\d*$"


def category_filter(papers: DataFrame, categories: Sequence[str]) -> DataFrame:
    wanted = F.array(*[F.lit(c) for c in categories])
    return papers.where(F.arrays_overlap("categories", wanted))


def null_vector_filter(papers: DataFrame, columns: Sequence[str]) -> DataFrame:
    return papers.where(V.all_present(columns))


def nan_vector_filter(papers: DataFrame, columns: Sequence[str]) -> DataFrame:
    return papers.where(V.all_clean(columns))


def nan_to_zero(papers: DataFrame, columns: Sequence[str]) -> DataFrame:
    return papers.withColumns({c: V.nan_to_zero(c) for c in columns})


def concat_features(papers: DataFrame, columns: Sequence[str], name: str = "features") -> DataFrame:
    return papers.withColumn(name, V.concat_features(columns))


def year_filter(papers: DataFrame, scan_start_year: int, background_start_year: int) -> DataFrame:
    """Only needed when the scan starts before the background year."""
    if scan_start_year >= background_start_year:
        return papers
    return papers.where(F.substring("updated", 1, 4).cast("int") >= background_start_year)


def date_window(papers: DataFrame, settings: Settings) -> DataFrame:
    """Both bounds given: inclusive range of date texts; else the last ``last_n_days`` before ``as_of``."""
    if settings.start_date and settings.end_date:
        return papers.where(F.col("updated").between(settings.start_date, settings.end_date))
    first_day = F.date_format(F.date_sub(F.lit(settings.as_of_text[:10]).cast("date"), settings.last_n_days), "yyyy-MM-dd")
    return papers.where(F.col("updated") >= first_day)


def label_column(rows: DataFrame, name: str = "label") -> DataFrame:
    """``like`` is 1, every other preference 0."""
    return rows.withColumn(name, F.when(F.col("preference") == "like", 1).otherwise(0))


def shown_only(predictions: DataFrame) -> DataFrame:
    return predictions.where(F.col("show") == 1).select("id", "title", "abstract", "score")


def paper_id_of_title(title: Column) -> Column:
    """Last path segment of a discussion title, when it looks like a paper id; else null."""
    trimmed = F.regexp_replace(F.trim(title), "/$", "")
    stem = F.trim(F.element_at(F.split(trimmed, "/"), -1))
    return F.when(stem.rlike(PAPER_ID_PATTERN), stem)


def paper_id_filter(discussions: DataFrame, published_ids: DataFrame, distinct: bool = False) -> DataFrame:
    """Discussions whose title names a published paper, with that ``id``.

    Where the published ids are known to be ``distinct``, the smaller side is sent to the larger one, whichever it is.
    """
    named = discussions.withColumn("id", paper_id_of_title(F.col("title"))).where(F.col("id").isNotNull())
    return named.join(published_ids.select("id"), "id", "inner" if distinct else "left_semi")


def with_draft_flag(rows: DataFrame) -> DataFrame:
    return rows.withColumn("draft", T.draft_flag(F.col("preference")))


def visible_posts(posts: DataFrame, settings: Settings, preview: bool = False) -> DataFrame:
    """Posts readers can see; a preview ignores the time rule."""
    if preview:
        return posts.where(~F.col("draft"))
    as_of = F.lit(settings.as_of_text).cast("timestamp")
    return posts.where(P.is_visible(as_of, settings.schedule_margin_seconds))
