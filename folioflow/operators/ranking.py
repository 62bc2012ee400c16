"""Listing order, pages, neighbours and feeds of posts. Ties in every order go to the smaller id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from folioflow.config import Settings
from folioflow.functions import posts as P
from folioflow.functions import text as T
from folioflow.operators.aggregates import month_posts
from folioflow.operators.filters import visible_posts
from folioflow.operators.ordering import neighbours, with_rank

RULES = ("date_desc", "date_asc", "paper_date_desc", "score_desc", "preference", "smart")
DEFAULT_RULE = "smart"

# Fixed value: folder the posts live in.
CONTENT_ROOT = "../content"


def order_of(rule: str, settings: Settings) -> list[Column]:
    """Sort keys of a listing rule."""
    newest = P.post_seconds().desc()
    keys = {
        "date_desc": [newest],
        "date_asc": [P.post_seconds().asc()],
        "paper_date_desc": [P.paper_month(F.col("id")).desc()],
        "score_desc": [F.coalesce("score", F.lit(-1.0)).desc()],
        "preference": [P.preference_rank().desc(), newest],
        "smart": [P.smart_score(F.lit(settings.as_of_text).cast("timestamp")).desc()],
    }
    return [*keys[rule], F.col("id").asc()]


def ranked_posts(posts: DataFrame, settings: Settings, rule: str = DEFAULT_RULE, total: str | None = None) -> DataFrame:
    """Visible posts with their 1-based ``rank``."""
    return with_rank(visible_posts(posts, settings), order_of(rule, settings), total=total)


def posts_of_tags(posts: DataFrame, settings: Settings, rule: str = DEFAULT_RULE) -> DataFrame:
    """Every (tag slug, post) of the visible posts with the post's ``rank`` and the ``total`` inside the tag."""
    tagged = visible_posts(posts, settings).withColumn(
        "tag", F.explode(F.array_distinct(F.transform("tags", T.slugify)))
    )
    return with_rank(tagged, order_of(rule, settings), group=["tag"], total="total")


def posts_by_tag(posts: DataFrame, tag_slug: str, settings: Settings, rule: str = DEFAULT_RULE) -> DataFrame:
    """Visible posts having one tag, ranked."""
    has_tag = F.exists("tags", lambda t: T.slugify(t) == tag_slug)
    return with_rank(visible_posts(posts, settings).where(has_tag), order_of(rule, settings))


def paginate(ranked: DataFrame, page_size: int, rank: str = "rank", total: str = "total") -> DataFrame:
    """``page`` of each row and the ``last_page`` of its listing."""
    return ranked.withColumns(
        {
            "page": (F.floor((F.col(rank) - 1) / F.lit(page_size)) + 1).cast("bigint"),
            "last_page": F.ceil(F.col(total) / F.lit(page_size)).cast("bigint"),
        }
    )


def prev_next(posts: DataFrame, settings: Settings, rule: str = DEFAULT_RULE) -> DataFrame:
    """Neighbours of each visible post in listing order; null at the ends."""
    ranked = ranked_posts(posts.select("id", "title", "pub", "mod", "score", "preference", "draft"), settings, rule)
    return neighbours(ranked.select("id", "title", "rank"), ["id", "title"])


def featured_recent(posts: DataFrame, settings: Settings, rule: str = DEFAULT_RULE) -> DataFrame:
    """All featured posts and the first few of the others, in listing order (``section``)."""
    ranked = with_rank(
        visible_posts(posts, settings).withColumn(
            "section", F.when(F.coalesce("featured", F.lit(False)), "featured").otherwise("recent")
        ),
        order_of(rule, settings),
        group=["section"],
    )
    return ranked.where((F.col("section") == "featured") | (F.col("rank") <= settings.index_size))


def feed(posts: DataFrame, settings: Settings, site: str) -> DataFrame:
    """Feed entries in listing order."""
    ranked = ranked_posts(posts, settings)
    link = F.concat(F.lit(site), T.post_path(F.col("id"), F.col("file_path"), CONTENT_ROOT), F.lit("/"))
    return ranked.select("rank", link.alias("link"), "title", "description", F.col("pub").alias("pub_date"))


def archive_listing(posts: DataFrame, settings: Settings) -> DataFrame:
    """Posts that are no drafts, newest first inside their month."""
    dated = month_posts(posts, settings.zone)
    return with_rank(dated, [F.unix_timestamp("pub").desc(), F.col("id").asc()], group=["year", "month"])
