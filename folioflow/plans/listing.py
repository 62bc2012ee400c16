"""Order, pages and neighbours of posts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from folioflow.functions import posts as P
from folioflow.operators import ordering, ranking, sampling
from folioflow.plans.bindings import SETTINGS, SITE, Bound, sql_uniform, with_ctes
from folioflow.plans.registry import query

SECONDS = "floor(epoch(shown_at))::BIGINT"
_DAYS = f"floor((epoch(timestamp '{SETTINGS.as_of_text}') - {SECONDS}) / 86400.0)"
SMART_SQL = (
    f"(greatest(0.0::DOUBLE, 1.0::DOUBLE - greatest(0, {_DAYS} - 7)::DOUBLE / 30) * 0.4::DOUBLE + coalesce(score, 0.5::DOUBLE) * 0.6::DOUBLE) * "
    "(CASE WHEN preference IS NULL OR preference = '' THEN 1.5 WHEN preference = 'unknown' THEN 1.5 WHEN preference = 'like' THEN 0.8 "
    "WHEN preference = 'neutral' THEN 0.4 WHEN preference = 'dislike' THEN 0.2 ELSE 1.0 END)::DOUBLE"
)
PREFERENCE_SQL = "coalesce(CASE preference WHEN 'like' THEN 3 WHEN 'neutral' THEN 2 WHEN 'dislike' THEN 1 WHEN 'unknown' THEN 0 END, -1)"
ORDERS = {
    "date_desc": f"{SECONDS} DESC, id",
    "date_asc": f"{SECONDS}, id",
    "paper_date_desc": "substr(id, 1, 4)::INT DESC, id",
    "score_desc": "coalesce(score, -1) DESC, id",
    "preference": f"{PREFERENCE_SQL} DESC, {SECONDS} DESC, id",
    "smart": f"{SMART_SQL} DESC, id",
}
NEEDED = ("id", "title", "pub", "mod", "score", "preference", "draft")


def ranked(b: Bound, rule: str, *more: str, total: str | None = None) -> DataFrame:
    return ranking.ranked_posts(b.posts.select(*NEEDED, *more), SETTINGS, rule, total)


def _register_rank(name: str, rule: str) -> None:
    @query(name, with_ctes("visible") + f" SELECT id, title, row_number() OVER (ORDER BY {ORDERS[rule]}) AS rank FROM visible")
    def run(b: Bound) -> DataFrame:
        return ranked(b, rule).select("id", "title", "rank")


for _name, _rule in (
    ("rank_date_desc", "date_desc"),
    ("rank_date_asc", "date_asc"),
    ("rank_paper_date", "paper_date_desc"),
    ("rank_score", "score_desc"),
    ("rank_preference", "preference"),
):
    _register_rank(_name, _rule)


@query(
    "rank_smart",
    with_ctes("visible")
    + f" SELECT id, title, round({SMART_SQL}, 6) AS smart_score, row_number() OVER (ORDER BY {ORDERS['smart']}) AS rank FROM visible",
)
def rank_smart(b: Bound) -> DataFrame:
    as_of = F.lit(SETTINGS.as_of_text).cast("timestamp")
    return ranked(b, "smart").select("id", "title", F.round(P.smart_score(as_of), 6).alias("smart_score"), "rank")


@query(
    "prev_next",
    with_ctes("visible")
    + f""" SELECT id, title, row_number() OVER w AS rank, lag(id) OVER w AS prev_id, lag(title) OVER w AS prev_title, lead(id) OVER w AS next_id, lead(title) OVER w AS next_title
    FROM visible WINDOW w AS (ORDER BY {ORDERS['smart']})""",
)
def prev_next(b: Bound) -> DataFrame:
    return ranking.prev_next(b.posts, SETTINGS)


@query(
    "paginate",
    with_ctes("visible")
    + f""" SELECT id, rank, total, (rank - 1) // 5 + 1 AS page, (total + 4) // 5 AS last_page
    FROM (SELECT id, row_number() OVER (ORDER BY {ORDERS['smart']}) AS rank, count(*) OVER () AS total FROM visible)""",
)
def paginate(b: Bound) -> DataFrame:
    pages = ranking.paginate(ranked(b, "smart", total="total"), SETTINGS.page_size)
    return pages.select("id", "rank", "total", "page", "last_page")


TAG_SLUG_SQL = "array_to_string(regexp_extract_all(tag, '[a-z]+|[0-9]+'), '-')"


@query(
    "paginate_tags",
    with_ctes("visible")
    + f""", tagged AS (SELECT * REPLACE ({TAG_SLUG_SQL} AS tag) FROM (SELECT *, unnest(tags) AS tag FROM visible)),
    placed AS (SELECT tag, id, row_number() OVER (PARTITION BY tag ORDER BY {ORDERS['smart']}) AS rank, count(*) OVER (PARTITION BY tag) AS total FROM tagged)
    SELECT tag, id, rank, total, (rank - 1) // 5 + 1 AS page, (total + 4) // 5 AS last_page FROM placed""",
)
def paginate_tags(b: Bound) -> DataFrame:
    """Pages inside every tag; a tag may hold a third of the posts."""
    tagged = ranking.posts_of_tags(b.posts.select(*NEEDED, "tags"), SETTINGS)
    return ranking.paginate(tagged, SETTINGS.page_size).select("tag", "id", "rank", "total", "page", "last_page")


@query(
    "featured_recent",
    with_ctes("visible")
    + f""" SELECT * FROM (SELECT id, CASE WHEN featured THEN 'featured' ELSE 'recent' END AS section,
        row_number() OVER (PARTITION BY featured ORDER BY {ORDERS['smart']}) AS rank FROM visible) WHERE section = 'featured' OR rank <= 3""",
)
def featured_recent(b: Bound) -> DataFrame:
    return ranking.featured_recent(b.posts.select(*NEEDED, "featured"), SETTINGS).select("id", "section", "rank")


@query(
    "feed",
    with_ctes("visible")
    + f""" SELECT row_number() OVER (ORDER BY {ORDERS['smart']}) AS rank, title, description, strftime(pub, '%Y-%m-%d %H:%M:%S') AS pub_date,
        '{SITE}/posts/' || CASE lang WHEN 'en' THEN 'src-' || substr(source, 4) || '/paper-notes/' ELSE '' END || id || '/' AS link FROM visible""",
)
def feed(b: Bound) -> DataFrame:
    rows = ranking.feed(b.posts.select(*NEEDED, "description", "file_path"), SETTINGS, SITE)
    return rows.withColumn("pub_date", F.date_format("pub_date", "yyyy-MM-dd HH:mm:ss"))


@query(
    "archive_listing",
    with_ctes("posts")
    + """, dated AS (SELECT id, pub, year(pub + INTERVAL 8 HOUR) AS year, month(pub + INTERVAL 8 HOUR) AS month FROM posts WHERE NOT draft)
    SELECT year, month, id, row_number() OVER (PARTITION BY year, month ORDER BY floor(epoch(pub)) DESC, id) AS rank FROM dated""",
)
def archive_listing(b: Bound) -> DataFrame:
    rows = ranking.archive_listing(b.posts.select(*NEEDED), SETTINGS)
    return rows.select(F.col("year").cast("bigint").alias("year"), F.col("month").cast("bigint").alias("month"), "id", "rank")


@query(
    "shuffle_rows",
    with_ctes("docs") + f" SELECT id, title, row_number() OVER (ORDER BY {sql_uniform('42:shuffle', 'id')}, id) AS rank FROM docs",
)
def shuffle_rows(b: Bound) -> DataFrame:
    keys = sampling.shuffle_order(SETTINGS.seed)
    return ordering.with_rank(b.documents.select("id", "title"), keys)
