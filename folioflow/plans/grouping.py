"""Aggregated reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from folioflow.functions import text as T
from folioflow.operators import aggregates, model, sampling
from folioflow.operators.filters import visible_posts
from folioflow.operators.ordering import with_rank
from folioflow.plans.bindings import SETTINGS, VECTORS, Bound, with_ctes
from folioflow.plans.joining import RANK_SQL, quota_sql
from folioflow.plans.modelling import DISTANCE_SQL, draw_sql
from folioflow.plans.registry import query
from folioflow.session import materialise


@query(
    "upsert_keep_last",
    with_ctes("label_rows", "reactions")
    + f""", log AS (SELECT id, preference, -2::BIGINT AS step FROM label_rows
        UNION ALL SELECT id, 'neutral', -1 FROM label_rows WHERE id LIKE '%3' UNION ALL SELECT id, ['like', 'dislike', 'neutral', 'unknown'][1 + {RANK_SQL}], event_id FROM reactions)
    SELECT id, preference, row_number() OVER (ORDER BY id) AS rank FROM (SELECT id, arg_max(preference, step) AS preference FROM log GROUP BY id)""",
)
def upsert_keep_last(b: Bound) -> DataFrame:
    new = b.reactions.withColumn("preference", aggregates.rank_to_preference(aggregates.reaction_rank(F.col("content"))))
    first = b.labels.select("id", "preference", F.lit(-2).alias("step"))
    later = b.labels.where("id LIKE '%3'").select("id", F.lit("neutral").alias("preference"), F.lit(-1).alias("step"))
    merged = aggregates.upsert_keep_last(first.unionByName(later), new, [F.col("step")], [F.col("event_id")])
    return with_rank(merged, [F.col("id").asc()])


@query(
    "vector_quality",
    with_ctes("papers")
    + """, checks AS (SELECT id, substr(updated, 1, 4)::BIGINT AS year, 'v1' AS vector, v1 IS NULL AS is_null, coalesce(len(list_filter(v1, lambda x: isnan(x))) > 0, false) AS has_nan FROM papers
        UNION ALL SELECT id, substr(updated, 1, 4)::BIGINT, 'v2', v2 IS NULL, coalesce(len(list_filter(v2, lambda x: isnan(x))) > 0, false) FROM papers)
    SELECT year, vector, count(*) AS rows, count(*) FILTER (is_null) AS null_vectors, count(*) FILTER (has_nan) AS nan_vectors,
        count(*) FILTER (is_null OR has_nan) AS removed, round(count(*) FILTER (is_null OR has_nan) * 100.0::DOUBLE / count(*), 2) AS removed_pct,
        array_to_string(list_sort(list(id) FILTER (is_null OR has_nan))[1:5], ',') AS bad_ids
    FROM checks GROUP BY year, vector""",
)
def vector_quality(b: Bound) -> DataFrame:
    return aggregates.vector_quality(b.papers, VECTORS).withColumn("year", F.col("year").cast("bigint"))


@query(
    "score_bands_report",
    quota_sql(SETTINGS.sample_rate)
    + """ SELECT band, count(*) AS total, sum("show")::BIGINT AS shown, round(sum("show")::DOUBLE / count(*), 6) AS ratio FROM (SELECT *,
        CASE WHEN score >= 0 AND score < 0.3 THEN '0.0-0.3' WHEN score >= 0.3 AND score < 0.5 THEN '0.3-0.5' WHEN score >= 0.5 AND score < 0.7 THEN '0.5-0.7'
             WHEN score >= 0.7 AND score < 0.9 THEN '0.7-0.9' WHEN score >= 0.9 AND score < 1.0 THEN '0.9-1.0' END AS band FROM flagged)
    WHERE band IS NOT NULL GROUP BY band""",
)
def score_bands_report(b: Bound) -> DataFrame:
    scored = materialise(b.scored.select("id", "score"), "scored")
    flagged = sampling.adaptive_quota(
        scored, SETTINGS.sample_rate, SETTINGS.high_threshold, SETTINGS.boundary_threshold, SETTINGS.seed
    )
    return aggregates.score_bands_report(flagged).withColumn("ratio", F.round("ratio", 6))


@query(
    "score_stats",
    with_ctes("scored", "positives", "background")
    + DISTANCE_SQL
    + """ SELECT 'score' AS quantity, round(min(score), 6) AS min, round(max(score), 6) AS max, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std FROM scored
    UNION ALL SELECT 'distance', round(min(distance), 6), round(max(distance), 6), round(avg(distance), 6), round(stddev_pop(distance), 6) FROM rated
    UNION ALL SELECT 'difficulty', round(min(weight), 6), round(max(weight), 6), round(avg(weight), 6), round(stddev_pop(weight), 6) FROM rated""",
)
def score_stats(b: Bound) -> DataFrame:
    rated = model.difficulty_weights(b.positives, b.background, SETTINGS.difficulty_neighbors)
    stats = [
        aggregates.value_stats(rows, value).withColumn("quantity", F.lit(name))
        for name, rows, value in (("score", b.scored, "score"), ("distance", rated, "distance"), ("difficulty", rated, "weight"))
    ]
    out = stats[0].unionByName(stats[1]).unionByName(stats[2])
    return out.withColumns({c: F.round(c, 6) for c in ("min", "max", "mean", "std")})


@query(
    "resample_coverage",
    with_ctes("positives", "background")
    + DISTANCE_SQL
    + draw_sql("rated", "(SELECT count(*) FROM rated)", "difficulty", f"{SETTINGS.seed}:resample", "drawn")
    + draw_sql("rated", "(SELECT count(*) FROM rated)", "difficulty", f"{SETTINGS.seed}:parents", "parents")
    + """ SELECT kind, count(*) AS distinct_picked, min(n) AS min_picks, max(n) AS max_picks, round(avg(n), 6) AS mean_picks,
        (SELECT count(*) FROM rated) AS parents, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM rated), 6) AS coverage_pct
    FROM (SELECT 'resampled' AS kind, id, count(*) AS n FROM drawn GROUP BY id UNION ALL SELECT 'synthetic', id, count(*) FROM parents GROUP BY id) GROUP BY kind""",
)
def resample_coverage(b: Bound) -> DataFrame:
    rated = model.difficulty_weights(b.positives, b.background, SETTINGS.difficulty_neighbors)
    n = rated.count()
    resampled = model.difficulty_resample(rated, n, SETTINGS.seed)
    parents = model.synthesis_plan(rated, n, n, SETTINGS)
    reports = [
        aggregates.resample_coverage(picks, rated).withColumn("kind", F.lit(kind))
        for kind, picks in (("resampled", resampled), ("synthetic", parents))
    ]
    out = reports[0].unionByName(reports[1])
    return out.withColumns({c: F.round(c, 6) for c in ("mean_picks", "coverage_pct")})


@query(
    "class_weights",
    with_ctes("label_rows")
    + """ SELECT label, count(*) AS n_class, round((SELECT count(*) FROM label_rows) / (2.0::DOUBLE * count(*)), 6) AS weight
    FROM (SELECT (preference = 'like')::BIGINT AS label FROM label_rows) GROUP BY label""",
)
def class_weights(b: Bound) -> DataFrame:
    rows = b.labels.withColumn("label", F.when(F.col("preference") == "like", 1).otherwise(0).cast("bigint"))
    return aggregates.class_counts(rows).withColumn("weight", F.round("weight", 6))


@query(
    "archive_counts",
    with_ctes("posts")
    + """ SELECT year, month, count(*) AS posts FROM (SELECT year(pub + INTERVAL 8 HOUR) AS year, month(pub + INTERVAL 8 HOUR) AS month FROM posts WHERE NOT draft)
    GROUP BY ROLLUP (year, month) HAVING grouping(year) = 0""",
)
def archive_counts(b: Bound) -> DataFrame:
    counts = aggregates.archive_counts(b.posts, SETTINGS.zone)
    return counts.select(F.col("year").cast("bigint").alias("year"), F.col("month").cast("bigint").alias("month"), "posts")


SLUG_SQL = (
    "array_to_string(regexp_extract_all(replace(strip_accents(lower({0})), 'ß', 'ss'), '[a-z]+|[0-9]+'), '-')"
)


@query(
    "unique_tags",
    with_ctes("visible")
    + f""", t AS (SELECT id, unnest(tags) AS tag, unnest(range(1, len(tags) + 1)) AS pos FROM visible)
    SELECT {SLUG_SQL.format('tag')} AS slug, arg_min(tag, [id, pos::VARCHAR]) AS tag FROM t GROUP BY 1""",
)
def unique_tags(b: Bound) -> DataFrame:
    return aggregates.unique_tags(visible_posts(b.posts, SETTINGS))


LONG_SQL = """, wide AS (SELECT id, title, array_to_string(authors, chr(31)) AS authors, array_to_string(keywords, chr(31)) AS keywords,
        round(score, 6)::DECIMAL(18,6)::VARCHAR AS score, abstract FROM digests)"""


def wide_text(b: Bound) -> DataFrame:
    return b.digests.select(
        "id",
        "title",
        T.list_join(F.col("authors")).alias("authors"),
        T.list_join(F.col("keywords")).alias("keywords"),
        T.float_text(F.col("score")).alias("score"),
        "abstract",
    )


@query(
    "unpivot_wide_to_long",
    with_ctes("digests")
    + LONG_SQL
    + " SELECT id, variable, value FROM wide UNPIVOT INCLUDE NULLS (value FOR variable IN (title, authors, keywords, score, abstract))",
)
def unpivot_wide_to_long(b: Bound) -> DataFrame:
    return aggregates.unpivot_wide_to_long(wide_text(b))


@query(
    "pivot_long_to_wide",
    with_ctes("digests") + LONG_SQL + " SELECT id, title, authors, keywords, score, abstract FROM wide",
)
def pivot_long_to_wide(b: Bound) -> DataFrame:
    long = aggregates.unpivot_wide_to_long(wide_text(b))
    return aggregates.pivot_long_to_wide(long, ["title", "authors", "keywords", "score", "abstract"])
