"""Filters, row checks and conformance reports."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, functions as F

from folioflow.operators import filters, quality
from folioflow.operators.sampling import adaptive_quota
from folioflow.plans.bindings import SETTINGS, SQL_CLEAN, SQL_ZEROED, VECTORS, Bound, with_ctes
from folioflow.plans.joining import quota_sql
from folioflow.plans.registry import query
from folioflow.session import materialise

CATEGORY_SQL = "[" + ", ".join(f"'{c}'" for c in SETTINGS.categories) + "]"


@query(
    "category_filter",
    with_ctes("papers") + f" SELECT id, array_to_string(categories, ',') AS categories FROM papers WHERE list_has_any(categories, {CATEGORY_SQL})",
)
def category_filter(b: Bound) -> DataFrame:
    return filters.category_filter(b.papers, SETTINGS.categories).select("id", F.array_join("categories", ",").alias("categories"))


@query("null_vector_filter", with_ctes("papers") + " SELECT id, updated FROM papers WHERE v1 IS NOT NULL AND v2 IS NOT NULL")
def null_vector_filter(b: Bound) -> DataFrame:
    return filters.null_vector_filter(b.papers, VECTORS).select("id", "updated")


@query("nan_vector_filter", with_ctes("papers") + f" SELECT id, updated FROM papers WHERE {SQL_CLEAN}")
def nan_vector_filter(b: Bound) -> DataFrame:
    return filters.nan_vector_filter(b.papers, VECTORS).select("id", "updated")


@query(
    "nan_to_zero",
    with_ctes("papers")
    + f""", z AS (SELECT id, {SQL_ZEROED.format('v1')} AS v1, v2 FROM papers)
    SELECT id, round(list_sum(list_transform(v1, lambda x: x::DOUBLE * x::DOUBLE)), 6) AS norm1, len(list_filter(v1, lambda x: x = 0)) AS zeros1, len(v2) AS size2 FROM z""",
)
def nan_to_zero(b: Bound) -> DataFrame:
    square = F.aggregate("v1", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return filters.nan_to_zero(b.papers, VECTORS).select(
        "id",
        F.round(square, 6).alias("norm1"),
        F.when(F.col("v1").isNotNull(), F.size(F.filter("v1", lambda x: x == 0))).cast("bigint").alias("zeros1"),
        F.when(F.col("v2").isNotNull(), F.size("v2")).cast("bigint").alias("size2"),
    )


@query(
    "concat_features",
    with_ctes("clean_papers")
    + """ SELECT id, len(vector) AS dims, vector[1] AS first_value, vector[65] AS middle_value, vector[128] AS last_value,
        round(list_sum(vector), 6) AS total FROM clean_papers""",
)
def concat_features(b: Bound) -> DataFrame:
    clean = filters.nan_vector_filter(b.papers, VECTORS)
    v = F.col("vector")
    return filters.concat_features(clean, VECTORS, "vector").select(
        "id",
        F.size(v).cast("bigint").alias("dims"),
        v[0].alias("first_value"),
        v[64].alias("middle_value"),
        v[127].alias("last_value"),
        F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x), 6).alias("total"),
    )


@query("year_filter", with_ctes("docs") + " SELECT id, updated FROM docs WHERE substr(updated, 1, 4)::INT >= 2024")
def year_filter(b: Bound) -> DataFrame:
    return filters.year_filter(b.documents, 2023, SETTINGS.background_start_year).select("id", "updated")


@query("date_window", with_ctes("docs") + f" SELECT id, updated FROM docs WHERE updated BETWEEN '{SETTINGS.start_date}' AND '{SETTINGS.end_date}'")
def date_window(b: Bound) -> DataFrame:
    return filters.date_window(b.documents, SETTINGS).select("id", "updated")


@query("date_window_recent", with_ctes("docs") + " SELECT id, updated FROM docs WHERE updated >= '2024-12-01'")
def date_window_recent(b: Bound) -> DataFrame:
    """Only one bound is set, so the last days count."""
    settings = replace(SETTINGS, end_date="", last_n_days=30)
    return filters.date_window(b.documents, settings).select("id", "updated")


@query("label_column", with_ctes("label_rows") + " SELECT id, preference, (preference = 'like')::BIGINT AS label FROM label_rows")
def label_column(b: Bound) -> DataFrame:
    return filters.label_column(b.labels).select("id", "preference", F.col("label").cast("bigint").alias("label"))


@query(
    "shown_only",
    quota_sql(SETTINGS.sample_rate)
    + """ SELECT f.id, f.title, md5(d.text) AS abstract_md5, round(f.score, 6) AS score FROM flagged f JOIN docs d ON f.id = d.id WHERE "show" = 1""",
)
def shown_only(b: Bound) -> DataFrame:
    scored = materialise(b.scored.select("id", "title", "score"), "scored")
    flagged = adaptive_quota(scored, SETTINGS.sample_rate, SETTINGS.high_threshold, SETTINGS.boundary_threshold, SETTINGS.seed)
    with_text = flagged.join(b.documents.select("id", F.col("text").alias("abstract")), "id")
    return filters.shown_only(with_text).select(
        "id", "title", F.md5("abstract").alias("abstract_md5"), F.round("score", 6).alias("score")
    )


PAPER_ID_SQL = """, named AS (SELECT *, trim(list_extract(string_split(regexp_replace(trim(title), '/$', ''), '/'), -1)) AS stem FROM reactions)"""


@query(
    "arxiv_id_filter",
    with_ctes("reactions", "published_ids")
    + PAPER_ID_SQL
    + r""" SELECT event_id, title, stem AS id FROM named WHERE regexp_full_match(stem, '\d{4}\.\d{4,5}v?\d*') AND stem IN (SELECT id FROM published_ids)""",
)
def arxiv_id_filter(b: Bound) -> DataFrame:
    return filters.paper_id_filter(b.reactions.drop("id"), b.published_ids).select("event_id", "title", "id")


@query("visible_posts", with_ctes("visible") + " SELECT id, title, strftime(pub, '%Y-%m-%d %H:%M:%S') AS pub FROM visible")
def visible_posts(b: Bound) -> DataFrame:
    return filters.visible_posts(b.posts, SETTINGS).select("id", "title", F.date_format("pub", "yyyy-MM-dd HH:mm:ss").alias("pub"))


@query("draft_flag", with_ctes("posts") + " SELECT id, preference, draft FROM posts")
def draft_flag(b: Bound) -> DataFrame:
    return filters.with_draft_flag(b.posts.drop("draft")).select("id", "preference", "draft")


@query(
    "validate_posts",
    with_ctes("posts")
    + """, raw AS (SELECT id, CASE WHEN lang <> 'fr' THEN title END AS title, CASE WHEN source <> 'src1' THEN description END AS description,
            CASE WHEN mod IS NULL OR lang <> 'en' THEN pub END AS pub, score * 1.2 - 0.1 AS score,
            CASE WHEN lang = 'de' THEN 'liked' ELSE preference END AS preference, CASE WHEN NOT draft THEN tags END AS tags FROM posts)
    SELECT id, array_to_string(list_filter([CASE WHEN title IS NULL THEN 'title_required' END,
            CASE WHEN description IS NULL THEN 'description_required' END, CASE WHEN pub IS NULL THEN 'pub_required' END,
            CASE WHEN score NOT BETWEEN 0 AND 1 THEN 'score_range' END,
            CASE WHEN preference NOT IN ('like', 'dislike', 'neutral', 'unknown') THEN 'preference_value' END], lambda x: x IS NOT NULL), ',') AS violations,
        array_to_string(coalesce(tags, ['others']), ',') AS tags, 'nobody' AS author FROM raw""",
)
def validate_posts(b: Bound) -> DataFrame:
    """Fields are blanked or bent by language and source first, so that every rule is broken somewhere."""
    lang = F.substring_index("description", " ", 1)
    raw = b.posts.select(
        "id",
        F.when(lang != "fr", F.col("title")).alias("title"),
        F.when(F.substring_index("description", " ", -1) != "src1", F.col("description")).alias("description"),
        F.when(F.col("mod").isNull() | (lang != "en"), F.col("pub")).alias("pub"),
        (F.col("score") * 1.2 - 0.1).alias("score"),
        F.when(lang == "de", "liked").otherwise(F.col("preference")).alias("preference"),
        F.when(~F.col("draft"), F.col("tags")).alias("tags"),
        F.lit(None).cast("string").alias("author"),
    )
    return quality.validate_posts(raw, "nobody").select(
        "id", F.array_join("violations", ",").alias("violations"), F.array_join("tags", ",").alias("tags"), "author"
    )


VOCABULARY = {"language": ["en", "fr"], "length": ["len 0", "len 1", "len 2"], "origin": ["src1", "src2", "src3", "en"]}
VOCABULARY_SQL = "['en', 'fr', 'len 0', 'len 1', 'len 2', 'src1', 'src2', 'src3']"


@query(
    "keyword_conformance",
    with_ctes("digests")
    + f""" SELECT id, len(keywords) AS n_keywords, len(list_filter(keywords, lambda k: list_contains({VOCABULARY_SQL}, k))) AS n_known,
        array_to_string(list_sort(list_filter(keywords, lambda k: NOT list_contains({VOCABULARY_SQL}, k))), ',') AS new_keywords,
        len(keywords) <= 2 AS within_limit FROM digests""",
)
def keyword_conformance(b: Bound) -> DataFrame:
    return quality.keyword_conformance(b.digests, VOCABULARY, limit=2).withColumn("new_keywords", F.array_join("new_keywords", ","))


SUMMARY_FIELDS_SQL = """{'institution': institution, 'reasoning_step': 'r', 'problem_background': problem_background, 'method': method, 'experiment': experiment,
    'one_sentence_summary': one_sentence_summary, 'slug': slug, 'keywords': keywords, 'further_thoughts': further_thoughts}"""


def summary_payload(b: Bound) -> DataFrame:
    """Summary JSON per document: broken text for some sources, an object or a missing field for some languages."""
    fields = {
        "institution": F.col("institution"),
        "reasoning_step": F.lit("r"),
        "problem_background": F.col("problem_background"),
        "method": F.col("method"),
        "experiment": F.col("experiment"),
        "one_sentence_summary": F.col("one_sentence_summary"),
        "slug": F.col("slug"),
        "keywords": F.col("keywords"),
        "further_thoughts": F.col("further_thoughts"),
    }
    nested = {**fields, "method": F.struct(F.col("method").alias("core"))}
    short = {k: v for k, v in fields.items() if k not in ("slug", "experiment")}

    def text(of: dict) -> Column:
        return F.to_json(F.struct(*[v.alias(k) for k, v in of.items()]))

    payload = F.when(F.col("lang") == "de", text(nested)).when(F.col("lang") == "es", text(short)).otherwise(text(fields))
    source = F.substring_index("slug", "-", 1)
    cut = F.when(source == "src5", F.substr(payload, F.lit(1), F.length(payload) - 1)).otherwise(payload)
    return b.digests.select("doc_id", "id", cut.alias("payload"), source.alias("source"))


@query(
    "summary_conformance",
    with_ctes("digests")
    + """ SELECT id, CASE WHEN slug LIKE 'src5-%' THEN 'malformed' WHEN lang = 'de' THEN 'method' WHEN lang = 'es' THEN 'experiment,slug' ELSE '' END AS defects,
        CASE WHEN slug NOT LIKE 'src5-%' AND lang NOT IN ('de', 'es') THEN md5(problem_background) END AS body_md5,
        CASE WHEN slug NOT LIKE 'src5-%' AND lang NOT IN ('de', 'es') THEN array_to_string(keywords, ',') END AS keywords FROM digests""",
)
def summary_conformance(b: Bound) -> DataFrame:
    good, bad = quality.summary_conformance(summary_payload(b))
    return good.select(
        "id", F.lit("").alias("defects"), F.md5("problem_background").alias("body_md5"), F.array_join("keywords", ",").alias("keywords")
    ).unionByName(bad.select("id", F.array_join("defects", ",").alias("defects")), allowMissingColumns=True)
