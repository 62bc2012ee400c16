"""Column functions over whole tables and whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from folioflow.functions import posts as P
from folioflow.functions import text as T
from folioflow.plans.bindings import SETTINGS, Bound, with_ctes
from folioflow.plans.grouping import SLUG_SQL
from folioflow.plans.predicates import summary_payload
from folioflow.plans.registry import query
from folioflow.plans.scans import INSTRUCTION, page_sql


@query("slugify", with_ctes("docs") + f" SELECT id, {SLUG_SQL.format('text')} AS slug FROM docs")
def slugify(b: Bound) -> DataFrame:
    """Whole texts in lower case: the SQL side cannot split at case borders."""
    return b.spread_documents.select("id", T.slugify(F.lower("text")).alias("slug"))


@query(
    "post_path",
    with_ctes("posts")
    + """ SELECT id, '/posts/' || CASE lang WHEN 'en' THEN 'src-' || substr(source, 4) || '/paper-notes/' ELSE '' END || id AS path,
        CASE lang WHEN 'en' THEN '/src-' || substr(source, 4) || '/paper-notes/' ELSE '/' END || id AS bare_path FROM posts""",
)
def post_path(b: Bound) -> DataFrame:
    nested = F.concat_ws("/", "preference", "id")
    return b.posts.select(
        "id",
        T.post_path(nested, F.col("file_path"), "../content").alias("path"),
        T.post_path(F.col("id"), F.col("file_path"), "../content", include_base=False).alias("bare_path"),
    )


@query(
    "paper_url",
    with_ctes("docs")
    + " SELECT id, 'https://arxiv.org/abs/' || id AS abs, 'https://arxiv.org/pdf/' || id AS pdf, 'https://arxiv.org/e-print/' || id AS source FROM docs",
)
def paper_url(b: Bound) -> DataFrame:
    return b.documents.select("id", *[T.paper_url(F.col("id"), kind).alias(kind) for kind in T.PAPER_URLS])


@query(
    "strip_references",
    with_ctes("docs")
    + """ SELECT id, md5(body) AS body_md5, length(body) AS body_length
    FROM (SELECT id, text || CASE lang WHEN 'en' THEN chr(10) WHEN 'fr' THEN '' ELSE ' # Referenz' || text END AS body FROM docs)""",
)
def strip_references(b: Bound) -> DataFrame:
    """English papers end in one reference list, French ones in two, others in none."""
    tail = (
        F.when(F.col("lang") == "en", "\n# References\n[1] A book.")
        .when(F.col("lang") == "fr", "# Reference\n[1] Un livre.\n# Reference\n[2] Un autre.")
        .otherwise(F.concat(F.lit(" # Referenz"), F.col("text")))
    )
    body = T.strip_references(F.concat("text", tail))
    return b.spread_documents.select("id", F.md5(body).alias("body_md5"), F.length(body).cast("bigint").alias("body_length"))


@query("count_tokens", with_ctes("docs") + r" SELECT id, len(regexp_extract_all(text, '\S+'))::BIGINT AS tokens FROM docs")
def count_tokens(b: Bound) -> DataFrame:
    return b.spread_documents.select("id", T.count_tokens(F.col("text")).alias("tokens"))


TOKEN_LIMIT = 200


@query(
    "truncate_middle",
    with_ctes("docs")
    + rf""", t AS (SELECT id, text, regexp_extract_all(text, '(?:^\s+)?\S+\s*') AS tokens FROM docs)
    SELECT id, CASE WHEN len(tokens) <= {TOKEN_LIMIT} THEN text ELSE array_to_string(tokens[1:80], '') || chr(10) || chr(10)
        || '[...content too long, middle part omitted...]' || chr(10) || chr(10) || array_to_string(tokens[len(tokens) - 59:], '') END AS text FROM t""",
)
def truncate_middle(b: Bound) -> DataFrame:
    return b.spread_documents.select("id", T.truncate_middle(F.col("text"), TOKEN_LIMIT).alias("text"))


@query(
    "list_join",
    with_ctes("posts")
    + " SELECT id, array_to_string(CASE WHEN draft THEN NULL WHEN featured THEN [] ELSE tags END, chr(31)) AS joined FROM posts",
)
def list_join(b: Bound) -> DataFrame:
    lists = F.when(F.col("draft"), None).when(F.col("featured"), F.array().cast("array<string>")).otherwise(F.col("tags"))
    return b.posts.select("id", T.list_join(lists).alias("joined"))


@query(
    "list_split",
    with_ctes("docs")
    + """, parts AS (SELECT id, string_split(text, chr(10)) AS parts FROM docs)
    SELECT id, len(parts) AS n, md5(parts[1]) AS first_md5, md5(parts[len(parts)]) AS last_md5 FROM parts""",
)
def list_split(b: Bound) -> DataFrame:
    """Lines of each text, joined with the separator and split again."""
    lines = T.list_split(T.list_join(F.split("text", "\n")))
    return b.documents.select(
        "id",
        F.size(lines).cast("bigint").alias("n"),
        F.md5(F.get(lines, F.lit(0))).alias("first_md5"),
        F.md5(F.element_at(lines, -1)).alias("last_md5"),
    )


@query(
    "float_text",
    with_ctes("posts")
    + " SELECT id, round(score, 6)::DECIMAL(18,6)::VARCHAR AS text, round(score, 6)::DECIMAL(18,6)::VARCHAR::DOUBLE AS value FROM posts",
)
def float_text(b: Bound) -> DataFrame:
    text = T.float_text(F.col("score"))
    return b.posts.select("id", text.alias("text"), text.cast("double").alias("value"))


@query("front_matter", with_ctes("digests") + ", pages_ AS (" + page_sql("digests") + ") SELECT id, header FROM pages_")
def front_matter(b: Bound) -> DataFrame:
    return b.digests.select("id", T.front_matter().alias("header"))


@query("render_page", with_ctes("digests") + ", pages_ AS (" + page_sql("digests") + ") SELECT id, md5(page) AS page_md5, length(page) AS page_length FROM pages_")
def render_page(b: Bound) -> DataFrame:
    page = T.render_page()
    return b.digests.select("id", F.md5(page).alias("page_md5"), F.length(page).cast("bigint").alias("page_length"))


@query(
    "build_prompt_request",
    with_ctes("docs")
    + f""" SELECT id, 'user' AS role, md5('{INSTRUCTION}' || chr(10) || chr(10) || 'The content of the paper is as follows:' || chr(10) || chr(10) || chr(10) || text) AS text_md5,
        0.1::DOUBLE AS temperature, 0.8::DOUBLE AS top_p, 'application/json' AS mime FROM docs""",
)
def build_prompt_request(b: Bound) -> DataFrame:
    request = T.build_prompt_request(F.col("text"), INSTRUCTION, SETTINGS.temperature, SETTINGS.top_p)
    r = b.documents.select("id", request.alias("r"))
    return r.select(
        "id",
        F.col("r.contents")[0]["role"].alias("role"),
        F.md5(F.col("r.contents")[0]["parts"][0]["text"]).alias("text_md5"),
        F.col("r.config.temperature").alias("temperature"),
        F.col("r.config.top_p").alias("top_p"),
        F.col("r.config.response_mime_type").alias("mime"),
    )


@query(
    "parse_summary",
    with_ctes("digests")
    + """ SELECT id, NOT slug LIKE 'src5-%' AS parsed, CASE WHEN slug NOT LIKE 'src5-%' AND lang <> 'es' THEN slug END AS slug,
        CASE WHEN slug NOT LIKE 'src5-%' THEN array_to_string(keywords, ',') END AS keywords,
        CASE WHEN slug NOT LIKE 'src5-%' THEN md5(problem_background) END AS body_md5 FROM digests""",
)
def parse_summary(b: Bound) -> DataFrame:
    s = summary_payload(b).select("id", T.parse_summary(F.col("payload")).alias("s"))
    parsed = F.col("s._corrupt_record").isNull()
    return s.select(
        "id",
        parsed.alias("parsed"),
        F.when(parsed, F.col("s.slug")).alias("slug"),
        F.when(parsed, F.array_join("s.keywords", ",")).alias("keywords"),
        F.when(parsed, F.md5("s.problem_background")).alias("body_md5"),
    )


@query(
    "preference_symbol",
    with_ctes("posts")
    + " SELECT id, CASE preference WHEN 'like' THEN '👍' WHEN 'dislike' THEN '👎' WHEN 'neutral' THEN '😐' WHEN 'unknown' THEN '🤔' ELSE '' END AS symbol FROM posts",
)
def preference_symbol(b: Bound) -> DataFrame:
    return b.posts.select("id", P.preference_symbol(F.col("preference")).alias("symbol"))


@query(
    "score_band",
    with_ctes("posts")
    + " SELECT id, CASE WHEN score IS NULL THEN '' WHEN score * 2 - 0.5 < 0.3 THEN 'low' WHEN score * 2 - 0.5 < 0.7 THEN 'medium' ELSE 'high' END AS band FROM posts",
)
def score_band(b: Bound) -> DataFrame:
    return b.posts.select("id", P.score_band(F.col("score") * 2 - 0.5).alias("band"))


@query("score_percent", with_ctes("posts") + " SELECT id, CASE WHEN score IS NOT NULL THEN printf('%.2f', score * 100.0::DOUBLE) END AS percent FROM posts")
def score_percent(b: Bound) -> DataFrame:
    return b.posts.select("id", P.score_percent(F.col("score")).alias("percent"))


@query(
    "display_time",
    with_ctes("posts")
    + """ SELECT id, strftime(greatest(pub, mod) + INTERVAL 8 HOUR, '%-d %b, %Y') AS day, strftime(greatest(pub, mod) + INTERVAL 8 HOUR, '%I:%M %p') AS clock FROM posts""",
)
def display_time(b: Bound) -> DataFrame:
    return b.posts.select("id", P.display_date(SETTINGS.zone).alias("day"), P.display_clock(SETTINGS.zone).alias("clock"))


@query("month_key", with_ctes("posts") + " SELECT id, strftime(pub, '%Y-%m') AS month FROM posts")
def month_key(b: Bound) -> DataFrame:
    return b.posts.select("id", P.month_key(F.col("pub")).alias("month"))


@query(
    "clean_equation",
    with_ctes("docs")
    + r""", e AS (SELECT id, lang, '\frac[x]{a}{b}' || replace(text, chr(10), ' ') || ' $$y$ \f{x}' AS body FROM docs),
    c AS (SELECT id, lang, trim(body) AS kept, replace(regexp_replace(trim(body), '\\[a-zA-Z]+\[.*?\]\{.*?\}\{.*?\}', '', 'g'), '$', '') AS cleaned FROM e)
    SELECT id, CASE WHEN lang = 'en' THEN '$$ ' || cleaned || ' $$' || chr(10) ELSE '$' || cleaned || '$' END AS cleaned,
        md5(CASE WHEN lang = 'en' THEN '$$ ' || kept || ' $$' || chr(10) ELSE '$' || kept || '$' END) AS kept_md5 FROM c""",
)
def clean_equation(b: Bound) -> DataFrame:
    body = F.concat(F.lit(r"\frac[x]{a}{b}"), F.replace("text", F.lit("\n"), F.lit(" ")), F.lit(r" $$y$ \f{x}"))
    block = F.col("lang") == "en"
    return b.spread_documents.select(
        "id",
        T.clean_equation(body, block, clean=True).alias("cleaned"),
        F.md5(T.clean_equation(body, block)).alias("kept_md5"),
    )


@query(
    "style_text",
    with_ctes("docs")
    + """ SELECT id, md5(CASE WHEN lang IN ('en', 'fr') AND n_chars % 2 = 0 THEN '<b><i>' || text || '</i></b>' WHEN lang IN ('en', 'fr') THEN '<b>' || text || '</b>'
        WHEN n_chars % 2 = 0 THEN '<i>' || text || '</i>' ELSE text END) AS styled_md5 FROM docs""",
)
def style_text(b: Bound) -> DataFrame:
    styles = F.array_compact(
        F.array(F.when(F.col("lang").isin("en", "fr"), "bold"), F.when(F.col("n_chars") % 2 == 0, "italic"))
    )
    return b.documents.select("id", F.md5(T.style_text(F.col("text"), styles)).alias("styled_md5"))
