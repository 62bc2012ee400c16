"""Joins and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from folioflow.functions import text as T
from folioflow.functions.hashing import uniform
from folioflow.operators import aggregates, joins, knn, ranking, search
from folioflow.plans.bindings import (
    MODEL,
    OWNER,
    SETTINGS,
    Bound,
    sql_open_uniform,
    sql_uniform,
    with_ctes,
)
from folioflow.plans.registry import query


def quota_sql(rate: float) -> str:
    """``WITH`` clause whose ``flagged`` holds the scored papers with their ``show`` flag."""
    high, boundary, tag = SETTINGS.high_threshold, SETTINGS.boundary_threshold, f"{SETTINGS.seed}:quota"
    weight = f"exp(2.0 * (score - {boundary}) / {high - boundary!r})"
    return (
        with_ctes("scored", "docs")
        + f""", placed AS (SELECT *, CASE WHEN score >= {high} THEN 0 WHEN score >= {boundary} THEN 1 ELSE 2 END AS tier FROM scored),
        keyed AS (SELECT *, CASE WHEN tier = 1 THEN -ln({sql_open_uniform(tag, 'id')}) / {weight} ELSE {sql_uniform(tag, 'id')} END AS key FROM placed),
        numbered AS (SELECT *, row_number() OVER (ORDER BY tier, key, id) AS place, count(*) OVER () AS n FROM keyed),
        flagged AS (SELECT id, title, updated, score, tier, CASE WHEN place <= greatest(1, floor(n * {rate}::DOUBLE)) THEN 1 ELSE 0 END AS "show" FROM numbered)"""
    )


@query(
    "split_labelled",
    with_ctes("docs", "label_rows")
    + " SELECT id, CASE WHEN id IN (SELECT id FROM label_rows) THEN 'labelled' ELSE 'unlabelled' END AS side FROM docs",
)
def split_labelled(b: Bound) -> DataFrame:
    known, rest = joins.split_labelled(b.documents.select("id"), b.labels)
    return known.withColumn("side", F.lit("labelled")).unionByName(rest.withColumn("side", F.lit("unlabelled")))


@query(
    "labelled_join",
    with_ctes("docs", "label_rows") + " SELECT d.id, d.title, l.preference FROM docs d JOIN label_rows l ON d.id = l.id",
)
def labelled_join(b: Bound) -> DataFrame:
    return joins.labelled_join(b.documents, b.labels).select("id", "title", "preference")


@query(
    "remove_published",
    with_ctes("docs", "published_ids") + " SELECT id, title FROM docs WHERE id NOT IN (SELECT id FROM published_ids)",
)
def remove_published(b: Bound) -> DataFrame:
    return joins.remove_published(b.documents, b.published_ids).select("id", "title")


@query(
    "pending_work",
    with_ctes("docs", "label_rows")
    + """ SELECT d.id, CASE WHEN l.id IS NULL THEN 'pending' WHEN l.preference <> 'dislike' THEN 'skipped' ELSE 'failed' END AS status
    FROM docs d LEFT JOIN label_rows l ON d.id = l.id""",
)
def pending_work(b: Bound) -> DataFrame:
    finished = b.labels.select("id", (F.col("preference") != "dislike").alias("ok"))
    return joins.pending_work(b.documents, finished)


@query(
    "enrich_metadata",
    with_ctes("published", "docs")
    + f""", preds AS (SELECT id, arg_max({{'score': score, 'title': title, 'abstract': abstract, 'categories': categories, 'updated': updated}}, step) AS n
        FROM (SELECT id, 0 AS step, 0.5::DOUBLE AS score, 'old' AS title, 'old' AS abstract, ['old'] AS categories, 'old' AS updated FROM docs WHERE lang = 'en'
            UNION ALL SELECT id, 1, {sql_uniform('p', 'doc_id')}, title, CASE WHEN source <> 'src4' THEN text END, ['cs.' || upper(lang)], updated FROM docs WHERE lang IN ('en', 'fr'))
        GROUP BY id)
    SELECT p.id, p.preference, n.id IS NOT NULL AS enriched, round(CASE WHEN n.id IS NOT NULL THEN n.n.score ELSE p.score END, 6) AS score,
        CASE WHEN n.id IS NOT NULL THEN n.n.title ELSE p.title END AS title,
        md5(CASE WHEN n.id IS NOT NULL THEN n.n.abstract ELSE p.abstract END) AS abstract_md5,
        array_to_string(CASE WHEN n.id IS NOT NULL THEN n.n.categories ELSE p.categories END, ',') AS categories,
        CASE WHEN n.id IS NOT NULL THEN n.n.updated ELSE p.updated END AS updated
    FROM published p LEFT JOIN preds n ON p.id = n.id""",
)
def enrich_metadata(b: Bound) -> DataFrame:
    """Predictions of two runs; the later one wins and may hold nulls."""
    docs = b.documents
    old = docs.where("lang = 'en'").select(
        "id",
        F.lit(0).alias("step"),
        F.lit(0.5).alias("score"),
        *[F.lit("old").alias(c) for c in ("title", "abstract", "created", "updated")],
        F.array(F.lit("old")).alias("authors"),
        F.array(F.lit("old")).alias("categories"),
    )
    new = docs.where(F.col("lang").isin("en", "fr")).select(
        "id",
        F.lit(1).alias("step"),
        uniform("p", "doc_id").alias("score"),
        "title",
        F.when(F.col("source") != "src4", F.col("text")).alias("abstract"),
        "created",
        "updated",
        F.array(F.lit("new")).alias("authors"),
        F.array(F.concat(F.lit("cs."), F.upper("lang"))).alias("categories"),
    )
    return joins.enrich_metadata(b.published, old.unionByName(new), order=F.col("step")).select(
        "id",
        "preference",
        "enriched",
        F.round("score", 6).alias("score"),
        "title",
        F.md5("abstract").alias("abstract_md5"),
        F.array_join("categories", ",").alias("categories"),
        "updated",
    )


RANK_SQL = "CASE content WHEN 'THUMBS_UP' THEN 0 WHEN 'HEART' THEN 0 WHEN 'THUMBS_DOWN' THEN 1 WHEN 'EYES' THEN 2 ELSE 3 END"
REACTION_LABEL_SQL = f""", patch AS (SELECT id, ['like', 'dislike', 'neutral', 'unknown'][1 + min({RANK_SQL})] AS preference
    FROM reactions WHERE login = '{OWNER}' GROUP BY id)"""


# Labels from discussions whose title names a paper.
NAMED_LABEL_SQL = REACTION_LABEL_SQL.replace("WHERE login", "WHERE user_id % 7 <> 0 AND login")


@query("reaction_to_label", with_ctes("reactions") + REACTION_LABEL_SQL + " SELECT id, preference FROM patch")
def reaction_to_label(b: Bound) -> DataFrame:
    return aggregates.reaction_to_label(b.reactions, OWNER)


@query(
    "patch_labels",
    with_ctes("published", "reactions")
    + NAMED_LABEL_SQL
    + " SELECT p.id, p.title, coalesce(n.preference, p.preference) AS preference FROM published p LEFT JOIN patch n ON p.id = n.id",
)
def patch_labels(b: Bound) -> DataFrame:
    patch = joins.labels_from_discussions(b.reactions, b.published_ids, OWNER)
    return joins.patch_labels(b.published, patch).select("id", "title", "preference")


@query(
    "merge_tables",
    with_ctes("digests", "published")
    + """, mine AS (SELECT id, CASE WHEN lang <> 'fr' THEN title END AS title, 0.25::DOUBLE AS score, lang || '.json' AS source_file FROM digests WHERE lang <> 'de')
    SELECT coalesce(l.id, r.id) AS id, coalesce(l.title, r.title) AS title, coalesce(l.score, r.score) AS score, l.source_file, r.slug, md5(r.problem_background) AS body_md5
    FROM mine l FULL JOIN published r ON l.id = r.id""",
)
def merge_tables(b: Bound) -> DataFrame:
    mine = b.digests.where("lang <> 'de'").select(
        "id",
        F.when(F.col("lang") != "fr", F.col("title")).alias("title"),
        F.lit(0.25).alias("score"),
        F.concat("lang", F.lit(".json")).alias("source_file"),
    )
    return joins.merge_tables(mine, b.published).select(
        "id", "title", "score", "source_file", "slug", F.md5("problem_background").alias("body_md5")
    )


@query(
    "correlate_responses",
    with_ctes("digests")
    + f""" SELECT doc_id AS idx, CASE WHEN lang = 'fr' THEN 'unknown_' || doc_id::VARCHAR ELSE id END AS id,
        CASE WHEN slug LIKE 'src7-%' THEN 'error' WHEN slug LIKE 'src5-%' THEN 'malformed' END AS reason,
        CASE WHEN slug NOT LIKE 'src5-%' AND slug NOT LIKE 'src7-%' THEN md5(problem_background) END AS body_md5,
        CASE WHEN slug NOT LIKE 'src5-%' AND slug NOT LIKE 'src7-%' THEN '{MODEL}|en|unknown|2024-12-31' END AS facts FROM digests""",
)
def correlate_responses(b: Bound) -> DataFrame:
    """Responses for all documents; French ones were never asked for, some hold an error or cut text."""
    fields = [c for c in T.SUMMARY_FIELDS if c != "reasoning_step"]
    payload = F.to_json(F.struct(F.lit("r").alias("reasoning_step"), *fields))
    source = F.substring_index("slug", "-", 1)
    payload = F.when(source == "src5", F.substr(payload, F.lit(1), F.length(payload) - 1)).otherwise(payload)
    part = F.struct(F.array(F.struct(F.struct(F.array(F.struct(payload.alias("text"))).alias("parts")).alias("content"))).alias("candidates"))
    line = F.when(source == "src7", F.lit('{"error": {"code": 500}}')).otherwise(F.to_json(F.struct(part.alias("response"))))
    responses = b.digests.select(F.col("doc_id").alias("idx"), line.alias("line"))
    requests = b.digests.where("lang <> 'fr'").select(F.col("doc_id").alias("idx"), "id")
    good, bad = joins.correlate_responses(responses, requests, MODEL, "en", "2024-12-31")
    facts = F.concat_ws("|", "model", "lang", "preference", "summary_time")
    return good.select(
        "idx", "id", F.lit(None).cast("string").alias("reason"), F.md5("problem_background").alias("body_md5"), facts.alias("facts")
    ).unionByName(bad, allowMissingColumns=True)


EXTRACTED_SQL = """, extracted AS (SELECT id, text, CASE WHEN doc_id % 3 = 0 THEN 'cached' WHEN doc_id % 2 = 0 THEN 'latex' WHEN doc_id % 5 <> 0 THEN 'pdf' ELSE 'failed' END AS method FROM docs)"""


@query(
    "extraction_fallback",
    with_ctes("docs") + EXTRACTED_SQL + " SELECT id, method, CASE WHEN method <> 'failed' THEN md5(text) END AS text_md5 FROM extracted",
)
def extraction_fallback(b: Bound) -> DataFrame:
    return joins.extraction_fallback(b.documents, *b.extracted).select("id", "method", F.md5("text").alias("text_md5"))


@query(
    "extraction_fallback_pdf",
    with_ctes("docs")
    + """ SELECT id, CASE WHEN doc_id % 3 = 0 THEN 'cached' WHEN doc_id % 5 <> 0 THEN 'pdf' ELSE 'failed' END AS method,
        CASE WHEN doc_id % 3 = 0 OR doc_id % 5 <> 0 THEN md5(text) END AS text_md5 FROM docs""",
)
def extraction_fallback_pdf(b: Bound) -> DataFrame:
    """Latex sources are passed over."""
    return joins.extraction_fallback(b.documents, *b.extracted, force_pdf=True).select("id", "method", F.md5("text").alias("text_md5"))


@query(
    "failed_ids",
    with_ctes("docs") + EXTRACTED_SQL + " SELECT id FROM extracted WHERE method = 'failed'",
)
def failed_ids(b: Bound) -> DataFrame:
    found = joins.extraction_fallback(b.documents, *b.extracted).where("method <> 'failed'")
    return joins.failed_ids(b.documents, found)


@query(
    "extraction_stats",
    with_ctes("docs")
    + EXTRACTED_SQL
    + """ SELECT method, count(*) AS papers, round((SELECT count(*) FILTER (method <> 'failed') * 100.0::DOUBLE / count(*) FROM extracted), 1) AS extraction_rate
    FROM extracted GROUP BY method""",
)
def extraction_stats(b: Bound) -> DataFrame:
    return aggregates.extraction_stats(joins.extraction_fallback(b.documents, *b.extracted))


@query(
    "knn_join",
    with_ctes("positives", "background")
    + """, pairs AS (SELECT q.id AS q_id, b.id AS id, list_distance(q.vector, b.vector) AS dist FROM positives q, background b)
    SELECT q_id, id, round(dist, 6) AS dist, rank FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY dist, id) AS rank FROM pairs) WHERE rank <= 5""",
)
def knn_join(b: Bound) -> DataFrame:
    near = knn.knn_join(b.positives, b.background, SETTINGS.difficulty_neighbors)
    return near.withColumn("dist", F.round("dist", 6))


KNN_CELLS_SQL = (
    with_ctes("positives", "background")
    + """, pairs AS (SELECT q.id AS q_id, b.id AS id, list_distance(q.vector, b.vector) AS dist FROM background q, positives b)
    SELECT q_id, id, round(dist, 6) AS dist, rank FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY dist, id) AS rank FROM pairs) WHERE rank <= 5"""
)


@query("knn_join_cells", KNN_CELLS_SQL)
def knn_join_cells(b: Bound) -> DataFrame:
    """The plan for query sets too large to send to every task, where cells rule out much of the base."""
    near = knn.knn_join(b.background, b.positives, SETTINGS.difficulty_neighbors, broadcast_bytes=0, cells_below=2)
    return near.withColumn("dist", F.round("dist", 6))


@query("knn_join_blocks", KNN_CELLS_SQL)
def knn_join_blocks(b: Bound) -> DataFrame:
    """The plan for query sets too large to send to every task, where cells do not help."""
    near = knn.knn_join(b.background, b.positives, SETTINGS.difficulty_neighbors, broadcast_bytes=0, cells_below=0)
    return near.withColumn("dist", F.round("dist", 6))


COSINE_SQL = (
    with_ctes("papers")
    + """, v AS (SELECT id, v2::DOUBLE[] AS vector FROM papers WHERE v2 IS NOT NULL),
    pairs AS (SELECT q.id AS q_id, b.id AS id, list_cosine_distance(q.vector, b.vector) AS dist FROM v q, v b WHERE q.id <> b.id),
    near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY dist, id) AS rank FROM pairs) WHERE rank <= 20)"""
)


def similar_papers(b: Bound) -> DataFrame:
    vectors = b.papers.where(F.col("v2").isNotNull()).select("id", F.col("v2").alias("vector"))
    return knn.cosine_topn(vectors, vectors, 20)


@query("cosine_topn", COSINE_SQL + " SELECT q_id, id, round(dist, 6) + 0.0 AS dist, rank FROM near")
def cosine_topn(b: Bound) -> DataFrame:
    return similar_papers(b).withColumn("dist", F.round("dist", 6) + F.lit(0.0))


TERMS_SQL = r"list_distinct(list_filter(regexp_split_to_array(lower(title || ' ' || abstract), '\s+'), lambda x: x <> ''))"


@query(
    "rescore_topn",
    COSINE_SQL
    + f""", words AS (SELECT id, {TERMS_SQL} AS tokens FROM papers WHERE v2 IS NOT NULL),
    common AS (SELECT n.q_id, n.id, len(list_intersect(a.tokens, b.tokens)) AS hits, len(a.tokens) AS na, len(b.tokens) AS nb
        FROM near n JOIN words a ON n.q_id = a.id JOIN words b ON n.id = b.id),
    rated AS (SELECT q_id, id, 1.0 / (1.0 + exp(-(hits::DOUBLE / (na + nb - hits)))) AS score FROM common)
    SELECT q_id, id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, id) AS rank FROM rated) WHERE rank <= 10""",
)
def rescore_topn(b: Bound) -> DataFrame:
    return search.rescore_topn(similar_papers(b), b.paper_texts, 10).withColumn("score", F.round("score", 6))


@query(
    "posts_by_tag",
    with_ctes("visible")
    + """ SELECT id, title, row_number() OVER (ORDER BY floor(epoch(shown_at)) DESC, id) AS rank FROM visible WHERE list_contains(tags, 'src7')""",
)
def posts_by_tag(b: Bound) -> DataFrame:
    return ranking.posts_by_tag(b.posts, "src-7", SETTINGS, "date_desc").select("id", "title", "rank")


@query(
    "stack_tables",
    with_ctes("label_rows", "reactions")
    + REACTION_LABEL_SQL
    + " SELECT id, preference FROM label_rows UNION ALL SELECT id, preference FROM patch",
)
def stack_tables(b: Bound) -> DataFrame:
    return joins.stack_tables(b.labels.select("id", "preference"), aggregates.reaction_to_label(b.reactions, OWNER))


@query(
    "schema_diff",
    """SELECT *, (SELECT count(*) FROM labels) AS local_rows, (SELECT count(*) FROM documents) AS remote_rows FROM (VALUES
        ('doc_id', 'common'), ('quality', 'local_only'), ('toxic', 'local_only'), ('text', 'remote_only'), ('lang', 'remote_only'),
        ('source', 'remote_only'), ('n_chars', 'remote_only')) AS t("column", side)""",
)
def schema_diff(b: Bound) -> DataFrame:
    return joins.schema_diff(b.table("labels"), b.table("documents"))
