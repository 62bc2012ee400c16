"""Search over the whole texts of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from folioflow.operators import search
from folioflow.plans.bindings import Bound, with_ctes
from folioflow.plans.registry import query
from folioflow.session import scratch_path

QUERY_TERMS = ("the", "eau", "und", "los", "their")

# The terms are added in the given order, so equal pages get equal sums.
SCORE_SQL = " + ".join(f"coalesce(sum(tf * idf) FILTER (term = '{t}'), 0)" for t in QUERY_TERMS)

INDEX_SQL = (
    with_ctes("docs")
    + r""", idx AS (SELECT term, id, count(*) AS tf FROM (SELECT id, unnest(regexp_split_to_array(lower(text), '\s+')) AS term FROM docs) WHERE term <> '' GROUP BY term, id)"""
)


def page_bodies(b: Bound) -> DataFrame:
    return b.spread_documents.select("id", "text")


@query("inverted_index", INDEX_SQL + " SELECT term, id, tf FROM idx")
def inverted_index(b: Bound) -> DataFrame:
    return search.inverted_index(page_bodies(b))


@query(
    "keyword_search",
    INDEX_SQL
    + f""", hits AS (SELECT * FROM idx WHERE term IN {QUERY_TERMS}),
    idf AS (SELECT term, ln((SELECT count(*) FROM docs)::DOUBLE / count(*)) AS idf FROM hits GROUP BY term),
    rated AS (SELECT id, {SCORE_SQL} AS score, count(*) AS matched FROM hits JOIN idf USING (term) GROUP BY id)
    SELECT id, round(score, 6) AS score, matched FROM rated ORDER BY score DESC, id LIMIT 20""",
)
def keyword_search(b: Bound) -> DataFrame:
    """Builds the index, then searches it."""
    index = scratch_path(b.spark, "postings")
    search.write_index(page_bodies(b), index)
    return search.keyword_search(b.spark, index, QUERY_TERMS, 20).withColumn("score", F.round("score", 6))
