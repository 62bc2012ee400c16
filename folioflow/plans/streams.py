"""Streams over files that Spark writes from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from folioflow.plans.bindings import OWNER, Bound, with_ctes
from folioflow.plans.joining import NAMED_LABEL_SQL
from folioflow.plans.registry import query
from folioflow.session import materialise, scratch_path
from folioflow.streaming import ingest


@query(
    "stream_upsert_labels",
    with_ctes("reactions", "published_ids")
    + NAMED_LABEL_SQL
    + " SELECT id, preference FROM patch WHERE id IN (SELECT id FROM published_ids)",
)
def stream_upsert_labels(b: Bound) -> DataFrame:
    """An early state of every discussion, one per line and liked by the owner; the present state, a pretty-printed
    file per page; and a broken file."""
    source, log, state = (scratch_path(b.spark, name) for name in ("reactions", "label-log", "label-state"))
    nodes = "data.repository.discussions.nodes"
    liked = F.array(F.struct(F.lit("THUMBS_UP").alias("content"), F.struct(F.lit(OWNER).alias("login")).alias("user")))

    def pages(change) -> Column:
        changed = F.struct(F.transform(nodes, change).alias("nodes"))
        return F.struct(F.struct(F.struct(changed.alias("discussions")).alias("repository")).alias("data"))

    early = pages(lambda n: n.withField("updatedAt", F.lit("2024-01-01")).withField("reactions", F.struct(liked.alias("nodes"))))
    now = pages(lambda n: n.withField("updatedAt", F.lit("2024-06-01")))
    found = materialise(b.reaction_pages, "reaction-pages")
    found.select(F.to_json(early)).write.text(f"{source}/early.json")
    found.select(F.to_json(now, {"pretty": "true"})).write.option("maxRecordsPerFile", 1).text(f"{source}/now.json")
    found.limit(1).select(F.lit('{"data": {')).write.text(f"{source}/broken.json")
    return ingest.stream_upsert_labels(b.spark, source, b.published_ids, OWNER, log, state, files_per_batch=100)


# Text of one file of digests, about, beyond the fewest files.
FILE_BYTES, FEWEST_FILES = 256 << 20, 4


def digest_files(digests: DataFrame, file_bytes: int = FILE_BYTES) -> int:
    """Files to deal digests to, so that the task that writes one reads a bounded share of the texts."""
    held = digests.agg(F.sum(F.octet_length("problem_background"))).first()[0] or 0
    return max(FEWEST_FILES, -(-held // file_bytes))


@query(
    "stream_ingest_summaries",
    with_ctes("digests", "published")
    + """, fresh AS (SELECT id, 'new ' || title AS title, NULL::VARCHAR AS abstract, score, problem_background FROM digests WHERE lang <> 'de'),
    stored AS (SELECT id, title, 'kept ' || title AS abstract, score, problem_background FROM published)
    SELECT coalesce(f.id, s.id) AS id, coalesce(f.title, s.title) AS title, coalesce(f.abstract, s.abstract) AS abstract, coalesce(f.score, s.score) AS score,
        md5(coalesce(f.problem_background, s.problem_background)) AS body_md5 FROM fresh f FULL JOIN stored s ON f.id = s.id""",
)
def stream_ingest_summaries(b: Bound) -> DataFrame:
    """New digests of all but the German papers, merged over what is published."""
    source, log, state = (scratch_path(b.spark, name) for name in ("summaries", "digest-log", "digest-state"))
    fresh = b.digests.where("lang <> 'de'").withColumn("title", F.concat(F.lit("new "), "title")).drop("doc_id")
    fresh.repartition(digest_files(fresh), "id").write.json(f"{source}/digests.json")
    b.published.limit(1).select(F.lit('{"id": ')).write.text(f"{source}/broken.json")
    stored = b.published.withColumn("abstract", F.concat(F.lit("kept "), "title"))
    merged = ingest.stream_ingest_summaries(b.spark, source, stored, log, state, files_per_batch=2)
    return merged.select("id", "title", "abstract", "score", F.md5("problem_background").alias("body_md5"))
